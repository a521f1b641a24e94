"""Best-fit packing of token sequences with exact-complement hashing.

Only the counts of the lengths decide the plan, and lengths are at most the
capacity, so the plan is made on the driver from one row for each length
whatever the size of the corpus. Documents then find their places by their
rank among the documents of their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docbraid.llm.common import checked_broadcast, materialise, row_key, slices
from docbraid.llm.tokens import VOCABULARY, encoder

CAPACITY = 2048
#: One token is added to each document to end it.
END = 1
#: A rank is counted within so many rows or so; more documents make more salts.
ROWS_PER_SALT = 2_000_000


@dataclass
class Plan:
    """Kinds of bin: lengths of the pieces in it, and how many such bins there are."""

    kinds: list[tuple[tuple[int, ...], int]]
    exact: int = 0


def make_plan(counts: dict[int, int], capacity: int) -> Plan:
    """Packs counts[length] pieces of each length into bins of the capacity.

    Lengths are taken from the longest down. The gap that a length leaves is
    looked up among the sums of one, two and three lengths, in this order; a
    combination that fills it exactly is used as often as its lengths last. What
    is left over then goes, longest first, into the bin with the least sufficient gap.
    """
    have = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit")
        have[length] = n
    plan = Plan([])

    def use(kind: tuple[int, ...]) -> None:
        sizes, need = np.unique(kind, return_counts=True)
        times = int((have[sizes] // need).min())
        have[sizes] -= need * times
        plan.kinds.append((kind, times))
        plan.exact += times

    def pair(total: int, spent: tuple[int, ...]) -> tuple[int, int] | None:
        left = have
        if spent:
            left = have.copy()
            np.subtract.at(left, list(spent), 1)
        low = np.arange(1, total // 2 + 1)
        good = (left[low] > 0) & (left[total - low] > 0)
        if total % 2 == 0 and len(low) and left[total // 2] < 2:
            good[-1] = False
        at = np.flatnonzero(good)
        return (total - int(low[at[0]]), int(low[at[0]])) if len(at) else None

    def sums() -> tuple[np.ndarray, np.ndarray]:
        """Which sums two and three of the available lengths reach: the index, by sum."""
        there = (have > 0).astype(float)
        size = 1 << (3 * capacity + 1).bit_length()
        f = np.fft.rfft(there, size)
        two = np.fft.irfft(f * f, size)[: capacity + 1] > 0.5
        three = np.fft.irfft(f * np.fft.rfft(two.astype(float), size), size)[: capacity + 1] > 0.5
        return two, three

    two, three = sums()
    for first in range(capacity, 0, -1):
        if have[first] <= 0:
            continue
        gap = capacity - first
        if gap == 0:
            use((first,))
            continue
        while have[first] > (gap == first) and have[gap] > 0:
            use((first, gap))
        while have[first] > 0 and two[gap] and (found := pair(gap, (first,))):
            use((first, *found))
        while have[first] > 0 and three[gap]:
            for second in np.flatnonzero((have[1:gap] > 0) & two[gap - 1 : 0 : -1])[::-1] + 1:
                left = have[second] - (second == first)
                if left > 0 and (found := pair(gap - int(second), (first, int(second)))):
                    use((first, int(second), *found))
                    break
            else:
                break
    # Best fit of the rest: bins of equal content are one kind; gaps[g] has the kinds with gap g.
    gaps: dict[int, list[list]] = {}
    for length in range(capacity, 0, -1):
        n = int(have[length])
        while n:
            gap = next((g for g in sorted(gaps) if g >= length and gaps[g]), None)
            if gap is None:
                room = capacity // length
                full, rest = divmod(n, room)
                if full:
                    gaps.setdefault(capacity - room * length, []).append([(length,) * room, full])
                if rest:
                    gaps.setdefault(capacity - rest * length, []).append([(length,) * rest, 1])
                n = 0
            else:
                kind, times = gaps[gap].pop()
                room = gap // length
                if n >= room:
                    filled = min(times, n // room)
                    gaps.setdefault(gap - room * length, []).append([kind + (length,) * room, filled])
                else:
                    filled, room = 1, n
                    gaps.setdefault(gap - room * length, []).append([kind + (length,) * room, 1])
                n -= filled * room
                if times > filled:
                    gaps.setdefault(gap, []).append([kind, times - filled])
    plan.kinds += [(kind, times) for kinds in gaps.values() for kind, times in kinds]
    return plan


def _intervals(plan: Plan) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, bin of the first, slot)."""
    used: dict[int, int] = {}
    out, base = [], 0
    for kind, times in plan.kinds:
        for slot, length in enumerate(kind):
            low = used.get(length, 0)
            out.append((length, low, low + times, base, slot))
            used[length] = low + times
        base += times
    return out


def token_type(vocabulary: str) -> str:
    """The least little-endian unsigned type that holds every id of a vocabulary and the end token's."""
    return "<u2" if encoder(vocabulary).encoding.max_token_value + 1 < 1 << 16 else "<u4"


def _pieces(docs: DataFrame, doc_id: str, text: str, vocabulary: str, capacity: int, kind_of_id: str) -> DataFrame:
    """(doc_id, k1, k2, start, length, tokens): every document with its end token, cut at the capacity."""
    k1, k2 = row_key(F.col(doc_id), F.col(text))
    rows = docs.select(F.col(doc_id).alias("doc_id"), k1.alias("k1"), k2.alias("k2"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        ender = e.encoding.max_token_value + 1
        for batch in batches:
            at = 0
            for part in slices(batch.column("text"), 1 << 20, 1 << 16):
                ids, ends = e.encode(part)
                n = len(part)
                sizes = np.diff(ends) + END
                stream = np.full(int(sizes.sum()), ender, kind_of_id)
                low = np.cumsum(sizes) - sizes
                own = np.ones(len(stream), bool)
                own[low + sizes - END] = False
                stream[own] = ids
                cuts = -(-sizes // capacity)
                doc = np.repeat(np.arange(n), cuts)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * capacity
                length = np.minimum(capacity, sizes[doc] - start)
                offsets = pa.py_buffer((stream.itemsize * np.append(low[doc] + start, len(stream))).astype(np.int32))
                tokens = pa.Array.from_buffers(pa.binary(), len(doc), [None, offsets, pa.py_buffer(stream.tobytes())])
                held = [batch.column(c).slice(at, n).take(pa.array(doc)) for c in ("doc_id", "k1", "k2")]
                at += n
                yield pa.RecordBatch.from_arrays([*held, pa.array(start), pa.array(length), tokens], ["doc_id", "k1", "k2", "start", "length", "tokens"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, k1 long, k2 long, start long, length long, tokens binary")


def _ranked(pieces: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Adds rank: the number of pieces of the same length before a piece, in the order of k1, k2 and start.

    A length of many pieces is sorted in ranges of k1, as many as its own count
    asks for, so no task sorts more than ROWS_PER_SALT or so. The ranges follow
    the order of k1, so the rank doesn't depend on their number.
    """
    most = max(counts)
    salts = [max(1, -(-counts.get(n, 0) // ROWS_PER_SALT)) for n in range(most + 1)]
    if max(salts) == 1:
        return pieces.withColumn("rank", F.row_number().over(Window.partitionBy("length").orderBy("k1", "k2", "start")).cast("long") - 1)
    parts = F.element_at(F.lit(salts), F.col("length").cast("int") + 1)
    salted = pieces.withColumn("salt", F.floor((F.col("k1") / F.lit(2.0**64) + 0.5) * parts).cast("long"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("k1", "k2", "start")).cast("long") - 1)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    return ranked.join(checked_broadcast(offsets, 24), ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """(bin_id, used, doc_ids, starts, lengths, token_bytes, tokens): one row for each sequence of at most capacity tokens.

    tokens holds the ids of the whole sequence, little-endian, token_bytes bytes
    each: two if the vocabulary allows it, else four. The piece that begins at token starts[i] of document doc_ids[i] is lengths[i] of
    them. A document is its tokens and an end token, whose id is the first after
    the vocabulary's; one longer than the capacity is cut into full windows and a
    rest, never shortened. Null and empty texts are a single end token. Every
    row of docs is packed, repeated ones as often as they occur; ids of any type
    keep it, a null id stays null. Pieces of equal length are interchangeable
    and ordered by a hash of (id, text), the hash of equal rows being equal.
    Other columns of docs play no part. An empty table gives an empty result.

    Pieces of the full capacity are bins of their own and pass straight from
    the scan; the tokens of the others are shuffled once to their ranks and once
    to their bins. bin_id is unique, not dense.
    """
    of_id = token_type(vocabulary)
    pieces = materialise(_pieces(docs, doc_id, text, vocabulary, capacity, of_id))
    wide = F.lit(np.dtype(of_id).itemsize).alias("token_bytes")
    full = F.col("length") == capacity
    counts = {r["length"]: r["n"] for r in pieces.filter(~full).groupBy("length").agg(F.count("*").alias("n")).collect()}  # one row a length: under capacity rows
    plan = make_plan(counts, capacity)
    own_bin = (F.monotonically_increasing_id() + sum(times for _, times in plan.kinds)).alias("bin_id")
    alone = pieces.filter(full).select(own_bin, F.col("length").alias("used"), F.array("doc_id").alias("doc_ids"), F.array("start").alias("starts"), F.array("length").alias("lengths"), wide, "tokens")
    if not counts:
        return alone
    places = _intervals(plan)
    # The places of all lengths, by length and rank: their number depends on the capacity, not on the corpus.
    big = max(counts.values()) + 1
    whole = np.array(sorted(places), np.int64)
    keys, low, base, slot = whole[:, 0] * big + whole[:, 1], whole[:, 1], whole[:, 3], whole[:, 4]

    @F.arrow_udf("struct<bin_id:long,slot:long>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        want = np.stack([length.to_numpy(), rank.to_numpy()])
        at = np.searchsorted(keys, want[0] * big + want[1], side="right") - 1
        return pa.StructArray.from_arrays([pa.array(base[at] + want[1] - low[at]), pa.array(slot[at])], ["bin_id", "slot"])

    placed = _ranked(pieces.filter(~full), counts).select("doc_id", "start", "length", "tokens", place("length", "rank").alias("p")).select("*", "p.*")
    members = F.array_sort(F.collect_list(F.struct("slot", "doc_id", "start", "length")))
    shared = placed.groupBy("bin_id").agg(F.sum("length").alias("used"), members.alias("m"), F.expr("listagg(tokens) WITHIN GROUP (ORDER BY slot)").alias("tokens"))
    mixed = shared.select("bin_id", "used", F.col("m.doc_id").alias("doc_ids"), F.col("m.start").alias("starts"), F.col("m.length").alias("lengths"), wide, "tokens")
    return alone.unionByName(mixed)
