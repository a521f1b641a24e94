"""Near-duplicate removal by SimHash, compared bit-sliced.

A text's signature has 128 bits, voted by its distinct word pairs. Two texts
are near duplicates if their signatures differ in at most RADIUS bits and
neither has more than 1 / MIN_RATIO times the other's pairs; groups are the
connected components of that relation, and one row of each group stays.

Search. Each of several tables groups signatures by a sample of their bits.
The number of sampled bits grows with the logarithm of the number of distinct
signatures, so that buckets keep their size, and the number of tables follows
from both, so that a pair at exactly RADIUS shares a bucket with probability
RECALL at least (closer pairs more). With few signatures there is one bucket and
the search is exact. A bucket of far more signatures than planned is cut into
parts, and each two parts are compared by a task of their own, so no pair of it
is lost. Inside a bucket all pairs are compared: signatures are
stored as bit planes, a word operation updates 64 distances, the planes are
added up by carry-save adders, and blocks of 64 are abandoned once all their
distances exceed the radius.

Equal signatures are merged before the search, and a bucket returns a spanning
forest of its pairs, so thousands of copies cost neither thousands of buckets'
rows nor millions of edges.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docbraid.llm import textkernel as tk
from docbraid.llm.common import fits, materialise, release, row_key, slices

BITS, RADIUS, MIN_RATIO, RECALL = 128, 26, 0.66, 0.9
#: Signatures that a bucket should hold.
BUCKET = 2048
#: Buckets over so many times that are compared in parts; they are found in a sample of one signature in SAMPLE.
HOT, SAMPLE = 8, 64
_SEED = 20240229
_WORD = np.uint64(0xFFFFFFFFFFFFFFFF)


@functools.cache
def _lanes() -> np.ndarray:
    """For each byte, its 8 bits as 8 one-byte counters in a word."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)
    return np.ascontiguousarray(bits).view(np.uint64)[:, 0]


def signatures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n, 16) signature bytes and the number of distinct word pairs of each text."""
    found, counts = [], []
    for part in slices(texts):
        n = len(part)
        words = tk.words(*tk.code_points(part))
        sizes = np.diff(words.offsets)
        with np.errstate(over="ignore"):
            last = np.zeros(len(words.hashes), bool)
            last[words.offsets[1:][sizes > 0] - 1] = True
            follow = np.append(words.hashes[1:], np.uint64(0)) if len(words.hashes) else words.hashes
            pair = tk.mix(words.hashes * np.uint64(1099511628211) + follow)
        use = ~last
        lone = words.offsets[:-1][sizes == 1]
        use[lone] = True
        pair[lone] = words.hashes[lone]
        keys = np.unique((pair[use] >> np.uint64(13)) | words.owner[use].astype(np.uint64) << np.uint64(51))
        owner = (keys >> np.uint64(51)).astype(np.int64)
        feature = keys & np.uint64((1 << 51) - 1)
        count = np.bincount(owner, minlength=n)
        ones = np.zeros((n, BITS), np.int64)
        if len(keys):
            start = np.concatenate([[0], np.cumsum(count)])[:-1]
            rank = np.arange(len(keys)) - start[owner]
            cut = np.flatnonzero(rank % 255 == 0)
            with np.errstate(over="ignore"):
                wide = np.stack([tk.mix(feature), tk.mix(feature ^ np.uint64(0xA5A5A5A5A5A5A5A5))], axis=1).view(np.uint8)
            sums = np.empty((len(cut), BITS // 8), np.uint64)
            for j in range(BITS // 8):
                sums[:, j] = np.add.reduceat(_lanes()[wide[:, j]], cut)
            lanes = sums.view(np.uint8)
            group = np.flatnonzero(np.diff(owner[cut], prepend=-1))
            ones[owner[cut][group]] = np.add.reduceat(lanes, group, axis=0, dtype=np.int64)
        found.append(np.packbits(2 * ones > count[:, None], axis=1))
        counts.append(count)
    if not found:
        return np.empty((0, BITS // 8), np.uint8), np.empty(0, np.int64)
    return np.concatenate(found), np.concatenate(counts)


def _node_column(texts: pa.Array) -> pa.Array:
    bits, counts = signatures(texts)
    raw = np.hstack([bits, counts.astype(">u4").view(np.uint8).reshape(-1, 4)])
    ends = np.arange(len(raw) + 1, dtype=np.int32) * 20
    made = pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(ends), pa.py_buffer(raw.tobytes())])
    return pc.if_else(pa.array(counts > 0), made, pa.scalar(None, pa.binary()))


def _exceeds(counter: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count is over the radius; counter has the binary digits, low first."""
    more, same = over, ~over
    for i in reversed(range(len(counter))):
        if radius >> i & 1:
            same = same & counter[i]
        else:
            more = more | (same & counter[i])
            same = same & ~counter[i]
    return more


def _adder(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = a ^ b
    return x ^ c, (a & b) | (x & c)


def near_pairs(bits: np.ndarray, radius: int = RADIUS, tile_words: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs i < j of rows of (m, bytes) signatures within the radius, tile by tile."""
    m, width = bits.shape[0], bits.shape[1] * 8
    if m < 2:
        return
    wide = -(-m // 64)
    flags = np.unpackbits(bits, axis=1)
    vertical = np.zeros((width, wide * 64), np.uint8)
    vertical[:, :m] = flags.T
    planes = np.packbits(vertical, axis=1, bitorder="little").view(np.uint64)
    masks = np.where(flags.T, _WORD, np.uint64(0))
    digits = radius.bit_length()
    step = max(1, tile_words // wide)
    for low in range(0, m, step):
        high = min(m, low + step)
        first = low // 64
        query = np.repeat(np.arange(low, high), wide - first)
        block = np.tile(np.arange(first, wide), high - low)
        keep = block >= query // 64
        query, block = query[keep], block[keep]
        over = np.zeros(len(query), np.uint64)
        own = block == query // 64
        shift = (query[own] % 64).astype(np.uint64)
        over[own] = (np.uint64(2) << shift) - np.uint64(1)
        if m % 64:
            over[block == wide - 1] |= _WORD << np.uint64(m % 64)
        counter = [np.zeros(len(query), np.uint64) for _ in range(digits)]
        none = np.zeros(len(query), np.uint64)
        for at in range(0, width, 7):
            x = [planes[p][block] ^ masks[p][query] for p in range(at, min(width, at + 7))]
            x += [none] * (7 - len(x))
            s1, c1 = _adder(x[0], x[1], x[2])
            s2, c2 = _adder(x[3], x[4], x[5])
            ones, c3 = _adder(s1, s2, x[6])
            twos, fours = _adder(c1, c2, c3)
            carry = none
            for i in range(digits):
                add = (ones, twos, fours)[i] if i < 3 else none
                counter[i], carry = _adder(counter[i], add, carry)
            for add in (ones, twos, fours)[digits:]:
                over = over | add
            over = over | carry
            if at % 14 == 7 or at + 7 >= width:
                dead = _exceeds(counter, over, radius)
                alive = dead != _WORD
                if not alive.all():
                    query, block, over = query[alive], block[alive], over[alive]
                    counter = [c[alive] for c in counter]
                    none = none[: len(query)]
                    if not len(query):
                        break
        if len(query):
            near = ~_exceeds(counter, over, radius)
            lanes = np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, lane = np.nonzero(lanes)
            yield query[row], block[row] * 64 + lane


def forest(m: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of m rows, the least row of its connected component."""
    root = np.arange(m)
    for a, b in pairs:
        while len(a):
            ra, rb = root[a], root[b]
            differ = ra != rb
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            if len(a):
                np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
                while (root[root] != root).any():
                    root = root[root]
    return root


def plan(n: int, radius: int = RADIUS, bucket: int = BUCKET, recall: float = RECALL) -> tuple[int, int]:
    """(sampled bits, tables) for n signatures."""
    sampled = max(0, math.ceil(math.log2(max(1, n) / bucket)))
    meet = math.comb(BITS - radius, sampled) / math.comb(BITS, sampled)  # a sample has each bit once
    return sampled, 1 if not sampled else math.ceil(math.log(1 - recall) / math.log1p(-meet))


def samples(n: int) -> list[np.ndarray]:
    """The bits of each table."""
    sampled, tables = plan(n)
    draw = np.random.default_rng(_SEED)
    return [np.sort(draw.choice(BITS, sampled, replace=False)) for _ in range(tables)]


def _edges(nodes: DataFrame, n: int) -> DataFrame:
    """(a, b): near-duplicate nodes, a spanning forest for each bucket or pair of its parts."""
    places = samples(n)
    tables = len(places)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column("node")
            flags = np.unpackbits(_rows(node)[:, :16], axis=1)
            for t, place in enumerate(places):
                key = flags[:, place].astype(np.int64) @ (1 << np.arange(len(place), dtype=np.int64)) if len(place) else np.zeros(len(node), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key * tables + t), node], ["bucket", "node"])

    def compare(group: pa.Table) -> pa.Table:
        raw = _rows(group.column("node").combine_chunks())
        raw = raw[np.lexsort(raw.T[::-1])]
        counts = np.ascontiguousarray(raw[:, 16:]).view(">u4")[:, 0].astype(np.int64)

        def fitting() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for a, b in near_pairs(np.ascontiguousarray(raw[:, :16])):
                fits = np.minimum(counts[a], counts[b]) >= MIN_RATIO * np.maximum(counts[a], counts[b])
                yield a[fits], b[fits]

        root = forest(len(raw), fitting())
        own = np.flatnonzero(root != np.arange(len(raw)))
        items = lambda rows: pa.array([x.tobytes() for x in rows], pa.binary())
        release()
        return pa.table({"a": items(raw[own]), "b": items(raw[root[own]])})

    buckets = nodes.mapInArrow(spread, "bucket long, node binary")
    some = nodes.filter(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0).mapInArrow(spread, "bucket long, node binary")
    sizes = some.groupBy("bucket").agg((F.count("*") * SAMPLE).alias("size")).filter(F.col("size") > HOT * BUCKET)
    hot = materialise(sizes.select("bucket", F.ceil(2 * F.col("size") / (HOT * BUCKET)).alias("parts")))
    one = F.lit(0).cast("long")
    if hot.isEmpty():
        cells = buckets.withColumns({"low": one, "high": one})
    else:
        joined = buckets.join(F.broadcast(hot) if fits(hot, 24) else hot, "bucket", "left").withColumn("own", F.pmod(F.xxhash64(F.lit(_SEED), "node"), F.col("parts")))
        others = F.filter(F.sequence(one, F.col("parts") - 1), lambda x: x != F.col("own"))
        apart = joined.withColumn("other", F.explode(F.when(F.col("parts").isNull(), F.array(one)).otherwise(others)))
        side = F.coalesce("own", one)
        cells = apart.select("bucket", "node", F.least(side, "other").alias("low"), F.greatest(side, "other").alias("high"))
    return cells.groupBy("bucket", "low", "high").applyInArrow(compare, "a binary, b binary").distinct()


def _rows(node: pa.Array) -> np.ndarray:
    if not len(node):
        return np.empty((0, 20), np.uint8)
    return np.frombuffer(b"".join(node.to_pylist()), np.uint8).reshape(-1, 20)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the least node of each component, for all nodes in edges.

    Alternates large-star and small-star rounds until a round changes nothing;
    each round is one aggregation of the edges, materialised in the shared folder.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = lambda e: e.groupBy("a").agg(F.min("b").alias("m"))
    now = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    digest = None
    while True:
        every = both(now)
        known = every.join(least(every).withColumn("m", F.least("a", "m")), "a")
        large = known.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = least(large)
        near = large.join(low, "a")
        small = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(near.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        now = materialise(small)
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if digest == (row["n"], row["h"]):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        digest = (row["n"], row["h"])


def _members(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row for each distinct (doc_id, text): id, key, copies, group root, least member."""

    @F.arrow_udf("binary")
    def node(texts: pa.Array) -> pa.Array:
        return _node_column(texts)

    k1, k2 = row_key(F.col(doc_id), F.col(text))
    # Texts without words have no signature: only equal ones are copies. 17 bytes keep them apart from nodes.
    wordless = F.when(F.col(text).isNotNull(), F.concat(F.lit(b"="), F.unhex(F.md5(F.col(text)))))
    rows = docs.select(F.col(doc_id).alias("doc_id"), k1.alias("k1"), k2.alias("k2"), F.coalesce(node(F.col(text)), wordless).alias("node"))
    rows = materialise(rows.groupBy("k1", "k2").agg(F.first("doc_id").alias("doc_id"), F.first("node").alias("node"), F.count("*").alias("copies")))
    nodes = materialise(rows.filter(F.length("node") == 20).select("node").distinct())
    roots = components(_edges(nodes, nodes.count()))
    alone = F.concat(F.lit(b"!"), *[F.unhex(F.lpad(F.hex(k), 16, "0")) for k in ("k1", "k2")])
    placed = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node", alone)).drop("node")
    order = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "k1", "k2")
    best = placed.groupBy("root").agg(F.min(order).alias("best"), F.sum("copies").alias("group_size"))
    return placed.join(best, "root").withColumn("kept", (F.col("best.k1") == F.col("k1")) & (F.col("best.k2") == F.col("k2")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, group_id, group_size, copies, kept) for every distinct (doc_id, text) of docs.

    group_id is the least doc_id of the group and belongs to the row that stays
    (nulls last; equal ids are told apart by a hash). A pair that repeats in a text
    counts once, so a text and its repetition are copies. group_size counts rows of
    docs, copies how often this very row occurs: fully repeated rows are one row
    here. A null text is never a copy of anything; empty texts and texts without
    any word are copies only of equal texts. Very long texts are read whole.
    Other columns of docs play no part. An empty table gives an empty result.
    """
    return _members(docs, doc_id, text).select("doc_id", F.col("best.doc_id").alias("group_id"), "group_size", "copies", "kept")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group, and all columns of docs.

    The rows to drop are found by key; only if their keys are too many to
    broadcast is the text of docs shuffled. Of rows that repeat in id and text,
    the one whose other columns are least, written as JSON, stays. A null text is
    never a copy of another row; empty and wordless texts are copies of equal
    texts only. An empty table gives an empty result.
    """
    members = materialise(_members(docs, doc_id, text).select("k1", "k2", "copies", "kept"))
    drop = materialise(members.filter(~F.col("kept") | (F.col("copies") > 1)))
    hint = F.broadcast if fits(drop, 32) else lambda table: table
    k1, k2 = row_key(F.col(doc_id), F.col(text))
    keyed = docs.select(F.struct("*").alias("row"), k1.alias("k1"), k2.alias("k2"))
    single = keyed.join(hint(drop), ["k1", "k2"], "left_anti").select("row.*")
    repeated = drop.filter("kept")
    if repeated.isEmpty():
        return single
    again = keyed.join(hint(repeated.select("k1", "k2")), ["k1", "k2"], "left_semi")
    one = again.groupBy("k1", "k2").agg(F.min_by("row", F.to_json(F.col("row").dropFields(text))).alias("row"))
    return single.unionByName(one.select("row.*"))
