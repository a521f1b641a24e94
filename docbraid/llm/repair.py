"""Re-Pair grammar compression of token ids, shard by shard.

A shard is a run of consecutive documents of one partition. Frequent pairs of
adjacent symbols are replaced by new symbols, round after round. A round
replaces many pairs at once: an occurrence is taken if its pair is the most
frequent one among those that overlap it, which is what one-at-a-time Re-Pair
would take first there. Pairs never cross documents, so every document stays
a range of symbols, and the expansion lengths of the rules give random access
to any token without expanding what comes before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docbraid.llm import textkernel as tk
from docbraid.llm.common import slices
from docbraid.llm.tokens import VOCABULARY, encoder

SHARD_TOKENS = 1 << 20
#: A pair must occur so often to become a rule: a rule is three stored words and each occurrence saves one.
MIN_COUNT = 4
#: Up to so many bits, a pair and a position are sorted as one word.
_SYMBOL_BITS = 21



def _schema(kind: str) -> str:
    return (
        f"shard long, first_rule int, n_tokens long, n_symbols long, n_rules int, doc_ids array<{kind}>, token_ends array<long>, "
        "symbol_ends array<long>, symbols binary, rule_left binary, rule_right binary, rule_length binary"
    )


@dataclass
class Grammar:
    """Symbols under first_rule are token ids; symbol first_rule + i is left[i] right[i]."""

    first_rule: int
    symbols: np.ndarray
    ends: np.ndarray
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray


def _pairs(seq: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The pairs at these positions as numbers; symbols have 31 bits."""
    return seq[at] << 32 | seq[at + 1]


def _positions_by_pair(seq: np.ndarray, at: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The positions at sorted by the pair there, the starts of the pairs' runs and their sizes."""
    key = _pairs(seq, at)
    if max(len(seq), symbols) < 1 << _SYMBOL_BITS:
        packed = (seq[at] << _SYMBOL_BITS | seq[at + 1]) << _SYMBOL_BITS
        packed |= at
        packed.sort()
        pair, place = packed >> _SYMBOL_BITS, packed & ((1 << _SYMBOL_BITS) - 1)
    else:
        order = np.argsort(key, kind="stable")
        pair, place = key[order], at[order]
    start = np.flatnonzero(pair[1:] != pair[:-1]) + 1
    start = np.concatenate([[0], start]) if len(pair) else start
    return place, start, np.diff(np.append(start, len(pair)))


def _odd_in_run(at: np.ndarray) -> np.ndarray:
    """Which of these ascending places are the second, fourth, ... of a run of neighbours."""
    fresh = np.ones(len(at), bool)
    fresh[1:] = at[1:] != at[:-1] + 1
    run = np.flatnonzero(fresh)
    return (np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 1


def compress(ids: np.ndarray, ends: np.ndarray, first_rule: int, min_count: int = MIN_COUNT) -> Grammar:
    """The grammar of a shard, made until no pair occurs min_count times; ends are the ends of the documents in ids."""
    seq, ends = ids.astype(np.int64), np.asarray(ends, np.int64)
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    following = first_rule
    # Replacing only ever lowers the count of a pair that exists, so a pair once too rare stays so:
    # later rounds count the pairs still frequent and those that a new symbol made.
    live = np.ones(len(seq), bool)
    live[ends[ends > 0] - 1] = False
    while len(seq) > 1:
        at = np.flatnonzero(live)
        # Of a pair over itself (a a a a) every other place counts, so the most frequent pair can be taken wherever it is counted.
        twice = at[seq[at] == seq[at + 1]]
        skipped = twice[_odd_in_run(twice)]
        live[skipped] = False
        place, start, size = _positions_by_pair(seq, np.flatnonzero(live), following)
        often = size >= min_count
        if not often.any():
            break
        place, size = place[np.repeat(often, size)], size[often]
        live[:] = False
        live[place] = True
        # Frequency first; a hash makes equally frequent pairs agree on one order everywhere.
        heads = np.cumsum(size) - size
        pair_hash = (tk.mix(_pairs(seq, place[heads]).view(np.uint64)) >> np.uint64(24)).view(np.int64)
        rank = np.zeros(len(seq) + 1, np.int64)
        rank[place] = np.repeat(np.minimum(size, (1 << 22) - 1) << 40 | pair_hash, size)
        take = rank[:-1] > 0
        take[1:] &= rank[1:-1] >= rank[:-2]
        take &= rank[:-1] >= rank[1:]
        took = np.flatnonzero(take)
        took = took[~_odd_in_run(took)]  # only a clash of the hash leaves neighbours
        live[skipped] = True
        place, start, size = _positions_by_pair(seq, took, following)
        often = size >= min_count
        if not often.any():
            break
        n = int(often.sum())
        place, size = place[np.repeat(often, size)], size[often]
        heads = np.cumsum(size) - size
        left.append(seq[place[heads]])
        right.append(seq[place[heads] + 1])
        seq[place] = np.repeat(np.arange(following, following + n), size)
        following += n
        keep = np.ones(len(seq), bool)
        keep[place + 1] = False
        before = np.concatenate([[0], np.cumsum(keep)])
        seq, ends, live = seq[keep], before[ends], live[keep]
        made = before[place]
        live[made] = True
        live[np.maximum(made - 1, 0)] = True
        live[ends[ends > 0] - 1] = False
    a = np.concatenate([np.empty(0, np.int64), *left])
    b = np.concatenate([np.empty(0, np.int64), *right])
    length = np.ones(following, np.int64)
    done = first_rule
    for part_a, part_b in zip(left, right, strict=True):  # a rule's parts are older than the rule
        length[done : done + len(part_a)] = length[part_a] + length[part_b]
        done += len(part_a)
    return Grammar(first_rule, seq, ends, a, b, length[first_rule:])


def expand(grammar: Grammar, start: int, stop: int) -> list[int]:
    """Token ids of the symbols in [start, stop)."""
    out: list[int] = []
    todo = grammar.symbols[start:stop][::-1].tolist()
    first, left, right = grammar.first_rule, grammar.left, grammar.right
    while todo:
        x = todo.pop()
        if x < first:
            out.append(x)
        else:
            todo += (int(right[x - first]), int(left[x - first]))
    return out


def tokens_at(grammar: Grammar, document: int, start: int, stop: int) -> list[int]:
    """Tokens [start, stop) of a document, expanding only the symbols that overlap them."""
    low = int(grammar.ends[document - 1]) if document else 0
    high = int(grammar.ends[document])
    first, left, right, length = grammar.first_rule, grammar.left, grammar.right, grammar.length
    own = grammar.symbols[low:high]
    rules = own >= first
    sizes = np.ones(len(own), np.int64)
    sizes[rules] = length[own[rules] - first]
    ends = np.cumsum(sizes)
    start, stop = max(0, start), min(stop, int(ends[-1]) if len(ends) else 0)
    out: list[int] = []
    if start >= stop:
        return out
    a, b = int(np.searchsorted(ends, start, side="right")), int(np.searchsorted(ends, stop, side="left"))
    todo = [(int(own[i]), int(ends[i] - sizes[i])) for i in range(b, a - 1, -1)]
    while todo:
        x, at = todo.pop()
        size = 1 if x < first else int(length[x - first])
        if at >= stop or at + size <= start:
            continue
        if x < first:
            out.append(x)
        else:
            l = int(left[x - first])
            todo.append((int(right[x - first]), at + (1 if l < first else int(length[l - first]))))
            todo.append((l, at))
    return out


def from_row(row) -> Grammar:
    """The grammar in a row of compress_corpus."""
    u4 = lambda x: np.frombuffer(bytes(x), "<u4").astype(np.int64)
    return Grammar(row["first_rule"], u4(row["symbols"]), np.array(row["symbol_ends"], np.int64), u4(row["rule_left"]), u4(row["rule_right"]), u4(row["rule_length"]))


def compress_corpus(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, shard_tokens: int = SHARD_TOKENS, min_count: int = MIN_COUNT
) -> DataFrame:
    """One row for each shard: doc_ids, where each document ends in tokens and symbols, symbols and rules.

    Binary columns are little-endian 32-bit integers. Every row of docs is in
    exactly one shard, in the order of its partition; there is no shuffle. A
    shard closes at shard_tokens tokens; a longer document makes a longer shard,
    whole. Null and empty texts are documents without tokens, ids of any type
    keep it, null ids stay null, repeated rows are stored as often as they occur. Other columns of docs
    play no part. An empty table gives no shard.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(vocabulary)
        first_rule, part = tokens.encoding.max_token_value + 1, TaskContext.get().partitionId()
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        keys: list = []
        held = done = 0

        def emit() -> pa.RecordBatch:
            nonlocal held, done
            ends = np.cumsum(np.concatenate(sizes))
            g = compress(np.concatenate(ids), ends, first_rule, min_count)
            raw = lambda x: [x.astype("<u4").tobytes()]
            row = {
                "shard": [part << 32 | done], "first_rule": pa.array([first_rule], pa.int32()), "n_tokens": [int(ends[-1]) if len(ends) else 0], "n_symbols": [len(g.symbols)],
                "n_rules": pa.array([len(g.left)], pa.int32()), "doc_ids": pa.array([list(keys)], pa.list_(kind)), "token_ends": [ends], "symbol_ends": [g.ends],
                "symbols": raw(g.symbols), "rule_left": raw(g.left), "rule_right": raw(g.right), "rule_length": raw(g.length),
            }
            ids.clear(), sizes.clear(), keys.clear()
            held, done = 0, done + 1
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            at = 0
            for texts in slices(batch.column("text"), 4 << 20, 1 << 16):
                flat, offsets = tokens.encode(texts)
                names = batch.column("doc_id").slice(at, len(texts)).to_pylist()
                at += len(texts)
                low = 0
                while low < len(names):
                    high = int(np.searchsorted(offsets, offsets[low] + shard_tokens - held, side="left"))
                    high = min(max(high, low + 1), len(names))
                    ids.append(flat[offsets[low] : offsets[high]])
                    sizes.append(np.diff(offsets[low : high + 1]))
                    keys.extend(names[low:high])
                    held += int(offsets[high] - offsets[low])
                    low = high
                    if held >= shard_tokens:
                        yield emit()
        if keys:
            yield emit()

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    name, kind = rows.schema["doc_id"].dataType.simpleString(), to_arrow_type(rows.schema["doc_id"].dataType)
    return rows.mapInArrow(shards, _schema(name))
