"""Unigram (SentencePiece-style) encoding and decoding.

Encoding finds the piece sequence of greatest total log score by Viterbi.
Pieces lie in a double-array trie over UTF-8 bytes, the space being the byte
0xFF, which UTF-8 never uses. Text is cut before every space that follows a
non-space, where no piece of the vocabulary reaches across; each distinct
segment of an Arrow batch is solved once, and the trie walk, the Viterbi steps
and the backtracking run over all segments side by side.
"""

from __future__ import annotations

import functools
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docbraid.llm.common import list_column, slices

#: The public vocabulary's file; a parameter of every function that needs it.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = 0xFF
UNKNOWN_PENALTY = 10.0


@dataclass(frozen=True)
class Vocabulary:
    """Pieces, their log scores, and the double array: a child of s by byte c is base[s] + c if check there is s."""

    pieces: list[bytes]
    scores: np.ndarray
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    byte_ids: np.ndarray
    longest: int

    @property
    def unknown(self) -> float:
        return float(self.scores[self.value[self.value >= 0]].min()) - UNKNOWN_PENALTY


def double_array(keys: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, value) of a trie over the keys; value is a key's number or -1."""
    children: list[dict[int, int]] = [{}]
    number = [-1]
    for key, n in keys.items():
        at = 0
        for c in key:
            if c not in children[at]:
                children[at][c] = len(children)
                children.append({})
                number.append(-1)
            at = children[at][c]
        number[at] = n
    size = 2 * len(children) + 1024
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    used = bytearray(size)
    used[0] = 1
    check[0] = -2
    free, top, todo = 257, 257, deque([(0, 0)])
    while todo:
        node, slot = todo.popleft()
        value[slot] = number[node]
        if not children[node]:
            base[slot] = 0
            continue
        codes = sorted(children[node])
        while used[free]:
            free += 1
        # Lone children fill the gaps from below; families start near the top, where room is easy to find.
        b = free - codes[0]
        if len(codes) > 1:
            b = max(b, top - 1024)
        while b + 257 < len(used) and any(used[b + c] for c in codes):
            b += 1
        if b + 512 > len(used):
            more = len(used)
            base, check, value = np.append(base, np.zeros(more, np.int32)), np.append(check, np.full(more, -1, np.int32)), np.append(value, np.full(more, -1, np.int32))
            used += bytearray(more)
            while any(used[b + c] for c in codes):
                b += 1
        top = max(top, b + codes[-1])
        base[slot] = b
        for c in codes:
            used[b + c] = 1
            check[b + c] = slot
            todo.append((children[node][c], b + c))
    return np.append(base, np.zeros(257, np.int32)), np.append(check, np.full(257, -1, np.int32)), np.append(value, np.full(257, -1, np.int32))


@functools.lru_cache(maxsize=2)
def vocabulary(path: str = MODEL) -> Vocabulary:
    """The pieces of a model file, loaded once for each worker process.

    Scores of a unigram model are its log probabilities. A merge-ranked (BPE)
    file has no probabilities, only ranks; its pieces get the log score of
    Zipf's law at their rank, -log(rank + 2).
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    raw = np.array([model.get_score(i) for i in range(n)])
    normal = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    by_rank = all(float(raw[i]).is_integer() for i in normal) and len({float(raw[i]) for i in normal}) == len(normal)
    scores = np.zeros(n)
    scores[normal] = -np.log(-raw[normal] + 2.0) if by_rank else raw[normal]
    pieces = [b""] * n
    byte_ids = np.full(256, -1, np.int64)
    for i in range(n):
        if model.is_byte(i):
            byte = int(model.id_to_piece(i)[3:-1], 16)
            byte_ids[byte] = i
            pieces[i] = bytes([byte])
    for i in normal:
        pieces[i] = model.id_to_piece(i).encode().replace("▁".encode(), bytes([MARK]))
        if MARK in pieces[i].lstrip(bytes([MARK])):
            raise ValueError(f"piece {i} holds a space after other characters; segments could not be cut at spaces")
    if (byte_ids < 0).any():
        raise ValueError("the vocabulary has no byte fallback")
    base, check, value = double_array({pieces[i]: i for i in normal})
    return Vocabulary(pieces, scores, base, check, value, byte_ids, max(len(pieces[i]) for i in normal))


def _best(v: Vocabulary, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all segments data[begin:end] in order, and their n + 1 offsets."""
    n, size = len(begin), end - begin
    stop = np.repeat(end, size)
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    # All matches of all pieces, by walking the trie from every character at once.
    state, at = np.zeros(len(starts), np.int64), starts
    lefts, rights, kinds = [], [], []
    width = np.where(data < 0x80, 1, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4)))
    width[data == MARK] = 1
    single = np.zeros(len(data), bool)
    for depth in range(1, v.longest + 1):
        inside = at + depth - 1 < stop[at]
        at, state = at[inside], state[inside]
        if not len(at):
            break
        following = v.base[state] + data[at + depth - 1]
        good = (v.check[following] == state) & (v.base[state] > 0)
        at, state = at[good], following[good].astype(np.int64)
        kind = v.value[state]
        hit = kind >= 0
        lefts.append(at[hit]), rights.append(at[hit] + depth), kinds.append(kind[hit].astype(np.int64))
        single[at[hit][width[at[hit]] == depth]] = True
    lone = starts[~single[starts]]
    lefts.append(lone), rights.append(lone + width[lone]), kinds.append(np.full(len(lone), -1))
    left, right, kind = np.concatenate(lefts), np.concatenate(rights), np.concatenate(kinds)
    gain = np.where(kind >= 0, v.scores[kind], v.unknown)
    # One Viterbi step for each distance from the segments' starts; the longest piece wins a tie.
    owner = np.repeat(np.arange(n), size)
    step = right - begin[owner[left]]
    order = np.lexsort((left, right, step))
    left, right, kind, gain, step = left[order], right[order], kind[order], gain[order], step[order]
    score = np.full(len(data) + n, -np.inf)
    slot = np.arange(n)  # a segment of k bytes has k + 1 places
    score[begin + slot] = 0.0
    back = np.zeros(len(data) + n, np.int64)
    place_left, place_right = left + slot[owner[left]], right + slot[owner[left]]
    edges = np.flatnonzero(np.diff(step, prepend=-1))
    bounds = np.append(edges, len(step))
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        tried = score[place_left[low:high]] + gain[low:high]
        ends = place_right[low:high]
        heads = np.flatnonzero(np.diff(ends, prepend=-1))
        most = np.maximum.reduceat(tried, heads)
        group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(ends))))
        winners = np.flatnonzero(tried == most[group])
        target = ends[heads]
        score[target] = most
        back[ends[winners[::-1]]] = winners[::-1] + low  # the first winner is written last
    # Backwards from every segment's end.
    current, who = end + slot, np.arange(n)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    busy = size > 0
    current, who = current[busy], who[busy]
    while len(who):
        edge = back[current]
        moves.append((who, edge))
        current = place_left[edge]
        more = current > begin[who] + slot[who]
        current, who = current[more], who[more]
    if not moves:
        return np.empty(0, np.int64), np.zeros(n + 1, np.int64)
    whose = np.concatenate([m[0] for m in moves])
    edge = np.concatenate([m[1] for m in moves])
    turn = np.repeat(np.arange(len(moves)), [len(m[0]) for m in moves])
    path = edge[np.lexsort((-turn, whose))]
    counts = np.bincount(whose, minlength=n)
    own = kind[path]
    spread = np.where(own >= 0, 1, right[path] - left[path])
    ids = np.repeat(own, spread)
    rank = np.arange(len(ids)) - np.repeat(np.cumsum(spread) - spread, spread)
    raw = ids < 0
    ids[raw] = v.byte_ids[data[np.repeat(left[path], spread)[raw] + rank[raw]]]
    total = np.concatenate([[0], np.cumsum(spread)])
    return ids, total[np.concatenate([[0], np.cumsum(counts)])]


def encode(v: Vocabulary, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids in order, and the n + 1 offsets of the texts in them. Null and empty texts have none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.empty(0, np.int64), np.zeros(1, np.int64)
    lists = pc.split_pattern(texts, " ")
    starts = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.slice(starts[0], starts[-1] - starts[0])
    starts = starts - starts[0]
    empty = pc.equal(texts, "").to_numpy(zero_copy_only=False).astype(bool)
    coded = pc.dictionary_encode(values)
    places = coded.indices.to_numpy().astype(np.int64)
    blank = pc.equal(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(bool)
    # Runs of spaces: an empty part belongs to the segment after it, except at a text's end.
    joined = np.zeros(len(values), np.int64)
    if blank.any():
        last = np.zeros(len(values), bool)
        last[starts[1:] - 1] = True
        joined = (blank & ~last).astype(np.int64)
    lead = np.zeros(len(values), np.int64)
    if joined.any():
        where = np.arange(len(values))
        anchor = np.maximum.accumulate(np.where(joined == 0, where, -1))
        previous = np.concatenate([[-1], anchor[:-1]])
        first_of_text = np.repeat(starts[:-1], np.diff(starts))
        lead = np.where(joined == 0, where - np.maximum(previous + 1, first_of_text), 0)
    keep = joined == 0
    kept_before = np.concatenate([[0], np.cumsum(keep)])
    starts = kept_before[starts]
    key = places[keep] * (int(lead.max(initial=0)) + 1) + lead[keep]
    distinct, number = np.unique(key, return_inverse=True)
    marks = distinct % (int(lead.max(initial=0)) + 1) + 1
    words = coded.dictionary.take(pa.array(distinct // (int(lead.max(initial=0)) + 1)))
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] is not None else np.empty(0, np.uint8)
    sizes = np.diff(ends)
    end = np.cumsum(sizes + marks)
    begin = end - sizes - marks
    data = np.full(int(end[-1]) if len(end) else 0, MARK, np.uint8)
    inner = np.repeat(begin + marks - (ends[:-1] - ends[0]), sizes) + np.arange(int(sizes.sum()))
    data[inner] = raw[ends[0] : ends[-1]]
    ids, offsets = _best(v, data, begin, end)
    count = np.diff(offsets)[number]
    whole = np.repeat(empty, np.diff(starts))
    count[whole] = 0
    total = np.concatenate([[0], np.cumsum(count)])
    shift = np.repeat(offsets[:-1][number] - total[:-1], count)
    return ids[np.arange(int(total[-1])) + shift], total[starts]


def decode(v: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Texts of id sequences: pieces joined, bytes put together, marks turned into spaces, the leading one dropped."""
    sizes, table, ends = _piece_bytes(v)
    count = sizes[ids]
    total = np.concatenate([[0], np.cumsum(count)])
    data = table[np.arange(int(total[-1])) + np.repeat(ends[ids] - total[:-1], count)]
    limits = total[offsets]
    has = limits[1:] > limits[:-1]
    drop = limits[:-1][has]
    keep = np.ones(len(data), bool)
    keep[drop] = data[drop] != MARK
    left = np.concatenate([[0], np.cumsum(keep)])[limits]
    data = data[keep]
    data = np.where(data == MARK, np.uint8(0x20), data)
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(data.tobytes())])


@functools.lru_cache(maxsize=2)
def _tables(key: int, pieces: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p in pieces], np.int64)
    return sizes, np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(sizes) - sizes


def _piece_bytes(v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _tables(id(v), tuple(v.pieces))


def _encoded(text: Column, model: str) -> Column:
    @F.arrow_udf("struct<ids:array<int>,round_trip:boolean>")
    def encoded(texts: pa.Array) -> pa.Array:
        v = vocabulary(model)
        ids, sizes, same = [np.empty(0, np.int64)], [np.zeros(1, np.int64)], [np.empty(0, bool)]
        for part in slices(texts, 2 << 20, 1 << 16):
            got, offsets = encode(v, part)
            back = decode(v, got, offsets)
            same.append(pc.equal(back, pc.fill_null(part.cast(pa.large_string()), "")).to_numpy(zero_copy_only=False).astype(bool))
            ids.append(got), sizes.append(np.diff(offsets))
        lists = list_column(np.concatenate(ids).astype(np.int32), np.cumsum(np.concatenate(sizes)), pa.int32())
        return pa.StructArray.from_arrays([lists, pa.array(np.concatenate(same))], ["ids", "round_trip"])

    return encoded(text)


def encode_corpus(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """(doc_id, ids, n_ids, round_trip): the best piece sequence of every text, and whether it decodes to that text.

    Null and empty texts have no ids (and decode to the empty text). Texts of any
    length are encoded whole. Characters outside the vocabulary become byte
    pieces, a literal marker character among them. Ties go to the longest last
    piece. Repeated rows and null ids are kept as they are; other columns of
    docs play no part. An empty table gives an empty result. There is no shuffle.
    """
    done = docs.select(F.col(doc_id).alias("doc_id"), _encoded(F.col(text), model).alias("e"))
    return done.select("doc_id", F.col("e.ids").alias("ids"), F.size("e.ids").alias("n_ids"), F.col("e.round_trip").alias("round_trip"))
