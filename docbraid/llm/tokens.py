"""Byte-pair token ids for whole Arrow batches.

Texts are cut where the vocabulary's own pre-tokeniser is sure to cut them;
pieces are told apart by a 64-bit hash of their code points, each distinct piece
is encoded once, and ids are gathered by index. The ids are those of
Encoding.encode_ordinary on the whole text.
"""

from __future__ import annotations

import base64
import functools
import itertools
import os
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from docbraid.llm import textkernel as tk

#: Where the public vocabularies lie; a parameter of every operator that needs one.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokeniser of that vocabulary, as published with it.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
_MOST_CACHED = 800_000
_TABLE = 0x20000


@functools.cache
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """By code point: 1 for a letter, 2 for white space, else 0; and a random value."""
    points = [chr(i) for i in range(_TABLE)]
    kind = np.array([1 if unicodedata.category(c)[0] == "L" else 2 if c.isspace() else 0 for c in points], np.uint8)
    with np.errstate(over="ignore"):
        value = tk.mix(np.arange(_TABLE, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))
    return kind, value


class Encoder:
    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding(os.path.basename(path), pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        (self.feed,) = self.encoding.encode_ordinary("\n")
        self._forget()

    def _forget(self) -> None:
        """The cache: sorted hashes of pieces, and where the ids of each lie in one array."""
        self.keys, self.starts, self.sizes = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids, self.filled = np.empty(1 << 16, np.int32), 0

    def _learn(self, keys: np.ndarray, plain: np.ndarray, pieces: list[str]) -> None:
        """Encodes new pieces: plain ones, a space or none and then letters, in one call apart by line feeds."""
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        n = int(plain.sum())
        joined = np.array(self.encoding.encode_ordinary("\n".join([pieces[i] for i in order[:n]])), np.int32)
        feeds = np.flatnonzero(joined == self.feed)
        odd = [self.encoding.encode_ordinary(pieces[i]) for i in order[n:]]
        if n and len(feeds) != n - 1:  # a letter that the tokeniser takes for something else: one by one
            every = [self.encoding.encode_ordinary(pieces[i]) for i in order[:n]]
            sizes, flat = np.fromiter(map(len, every), np.int64, n), np.fromiter(itertools.chain.from_iterable(every), np.int32)
        else:
            sizes = np.diff(np.concatenate([[-1], feeds, [len(joined)]]))[: max(n, 0)] - 1 if n else np.empty(0, np.int64)
            flat = np.delete(joined, feeds)
        sizes = np.concatenate([sizes, np.fromiter(map(len, odd), np.int64, len(odd))])
        flat = np.concatenate([flat, np.fromiter(itertools.chain.from_iterable(odd), np.int32)])
        while self.filled + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.filled : self.filled + len(flat)] = flat
        starts = self.filled + np.cumsum(sizes) - sizes
        self.filled += len(flat)
        keys = np.concatenate([self.keys, keys[order]])
        by_key = np.argsort(keys, kind="stable")
        self.keys = keys[by_key]
        self.starts, self.sizes = np.concatenate([self.starts, starts])[by_key], np.concatenate([self.sizes, sizes])[by_key]

    def _gathered(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct pieces' ids, their offsets, piece number of each place, places' offsets by text)."""
        points, offsets = tk.code_points(texts)
        n = len(points)
        if not n:
            return np.empty(0, np.int32), np.zeros(1, np.int64), np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        kinds, values = _kinds()
        small = points if int(points.max()) < _TABLE else np.minimum(points, _TABLE - 1)
        kind = kinds[small]
        letter, space = kind == 1, kind == 2
        # A place is a sure boundary before a space that follows no white space, after a run of
        # letters, and between a single line feed and a letter. Beyond the table: no letters, no cuts.
        cut = np.zeros(n, bool)
        cut[1:] = ((points[1:] == 32) & ~space[:-1]) | (letter[:-1] & ~letter[1:] & (points[1:] < _TABLE))
        fed = letter[2:] & (points[1:-1] == 10) & ~space[:-2]
        begins = offsets[:-1][np.diff(offsets) > 0]
        second = begins[(begins > 0) & (begins + 1 < n)] + 1
        fed[second - 2] = False  # what precedes the line feed there is another text
        cut[2:] |= fed
        cut[begins] = True
        first = np.flatnonzero(cut)
        size = np.diff(np.append(first, n))
        place = np.arange(n, dtype=np.int32) - np.repeat(first.astype(np.int32), size)
        with np.errstate(over="ignore"):
            value = values[small]
            if small is not points:
                high = points >= _TABLE
                value[high] = tk.mix(points[high].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))
            hashes = tk.mix(np.add.reduceat(value * tk._powers(int(size.max()))[place], first))
        coded = pc.dictionary_encode(pa.array(hashes.view(np.int64)))
        places = coded.indices.to_numpy().astype(np.int64)
        known = coded.dictionary.to_numpy()
        if len(self.keys) > _MOST_CACHED:
            self._forget()
        found = np.searchsorted(self.keys, known)
        missing = np.ones(len(known), bool)
        inside = found < len(self.keys)
        missing[inside] = self.keys[found[inside]] != known[inside]
        new = np.flatnonzero(missing)
        if len(new):
            example = np.empty(len(known), np.int64)
            example[places[::-1]] = np.arange(len(places))[::-1]
            one = example[new]
            letters = np.add.reduceat(letter, first, dtype=np.int64)[one]
            plain = (letters > 0) & (letters + (points[first[one]] == 32) == size[one])
            text = points.tobytes().decode("utf-32-le", "surrogatepass")
            self._learn(known[new], plain, [text[a : a + n] for a, n in zip(first[one].tolist(), size[one].tolist(), strict=True)])
            found = np.searchsorted(self.keys, known)
        sizes = self.sizes[found]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        flat = self.ids[np.arange(ends[-1]) + np.repeat(self.starts[found] - ends[:-1], sizes)]
        return flat, ends, places, np.searchsorted(first, offsets)

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text; 0 for null."""
        _, ends, places, starts = self._gathered(texts)
        total = np.concatenate([[0], np.cumsum(np.diff(ends)[places])])
        return np.diff(total[starts])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the n + 1 offsets of the texts in them; null has none."""
        flat, ends, places, starts = self._gathered(texts)
        size = np.diff(ends)[places]
        total = np.concatenate([[0], np.cumsum(size)])
        shift = np.repeat(ends[places] - total[:-1], size)
        return flat[np.arange(total[-1]) + shift], total[starts]


@functools.lru_cache(maxsize=2)
def encoder(path: str = VOCABULARY) -> Encoder:
    """One for each worker process."""
    return Encoder(path)
