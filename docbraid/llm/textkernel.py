"""Vectorised text primitives over Arrow string arrays.

Everything here works on a whole Arrow batch at once: the batch's UTF-8 is
decoded to one code-point array, classified by table look-up, cut into words by
comparing neighbours, and hashed with segmented sums. Nothing loops over rows
or characters in Python, and null texts behave as empty ones.
"""

from __future__ import annotations

import functools
import itertools
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

UPPER, LOWER, LETTER, DIGIT, SPACE, SENTENCE, PUNCT, SYMBOL, OTHER = range(9)
N_CLASSES = 9
_TABLE = 0x110000
#: The code points that may be assigned: three planes, and the tags and variation selectors of the fifteenth.
_ASSIGNED = (range(0x32400), range(0xE0000, 0xE0200))
_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class of a code point, its lower case, whether it belongs to words)."""
    kind = np.full(_TABLE, OTHER, np.uint8)
    low = np.arange(_TABLE, dtype=np.uint32)
    word = np.zeros(_TABLE, bool)
    for cp in itertools.chain(*_ASSIGNED):
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if cat == "Lu":
            kind[cp] = UPPER
        elif cat == "Ll":
            kind[cp] = LOWER
        elif cat[0] in "LM":
            kind[cp] = LETTER
        elif cat[0] == "N":
            kind[cp] = DIGIT
        elif ch.isspace():
            kind[cp] = SPACE
        elif ch in ".,;:?'\"()-":
            kind[cp] = SENTENCE
        elif cat[0] == "P" and ch not in "#%&*@\\":
            kind[cp] = PUNCT
        elif cat[0] in "SP":
            kind[cp] = SYMBOL
        word[cp] = cat[0] in "LMN"
        small = ch.lower()
        if len(small) == 1:
            low[cp] = ord(small)
    return kind, low, word


def flat(array: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One contiguous large_string array with nulls as empty texts."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
        if isinstance(array, pa.ChunkedArray):
            array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.string())
    return pc.fill_null(array.cast(pa.large_string()), "")


def code_points(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and the n + 1 offsets of the texts in them."""
    array = flat(array)
    lengths = pc.utf8_length(array).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    if not offsets[-1]:
        return np.empty(0, np.uint32), offsets
    ends = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    raw = memoryview(array.buffers()[2])[ends[0] : ends[-1]]
    points = np.frombuffer(str(raw, "utf-8").encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, offsets


@dataclass
class Words:
    """Words of a batch: hash and owning text of each, in reading order."""

    hashes: np.ndarray
    owner: np.ndarray
    offsets: np.ndarray
    n_texts: int


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@functools.cache
def _char_values() -> np.ndarray:
    _, low, _ = tables()
    with np.errstate(over="ignore"):
        return mix(low.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019))


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        steps = np.full(n, 0x9E3779B97F4A7C15 | 1, np.uint64)
        steps[:1] = 1
        return np.multiply.accumulate(steps)


def words(points: np.ndarray, offsets: np.ndarray) -> Words:
    """Cuts texts into runs of letters, marks and digits; hashes are case-blind."""
    n = len(offsets) - 1
    _, _, is_word = tables()
    inside = is_word[points]
    at = np.flatnonzero(inside)
    if not len(at):
        return Words(np.empty(0, np.uint64), np.empty(0, np.int64), np.zeros(n + 1, np.int64), n)
    begins = np.empty(len(at), bool)
    begins[0] = True
    np.not_equal(at[1:], at[:-1] + 1, out=begins[1:])
    edges = np.searchsorted(at, offsets[1:-1])
    begins[edges[edges < len(at)]] = True
    first = np.flatnonzero(begins)
    size = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, size)
    with np.errstate(over="ignore"):
        value = _char_values()[points[at]] * _powers(int(size.max()))[place]
        sums = np.add.reduceat(value, first)
    owner = np.searchsorted(offsets, at[first], side="right") - 1
    counts = np.bincount(owner, minlength=n)
    return Words(mix(sums), owner, np.concatenate([[0], np.cumsum(counts)]), n)


def hash_words(items: list[str]) -> np.ndarray:
    """The hash that words() gives to each of these single words."""
    points, offsets = code_points(pa.array(items, pa.string()))
    found = words(points, offsets)
    if len(found.hashes) != len(items):
        raise ValueError("every item must be exactly one word")
    return found.hashes


def class_histogram(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts per text (rows) and character class (columns)."""
    n = len(offsets) - 1
    kind, _, _ = tables()
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    keys = owner * N_CLASSES + kind[points]
    return np.bincount(keys, minlength=n * N_CLASSES).reshape(n, N_CLASSES)
