"""Kernels of the text functions that run in Arrow batches: plain Python and numpy, without Spark.

Spark's own array lambdas and replacing expressions are interpreted, and read a
text again for each of its parts; these read it once. A batch is worked on in
slices, so that the Python objects of one slice alone are held at a time.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa

#: Rows of a batch that are Python objects at a time.
SLICE = 512
#: Words that a worker remembers, and the longest of them.
KNOWN, LONGEST = 100_000, 64
#: White space of Unicode, as Java has it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
_WHITE = re.compile(f"[{WHITE}]+")
_STOPS = re.compile("[.?!।]+")
_TOKEN = re.compile(r"\S+")
_URL = re.compile(r"https?://[^\t-\r ]+|www\.[^\t-\r ]+|[^\t-\r ]+@[^\t-\r ]+\.[^\t-\r ]+")
_WORD = re.compile(r"[A-Za-z][A-Za-z\-']+")
_ENGLISH = re.compile(r"[^A-Za-z]*(?!(?:[A-Z]{2,4}|[A-Z][a-z]+)[^A-Za-z]*\Z)[A-Za-z][A-Za-z\-']*[A-Za-z][^A-Za-z]*\Z")
_NAME = re.compile(r"[A-Z]{2,4}|[A-Z][a-z]+")


def texts(column: pa.Array) -> list:
    """The values of a column; bytes of a string that are no UTF-8 become U+FFFD, as in the JVM."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        if not pa.types.is_string(column.type):
            raise
        return [None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def joined(parts: Iterable[pa.Array], kind: pa.DataType) -> pa.Array:
    parts = list(parts)
    return parts[0] if len(parts) == 1 else pa.concat_arrays(parts) if parts else pa.array([], kind)


def sliced(columns: Sequence[pa.Array]) -> Iterator[tuple[list, ...]]:
    """The values of parallel columns, slice by slice."""
    for low in range(0, len(columns[0]), SLICE):
        yield tuple(texts(c.slice(low, SLICE)) for c in columns)


def mapped(f: Callable, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """f of the values of every row."""
    return joined((pa.array([f(*row) for row in zip(*part, strict=True)], kind) for part in sliced(columns)), kind)


class Memo(dict):
    """f of short texts, remembered up to a number of them."""

    def __init__(self, f: Callable[[str], str]) -> None:
        self.f = f

    def __missing__(self, key: str) -> str:
        value = self.f(key)
        if len(key) <= LONGEST:
            if len(self) >= KNOWN:
                self.clear()
            self[key] = value
        return value


def units(text: str | None, size: int, hard_cap: bool) -> list[str]:
    bare = (text or "").strip(WHITE)
    parts, low = [], 0
    for stop in _STOPS.finditer(bare):
        parts.append(bare[low : stop.end()].strip(WHITE))
        low = stop.end()
    if low < len(bare):
        parts.append(bare[low:].strip(WHITE))
    packed, open_, n = [], [], 0
    for p in parts:
        if n and n + len(p) + 1 > size:
            packed.append(" ".join(open_))
            open_, n = [p], len(p)
        else:
            open_.append(p)
            n += len(p) + (n > 0)
    if open_:
        packed.append(" ".join(open_))
    if not hard_cap:
        return packed
    return [x for u in packed for x in ([u] if len(u) <= 2 * size else [u[i : i + size] for i in range(0, len(u), size)])]


def _mock_word(tok: str, base: int, keep: dict[str, str], verbatim: frozenset[str]) -> str:
    bare = "".join(c for c in tok.lower() if c.isalnum())
    if not bare or any("0" <= c <= "9" for c in tok) or bare in verbatim:
        return tok
    if bare in keep:
        return keep[bare]
    h = 0
    for unit in array("H", tok.encode("utf-16-le", "surrogatepass")):
        h = (31 * h + unit) & 0xFFFFFFFF
    size = max(2, min(8, sum(c.isalpha() for c in tok)))
    return "".join(chr(base + (h + 7 * i) % 24) for i in range(size))


@functools.lru_cache(maxsize=8)
def _mock_words(base: int, keep: tuple[tuple[str, str], ...], verbatim: frozenset[str]) -> Memo:
    fixed = dict(keep)
    return Memo(lambda piece: _TOKEN.sub(lambda m: _mock_word(m[0], base, fixed, verbatim), piece))


def _mock_one(text: str, base: int, keep: tuple[tuple[str, str], ...], verbatim: frozenset[str]) -> str:
    return " ".join(map(_mock_words(base, keep, verbatim).__getitem__, text.split(" ")))


#: Texts up to so many characters are made at once.
AT_ONCE = 1 << 20
#: In one number: the letters of a token, what makes it a word, the digits that keep it. A token has fewer than 2^21.
_MAKES, _KEEPS = 1 << 21, 1 << 42


@functools.cache
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Of each UTF-16 unit whether it is no white space, and what it counts; tokens are told apart and made as in _mock_word."""
    every = [chr(i) for i in range(0x10000)]
    counts = [c.isalpha() + _MAKES * any(x.isalnum() for x in c.lower()) + _KEEPS * ("0" <= c <= "9") for c in every]
    return np.array([not c.isspace() for c in every]), np.array(counts, np.int64)


@functools.lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of 31 and of its inverse modulo 2^32, 2^bits of each."""
    power = lambda by: np.multiply.accumulate(np.concatenate((np.ones(1, np.uint32), np.full((1 << bits) - 1, by, np.uint32))), dtype=np.uint32)
    return power(31), power(pow(31, -1, 2**32))


def _from_zero(sums: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, sums.dtype), sums))


def _mock_many(values: list[str], base: int) -> list[str]:
    """Pseudo-translations of texts without characters of two units. The hash of a token is a difference of prefix sums, by the inverse of 31 modulo 2^32."""
    units = np.frombuffer("\n".join(values).encode("utf-16-le", "surrogatepass"), np.uint16)
    solid, counts = _kinds()
    edge = np.diff(np.concatenate(([0], solid[units].view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = _from_zero(np.cumsum(counts[units]))
    has = total[ends] - total[starts]
    made = (has >= _MAKES) & (has < _KEEPS)
    starts, ends, size = starts[made], ends[made], np.clip(has[made] % _MAKES, 2, 8)
    power, inverse = _powers(max(20, len(units).bit_length()))
    prefix = _from_zero(np.cumsum(units * inverse[: len(units)], dtype=np.uint32))
    letter = (((prefix[ends] - prefix[starts]) * power[ends - 1]) % 24).astype(np.int64)
    inside = np.zeros(len(units) + 1, np.int8)
    inside[starts], inside[ends] = 1, -1
    kept = np.cumsum(inside[:-1], dtype=np.int8) == 0
    length = kept.astype(np.int64)
    length[starts] = size
    at = _from_zero(np.cumsum(length))
    out = np.empty(at[-1], np.uint16)
    out[at[:-1][kept]] = units[kept]
    first = at[starts]
    for i in range(8):
        out[first + i] = base + (letter + 7 * i) % 24
        more = size > i + 1
        first, letter, size = first[more], letter[more], size[more]
    said, rows = out.tobytes().decode("utf-16-le", "surrogatepass"), np.cumsum([len(x) + 1 for x in values])
    return [said[low:high] for low, high in zip(at[_from_zero(rows[:-1])].tolist(), at[rows - 1].tolist(), strict=True)]


def mock(values: list[str | None], base: int, keep: tuple[tuple[str, str], ...] = (), verbatim: frozenset[str] = frozenset()) -> list[str | None]:
    """Pseudo-translations; those of fixed words and of rare characters are made word by word and remembered by the worker."""
    if keep or verbatim:
        return [None if x is None else _mock_one(x, base, keep, verbatim) for x in values]
    plain = [i for i, x in enumerate(values) if x is not None and len(x) < AT_ONCE and (x.isascii() or max(x) < "\U00010000")]
    out = [None if x is None else "" for x in values]
    if plain:
        for i, said in zip(plain, _mock_many([values[i] for i in plain], base), strict=True):
            out[i] = said
    for i in set(range(len(values))).difference(plain):
        out[i] = None if values[i] is None else _mock_one(values[i], base, keep, verbatim)
    return out


@functools.lru_cache(maxsize=16)
def _classes(ranges: tuple[tuple[int, int], ...], skipped: tuple[tuple[int, int], ...]) -> np.ndarray:
    """By code point: 1 if it counts, 3 if it is also in the ranges."""
    out = np.ones(0x110000, np.uint8)
    for low, high in ranges:
        out[low : high + 1] = 3
    for low, high in skipped:
        out[low : high + 1] = 0
    return out


def shares(values: list[str | None], ranges: tuple[tuple[int, int], ...], skipped: tuple[tuple[int, int], ...]) -> list[float | None]:
    """Of each text, the share of its counting characters that are in the ranges; 1 without any."""
    classes = _classes(ranges, skipped)[np.frombuffer("".join(x or "" for x in values).encode("utf-32-le", "surrogatepass"), np.uint32)]
    ends = np.cumsum([len(x or "") for x in values])
    count = lambda which: np.diff(np.concatenate(([0], np.cumsum(which, dtype=np.int64)))[np.concatenate(([0], ends))])
    kept, hits = count(classes > 0), count(classes > 1)
    ratio = np.where(kept == 0, 1.0, hits / np.maximum(kept, 1)).tolist()
    return [None if x is None else r for x, r in zip(values, ratio, strict=True)]


@functools.lru_cache(maxsize=4)
def _blocks(labels: tuple[tuple[str, int, int], ...]) -> tuple[re.Pattern, list[tuple[str, re.Pattern]]]:
    spans = [(label, f"{chr(low)}-{chr(high)}") for label, low, high in labels]
    return re.compile(f"[{''.join(s for _, s in spans)}]"), [(label, re.compile(f"[{s}]")) for label, s in spans]


def first_block(text: str | None, labels: tuple[tuple[str, int, int], ...]) -> str | None:
    """The first label of which a character occurs."""
    every, each = _blocks(labels)
    if text is None or text.isascii() or not every.search(text):
        return None
    return next(label for label, block in each if block.search(text))


def _without_urls(text: str) -> str:
    return _URL.sub(" ", text) if "://" in text or "www." in text or "@" in text else text


def _prose(words: Iterable[str]) -> Iterator[str]:
    return (w for w in words if not _NAME.fullmatch(w) or len(w) <= 3 and not w.isupper())


def english_words(text: str | None) -> list[str] | None:
    return None if text is None else list(_prose(_WORD.findall(_without_urls(text))))


def any_english(text: str) -> bool:
    return bool(_WORD.search(text)) and any(True for _ in _prose(m[0] for m in _WORD.finditer(_without_urls(text))))


def english_run(text: str | None) -> int:
    """Most consecutive tokens that are English words between other characters than letters, and no names."""
    most = n = 0
    if text is not None and _WORD.search(text):
        for token in _WHITE.split(_without_urls(text)):
            n = n + 1 if _ENGLISH.match(token) else 0
            if n > most:
                most = n
    return most


def leak(text: str | None, labels: tuple[tuple[str, int, int], ...], min_words: int, target: str | None) -> dict:
    label, run = first_block(text, labels), english_run(text)
    if label is not None:
        kind = "mixed" if run >= min_words and (target is None or target in label) else None
    else:
        kind = "full_english" if text is not None and any_english(text) else None
    return {"label": label, "run": run, "kind": kind}
