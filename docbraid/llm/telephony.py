"""Telephony audio columns: mu-law, A-law and IMA ADPCM payloads to resampled 16-bit PCM.

Companded bytes are expanded by 256-entry tables. ADPCM is decoded for all
blocks of a batch at once: a step of the loop decodes the same nibble of every
block. Sampling from 8 to 16 kHz keeps the samples and puts between them the
values of a windowed-sinc half-band filter.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docbraid.llm.common import release

RATE_IN, RATE_OUT = 8000, 16000
#: Bytes of an ADPCM block: predictor (2), step index (1), reserve (1), then two samples a byte.
BLOCK = 256
CODECS = ("mulaw", "alaw", "ima_adpcm")
_HALF_TAPS = 8
_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int64)


@functools.cache
def tables() -> dict[str, np.ndarray]:
    """The expansions of the two companding laws (ITU-T G.711), and the ADPCM step sizes."""
    byte = np.arange(256)
    u = ~byte & 0xFF
    mu = (((u & 15) << 3) + 132 << (u >> 4 & 7)) - 132
    a = byte ^ 0x55
    part, level = a >> 4 & 7, (a & 15) << 4
    large = np.where(part == 0, level + 8, level + 264 << np.maximum(part - 1, 0))
    steps = np.array(
        "7 8 9 10 11 12 13 14 16 17 19 21 23 25 28 31 34 37 41 45 50 55 60 66 73 80 88 97 107 118 130 143 157 173 190 209 230 253 279 307 337 371 408 449 494 544 598 658 724 796 876 963 1060 1166 1282 1411 1552 1707 1878 2066 2272 2499 2749 3024 3327 3660 4026 4428 4871 5358 5894 6484 7132 7845 8630 9493 10442 11487 12635 13899 15289 16818 18500 20350 22385 24623 27086 29794 32767".split(),
        np.int64,
    )
    return {"mulaw": np.where(u & 128, -mu, mu).astype(np.int16), "alaw": np.where(a & 128, large, -large).astype(np.int16), "steps": steps}


def decode_adpcm(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples of all payloads data[offsets[i]:offsets[i + 1]] and their n + 1 offsets.

    A payload is cut into blocks; a last one of under 4 bytes has no header and no samples.
    """
    sizes = np.diff(offsets)
    blocks = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(sizes)), blocks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = offsets[:-1][owner] + nth * BLOCK
    length = np.minimum(BLOCK, offsets[1:][owner] - start)
    full = length >= 4
    owner, start, length = owner[full], start[full], length[full]
    if not len(owner):
        return np.empty(0, np.int16), np.zeros(len(sizes) + 1, np.int64)
    order = np.argsort(-length, kind="stable")  # longer blocks first: those still at work are a prefix
    begin, size = start[order], length[order]
    steps = tables()["steps"]
    value = (data[begin].astype(np.int64) | data[begin + 1].astype(np.int64) << 8) ^ 0x8000
    value -= 0x8000
    index = np.minimum(data[begin + 2].astype(np.int64), 88)
    width = 2 * (BLOCK - 4) + 1
    out = np.zeros((len(begin), width), np.int16)
    out[:, 0] = value
    working = np.searchsorted(-size, -np.arange(5, BLOCK + 1), side="right")
    for k, n in enumerate(working.tolist()):
        if not n:
            break
        byte = data[begin[:n] + 4 + k].astype(np.int64)
        for half, nibble in enumerate((byte & 15, byte >> 4)):
            step = steps[index[:n]]
            change = (step >> 3) + np.where(nibble & 1, step >> 2, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 4, step, 0)
            value[:n] = np.clip(value[:n] + np.where(nibble & 8, -change, change), -32768, 32767)
            index[:n] = np.clip(index[:n] + _INDEX[nibble], 0, 88)
            out[:n, 1 + 2 * k + half] = value[:n]
    counts = np.empty(len(order), np.int64)
    counts[order] = 2 * (size - 4) + 1
    back = np.empty_like(out)
    back[order] = out
    keep = np.arange(width)[None, :] < counts[:, None]
    total = np.bincount(owner, weights=counts, minlength=len(sizes)).astype(np.int64)
    return back[keep], np.concatenate([[0], np.cumsum(total)])


@functools.cache
def half_band() -> np.ndarray:
    """Taps that give the value half-way between two samples."""
    at = np.arange(-_HALF_TAPS + 0.5, _HALF_TAPS)
    taps = np.sinc(at) * np.hanning(2 * _HALF_TAPS + 2)[1:-1]
    return (taps / taps.sum()).astype(np.float32)


def double_rate(samples: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Twice as many samples for each signal samples[offsets[i]:offsets[i + 1]]; silence lies around a signal."""
    n, pad = len(offsets) - 1, 2 * _HALF_TAPS
    place = np.arange(len(samples)) + np.repeat(np.arange(n) * pad, np.diff(offsets)) + _HALF_TAPS
    spread = np.zeros(len(samples) + (n + 1) * pad, np.float32)
    spread[place] = samples
    between = np.convolve(spread, half_band(), mode="full")[place + _HALF_TAPS]
    out = np.empty((len(samples), 2), np.int16)
    out[:, 0] = samples
    out[:, 1] = np.clip(np.rint(between), -32768, 32767)
    return out.ravel()


def decode_batch(payloads: pa.Array, codecs: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(PCM bytes, or null where the payload is null or the codec unknown; number of samples)."""
    payloads = payloads.cast(pa.large_binary())
    known = pc.is_valid(payloads).to_numpy(zero_copy_only=False).astype(bool) & np.isin(codecs, CODECS)
    result = np.full(len(codecs), None, object)
    counts = np.zeros(len(codecs), np.int64)
    for codec in CODECS:
        rows = np.flatnonzero(known & (codecs == codec))
        if not len(rows):
            continue
        part = payloads.take(pa.array(rows))
        offsets = np.frombuffer(part.buffers()[1], np.int64)[: len(rows) + 1]
        data = np.frombuffer(part.buffers()[2], np.uint8) if offsets[-1] else np.empty(0, np.uint8)
        if codec == "ima_adpcm":
            samples, ends = decode_adpcm(data, offsets)
        else:
            samples, ends = tables()[codec][data[: offsets[-1]]], offsets
        pcm = memoryview(double_rate(samples, ends).astype("<i2").tobytes())
        counts[rows] = 2 * np.diff(ends)
        for i, low, high in zip(rows.tolist(), (ends[:-1] * 4).tolist(), (ends[1:] * 4).tolist(), strict=True):
            result[i] = pcm[low:high]
    return pa.array([None if x is None else bytes(x) for x in result], pa.binary()), counts


def decode_audio(calls: DataFrame, call_id: str, payload: str, codec: str) -> DataFrame:
    """(call_id, codec, sample_rate, n_samples, pcm): little-endian 16-bit PCM at 16 kHz of every payload at 8 kHz.

    A null payload or an unknown or null codec gives a null pcm and no samples;
    an empty payload gives an empty one. A truncated ADPCM block is decoded as
    far as it goes. Repeated rows and null ids are kept, ids of any type keep it,
    other columns play no part, long payloads are decoded whole. An empty table gives an empty result.
    There is no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("payload")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            total = np.concatenate([[0], np.cumsum(sizes)])
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(total, total[at] + (1 << 20), side="right")) - 1)
                part = batch.slice(at, end - at)
                at = end
                codecs = np.array(part.column("codec").to_pylist(), object)
                pcm, counts = decode_batch(part.column("payload"), codecs)
                rate = pa.array(np.full(len(codecs), RATE_OUT, np.int32))
                yield pa.RecordBatch.from_arrays([part.column("call_id"), part.column("codec"), rate, pa.array(counts), pcm], ["call_id", "codec", "sample_rate", "n_samples", "pcm"])
            release()

    rows = calls.select(F.col(call_id).alias("call_id"), F.col(payload).cast("binary").alias("payload"), F.col(codec).alias("codec"))
    kind = rows.schema["call_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"call_id {kind}, codec string, sample_rate int, n_samples long, pcm binary")
