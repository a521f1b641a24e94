"""OCR lines and page profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LINE = ("page", "block", "par", "line")
_BOX = {"x0": np.fmin, "y0": np.fmin, "x1": np.fmax, "y1": np.fmax}


def _codes(column: pa.Array) -> np.ndarray:
    """A number for each distinct value, null included."""
    return pc.dictionary_encode(column, null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def _lines(words: pa.RecordBatch) -> pa.RecordBatch:
    """The lines of whole pages."""
    keys = [_codes(words[k]) for k in _LINE]
    idx = pc.fill_null(words["idx"].cast(pa.int64()), -(2**63)).to_numpy(zero_copy_only=False)
    order = np.lexsort((idx, *reversed(keys)))
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    if np.any(~new[1:] & (idx[order][1:] == idx[order][:-1])):  # words of one place are in the order of their texts
        order = np.lexsort((pc.rank(words["t"], tiebreaker="dense").to_numpy(), idx, *reversed(keys)))
    starts = np.flatnonzero(new)
    sorted_words, first = words.take(pa.array(order)), pa.array(order[starts])
    listed = pa.LargeListArray.from_arrays(pa.array(np.append(starts, len(order)), pa.int64()), sorted_words["t"])
    sizes = np.diff(np.append(starts, len(order)))
    conf = np.add.reduceat(sorted_words["conf"].to_numpy(zero_copy_only=False), starts) / sizes
    box = [f.reduceat(pc.fill_null(sorted_words[k], np.nan).to_numpy(zero_copy_only=False), starts) for k, f in _BOX.items()]
    made = [words[k].take(first) for k in _LINE] + [pc.binary_join(listed, " ").cast(pa.string()), pa.array(conf)] + [pa.array(x, from_pandas=True) for x in box]
    return pa.RecordBatch.from_arrays(made, [*_LINE, "text", "mean_conf", *_BOX])


def _by_page(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of adjacent pages; a page that reaches the end of a batch waits for the rest of it."""
    waiting: list[pa.RecordBatch] = []
    for batch in filter(len, batches):
        page = batch["page"] if not waiting else pa.concat_arrays([waiting[-1]["page"].slice(len(waiting[-1]) - 1), batch["page"]])
        cuts = np.flatnonzero(np.diff(_codes(page))) + (0 if waiting else 1)
        if len(cuts):
            yield _lines(pa.concat_batches([*waiting, batch.slice(0, cuts[-1])]))
            waiting = []
            batch = batch.slice(cuts[-1])
        waiting.append(batch)
    if waiting:
        yield _lines(pa.concat_batches(waiting))


def ocr_lines(words: DataFrame, min_conf: float = 55.0, zoom: float = 200 / 72, adjacent: bool = False) -> DataFrame:
    """Words grouped into lines: text, mean confidence, box in points, and whether the line is kept.

    Where all words of a page are adjacent rows of one partition, lines are made
    page by page in Arrow batches, without a shuffle or a sort of the words.
    """
    good = words.filter("trim(text) <> '' AND conf >= 0")
    number = lambda c: c.cast("double")
    good = good.select(*_LINE, "idx", F.trim("text").alias("t"), number(F.col("conf")).alias("conf"), number(F.col("left")).alias("x0"), number(F.col("top")).alias("y0"), number(F.col("left") + F.col("width")).alias("x1"), number(F.col("top") + F.col("height")).alias("y1"))
    if adjacent:
        kinds = dict(good.dtypes)
        lines = good.mapInArrow(_by_page, ", ".join([f"{k} {kinds[k]}" for k in _LINE] + ["text string", "mean_conf double", *(f"{k} double" for k in _BOX)]))
    else:
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "t"))), lambda x: x["t"]), " ")
        lines = good.groupBy(*_LINE).agg(text.alias("text"), F.avg("conf").alias("mean_conf"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    lines = lines.withColumns({k: F.col(k) / zoom for k in _BOX}).filter((F.length("text") >= 2) & F.col("text").rlike(r"\p{L}"))
    return lines.withColumn("kept", F.col("mean_conf") >= min_conf)


def profile(pages: DataFrame) -> DataFrame:
    """Adds page_class by text length and share of image area."""
    n, share = F.col("text_len"), F.col("image_ratio")
    kind = F.when(n >= 200, "TEXT").when((share > 0.5) & (n < 100), "SCANNED").when(n < 50, "SCANNED").otherwise("MIXED")
    return pages.withColumn("page_class", kind)


def histogram(profiled: DataFrame) -> DataFrame:
    return profiled.groupBy("page_class").agg(F.count("*").alias("pages"), F.sum("text_len").alias("chars"))


def dominant(profiled: DataFrame) -> DataFrame:
    """The most frequent class; of equally frequent ones TEXT, SCANNED, MIXED in this order."""
    rank = F.when(F.col("page_class") == "TEXT", 2).when(F.col("page_class") == "SCANNED", 1).otherwise(0)
    return histogram(profiled).agg(F.max_by("page_class", F.struct("pages", rank)).alias("dominant"))


def analysed(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, blocks, chars, type): a page is TEXT with any block and 40 characters."""
    per = blocks.groupBy("doc_id", "page").agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars"))
    return per.withColumn("type", F.when(F.col("chars") >= 40, "TEXT").otherwise("IMAGE"))


def totals(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.count("*").alias("page_count"), F.count_if(F.col("type") == "TEXT").alias("text_pages"), F.count_if(F.col("type") == "IMAGE").alias("image_pages"), F.sum("blocks").alias("total_blocks"))
