"""Translation memory: exact reuse by hash, fuzzy reuse by length and edit distance."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Texts of either side that one block of pairs holds at most, on average.
BLOCK = 4096


def exact(segments: DataFrame, memory: DataFrame) -> DataFrame:
    """Adds target_text, hit to segments (source, lang): approved entries first, then quality, then id."""
    best = Window.partitionBy("source_hash", "target_language").orderBy(F.desc("approved"), F.desc("quality"), "entry_id")
    one = memory.withColumn("n", F.row_number().over(best)).filter("n = 1").select("source_hash", "target_language", "target_text")
    keyed = segments.withColumn("source_hash", F.sha2("source", 256))
    joined = keyed.join(one, (keyed.source_hash == one.source_hash) & (keyed.lang == one.target_language), "left")
    return joined.select(segments["*"], "target_text", F.col("target_text").isNotNull().alias("hit"))


def fuzzy(segments: DataFrame, memory: DataFrame, least: float = 0.7) -> DataFrame:
    """(seg_id, entry_id, similarity): all pairs whose edit similarity is at least least.

    An edit changes a length by one at most, so the shorter text of a pair has at
    least that share of the longer one's length: texts meet in classes of length
    whose width is that ratio, their own and the two beside it. Every pair that the
    lengths allow is compared, up to the edits it may have; blocks spread a class.
    """
    slack = 1e-6  # the similarity counts as rounded to six places
    a = segments.select("seg_id", F.col("text").alias("a")).distinct()
    b = memory.select("entry_id", F.col("text").alias("b")).distinct()
    blocks = max(1, math.ceil(max(a.count(), b.count()) / BLOCK))

    def keyed(df: DataFrame, key: str, text: str, own: str, other: str, reach: int) -> DataFrame:
        size = F.greatest(F.length(text), F.lit(1))
        one = F.floor(F.log(size) / -math.log(min(least, 1) - 2 * slack)) if least > 2 * slack else F.lit(0).cast("long")
        near = F.sequence(one - reach, one + reach) if least > 2 * slack else F.array(one)
        row = df.filter(F.col(text).isNotNull()).withColumn(own, F.pmod(F.xxhash64(key, text), F.lit(blocks)))
        return row.withColumn("class", F.explode(near)).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    pairs = keyed(a, "seg_id", "a", "i", "j", 0).join(keyed(b, "entry_id", "b", "j", "i", 1), ["class", "i", "j"])
    longer = F.greatest(F.length("a"), F.length("b"), F.lit(1))
    most = F.floor((1 - least + slack) * longer).cast("int")
    edits = F.when(F.abs(F.length("a") - F.length("b")) <= most, F.call_function("levenshtein", F.col("a"), F.col("b"), most)).otherwise(-1)
    scored = pairs.select("seg_id", "entry_id", edits.alias("edits"), longer.alias("longer")).filter("edits >= 0")
    return scored.select("seg_id", "entry_id", F.round(1 - F.col("edits") / F.col("longer"), 6).alias("similarity")).filter(F.col("similarity") >= least)
