"""Glossaries: reading, merging, relevance to a text, token matches, insert-if-absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows a glossary may have to be broadcast; a larger one is joined by its words.
SMALL = 500


def _windows(text: Column, n: int) -> Column:
    """The distinct runs of n letters of a text; none if it is shorter."""
    runs = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, F.array_distinct(runs) if n else F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))


def relevant_terms(rows: DataFrame, terms: DataFrame, text: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, idx, source_term, target_term) and the columns to keep, for every term that occurs in a text, letter case aside.

    Containment is no equality, so the terms, counted first, are broadcast to a
    nested loop; beyond SMALL terms the join runs by grams of a term's first three
    letters, or of the whole term where it is shorter. Both find the same rows.
    """
    t = terms.select(F.col("source").alias("source_term"), F.col("target").alias("target_term"))
    keyed = rows.select("doc_id", "idx", F.lower(text).alias("low"), *keep)
    inside = F.instr(F.col("low"), F.lower("source_term")) > 0
    if t.limit(SMALL + 1).count() <= SMALL:
        found = keyed.join(F.broadcast(t), inside)
    else:
        t = t.withColumn("gram", F.left(F.lower("source_term"), F.lit(3)))
        sizes = sorted(r[0] for r in t.select(F.length("gram")).distinct().collect() if r[0] is not None)
        probes = keyed.withColumn("gram", F.explode(F.concat(*[_windows(F.col("low"), n) for n in sizes or [3]])))
        found = probes.join(t, "gram").filter(inside)
    return found.select("doc_id", "idx", "source_term", "target_term", *keep)


def token_matches(rows: DataFrame, verbatim: DataFrame, terms: DataFrame, entities: DataFrame, text: str = "source") -> DataFrame:
    """(doc_id, kind, n): tokens by what they match first: number, verbatim, glossary, entity, word."""
    tokens = rows.select("doc_id", F.explode(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))).alias("tok"))
    bare = tokens.withColumn("bare", F.regexp_replace(F.lower("tok"), r"[^\p{L}\p{N}]", "")).filter("bare <> ''")
    side = lambda df, c, flag: df.select(F.lower(c).alias("bare"), F.lit(True).alias(flag)).distinct()
    joined = bare.join(side(verbatim, "term", "v"), "bare", "left").join(side(terms, "source", "g"), "bare", "left").join(side(entities, "name", "e"), "bare", "left")
    kind = F.when(F.col("tok").rlike("[0-9]"), "number").when(F.col("v"), "verbatim").when(F.col("g"), "glossary").when(F.col("e"), "entity").otherwise("word")
    return joined.groupBy("doc_id", kind.alias("kind")).agg(F.count("*").alias("n"))


def as_line(terms: DataFrame) -> DataFrame:
    """One row: source=target pairs joined in order, blank sides skipped."""
    good = terms.filter("coalesce(source, '') <> '' AND coalesce(target, '') <> ''")
    pairs = F.array_sort(F.collect_list(F.struct("ord", F.concat("source", F.lit("="), "target").alias("p"))))
    return good.agg(F.array_join(F.transform(pairs, lambda x: x["p"]), "; ").alias("line"))


def merged(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """(source, target, origin): for each source the pair of the first part that has it."""
    every = None
    for rank, (origin, df) in enumerate(parts):
        rows = df.select("source", "target", F.lit(origin).alias("origin"), F.lit(rank).alias("rank"))
        every = rows if every is None else every.unionByName(rows)
    best = Window.partitionBy("source").orderBy("rank", "target")
    return every.withColumn("n", F.row_number().over(best)).filter("n = 1").select("source", "target", "origin")


def insert_if_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return table.unionByName(rows.join(table, keys, "left_anti"))
