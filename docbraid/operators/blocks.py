"""Text extraction into ordered blocks, and structure-aware chunking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docbraid.functions.split import sentence_pieces
from docbraid.functions.text import trimmed

LIST_ITEM = r"^([-*•]|\d+[.)])\s+"
_BLOCK = "struct<type:string,level:int,text:string>"


def heading_level(line: Column) -> Column:
    """Level of a heading line, or null. A numbered heading counts every dot of the line."""
    dots = F.regexp_count(line, F.lit(r"\."))
    shouted = (F.length(line) < 60) & line.rlike("[A-Za-z]") & (line == F.upper(line)) & ~line.rlike(r"[.?!]\z")
    return (
        F.when(F.length(line) > 90, None)
        .when(line.rlike(r"(?i)^(chapter|part)\b"), 1)
        .when(line.rlike(r"(?i)^section\b"), 2)
        .when(line.rlike(r"^(\d+)(\.\d+)*\.?\s+\S"), F.least(F.lit(6), dots + 1))
        .when(shouted, 1)
    )


def _block(kind: str, level: Column, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), level.cast("int").alias("level"), text.alias("text")).cast(_BLOCK)


def _group(group: Column) -> Column:
    lines = F.filter(F.transform(F.split(group, "\n"), trimmed), lambda x: x != "")
    level = heading_level(lines[0])
    items = F.transform(lines, lambda x: _block("list_item", F.lit(None), F.regexp_replace(x, LIST_ITEM, "")))
    return (
        F.when(F.size(lines) == 0, F.array().cast(f"array<{_BLOCK}>"))
        .when((F.size(lines) == 1) & level.isNotNull(), F.array(_block("heading", level, lines[0])))
        .when(F.forall(lines, lambda x: x.rlike(LIST_ITEM)), items)
        .otherwise(F.array(_block("paragraph", F.lit(None), F.array_join(lines, " "))))
    )


def text_blocks(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ord, block_id, type, level, text, page): blocks of plain texts in reading order.

    Groups are split at blank lines; a lone line may be a heading, a group of list
    lines becomes items, other lines are joined. Stays inside one projection: the
    order comes from posexplode, not from a shuffle.
    """
    raw = F.regexp_replace(F.regexp_replace(F.col(text), "\r\n", "\n"), "\r", "\n")
    blocks = F.flatten(F.transform(F.split(raw, "\n{2,}"), _group))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode_outer(blocks).alias("ord", "b")).filter("ord IS NOT NULL")
    return rows.select("doc_id", "ord", F.concat(F.lit("b"), "ord").alias("block_id"), "b.type", "b.level", "b.text", F.lit(1).alias("page"))


def outline(blocks: DataFrame) -> DataFrame:
    """Headings as a table of contents."""
    return blocks.filter("type = 'heading'").select("doc_id", "ord", F.col("text").alias("title"), "level", "block_id")


def table_text(cells: Column) -> Column:
    """Cells by tab, rows by line feed."""
    return F.array_join(F.transform(cells, lambda row: F.array_join(F.transform(row, lambda c: c["text"]), "\t")), "\n")


def tail(text: Column, n: int = 240) -> Column:
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.lit("…"), F.right(text, F.lit(n))))


def previous_context(rows: DataFrame, partition: str, order: str, text: str, n: int = 240) -> DataFrame:
    """Adds prev_context: the end of the previous row's text, null for the first."""
    return rows.withColumn("prev_context", tail(F.lag(text).over(Window.partitionBy(partition).orderBy(order)), n))


def chunk_blocks(blocks: DataFrame, max_chars: int = 1800, context_chars: int = 240) -> DataFrame:
    """(doc_id, chunk_index, chapter_index, section_title, block_ids, source_text, prev_context).

    Headings end the open chunk and start a new one; tables and over-long
    paragraphs stand alone, the latter cut at sentences; other paragraphs are
    packed greedily, the joiners not counted. blocks may have a cells column.
    One shuffle by document serves all windows; the greedy step is an array fold
    inside a segment between two forced breaks.
    """
    cells = table_text(F.col("cells")) if "cells" in blocks.columns else F.lit(None).cast("string")
    by_doc = Window.partitionBy("doc_id").orderBy("ord")
    upto = by_doc.rowsBetween(Window.unboundedPreceding, 0)
    bare = trimmed(F.coalesce("text", F.lit("")))
    head, table = F.col("type") == "heading", F.col("type") == "table"
    b = blocks.select("doc_id", "ord", "block_id", "level", F.coalesce("text", F.lit("")).alias("raw"), bare.alias("bare"), head.alias("head"), table.alias("tab"), F.coalesce(cells, "text").alias("cells"))
    b = b.filter("head or tab or bare <> ''").withColumn("big", ~F.col("head") & ~F.col("tab") & (F.length("bare") > max_chars))
    b = b.withColumns(
        {
            "chapter": F.sum(F.when(F.col("head") & (F.coalesce("level", F.lit(1)) <= 1), 1).otherwise(0)).over(upto).cast("int"),
            "section": F.last(F.when(F.col("head") & (F.col("bare") != ""), F.col("bare")), ignorenulls=True).over(upto),
            "after": F.coalesce(F.lag(F.col("tab") | F.col("big")).over(by_doc), F.lit(False)),
        }
    )
    b = b.withColumn("segment", F.sum(F.when(F.col("head") | F.col("tab") | F.col("big") | F.col("after"), 1).otherwise(0)).over(upto))
    item = F.struct("ord", "block_id", "bare", F.when(F.col("head"), F.length("raw")).otherwise(F.length("bare")).alias("n"), "tab", "big", "cells")
    segments = b.groupBy("doc_id", "segment").agg(F.first("chapter").alias("chapter_index"), F.first("section").alias("section_title"), F.array_sort(F.collect_list(item)).alias("items"))
    kind = "struct<done:array<struct<ids:array<string>,parts:array<string>>>,ids:array<string>,parts:array<string>,n:int>"
    start = F.from_json(F.lit('{"done":[],"ids":[],"parts":[],"n":0}'), kind)

    def step(a: Column, x: Column) -> Column:
        full = (F.size(a["ids"]) > 0) & (a["n"] + x["n"] > max_chars)
        closed = F.concat(a["done"], F.array(F.struct(a["ids"].alias("ids"), a["parts"].alias("parts"))))
        state = lambda done, ids, parts, n: F.struct(done.alias("done"), ids.alias("ids"), parts.alias("parts"), n.cast("int").alias("n"))
        return F.when(full, state(closed, F.array(x["block_id"]), F.array(x["bare"]), x["n"])).otherwise(
            state(a["done"], F.concat(a["ids"], F.array(x["block_id"])), F.concat(a["parts"], F.array(x["bare"])), a["n"] + x["n"])
        )

    def finish(a: Column) -> Column:
        return F.concat(a["done"], F.array(F.struct(a["ids"].alias("ids"), a["parts"].alias("parts"))))

    whole = F.transform(F.aggregate("items", start, step, finish), lambda c: F.struct(c["ids"].alias("ids"), trimmed(F.array_join(c["parts"], "\n\n")).alias("text")))
    first = F.col("items")[0]
    alone = lambda text: F.array(F.struct(F.array(first["block_id"]).alias("ids"), text.alias("text")))
    cut = F.transform(sentence_pieces(first["bare"], max_chars), lambda p: F.struct(F.array(first["block_id"]).alias("ids"), p.alias("text")))
    pieces = F.when(first["tab"], alone(trimmed(first["cells"]))).when(first["big"], cut).otherwise(whole)
    rows = segments.select("doc_id", "segment", "chapter_index", "section_title", F.posexplode_outer(pieces).alias("k", "c")).filter("c.text <> ''")
    in_order = Window.partitionBy("doc_id").orderBy("segment", "k")
    rows = rows.select("doc_id", (F.row_number().over(in_order) - 1).alias("chunk_index"), "chapter_index", "section_title", F.col("c.ids").alias("block_ids"), F.col("c.text").alias("source_text"))
    return previous_context(rows, "doc_id", "chunk_index", "source_text", context_chars)
