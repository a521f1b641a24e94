"""Sentence splitting and greedy packing as Spark columns; without Python, but for units."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from docbraid.functions import kernels
from docbraid.functions.text import trimmed

_STATE = "struct<p:array<string>,c:string>"
PIECES = "[^.?!।]+[.?!।]+\\s*|[^.?!।]+\\z"
UNITS = "[^.?!।]*[.?!।]+|\\S[^.?!।]*\\z"


def _start() -> Column:
    return F.from_json(F.lit('{"p":[],"c":""}'), _STATE)


def _state(p: Column, c: Column) -> Column:
    return F.struct(p.alias("p"), c.alias("c"))


def _append(a: Column, x: Column) -> Column:
    return F.concat(a, F.array(x))


def sentence_pieces(text: Column, max_chars: int) -> Column:
    """Whole sentences packed into pieces of at most max_chars; a longer sentence stays whole."""
    found = F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))
    sentences = F.when(F.size(found) > 0, found).otherwise(F.array(text))

    def step(a: Column, s: Column) -> Column:
        full = (a["c"] != "") & (F.length(a["c"]) + F.length(s) > max_chars)
        return F.when(full, _state(_append(a["p"], trimmed(a["c"])), s)).otherwise(_state(a["p"], F.concat(a["c"], s)))

    def finish(a: Column) -> Column:
        return F.when(trimmed(a["c"]) != "", _append(a["p"], trimmed(a["c"]))).otherwise(a["p"])

    return F.aggregate(sentences, _start(), step, finish)


def _slices(s: Column, size: int) -> Column:
    """Consecutive parts of size characters.

    Not by a lambda that captures s: where s is itself a lambda's variable, Spark's
    planner takes the captured one for a missing column, and leaves a Python
    function of the result in a plan of the JVM, which fails.
    """
    return F.regexp_extract_all(s, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def _parts(text: Column) -> Column:
    found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(UNITS), F.lit(0)), trimmed), lambda x: x != "")
    return F.when(F.size(found) > 0, found).otherwise(F.array(text))


def _joined(a: Column, p: Column, size: int) -> Column:
    full = (a["c"] != "") & (F.length(a["c"]) + F.length(p) + 1 > size)
    return F.when(full, _state(_append(a["p"], a["c"]), p)).otherwise(_state(a["p"], F.when(a["c"] == "", p).otherwise(F.concat_ws(" ", a["c"], p))))


def _last(a: Column) -> Column:
    return F.when(a["c"] != "", _append(a["p"], a["c"])).otherwise(a["p"])


def units(text: Column, size: int = 280, hard_cap: bool = True) -> Column:
    """Sentence-sized units of about size characters; with hard_cap, one over twice the size is cut. In Arrow batches: no unit for null."""

    @F.arrow_udf("array<string>")
    def cut(column: pa.Array) -> pa.Array:
        return kernels.mapped(lambda t: kernels.units(t, size, hard_cap), pa.list_(pa.string()), column)

    return cut(text)


def limited(text: Column, limit: int = 900) -> Column:
    """Pieces of at most limit characters; a longer sentence ends the current piece and is cut."""

    def step(a: Column, p: Column) -> Column:
        cut = _state(F.concat(_last(a), _slices(p, limit)), F.lit(""))
        return F.when(F.length(p) > limit, cut).otherwise(_joined(a, p, limit))

    return F.when(F.length(text) <= limit, F.array(text)).otherwise(F.aggregate(_parts(text), _start(), step, _last))


def wrapped(text: Column, width: int = 80) -> Column:
    """Lines of whole words, as many as fit into the width; a longer word is a line of its own."""
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    return F.aggregate(words, _start(), lambda a, w: _joined(a, w, width), _last)


def budget_batches(texts: Column, max_chars: int = 700, max_lines: int = 15) -> Column:
    """For each text the index of the first text of its batch; null for blank ones.

    Texts fill a batch up to both budgets; one over max_chars is a batch of its
    own and does not end the current one.
    """
    kind = "struct<n:int,chars:int,start:int,out:array<int>>"

    def step(a: Column, x: Column) -> Column:
        n = F.length(x["s"])
        make = lambda count, chars, start, mine: F.struct(count.cast("int").alias("n"), chars.cast("int").alias("chars"), start.cast("int").alias("start"), F.concat(a["out"], F.array(mine.cast("int"))).alias("out"))
        full = (a["n"] > 0) & ((a["chars"] + n + 1 > max_chars) | (a["n"] >= max_lines))
        return (
            F.when(n == 0, make(a["n"], a["chars"], a["start"], F.lit(None)))
            .when(n > max_chars, make(a["n"], a["chars"], a["start"], x["i"]))
            .when(full | (a["n"] == 0), make(F.lit(1), n + 1, x["i"], x["i"]))
            .otherwise(make(a["n"] + 1, a["chars"] + n + 1, a["start"], a["start"]))
        )

    rows = F.transform(texts, lambda s, i: F.struct(trimmed(F.coalesce(s, F.lit(""))).alias("s"), i.alias("i")))
    return F.aggregate(rows, F.from_json(F.lit('{"n":0,"chars":0,"start":0,"out":[]}'), kind), step, lambda a: a["out"])


def numbered(texts: Column) -> Column:
    return F.array_join(F.transform(texts, lambda s, i: F.concat((i + 1).cast("string"), F.lit(") "), s)), " ")


def denumbered(reply: Column, n: Column) -> Column:
    """The parts of a numbered reply, or null if their number is not n."""
    parts = F.filter(F.transform(F.split(reply, r"\s*\d+\)\s*"), trimmed), lambda x: x != "")
    return F.when(F.size(parts) == n, parts)


def json_reply(reply: Column, n: Column) -> Column:
    """The JSON array between the first [ and the last ], if it has n items; else null."""
    low, high = F.instr(reply, "["), F.length(reply) - F.instr(F.reverse(reply), "]") + 1
    body = F.when((low > 0) & (F.instr(reply, "]") > 0) & (high > low), F.substring(reply, low, high - low + 1))
    items = F.from_json(body, "array<string>")
    return F.when(F.size(items) == n, items)
