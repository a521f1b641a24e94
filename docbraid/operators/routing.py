"""Engine choice, ordered fallback with attempt records, prompts and costs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docbraid.functions.text import LANGUAGES, TARGETS

#: Specialists first; the last resort needs no network.
RANKS = ("INDICTRANS2", "LLM", "AMAZON_TRANSLATE", "GOOGLE_ADVANCED", "MOCK")
RANKS_BY_LANGUAGE = {"or": ("INDICTRANS2", "LLM", "MOCK"), "as": ("INDICTRANS2", "LLM", "MOCK")}
#: Languages each engine offers.
SUPPORT = {
    "INDICTRANS2": TARGETS,
    "LLM": TARGETS,
    "AMAZON_TRANSLATE": tuple(x for x in TARGETS if x not in ("or", "as")),
    "MOCK": TARGETS,
}


@dataclass(frozen=True)
class Engine:
    """A named engine: its output, the cost column in micro-dollars, and whether it is on.

    translate is a column, or a function of the source column, which is null
    for rows that need no call; with reports it gives the struct of
    engines.client, whose error, latency and cost are those of the attempt. The
    output may be null (the call failed) or blank (counts as failure).
    """

    kind: str
    translate: Column | Callable[[Column], Column]
    cost: Column
    prompt_version: str | None = None
    enabled: bool = True
    latency: Column | None = None
    reports: bool = False

    def said(self, todo: Column) -> Column:
        """text, error, latency_ms, cost of the rows to do; a row that is not to be done reaches no engine."""
        source = F.when(todo, F.col("source"))
        out = self.translate(source) if callable(self.translate) else F.when(todo, self.translate)
        if self.reports:
            return out
        latency = F.lit(None) if self.latency is None else self.latency
        return F.struct(out.alias("text"), F.lit(None).cast("string").alias("error"), latency.cast("bigint").alias("latency_ms"), self.cost.cast("bigint").alias("cost"))


def registry(conf: dict[str, str]) -> list[tuple[str, bool]]:
    """(engine, enabled) in order of registration, from settings."""
    has = lambda *names: any(conf.get(n) for n in names)
    return [("INDICTRANS2", has("nmt.url")), ("LLM", has("llm.key")), ("AMAZON_TRANSLATE", has("amazon.key")), ("MOCK", True)]


def chains(spark: SparkSession, engines: list[tuple[str, bool]], forced: str | None = None) -> DataFrame:
    """(target, engine, position): enabled engines that offer the target, by the target's preference."""
    support = [(k, on, i, t) for i, (k, on) in enumerate(engines) for t in SUPPORT.get(k, ())]
    ranks = [(t, k, i) for t in TARGETS for i, k in enumerate(RANKS_BY_LANGUAGE.get(t, RANKS))]
    offered = spark.createDataFrame(support, "engine string, enabled boolean, registered int, target string").filter("enabled")
    ranked = offered.join(F.broadcast(spark.createDataFrame(ranks, "target string, engine string, rank int")), ["target", "engine"], "left")  # fixed: targets x engines
    front = F.when(F.col("engine") == F.lit(forced), 0).otherwise(1) if forced else F.lit(1)
    order = Window.partitionBy("target").orderBy(front, F.coalesce("rank", F.lit(99)), "registered")
    return ranked.select("target", "engine", (F.row_number().over(order) - 1).alias("position"))


def run_chain(rows: DataFrame, engines: list[Engine]) -> DataFrame:
    """Adds translated, engine, ok, attempts: the first non-blank output wins, every attempt is recorded.

    When all fail the source stays in place. An engine that is a function gets
    the source only of the rows that all engines before it failed on, so no
    call is made, or paid, for a row that has its translation.
    """
    live = [e for e in engines if e.enabled]
    none = "CAST(array() AS array<struct<engine:string,success:boolean,cost:bigint,error:string,latency_ms:bigint>>)"
    out = rows.withColumns({"translated": F.lit(None).cast("string"), "engine": F.lit(None).cast("string"), "attempts": F.expr(none)})
    for e in live:
        todo = F.col("engine").isNull()
        out = out.withColumn("reply", e.said(todo))
        said = F.col("reply.text")
        good = said.isNotNull() & F.coalesce(said, F.lit("")).rlike(r"(?U)\S")
        error = F.when(good, None).otherwise(F.coalesce("reply.error", F.when(said.isNull(), "call failed").otherwise("empty output")))
        cost = F.when(good, F.coalesce("reply.cost", F.lit(0))).otherwise(F.lit(0)).cast("bigint")
        attempt = F.struct(F.lit(e.kind).alias("engine"), good.alias("success"), cost.alias("cost"), error.alias("error"), F.col("reply.latency_ms").alias("latency_ms"))
        out = out.withColumns(
            {
                "attempts": F.when(todo, F.concat("attempts", F.array(attempt))).otherwise(F.col("attempts")),
                "translated": F.when(todo & good, said).otherwise(F.col("translated")),
                "engine": F.when(todo & good, F.lit(e.kind)).otherwise(F.col("engine")),
            }
        ).drop("reply")
    return out.withColumn("ok", F.col("engine").isNotNull()).withColumn("translated", F.coalesce("translated", "source"))


def engine_runs(routed: DataFrame) -> DataFrame:
    """One row for each attempt."""
    rows = routed.select("doc_id", "idx", F.posexplode_outer("attempts").alias("attempt", "a")).filter("attempt IS NOT NULL")
    return rows.select("doc_id", "idx", "attempt", "a.engine", "a.success", F.col("a.cost").alias("cost_micro_usd"), F.col("a.error").alias("error"), "a.latency_ms")


def compared(rows: DataFrame, engines: list[Engine]) -> DataFrame:
    """Every enabled engine's output for every row; failures are left out."""
    items = [F.struct(F.lit(e.kind).alias("engine"), e.said(F.lit(True))["text"].alias("output")) for e in engines if e.enabled]
    return rows.select("doc_id", "idx", F.inline_outer(F.array(*items))).filter("output IS NOT NULL AND trim(output) <> ''")


def llm_cost(tokens_in: Column, tokens_out: Column) -> Column:
    """Micro-dollars at 3 and 15 dollars a million tokens."""
    return F.floor(tokens_in * 3 + tokens_out * 15 + 0.5).cast("bigint")


def amazon_cost(text: Column) -> Column:
    """Micro-dollars at 15 dollars a million characters."""
    return (F.length(text) * 15).cast("bigint")


def engine_mode(engine: str, llm_available: bool, post_edit: bool | None = None) -> tuple[str, bool]:
    """(base engine, whether its drafts are post-edited); an engine that ends in +llm needs a model."""
    base, _, suffix = engine.partition("+")
    if suffix == "llm" and not llm_available:
        raise ValueError(f"{engine} needs a language model, and none is configured")
    if base not in ("llm", "sarvam", "indictrans"):
        raise ValueError(f"unknown engine {engine}")
    return base, base != "llm" and (llm_available if post_edit is None else post_edit)


def prompt(source: Column, target: str, tone: str = "FORMAL", glossary: Column | None = None, context: Column | None = None, domain: str | None = None, verbatim: tuple[str, ...] = ()) -> Column:
    """A translation request of labelled sections; sections without content are left out."""
    section = lambda label, body: F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"{label}: "), body))
    none = F.lit(None).cast("string")
    return F.concat_ws(
        "\n",
        F.lit(f"Into: {LANGUAGES[target][0]} ({target})"),
        F.lit(f"Register: {tone}"),
        section("Field", F.lit(domain).cast("string")),
        section("Before this", context if context is not None else none),
        section("Fixed terms", F.coalesce(glossary, F.lit("none")) if glossary is not None else F.lit("none")),
        section("Keep unchanged", F.lit(", ".join(verbatim) or None).cast("string")),
        section("Text", source),
    )
