"""The kernels of the text functions against plain definitions, and plans that do each step once."""

import json
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docbraid.functions import kernels, split, text
from docbraid.operators import engines, evaluate, glossary, jobs, pages, qa, routing
from docbraid.plans import queries, translate

ODD = ["", " ", "\n", "a\x1cb c\x1f", "İstanbul Σ ⅷ ²", "😀 a😀b x", None, "x1 y", "٣ three ٣x", "ǅ ß…", "-- 'a' I", "A B\xa0C", " . .a. ।।b", "see www.a.b and x@y.z or http://q NASA Bob", "नमस्ते keep this text", "اردو", "বাংলা हि"]


def texts():
    r = random.Random(7)
    letters = "abC  .?!।\n\t\xa0  é1-'@😀न\x1f"
    return [*ODD, *("".join(r.choice(letters) for _ in range(r.randint(1, 90))) for _ in range(300))]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def nodes(df, name):
    return len(re.findall(rf"\b{name}\b", plan(df)))


def columns(spark, *made):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "id long, v string").select("id", *[c.alias(f"c{i}") for i, c in enumerate(made)])
    return [tuple(r)[1:] for r in df.orderBy("id").collect()]


def old_units(v, size, hard_cap):
    """Units as expressions of the JVM, as they were."""
    bare = text.trimmed(v)
    packed = F.aggregate(split._parts(bare), split._start(), lambda a, p: split._joined(a, p, size), split._last)
    if hard_cap:
        packed = F.flatten(F.transform(packed, lambda u: F.when(F.length(u) <= 2 * size, F.array(u)).otherwise(split._slices(u, size))))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(packed)


@pytest.mark.parametrize("size, cap", [(5, True), (20, True), (20, False)])
def test_units_are_the_same(spark, size, cap):
    v = F.col("v")
    got = columns(spark, split.units(v, size, cap), old_units(v, size, cap))
    assert all(a == b for a, b in got)


def test_scripts_and_leaks_are_the_same(spark):
    v = F.col("v")
    kept = F.regexp_replace(v, text.SKIPPED, "")
    ratio = lambda lang: F.when(F.length(kept) == 0, F.lit(1.0)).otherwise(F.length(F.regexp_replace(kept, f"[^{''.join(f'\\x{{{a:X}}}-\\x{{{b:X}}}' for a, b in text.LANGUAGES[lang][2])}]", "")) / F.length(kept))
    label = F.lit(None)
    for name, low, high in reversed(text.LABEL_RANGES):
        label = F.when(v.rlike(f"[\\x{{{low:X}}}-\\x{{{high:X}}}]"), name).otherwise(label)
    clean = F.regexp_replace(v, text.URL, " ")
    bare = F.transform(F.split(clean, r"(?U)\s+"), lambda t: F.regexp_replace(t, r"^[^A-Za-z]+|[^A-Za-z]+\z", ""))
    flags = F.transform(bare, lambda w: F.when(w.rlike(r"^[A-Za-z][A-Za-z\-']+\z") & ~w.rlike(r"^([A-Z]{2,4}|[A-Z][a-z]+)\z"), "E").otherwise("-"))
    run = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(F.array_join(flags, ""), F.lit("E+"), F.lit(0)), F.length)), F.lit(0))
    words = F.filter(F.regexp_extract_all(clean, F.lit(text.WORD), F.lit(0)), lambda w: ~w.rlike(r"^[A-Z]{2,4}\z") & ~(w.rlike(r"^[A-Z][a-z]+\z") & (F.length(w) > 3)))
    kind = F.when(label.isNotNull() & (run >= 3), "mixed").when(label.isNull() & (F.size(words) > 0), "full_english")
    mine = [text.script_ratio(v, "hi"), text.latin_ratio(v), text.has_indic(v), text.longest_english_run(v), text.english_words(v), text.leak_kind(v)]
    half = len(mine)
    for row in columns(spark, *mine, ratio("hi"), ratio("en"), label, run, words, kind):
        assert row[:half] == row[half:]


def test_mock_words_are_made_at_once_as_one_by_one():
    base, given = 0x920, texts()
    want = [None if t is None else kernels._TOKEN.sub(lambda m: kernels._mock_word(m[0], base, {}, frozenset()), t) for t in given]
    assert kernels.mock(given, base) == want
    assert kernels.mock([], base) == [] and kernels.mock(["", ""], base) == ["", ""]


def test_words_of_long_texts_are_not_read_again():
    """Distinct words, of which a memory of words keeps few, are made without one call each."""
    r = random.Random(1)
    given = [" ".join("".join(r.choice("abcdefgh") for _ in range(9)) for _ in range(400)) for _ in range(20)]
    known = kernels._mock_words(0x920, (), frozenset())
    before = len(known)
    kernels.mock(given, 0x920)
    assert len(known) == before


def test_a_slice_of_a_batch_is_python_at_a_time(monkeypatch):
    monkeypatch.setattr(kernels, "SLICE", 3)
    seen = []
    monkeypatch.setattr(kernels, "texts", lambda c: seen.append(len(c)) or c.to_pylist())
    assert kernels.mapped(lambda a, b: a + b, pa.int64(), pa.array(range(8)), pa.array(range(8))).to_pylist() == [2 * i for i in range(8)]
    assert seen == [3, 3, 3, 3, 2, 2] and len(kernels.mapped(lambda a: a, pa.int64(), pa.array([], pa.int64()))) == 0


def test_services_work_in_slices(monkeypatch):
    """Of a batch of documents, the service's texts and replies of one slice are held at a time."""
    held = []
    made = engines.post_edit.__globals__["mapped"]
    assert made is kernels.mapped
    monkeypatch.setattr(kernels, "SLICE", 2)
    monkeypatch.setattr(kernels, "texts", lambda c: held.append(len(c)) or c.to_pylist())
    made(lambda s, t: engines._worked([s, t], 9, lambda service, p: {"text": "[]"}, ("E",), ("texts", "drafts"), 1, engines.Retry()), engines._BATCHED, *[pa.array([["a"]] * 5)] * 2)
    assert max(held) == 2


def test_drafts_are_made_beside_the_call(spark):
    """One Python step cuts the texts, drafts and edits; null and empty lists stay."""
    send = lambda service, p: {"text": json.dumps([f"{service}{a}{b}" for a, b in zip(p["texts"], p["drafts"])])}
    rows = spark.createDataFrame([(1, ["x", "y", "z"]), (2, []), (3, None)], "doc_id long, s array<string>")
    both = [engines.post_edit(F.col("s"), d, ("E",), send, 2).alias("e") for d in (lambda s: f"…{s}", F.transform("s", lambda s: F.concat(F.lit("…"), s)))]
    one, two = [[r.e and [x.text for x in r.e] for r in rows.select("doc_id", e).orderBy("doc_id").collect()] for e in both]
    assert one == two and one[0] == ["Ex…x", "Ey…y", "Ez…z"]
    documents = spark.createDataFrame([(1, "One. Two.")], "doc_id long, text string")
    edited = documents.select("doc_id", engines.post_edit(split.units(F.col("text")), lambda s: f"…{s}", ("E",), send).alias("e"))
    assert nodes(edited, "ArrowEvalPython") == 1 and edited.first().e[0].text == "EOne. Two.…One. Two."


def test_lost_items_are_those_of_the_arrays(spark):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate([("1 2 2 3,4% [5]", "२ 1"), ("Figure 2 and [1, 2] [1, 2]", "Table 2"), ("none", "9"), ("7", None), (None, "7"), ("٣ ३ 3", "३"), ("[1] Table 3", "[1]")])], "id int, s string, t string")
    s, t = F.col("s"), F.col("t")
    got = rows.select(qa.lost_numbers(s, t), qa.missing_items(qa.numbers(s), qa.numbers(t)), qa.lost_markers(s, t), F.array_except(qa.markers(s), qa.markers(t)), t.isNull() | s.isNull()).collect()
    for numbers, want_numbers, marks, want_marks, null in got:
        assert null or (numbers == want_numbers and marks == want_marks)
        assert not null or (not numbers and not marks)


def test_checks_read_a_translation_once(spark):
    rows = spark.createDataFrame([(1, 0, "a", "b", True)], "doc_id long, idx int, source string, translated string, ok boolean")
    for df in (qa.flags(rows, "hi"), qa.row_report(qa.row_scores(qa.with_flags(rows, "hi"))), qa.by_type(qa.flags(rows, "hi"))):
        assert nodes(df, "ArrowEvalPython") == 1 and "regexp" not in plan(df)
    for df in (evaluate.leak_scan(rows), evaluate.leak_counts(rows), evaluate.worst_leaks(evaluate.leak_scan(rows))):
        assert nodes(df, "ArrowEvalPython") == 1 and "regexp" not in plan(df)


def docs(spark, tmp_path, n=6):
    rows = [(i, "The license of the GNU project. Number 7 stays here! " * (i + 1) + "🙂 end", "en", "a/b", 1) for i in range(n)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_queries_make_each_translation_once(spark, tmp_path):
    """Both sides of a comparison, terms and their translations, chunks and their attempts come from one pass, without a join of the table with itself."""
    d = docs(spark, tmp_path)
    once = {
        "bilingual": 0,
        "qa_flags": 0,
        "ab_diff": 0,
        "ab_summary": 0,
        "glossary_violations": 0,
        "chunk_runs": 0,
        "tm_exact": 1,
    }
    for name, joins in once.items():
        df = queries.QUERIES[name](spark, d)
        assert nodes(df, "SortMergeJoin") + nodes(df, "BroadcastHashJoin") + nodes(df, "ShuffledHashJoin") - (name == "tm_exact") == joins, name  # of the memory, and of the labels
    assert len(re.findall(r"said\(", re.sub(r"pythonUDF\S*", "", plan(queries.QUERIES["glossary_violations"](spark, d))))) == 1


def test_lines_of_adjacent_pages_are_those_of_groups(spark, tmp_path):
    r = random.Random(5)
    pick = lambda *x: r.choice(x)
    rows = [(pick(None, *range(6)), p, pick(0, 1, None), r.randint(0, 1), r.randint(0, 2), pick("a", "bé", "  c ", "", "..", "zz"), pick(None, -1.0, 10.0, 60.0, 99.0), pick(None, 1, 2, 3), r.randint(0, 9), r.randint(1, 5), pick(None, 4)) for p in [1] * 300 + [2] * 3 + [3] * 50 + [None] * 9 + [4]]
    words = spark.createDataFrame(rows, "idx int, page int, block int, par int, line int, text string, conf double, left int, top int, width int, height int").coalesce(1)
    want = sorted(map(str, pages.ocr_lines(words).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(str, pages.ocr_lines(words, adjacent=True).collect())) == want and len(want) > 20
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    lines = queries.QUERIES["ocr_lines"](spark, docs(spark, tmp_path))
    assert nodes(lines, "Exchange") == 1 and "Aggregate" not in plan(lines)


def test_lines_of_a_page_in_several_rows(spark, tmp_path):
    """Two documents of one number are one page, wherever their rows are."""
    d = str(tmp_path)
    spark.createDataFrame([(1, "a b c"), (2, "x y"), (1, "d e")], "doc_id long, text string").repartition(3).write.parquet(f"{d}/documents.parquet")
    one = pages.ocr_lines(queries.ocr_words(spark, d))
    assert sorted(map(str, queries.QUERIES["ocr_lines"](spark, d).select("page", "text").collect())) == sorted(map(str, one.select("page", "text").collect()))


def test_attempts_are_those_of_the_runs(spark):
    t = translate.translate(spark.createDataFrame([(i, "One two. " * 90) for i in range(7)], "doc_id long, text string"), "hi")
    key = lambda df: sorted(map(tuple, df.select("doc_id", "idx", "attempts").collect()))
    assert key(jobs.with_attempts(t)) == key(jobs.with_runs(t.select("doc_id", "idx"), routing.engine_runs(t)))


def test_violations_with_and_without_a_join(spark, monkeypatch):
    p = spark.createDataFrame([(1, 0, "the cat", "वह"), (1, 1, "The dog", "x"), (2, 0, "none", "y")], "doc_id long, idx int, source string, translated string")
    terms = spark.createDataFrame([("the", "वह"), ("dog", "k"), ("on", "z")], "source string, target string")
    key = lambda df: sorted(map(tuple, df.collect()))
    want = key(qa.glossary_violations(glossary.relevant_terms(p, terms), p))
    assert key(qa.glossary_violations(glossary.relevant_terms(p, terms, keep=("translated",)))) == want and len(want) == 3
    monkeypatch.setattr(glossary, "SMALL", 0)
    assert key(qa.glossary_violations(glossary.relevant_terms(p, terms, keep=("translated",)))) == want
