"""Cases of the library's own operators, without any table."""

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from docbraid.functions import split, text
from docbraid.operators import batches, blocks, engines, evaluate, glossary, jobs, memory, pages, qa, routing
from docbraid.plans import translate
from docbraid.sources import files

BLOCK = "doc_id long, ord int, block_id string, type string, level int, text string, cells array<array<struct<text:string>>>, page int"


def stream(spark, *items):
    rows = [(1, i, f"b{i}", t, lvl, s, cells, 1) for i, (t, lvl, s, cells) in enumerate(items)]
    return spark.createDataFrame(rows, BLOCK)


def head(s, level=1):
    return ("heading", level, s, None)


def para(s):
    return ("paragraph", None, s, None)


def chunks(spark, *items, **kw):
    return blocks.chunk_blocks(stream(spark, *items), **kw).orderBy("chunk_index").collect()


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr.alias("x")).first().x


def test_one_chunk_keeps_the_order(spark):
    (c,) = chunks(spark, head("A"), para("One."), para("Two."), max_chars=5000)
    assert (c.chunk_index, c.chapter_index, c.section_title, c.source_text) == (0, 1, "A", "A\n\nOne.\n\nTwo.") and c.prev_context is None
    assert c.block_ids == ["b0", "b1", "b2"]


def test_chapters_and_sections(spark):
    got = chunks(spark, head("A"), para("x"), head("B", 2), para("y"), head("C"), para("z"))
    assert [(c.chunk_index, c.chapter_index, c.section_title) for c in got] == [(0, 1, "A"), (1, 1, "B"), (2, 2, "C")]


def test_table_stays_whole(spark):
    got = chunks(spark, para("a"), ("table", None, "", [[("1",), ("2",)], [("3",), ("4",)]]), para("b"))
    assert [c.source_text for c in got] == ["a", "1\t2\n3\t4", "b"]


def test_long_paragraph_is_cut_at_sentences(spark):
    got = chunks(spark, para(" ".join(f"This is sentence number {i}." for i in range(20))), max_chars=120)
    assert len(got) > 1 and all(c.source_text.endswith(".") for c in got)
    assert all(f"number {i}." in " ".join(c.source_text for c in got) for i in range(20))


def test_previous_context(spark):
    got = chunks(spark, head("A"), para("x" * 1900), head("B"), para("second"))
    assert got[0].source_text == "A" and got[0].prev_context is None and got[1].prev_context == "A" and got[2].prev_context == "…" + "x" * 240


def brute_chunks(items, most):
    """The rules one block after the other."""
    out, ids, parts, n, chapter, section = [], [], [], 0, 0, None

    def push(text):
        if text.strip():
            out.append((chapter, section, text.strip()))

    def flush():
        nonlocal ids, parts, n
        if ids:
            push("\n\n".join(parts))
        ids, parts, n = [], [], 0

    for i, (kind, level, s, cells) in enumerate(items):
        if kind == "heading":
            flush()
            chapter += (level or 1) <= 1
            section = s.strip() or section
            ids, parts, n = [i], [s.strip()], len(s)
        elif kind == "table":
            flush()
            push("\n".join("\t".join(c[0] for c in row) for row in cells))
        elif s.strip():
            if len(s.strip()) > most:
                flush()
                cur = ""
                import re

                for t in re.findall(r"[^.?!]+[.?!]+\s*|[^.?!]+\Z", s.strip()):
                    if cur and len(cur) + len(t) > most:
                        push(cur)
                        cur = ""
                    cur += t
                push(cur)
            else:
                if n + len(s.strip()) > most and ids:
                    flush()
                ids.append(i)
                parts.append(s.strip())
                n += len(s.strip())
    flush()
    return out


def test_chunker_equals_its_sequential_version(spark):
    import random

    r = random.Random(1)
    rows, want = [], {}
    for d in range(60):
        items = []
        for _ in range(r.randint(0, 12)):
            k = r.random()
            words = " ".join(r.choice(["ab", "cde.", "f!", " g "]) for _ in range(r.randint(0, 18)))
            items.append(head(words[: r.randint(0, 9)], r.choice([1, 2, None])) if k < 0.25 else ("table", None, "", [[("p",), ("q",)]]) if k < 0.35 else para(words))
        rows += [(d, i, f"b{i}", t, lvl, s, cells, 1) for i, (t, lvl, s, cells) in enumerate(items)]
        want[d] = brute_chunks(items, 30)
    got = {}
    for c in blocks.chunk_blocks(spark.createDataFrame(rows, BLOCK), 30).orderBy("doc_id", "chunk_index").collect():
        assert c.chunk_index == len(got.get(c.doc_id, []))
        got.setdefault(c.doc_id, []).append((c.chapter_index, c.section_title, c.source_text))
    assert got == {d: w for d, w in want.items() if w}


def test_text_blocks(spark):
    raw = "INTRODUCTION\r\n\r\nFirst sentence. Second one.\r\n\r\n1.2 Methods here\n\nbody\nmore\n\n- first item\n- second item\n\n\n"
    got = blocks.text_blocks(spark.createDataFrame([(1, raw), (2, ""), (3, None)], "doc_id long, text string")).orderBy("ord").collect()
    assert [(b.type, b.level, b.text) for b in got] == [("heading", 1, "INTRODUCTION"), ("paragraph", None, "First sentence. Second one."), ("heading", 2, "1.2 Methods here"), ("paragraph", None, "body more"), ("list_item", None, "first item"), ("list_item", None, "second item")]


@pytest.mark.parametrize("line, level", [("Chapter one", 1), ("Section 2", 2), ("1. Introduction", 2), ("3 Results", 1), ("1.2.3 x. y", 4), ("ALL CAPS", 1), ("ALL CAPS.", None), ("plain", None), ("A" * 91, None)])
def test_heading_levels(spark, line, level):
    assert one(spark, blocks.heading_level(F.col("v")), line) == level


def test_sentences(spark):
    pieces = lambda s, n: one(spark, split.sentence_pieces(F.col("v"), n), s)
    assert pieces("One two. Three four. Five six. Seven.", 25) == ["One two. Three four.", "Five six. Seven."]
    assert all(p.endswith("।") for p in pieces("यह एक है। यह दो है। यह तीन है।", 12))
    assert pieces("no end", 3) == ["no end"] and pieces("...", 5) == ["..."]


def test_units_and_limits(spark):
    u = one(spark, split.units(F.col("v"), 10), "x" * 25)
    assert u == ["x" * 10, "x" * 10, "x" * 5] and one(spark, split.units(F.col("v")), "  ") == []
    assert one(spark, split.limited(F.col("v"), 10), "short. " + "y" * 25) == ["short.", "y" * 10, "y" * 10, "y" * 5]


def test_budget(spark):
    texts = ["a" * 5, "", "b" * 30, "c" * 5, "d" * 9, None, "e"]
    got = one(spark, split.budget_batches(F.col("v"), 20, 2), texts, "array<string>")
    assert got == [0, None, 2, 0, 4, None, 4]


def test_replies(spark):
    assert one(spark, split.denumbered(F.col("v"), F.lit(2)), "1) a 2) b") == ["a", "b"] and one(spark, split.denumbered(F.col("v"), F.lit(3)), "1) a 2) b") is None
    assert one(spark, split.json_reply(F.col("v"), F.lit(2)), 'x ["a","b"] y') == ["a", "b"]
    assert one(spark, split.json_reply(F.col("v"), F.lit(2)), "none") is None and one(spark, split.json_reply(F.col("v"), F.lit(2)), "][") is None


@pytest.mark.parametrize("s, lang, low, high", [("नमस्ते दुनिया", "hi", 0.95, 1), ("123 % !", "hi", 1, 1), ("বাংলা", "bn", 1, 1), ("தமிழ்", "ta", 1, 1), ("اردو", "ur", 1, 1), ("ಕನ್ನಡ", "kn", 1, 1), ("Hello नमस्ते", "en", 0.3, 0.6), ("x", "zz", 0, 0)])
def test_script_ratio(spark, s, lang, low, high):
    assert low <= one(spark, text.script_ratio(F.col("v"), lang), s) <= high


def test_languages():
    assert len(text.TARGETS) == 12 and text.LANGUAGES["ur"][3]


def test_leaks(spark):
    run = lambda s: one(spark, text.longest_english_run(F.col("v")), s)
    assert run("यह keep this as is नहीं Word more") == 4 and run("http://a.b see x") == 1 and run("") == 0
    assert one(spark, text.english_words(F.col("v")), "The GNU project at www.x.org saw Bob and Alice") == ["The", "project", "at", "saw", "Bob", "and"]
    kind = lambda s, t=None: one(spark, text.leak_kind(F.col("v"), 3, t), s)
    assert kind("नमस्ते keep this text") == "mixed" and kind("plain words") == "full_english" and kind("नमस्ते") is None and kind("नमस्ते keep this text", "ta") is None


@pytest.mark.parametrize("name, mime, want", [("a.txt", None, "TXT"), ("thesis.docx", None, "DOCX"), ("report.PDF", None, "PDF_TEXT"), ("x", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "DOCX"), ("x", None, "TXT")])
def test_doc_types(spark, name, mime, want):
    df = spark.createDataFrame([(name, mime)], "n string, m string")
    assert df.select(text.doc_type(F.col("n"), F.col("m")).alias("x")).first().x == want


def test_page_numbers(spark):
    pick = lambda s, n: one(spark, text.page_numbers(F.col("v"), F.lit(n)), s)
    assert pick("1-3,7", 8) == [0, 1, 2, 6] and pick("7, 2,2", 5) == [1, 1] and pick("", 3) == [0, 1, 2] and pick("", 0) == []


def test_mock(spark):
    said = one(spark, text.mock_translate(F.col("v"), "hi", {"rights": "अधिकार"}, ("WHO",)), "The WHO  rights, 42% of words !")
    assert "WHO" in said and "42%" in said and "अधिकार" in said and said.endswith(" !") and "  " in said
    assert one(spark, text.script_ratio(F.col("v"), "hi"), one(spark, text.mock_translate(F.col("v"), "hi"), "ordinary words here")) > 0.8


def test_routing(spark):
    rows = spark.createDataFrame([(1, 0, "abc")], "doc_id long, idx int, source string")
    ok, fail, blank = F.lit("done"), F.lit(None).cast("string"), F.lit(" ")
    go = lambda *outs: routing.run_chain(rows, [routing.Engine(f"E{i}", o, F.lit(5)) for i, o in enumerate(outs)]).first()
    r = go(fail, blank, ok)
    assert r.translated == "done" and r.engine == "E2" and [a.success for a in r.attempts] == [False, False, True] and r.attempts[1].error == "empty output"
    r = go(fail, fail)
    assert not r.ok and r.translated == "abc" and len(r.attempts) == 2
    assert [a.engine for a in go(ok, fail).attempts] == ["E0"]
    assert routing.compared(rows, [routing.Engine("A", ok, F.lit(0)), routing.Engine("B", fail, F.lit(0))]).count() == 1
    got = routing.chains(spark, [("MOCK", True), ("LLM", True), ("AMAZON_TRANSLATE", True)], forced="MOCK").filter("target = 'or'").orderBy("position").collect()
    assert [x.engine for x in got] == ["MOCK", "LLM"]
    assert routing.registry({}) == [("INDICTRANS2", False), ("LLM", False), ("AMAZON_TRANSLATE", False), ("MOCK", True)] and routing.registry({"llm.key": "k"})[1][1]
    assert routing.engine_mode("sarvam+llm", True) == ("sarvam", True) and routing.engine_mode("llm", True) == ("llm", False)
    with pytest.raises(ValueError):
        routing.engine_mode("indictrans+llm", False)


def test_large_glossaries_join_by_grams(spark, monkeypatch):
    rows = spark.createDataFrame([(1, 0, "The Right to Information Act")], "doc_id long, idx int, source string")
    terms = spark.createDataFrame([("right to information", "x"), ("act", "y"), ("to", "w"), ("zebra", "z")], "source string, target string")
    small = {r.source_term for r in glossary.relevant_terms(rows, terms).collect()}
    monkeypatch.setattr(glossary, "SMALL", 1)
    assert small == {"right to information", "act", "to"}
    assert {"right to information", "act"} <= {r.source_term for r in glossary.relevant_terms(rows, terms).collect()}


def test_both_glossary_joins_find_the_same_terms(spark, monkeypatch):
    texts = ["The EU and AI to come", "to", "a", "", None, "İstanbul AB", "abcabc"]
    rows = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, idx int, source string")
    words = ["AI", "eu", "to", "A", "ab", "İ", "abc", "come", "abcd", "zz", "", None]
    terms = spark.createDataFrame([(w, f"t{i}") for i, w in enumerate(words)], "source string, target string")
    found = lambda t: sorted(tuple(r) for r in glossary.relevant_terms(rows, t).collect())
    picked = [terms, terms.filter("length(source) > 2"), terms.filter("length(source) < 3")]
    small = [found(t) for t in picked]
    monkeypatch.setattr(glossary, "SMALL", 0)
    assert (0, 0, "AI", "t0") in small[0] and small == [found(t) for t in picked]


def test_memory(spark):
    seg = spark.createDataFrame([(1, "hello", "hi"), (2, "bye", "hi")], "doc_id long, source string, lang string")
    mem = spark.createDataFrame([(1, "hello", "hi", "A", 9, False), (2, "hello", "hi", "B", 1, True)], "entry_id long, s string, target_language string, target_text string, quality int, approved boolean").withColumn("source_hash", F.sha2("s", 256))
    assert {r.doc_id: r.target_text for r in memory.exact(seg, mem).collect()} == {1: "B", 2: None}
    a = spark.createDataFrame([(1, "one two three four five")], "seg_id long, text string")
    b = spark.createDataFrame([(7, "one two three four six"), (8, "nothing alike at all")], "entry_id long, text string")
    assert [r.entry_id for r in memory.fuzzy(a, b).collect()] == [7]


@pytest.mark.parametrize("block", [4096, 40])
def test_fuzzy_finds_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(memory, "BLOCK", block, raising=False)
    r = random.Random(3)
    base = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) for _ in range(400)]
    texts = ["Hello world", "hi", "", "a", "ab", *(" ".join(r.sample(base, r.randint(1, 12))) for _ in range(60))]
    every = lambda t, k: " ".join(w + "x" * (i % k == 0) for i, w in enumerate(t.split(" ")))
    edited = [*texts, "Hello world!", *(every(t, k) for t in texts for k in (1, 2, 3))]
    a = spark.createDataFrame(list(enumerate(texts)) + [(900, None), (0, texts[0])], "seg_id long, text string")
    b = spark.createDataFrame(list(enumerate(edited)) + [(900, None)], "entry_id long, text string")
    score = F.round(1 - F.levenshtein("x", "y") / F.greatest(F.length("x"), F.length("y"), F.lit(1)), 6)
    cross = a.distinct().select("seg_id", F.col("text").alias("x")).crossJoin(b.select("entry_id", F.col("text").alias("y"))).select("seg_id", "entry_id", score.alias("similarity"))
    for least in (0.7, 0.9, 1.0):
        want = sorted(tuple(x) for x in cross.filter(F.col("similarity") >= least).collect())
        assert sorted(tuple(x) for x in memory.fuzzy(a, b, least).collect()) == want and len(want) >= len(texts)


def test_ocr(spark):
    rows = [(1, 1, 1, 1, i, t, c, 10 * i, 5, 8, 10) for i, (t, c) in enumerate([("Hello", 90.0), ("world", 70.0), ("", 99.0), ("bad", -1.0)])] + [(1, 1, 1, 2, 9, "..", 90.0, 0, 0, 1, 1)]
    (line,) = pages.ocr_lines(spark.createDataFrame(rows, "page int, block int, par int, line int, idx int, text string, conf double, left int, top int, width int, height int")).collect()
    assert line.text == "Hello world" and line.mean_conf == 80 and line.kept


def test_quality_checks(spark):
    rows = spark.createDataFrame([(1, 0, "In 1947 and 1947 see [12]", "१९४७ में", True), (1, 1, "fine", "ठीक", True)], "doc_id long, idx int, source string, translated string, ok boolean")
    f = qa.flags(rows, "hi")
    assert {(r.idx, r.type) for r in f.collect()} == {(0, "number_mismatch"), (0, "citation_mismatch")}
    s = {r.idx: r for r in qa.scores(rows, f).collect()}
    assert s[0].score == 72 and s[1].score == 100
    r = qa.report(qa.scores(rows, f), rows).first()
    assert r.overall_score == 86 and not r["pass"]
    shape = spark.createDataFrame([([["a", "b"]], [["x", "y"]], [["x"]])], "a array<array<string>>, b array<array<string>>, c array<array<string>>")
    assert shape.select(qa.same_shape(F.col("a"), F.col("b")).alias("p"), qa.same_shape(F.col("a"), F.col("c")).alias("q")).first() == (True, False)
    assert 0 < qa.sampled(spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(0).alias("idx")), 20).count() < 400


def test_jobs(spark):
    rows = spark.createDataFrame([(1, 0, True), (1, 1, False), (2, 0, True)], "doc_id long, idx int, ok boolean")
    p = {r.doc_id: r for r in jobs.progress(rows).collect()}
    assert p[1].status == "PARTIALLY_COMPLETED" and p[2].status == "COMPLETED" and p[2].percent == 90
    made = spark.createDataFrame([(None, "hi", None, None, None), ("de", "hi", None, None, None), ("en", "en", None, None, None)], "source_language string, target_language string, tone string, mode string, special_instructions string")
    assert [r.problem for r in jobs.validated(made).collect()] == [None, "source_language", "target_language"]
    own = spark.createDataFrame([("u", "QUEUED"), ("u", "TRANSLATING"), ("v", "QUEUED")], "user_id string, status string")
    assert jobs.may_start(own, "u").count() == 1


def docx(body):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {w}><w:p><w:r><w:t>Head</w:t></w:r></w:p></w:hdr>")
        z.writestr("other.bin", b"kept")
    return out.getvalue()


BODY = (
    "<w:p><w:r><w:t>One </w:t></w:r><w:ins><w:r><w:t>two</w:t></w:r></w:ins><w:del><w:r><w:delText>gone</w:delText></w:r></w:del></w:p>"
    "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t> </w:t></w:r></w:p>"
    "<w:p><w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink><w:r><w:t> after</w:t></w:r></w:p>"
    "<w:p><w:r><w:t>outer</w:t><w:pict><w:p><w:r><w:t>box</w:t></w:r></w:p></w:pict></w:r></w:p>"
)


def test_word_files(spark, tmp_path):
    data = docx(BODY)
    assert files.docx_paragraphs(data) == ["One two", "link after", "outer", "cell", "Head"]
    assert "box" in files.docx_paragraphs(data, nested=True) and files.docx_paragraphs(b"no zip") == []
    (tmp_path / "in").mkdir()
    (tmp_path / "out").mkdir()
    (tmp_path / "in" / "a.docx").write_bytes(data)
    (tmp_path / "in" / "b.txt").write_text("TITLE\n\nbody")
    table = files.read_binary(spark, str(tmp_path / "in"))
    assert {(r.ord, r.text) for r in files.extract(table).filter("path like '%txt'").collect()} == {(0, "TITLE"), (1, "body")}
    word = table.filter("path like '%docx'")
    done = files.write_docx(word, files.docx_blocks(word).withColumn("text", F.upper("text")), str(tmp_path / "out")).collect()
    new = (tmp_path / "out" / "a.docx").read_bytes()
    assert len(done) == 1 and files.docx_paragraphs(new) == ["ONE TWO", "LINK AFTER", "OUTER", "CELL", "HEAD"]
    with zipfile.ZipFile(io.BytesIO(new)) as z:
        xml = z.read("word/document.xml").decode()
        assert z.read("other.bin") == b"kept" and xml.index("LINK AFTER") > xml.index("</w:hyperlink>" if "</w:hyperlink>" in xml else "hyperlink")


def test_html_blocks():
    got = files.html_page_blocks("<h1>T</h1><p>a<p>b<ul><li>c<li>d</ul><table><tr><td>1<td>2</table><img src=x><script>var t='</p>'</script>tail")
    assert [b["type"] for b in got] == ["heading", "paragraph", "paragraph", "list_item", "list_item", "table", "figure", "paragraph"] and got[5]["cells"] == [["1", "2"]]


def test_store(tmp_path):
    s = files.ObjectStore(str(tmp_path))
    s.put("jobs/1/a.txt", b"x")
    assert s.get("jobs/1/a.txt") == b"x" and s.exists("jobs/1/a.txt") and not s.exists("jobs/2/a.txt")
    with pytest.raises(ValueError):
        s.get("../../etc/passwd")
    with pytest.raises(NotImplementedError):
        s.presign("jobs/1/a.txt")


def test_glossary_files(spark, tmp_path):
    (tmp_path / "hi.json").write_text('[{"source": "a", "target": "b"}, {"source": "", "target": "c"}, {"source": "d", "target": "e"}]')
    (tmp_path / "bad.json").write_text("{nope")
    assert glossary.as_line(files.read_glossary_json(spark, str(tmp_path / "hi.json"))).first().line == "a=b; d=e"
    assert files.read_glossary_json(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "g.csv").write_text("source,target,doNotTranslate,caseSensitive,notes\na,b,true,false,n\n")
    assert files.read_glossary_csv(spark, str(tmp_path / "g.csv")).first().doNotTranslate is True


def test_whole_flow_keeps_every_segment(spark):
    docs = spark.createDataFrame([(i, "First sentence here. Second sentence there. " * 20) for i in range(8)], "doc_id long, text string")
    rows = translate.translate(docs, "hi").cache()
    assert rows.count() == translate.segments(docs).count() and rows.filter("translated IS NULL").count() == 0
    assert translate.checked(docs, "hi").count() == 8 and translate.analyse(docs).count() == 8
    assert batches.reassembled(rows).count() == 8 and evaluate.leak_counts(rows).count() == 8


def test_an_engine_sees_only_what_failed_before_it(spark, tmp_path):
    """The second engine is called for the first one's failures alone; what it throws is an attempt, not the job's end."""
    rows = spark.createDataFrame([(1, i, f"text {i}") for i in range(100)], "doc_id long, idx int, source string").coalesce(1)
    log = str(tmp_path / "asked")

    def first(service, payload):
        n = int(payload["text"].split()[1])
        if n % 10 == 0:
            raise engines.Unavailable(400)
        return {"translation": " " if n % 10 == 1 else f"a{n}"}

    def second(service, payload):
        with open(log, "a") as f:
            f.write(payload["Text"] + "\n")
        if payload["Text"] == "text 20":
            raise RuntimeError("broken")
        return {"TranslatedText": f"b {payload['Text']}"}

    a = routing.Engine("A", engines.client(engines.nmt("u"), first, "hi"), F.lit(0), reports=True)
    b = routing.Engine("B", engines.client(engines.amazon("r"), second, "hi"), F.lit(0), reports=True)
    out = {r.idx: r for r in routing.run_chain(rows, [a, b]).collect()}
    failed = {i for i in range(100) if i % 10 < 2}
    with open(log) as f:
        assert sorted(f.read().split("\n")[:-1]) == sorted(f"text {i}" for i in failed)
    assert {i for i, r in out.items() if r.engine == "B"} == failed - {20} and out[20].translated == "text 20" and not out[20].ok
    assert [x.error for x in out[20].attempts] == ["Unavailable: status 400", "RuntimeError: broken"] and out[1].attempts[0].error == "empty output"
    assert out[10].attempts[1].cost == 15 * len("text 10") and all(x.latency_ms >= 0 for r in out.values() for x in r.attempts)


def test_retries_wait_longer_each_time():
    waits, asked = [], []

    def send(status):
        def go(service, payload):
            asked.append(service)
            if len(asked) < 4:
                raise engines.Unavailable(status)
            return {"text": "ok"}

        return go

    assert engines.Retry(4, 0.5, 1.0).call(send(429), "s", {}, waits.append) == {"text": "ok"} and waits == [0.5, 1.0, 1.0]
    for status, most in ((503, 2), (400, 4)):
        asked.clear()
        with pytest.raises(engines.Unavailable):
            engines.Retry(most, 0).call(send(status), "s", {}, lambda _: None)
        assert len(asked) == (2 if status == 503 else 1)


def test_rotation_failover_and_singles(spark):
    def send(service, payload):
        t = payload["texts"]
        if service == "A" and "bad" in t or "hopeless" in t:
            raise engines.Unavailable(400)
        return {"text": json.dumps([f"{service}{x}" for x in (t[:-1] if "short" in t and len(t) > 1 else t)])}

    rows = spark.createDataFrame([(1, ["x", "y", "z", "w"]), (2, ["bad", "y"]), (3, ["short", "q", "hopeless", "v"]), (4, []), (5, None)], "doc_id long, s array<string>")
    got = {r.doc_id: r.t and [(x.text, x.provider, x.ok) for x in r.t] for r in rows.select("doc_id", engines.batch_translate(F.col("s"), ("A", "B"), send, 2).alias("t")).collect()}
    assert got[1] == [("Ax", "A", True), ("Ay", "A", True), ("Bz", "B", True), ("Bw", "B", True)] and got[2][0] == ("Bbad", "B", True)
    assert got[3] == [("Ashort", "A", True), ("Aq", "A", True), ("hopeless", None, False), ("Bv", "B", True)] and got[4] == [] and got[5] is None
    edited = rows.select("doc_id", engines.post_edit(F.col("s"), F.transform("s", lambda x: F.concat(x, F.lit("!"))), ("A",), lambda service, p: send(service, {"texts": p["texts"]}), 2).alias("t"))
    assert [x.text for x in edited.filter("doc_id = 2").first().t] == ["bad!", "Ay"]


def test_services_take_cut_texts(spark):
    """Sources that cut long texts are planned together with the call, whatever numbers the columns have."""
    spark.range(1).collect()
    long = "é\n😀" * 300 + "."
    rows = spark.createDataFrame([(1, long), (2, "short")], "doc_id long, text string")
    send = lambda service, payload: {"text": json.dumps([f"{service}{x}" for x in payload["texts"]])}
    for cut in (split.units(F.col("text"), 100), split.limited(F.col("text"), 100)):
        said = rows.select("doc_id", engines.batch_translate(cut, ("A",), send, 100).alias("t"))
        got = {r.doc_id: [x.text for x in r.t] for r in said.collect()}
        assert got == {1: ["A" + long[i : i + 100] for i in range(0, 901, 100)], 2: ["Ashort"]}


def test_fixed_terms_and_counters(spark):
    engine = engines.with_fixed_terms([("cat", "K"), ("cat food", "KF")], F.upper)
    row = spark.createDataFrame([("one cat food, a cat",)], "source string").select(engine(F.col("source")).alias("t")).first()
    assert row.t == "ONE KF, A K"
    rows = spark.createDataFrame([(1, 0, "ab", "abc", True), (1, 1, "ab", "ab", False), (1, 25, "ab", "ab", False), (2, 0, "a", "a", True)], "doc_id long, idx int, source string, translated string, ok boolean")
    got = {r.doc_id: r for r in batches.page_report(rows, F.length("translated") > F.length("source")).collect()}
    assert (got[1].translated, got[1].overflowed, got[1].failed, got[1].failed_pages) == (1, 1, 2, [0, 2]) and got[2].failed_pages == []


def test_row_scores_equal_joined_scores(spark):
    rows = spark.createDataFrame([(1, 0, "Figure 1 has 20 things", "x", True), (1, 1, "plain", "सादा", True), (2, 0, "plain", "plain text", False)], "doc_id long, idx int, source string, translated string, ok boolean")
    found = qa.flags(rows, "hi")
    joined = qa.scores(rows, found)
    mine = qa.row_scores(qa.with_flags(rows, "hi"))
    key = lambda df, c: sorted(map(tuple, df.select(*c).collect()))
    assert key(mine, joined.columns) == key(joined, joined.columns)
    whole = qa.report(joined, rows)
    assert key(qa.row_report(mine), whole.columns) == key(whole, whole.columns)
