import os
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docbraid.llm import htmltext, telephony, transcripts

CONV = "conv_id long, turn long, role string, text string, transcript string, states string"


def test_layout():
    page = "<title>t</title><p>One<p>Two <b>bold</b>,x<ul><li>a<li>b<ol start=3><li>c<li>d</ol><li>e</ul><table><tr><th>Name<th>Qty<tr><td>apple pie<td>3<tr><td colspan=2>all</table>after<br>break"
    want = "One\n\nTwo bold,x\n\n- a\n- b\n  3. c\n  4. d\n- e\n\nName      | Qty\napple pie | 3\nall\n\nafter\nbreak"
    assert htmltext.page_text(page) == want


@pytest.mark.parametrize(
    "page, want",
    [
        ("", ""), (None, ""), ("just text", "just text"), ("a &amp; b&nbsp;c &#x41;", "a & b c A"), ("<div hidden>x</div>y", "y"),
        ("<p style='display: none'>x</p><p>y</p>", "y"), ("<script>var a = '</p>';</script>z", "z"), ("<style>p{}</style><!-- c -->z", "z"),
        ("<pre>a  b\n  c</pre>", "a  b\n  c"), ("<dialog>x</dialog><details><summary>s</summary>d</details>", "s"), ("</p></b>x", "x"),
        ("<div>a</div><div>b</div>", "a\nb"), ("<h1>a</h1>b", "a\n\nb"), ("a<b>b</b> <i>c</i>d", "ab cd"), ("<td>x<td>y", "xy"), ("<", "<"), ("<a href='", "<a href='"),
        ("<select><option>a<option>b</select>", "a\nb"), ("<input type=hidden value=x>q<img alt=z>", "q"), ("<blockquote>q</blockquote>", "  q"),
    ],
)
def test_visible_text(page, want):
    assert htmltext.page_text(page) == want


@pytest.mark.parametrize(
    "page, want",
    [
        ("<table><tr><td rowspan=2>A<td>b1<tr><td>b2<tr><td>C<td>c1</table>", "A | b1\n  | b2\nC | c1"),
        ("<table><tr><td>a<td rowspan=0>b<td>c<tr><td>d<td>e<tr><td>f</table>", "a | b | c\nd |   | e\nf"),
        ("<table><tr><td colspan=2 rowspan=2>x<td>1<tr><td>2<tr><td>p<td>q<td>3</table>", "x     | 1\n  |   | 2\np | q | 3"),
        ("<table><tr><td>日本<td>x<tr><td>abcdef<td>y<tr><td>e\u0301<td>z</table>", "日本   | x\nabcdef | y\ne\u0301      | z"),
        ("<div style='visibility:hidden'>no<span style='visibility:visible'>yes</span></div>z", "yes\nz"),
        ("<ul style='visibility: hidden'><li>no</ul>z", "z"),
        ("<style>.x{display:none} #k, b.y {visibility:hidden}</style><p class='x y'>no<p id=k>no<p><b class=y>no</b>yes", "yes"),
        ("<style>/* .q{display:none} */ @media print {.q{display:none}} @media screen {.r{display:none}} p .q{display:none}</style><p class=q>q<p class=r>r", "q"),
        ("<style>.x{display:none}</style><p class=x style='display:block'>in<style>#a{display:block!important}</style><p id=a class=x style='display:none'>important", "in\n\nimportant"),
        ("<p hidden style='display:block'>shown", "shown"),
        ("<input type=submit value='Go now'><input value=typed><input type=password value=no><input type=search placeholder=hint>", "Go nowtypedhint"),
        ("<pre>\n a\n  b</pre>", " a\n  b"),
        ("<head><title>t</title><span>seen</span>", "seen"), ("<head><meta x>text here", "text here"), ("<head><template><div>no</div></template></head>x", "x"),
        ("<svg><title>no</title><desc>no</desc><text>label</text></svg><math><mi>x</mi></math>", "label\nx"),
        ("<a href='x>y'>q</a>", "q"), ("<a title=it's>ok</a>", "ok"), ('<a "x>y', "y"), ("a < b <1> c", "a < b <1> c"), ("x<!-- never closed", "x"), ("x</", "x"),
    ],
)
def test_rules_of_visibility_and_layout(page, want):
    assert htmltext.page_text(page) == want


@pytest.mark.parametrize("page", ['<a ' + '"x" ' * 150_000, "<a " * 200_000, '<a href="' * 70_000, "<script>" + "</script " * 70_000, "<p><button>" + "<b>" * 40_000 + "<div>" * 40_000, "<a " * 100_000 + '="">' + ' ="', "<style>" + "a{" * 100_000 + "</style><p>x",
                                  "<style>" + "/*" * 200_000, "<!--" * 100_000, "<table>" + "<tr><td rowspan=9999 colspan=5>x" * 8_000, "<table><tr><td>" + "long " * 60_000 + "<tr><td>a<td>b" * 8_000, "<table><tr>" + "<td colspan=1000>x" * 20_000])
def test_broken_pages_take_no_longer_than_they_are_long(page):
    import time

    start = time.thread_time()
    text = htmltext.page_text(page)
    assert time.thread_time() - start < 20 and len(text) < 70 * len(page)


def plain_words(page):
    """Brute force: the words of a page by the standard library's parser, without layout."""
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.stack, self.out = [], []

        def handle_starttag(self, tag, attrs):
            a = dict(attrs)
            if tag == "br":
                self.out.append(" ")
            if tag not in htmltext.VOID:
                self.stack.append((tag, tag in htmltext.INVISIBLE or "hidden" in a or "display:none" in (a.get("style") or "").replace(" ", "")))
                self.out.append(" " if tag in htmltext.BLOCK or tag in ("td", "th") else "")

        def handle_endtag(self, tag):
            at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag), None)
            if at is not None:
                del self.stack[at:]
                self.out.append(" " if tag in htmltext.BLOCK or tag in ("td", "th") else "")

        def handle_data(self, data):
            if not any(off for _, off in self.stack):
                self.out.append(data)

    w = Words()
    w.feed(page or "")
    w.close()
    return "".join(w.out).split()


def marks_off(words):
    import re

    return Counter(w for w in words if not re.fullmatch(r"-|\d+\.|\|", w))


def test_table_rows_do_not_depend_on_the_size_of_their_table():
    head, row = f"<tr><td>{'x' * 190}<td>{'y' * 190}", "<tr><td>a<td>b"
    for n in (1, 1000):
        lines = htmltext.page_text("<table>" + head + row * n + "</table>").split("\n")
        assert len(lines) == n + 1 and set(lines[1:]) == {"a" + " " * 189 + " | b"}
    wide = htmltext.page_text("<table><tr><td>" + "w" * 201 + "<td>z" + row * 2 + "</table>").split("\n")
    assert wide == ["w" * 201 + " | z", "a | b", "a | b"]
    many = htmltext.page_text("<table><tr>" + "<td>ab" * 10_001 + "<tr>" + "<td>a" * 10_001 + "</table>").split("\n")
    assert many[1] == "a  | " * 10_000 + "a"


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="no tables")
def test_every_page_shows_the_words_of_the_plain_parser():
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    for page in pages:
        assert marks_off(htmltext.page_text(page).split()) == marks_off(plain_words(page))
    assert len(pages) > 200


def test_depth_and_breakage_are_no_limit():
    for page in ["<div>" * 20000 + "x", "<li>" * 3000, "<table><tr><td>" * 300 + "x", "<b>" * 5000 + "</b>" * 5000]:
        htmltext.page_text(page)


def test_pages(spark):
    rows = [(1, "<p>a", "t"), (1, "<p>a", "t"), (None, None, None), (3, "", ""), (4, "<p>" + "long " * 50000, "")]
    out = htmltext.render_pages(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()
    assert [r.text for r in out][:4] == ["a", "a", "", ""] and len(out[4].text) == 249999
    assert htmltext.render_pages(spark.createDataFrame([], "page_id long, html string")).count() == 0


def small_model():
    rows = [("System: be kind\n\nUser: hi there?\nmore\n\nAssistant: yes. ok.\n", [0, 1, 2, 3, 3, 4, 5]), ("Q: what?\nA: that.", [2, 4])]
    return transcripts.model_from_counts(sum(transcripts.count(t.split("\n"), s) for t, s in rows))


def test_viterbi_is_the_best_of_all_paths():
    import itertools

    m = small_model()
    for text in ["User: a?\nb\n\nBot: c.", "a\nb", "x: y\n\nAI: z\nUser: q?"]:
        f = transcripts.features(text.split("\n"))
        e = sum(m.emit[k][:, f[:, k]].T for k in range(4))
        with np.errstate(invalid="ignore"):
            best = max(itertools.product(range(6), repeat=len(f)), key=lambda p: m.start[p[0]] + e[0, p[0]] + sum(m.move[a, b] + e[i + 1, b] for i, (a, b) in enumerate(zip(p, p[1:], strict=False))))
        both = transcripts.viterbi(m, [f, f[:0], f[:1]])
        assert tuple(both[0]) == best and len(both[1]) == 0 and len(both[2]) == 1


def test_names_are_told_apart_by_their_order():
    lines = "Ana: hi\nSeñor Ruiz: yes\nana: so\nKim: x\nLi: y\nUser: z\nplain".split("\n")
    assert transcripts.features(lines)[:, 0].tolist() == [4, 5, 4, 6, 6, 2, 0]


def test_slices_parse_as_whole_batches(spark, monkeypatch):
    rows = [(i, f"User: a{i}?\n\nBot: b.\nmore" * (i % 4)) for i in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, transcript string").coalesce(1)
    want = transcripts.parse_transcripts(df, small_model()).collect()
    for i, t in rows:
        lines = transcripts.split_lines(t)
        (found,) = transcripts.viterbi(small_model(), [transcripts.features(lines)])
        assert want[i].rendered == transcripts.canonical(transcripts.turns(lines, found))


def test_rendering():
    lines = "User: hi\nmore\n\nbot: yes".split("\n")
    assert transcripts.canonical(transcripts.turns(lines, np.array([2, 3, 3, 4]))) == "<|user|>\nhi\nmore\n<|end|>\n<|assistant|>\nyes\n<|end|>\n"


def test_awkward_conversations(spark):
    rows = [(1, 0, "user", "a?"), (1, 0, "user", "a?"), (1, None, None, None), (None, 1, "assistant", "b"), (2, 1, "other", ""), (3, 0, "user", "w " * 30000)]
    convs = spark.createDataFrame([(*r, "x", "y") for r in rows], CONV)
    written = {r.conv_id: r for r in transcripts.write_transcripts(convs).collect()}
    assert len(written) == 4 and all(len(r.states) == len(r.transcript.split("\n")) for r in written.values())
    out = transcripts.parse_conversations(convs).collect()
    assert len(out) == 4 and all(r.n_turns == len(r.roles) for r in out)
    assert transcripts.parse_conversations(convs.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, None), (2, ""), (3, " \n ")], "conv_id long, transcript string")
    assert [r.n_turns for r in transcripts.parse_transcripts(blank, small_model()).collect()] == [0, 0, 0]


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="no tables")
def test_held_out_roles(spark):
    """The query parses every conversation with a model of others; a third of the styles has no word of a role."""
    from docbraid.llm import queries

    written = transcripts.write_transcripts(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")).collect()
    gold = {r.conv_id: [transcripts.ROLES[s // 2] for s in r.states if s % 2 == 0] for r in written}
    got = {r.conv_id: r.roles for r in queries.op4_transcript_roles(spark, "/root/testdata/sf0.01").collect()}
    assert got.keys() == gold.keys()
    assert np.mean([got[k] == v for k, v in gold.items()]) > 0.85


def slow_adpcm(data):
    steps, out = telephony.tables()["steps"], []
    for k in range(0, len(data), telephony.BLOCK):
        block = data[k : k + telephony.BLOCK]
        if len(block) < 4:
            continue
        v, i = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
        out.append(v)
        for byte in block[4:]:
            for n in (byte & 15, byte >> 4):
                s = int(steps[i])
                d = (s >> 3) + (s >> 2) * (n & 1) + (s >> 1) * (n >> 1 & 1) + s * (n >> 2 & 1)
                v = max(-32768, min(32767, v - d if n & 8 else v + d))
                i = max(0, min(88, i + [-1, -1, -1, -1, 2, 4, 6, 8][n & 7]))
                out.append(v)
    return out


def test_adpcm_equals_the_scalar_decoder():
    r = np.random.default_rng(0)
    parts = [r.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (0, 1, 3, 4, 5, 255, 256, 257, 259, 260, 1000)]
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    samples, at = telephony.decode_adpcm(np.frombuffer(b"".join(parts), np.uint8), ends)
    for i, p in enumerate(parts):
        assert samples[at[i] : at[i + 1]].tolist() == slow_adpcm(p)


def test_companding_tables():
    mu, a = telephony.tables()["mulaw"], telephony.tables()["alaw"]
    assert mu[0xFF] == 0 and mu[0x80] == 32124 and mu[0x00] == -32124 and (mu[:127] < 0).all()
    assert a[0xD5] == 8 and a[0x55] == -8 and a[0xAA] == 32256 and a[0x2A] == -32256
    assert sorted(set(mu.tolist())) == sorted({-x for x in mu.tolist()}) and len(set(a.tolist())) == 256


def test_double_rate_keeps_samples_and_signals_apart():
    x = np.concatenate([np.full(50, 1000), np.round(8000 * np.sin(np.arange(200) / 5))]).astype(np.int16)
    y = telephony.double_rate(x, np.array([0, 50, 50, 250]))
    assert (y[::2] == x).all() and abs(y[51] - 1000) < 25
    between = 8000 * np.sin((np.arange(200) + 0.5) / 5)
    assert np.abs(y[101::2][20:-20] - between[20:-20]).max() < 60


def test_audio(spark):
    rows = [(1, bytearray(b"abcdef"), "mulaw"), (1, bytearray(b"abcdef"), "mulaw"), (2, None, "alaw"), (3, bytearray(b""), "alaw"), (4, bytearray(b"abc"), "opus"), (None, bytearray(b"abcdefg"), "ima_adpcm"), (5, bytearray(b"x" * 300000), "alaw"), (6, bytearray(b"x"), None)]
    df = spark.createDataFrame([(*r, "pcm") for r in rows], "id long, payload binary, codec string, pcm string")
    out = telephony.decode_audio(df, "id", "payload", "codec").collect()
    assert len(out) == 8
    by = {r.call_id: r for r in out}
    assert by[1].n_samples == 12 and len(by[1].pcm) == 24 and by[2].pcm is None and bytes(by[3].pcm) == b"" and by[4].pcm is None and by[6].pcm is None
    assert by[None].n_samples == 2 * 7 and by[5].n_samples == 600000
    named = telephony.decode_audio(df.withColumn("id", F.concat(F.lit("c"), "id")), "id", "payload", "codec").collect()
    assert sorted(str(r.call_id) for r in named) == sorted("None" if r.call_id is None else f"c{r.call_id}" for r in out)
    assert telephony.decode_audio(df.filter(F.lit(False)), "id", "payload", "codec").count() == 0
