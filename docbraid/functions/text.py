"""Text functions as Spark columns. Java's \\s is ASCII; (?U) makes it Unicode where the semantics need it.

What reads a text character by character or word by word runs in Arrow batches,
see kernels; such a column can't stand inside a lambda.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from docbraid.functions import kernels

#: code: (name, script, inclusive code-point ranges, right to left)
LANGUAGES: dict[str, tuple[str, str, tuple[tuple[int, int], ...], bool]] = {
    "en": ("English", "Latin", ((0x41, 0x24F),), False),
    "hi": ("Hindi", "Devanagari", ((0x900, 0x97F), (0xA8E0, 0xA8FF)), False),
    "mr": ("Marathi", "Devanagari", ((0x900, 0x97F), (0xA8E0, 0xA8FF)), False),
    "pa": ("Punjabi", "Gurmukhi", ((0xA00, 0xA7F),), False),
    "bn": ("Bengali", "Bengali", ((0x980, 0x9FF),), False),
    "gu": ("Gujarati", "Gujarati", ((0xA80, 0xAFF),), False),
    "ta": ("Tamil", "Tamil", ((0xB80, 0xBFF),), False),
    "te": ("Telugu", "Telugu", ((0xC00, 0xC7F),), False),
    "kn": ("Kannada", "Kannada", ((0xC80, 0xCFF),), False),
    "or": ("Odia", "Odia", ((0xB00, 0xB7F),), False),
    "ur": ("Urdu", "Arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)), True),
    "as": ("Assamese", "Bengali-Assamese", ((0x980, 0x9FF),), False),
    "ml": ("Malayalam", "Malayalam", ((0xD00, 0xD7F),), False),
}
#: Codes of the translation models.
FLORES = {"en": "eng_Latn", "hi": "hin_Deva", "mr": "mar_Deva", "pa": "pan_Guru", "bn": "ben_Beng", "gu": "guj_Gujr", "ta": "tam_Taml", "te": "tel_Telu", "kn": "kan_Knda", "or": "ory_Orya", "ur": "urd_Arab", "as": "asm_Beng", "ml": "mal_Mlym"}
TARGETS = tuple(x for x in LANGUAGES if x != "en")
#: First match wins; the label is what the leak check compares with a target.
SCRIPT_LABELS = (("hi/mr", 0x900), ("bn/as", 0x980), ("pa", 0xA00), ("gu", 0xA80), ("or", 0xB00), ("ta", 0xB80), ("te", 0xC00), ("kn", 0xC80), ("ml", 0xD00))
LABEL_RANGES = (*((label, start, start + 0x7F) for label, start in SCRIPT_LABELS), ("ur", 0x600, 0x6FF))
#: Not counted by script_ratio: controls, ASCII below A, white space, general punctuation.
SKIPPED = r"[\x{0}-\x{40}\x{A0}\x{1680}\x{2000}-\x{206F}\x{3000}\x{FEFF}]"
SKIPPED_RANGES = ((0, 0x40), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x206F), (0x3000, 0x3000), (0xFEFF, 0xFEFF))
URL = r"https?://\S+|www\.\S+|\S+@\S+\.\S+"
WORD = r"[A-Za-z][A-Za-z\-']{1,}"


def trimmed(c: Column) -> Column:
    """Without white space (Unicode) at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def script_ratio(text: Column, lang: str) -> Column:
    """Share of the letter-like characters that belong to the language's script; 1 for none, 0 for an unknown language."""
    if lang not in LANGUAGES:
        return F.lit(0.0)
    ranges = LANGUAGES[lang][2]

    @F.arrow_udf("double")
    def share(column: pa.Array) -> pa.Array:
        return kernels.joined((pa.array(kernels.shares(x, ranges, SKIPPED_RANGES), pa.float64()) for (x,) in kernels.sliced([column])), pa.float64())

    return share(text)


def latin_ratio(text: Column) -> Column:
    return script_ratio(text, "en")


def has_indic(text: Column) -> Column:
    """Label of the first script block that occurs, or null."""

    @F.arrow_udf("string")
    def label(column: pa.Array) -> pa.Array:
        return kernels.mapped(lambda t: kernels.first_block(t, LABEL_RANGES), pa.string(), column)

    return label(text)


def english_words(text: Column) -> Column:
    """Prose-like English words in order: no addresses, short capital acronyms or longer capitalised words."""

    @F.arrow_udf("array<string>")
    def words(column: pa.Array) -> pa.Array:
        return kernels.mapped(kernels.english_words, pa.list_(pa.string()), column)

    return words(text)


def longest_english_run(text: Column) -> Column:
    """Most consecutive English tokens; capitalised words of any length and acronyms end a run; 0 for null."""

    @F.arrow_udf("int")
    def run(column: pa.Array) -> pa.Array:
        return kernels.mapped(kernels.english_run, pa.int32(), column)

    return run(text)


def leaks(text: Column, min_words: int = 3, target: str | None = None) -> Column:
    """struct(label, run, kind): has_indic, longest_english_run and leak_kind of one reading, made once wherever the plan needs it."""
    kinds = pa.struct([("label", pa.string()), ("run", pa.int32()), ("kind", pa.string())])

    @F.arrow_udf("struct<label:string,run:int,kind:string>")
    def found(column: pa.Array) -> pa.Array:
        return kernels.mapped(lambda t: kernels.leak(t, LABEL_RANGES, min_words, target), kinds, column)

    return found.asNondeterministic()(text)


def leak_kind(text: Column, min_words: int = 3, target: str | None = None) -> Column:
    """'mixed', 'full_english' or null."""
    return leaks(text, min_words, target)["kind"]


def preview(text: Column, most: int = 240) -> Column:
    half = most // 2
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(half)), F.lit(" […] "), F.right(text, F.lit(half))))


def length_divergence(a: Column, b: Column) -> Column:
    """Longer over shorter length; null if either is empty."""
    x, y = F.length(a), F.length(b)
    return F.when((x > 0) & (y > 0), F.greatest(x, y) / F.greatest(F.lit(1), F.least(x, y)))


def doc_type(filename: Column, mime: Column) -> Column:
    """TXT, DOCX or PDF_TEXT by extension or mime type; TXT by default."""
    ext = F.lower(F.element_at(F.split(filename, r"\."), -1))
    word = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
    is_mime = lambda m: F.coalesce(mime == m, F.lit(False))
    return (
        F.when((ext == "txt") | is_mime("text/plain"), "TXT")
        .when((ext == "docx") | is_mime(word), "DOCX")
        .when((ext == "pdf") | is_mime("application/pdf"), "PDF_TEXT")
        .otherwise("TXT")
    )


def storage_key(job_id: Column, filename: Column) -> Column:
    clean = F.left(F.regexp_replace(filename, r"[^A-Za-z0-9_.\-]+", "_"), F.lit(200))
    return F.concat(F.lit("jobs/"), job_id, F.lit("/source/"), clean)


def export_name(filename: Column, lang: Column, output: Column) -> Column:
    """Base of the source, the language, the extension of the output."""
    base = F.regexp_replace(filename, r"\.[^.]+\z", "")
    return F.concat(base, F.lit("-"), lang, F.lit("."), F.element_at(F.split(output, r"\."), -1))


def half_up(x: Column) -> Column:
    """Rounds halves up, also below zero."""
    return F.floor(x + 0.5)


def text_progress(done: Column, failed: Column, total: Column) -> Column:
    return (20 + half_up(70 * (done + failed) / F.greatest(total, F.lit(1)))).cast("int")


def pdf_progress(done: Column, total: Column) -> Column:
    return F.least(F.lit(94), 10 + half_up(84 * done / F.greatest(total, F.lit(1)))).cast("int")


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def text_colour(r: Column, g: Column, b: Column) -> Column:
    """Black on light, white on dark backgrounds; components are 0 to 1."""
    return F.when(luminance(r, g, b) > 0.55, "black").otherwise("white")


def regional_code(lang: Column) -> Column:
    return F.when(lang == "or", "od-IN").otherwise(F.concat(lang, F.lit("-IN")))


def model_code(lang: Column) -> Column:
    """The model's code of a language, or null."""
    return F.element_at(F.create_map(*[F.lit(x) for p in FLORES.items() for x in p]), lang)


def try_int(c: Column, default: int = -1) -> Column:
    return F.coalesce(c.try_cast("int"), F.lit(default))


def try_float(c: Column, default: float = -1.0) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(default))


def placeholder(text: Column, word: str = "शब्द ") -> Column:
    """A fixed word repeated by the length of the text."""
    return F.repeat(F.lit(word), F.greatest(F.lit(1), F.floor(F.length(text) / 8)).cast("int"))


def page_numbers(spec: Column, n: Column) -> Column:
    """Zero-based pages of a selection such as 1-3,7: order and repeats kept, others dropped, empty is all."""
    part = F.transform(F.split(spec, ","), lambda p: F.trim(p))

    def span(p: Column) -> Column:
        ends = F.split(p, "-")
        low, high = ends[0].cast("int") - 1, F.element_at(ends, -1).cast("int") - 1
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    chosen = F.flatten(F.transform(part, span))
    every = F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(F.coalesce(spec, F.lit("")) == "", every).otherwise(F.filter(chosen, lambda p: (p >= 0) & (p < n)))


def mock_translate(text: Column, lang: str, keep: dict[str, str] | None = None, verbatim: tuple[str, ...] = ()) -> Column:
    """Deterministic pseudo-translation: white space, punctuation and numbers stay, words become words of the script.

    keep maps lower-case words to their fixed renderings; verbatim words stay. It
    is an engine call: the plan makes it once, wherever it needs the reply. Null
    stays null and costs nothing.
    """
    base = LANGUAGES[lang][2][0][0] + 0x20 if lang in LANGUAGES else 0x920
    fixed, stays = tuple((keep or {}).items()), frozenset(v.lower() for v in verbatim)

    @F.arrow_udf("string")
    def said(column: pa.Array) -> pa.Array:
        return kernels.joined((pa.array(kernels.mock(x, base, fixed, stays), pa.string()) for (x,) in kernels.sliced([column])), pa.string())

    return said.asNondeterministic()(text)
