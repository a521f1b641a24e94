"""Awkward documents that every operator must survive."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, k1 long, row string, node string, size long"
PROSE = "The cat sat on the mat and it was glad of that. "


def awkward(spark, extra=()):
    """Nulls everywhere, empty and blank texts, repeated rows, ties, a very long text, clashing column names."""
    long = PROSE * 4000
    rows = [
        (1, PROSE * 3, "en", "a"),
        (1, PROSE * 3, "en", "a"),
        (2, PROSE * 3, "en", "b"),
        (3, "", "en", "a"),
        (4, "", None, None),
        (5, None, "en", "a"),
        (None, None, None, None),
        (None, "word", "xx", ""),
        (6, " \n\t ", "fr", "c"),
        (7, "!!! ??? ...", "fr", "c"),
        (8, long, "en", "d"),
        (9, "naïve 𝒳 ▁ 日本語 mixed", "de", "e"),
        *extra,
    ]
    full = [(*r, None if r[1] is None else len(r[1]), "x", 7, "row", "node", 1) for r in rows]
    return spark.createDataFrame(full, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
