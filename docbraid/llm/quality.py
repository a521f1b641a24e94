"""Quality rules by distribution divergence.

A document's histogram of character classes and its histogram of the common
words of its language are compared, by Jensen-Shannon distance (the root of the
divergence in bits), with the language's reference: the mean of these histograms
over the documents of a trusted table where one is given, else over the nearer
half of the corpus, each document with the same weight, so that no long one makes
the reference its own. The nearer half are the documents no farther from the mean
of all than the median one: junk, unless it is most of a language, has no part in
what it is held against. Prose stays close to its language; menus, symbol soup,
shouting and repetition do not.

The histograms are counted in Arrow batches, once for the references and once for
the scores; sums and medians are Spark aggregations over the histograms, so no
text is ever shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docbraid.llm import textkernel as tk
from docbraid.llm.common import checked_broadcast, list_column, materialise, slices

COMMON_WORDS: dict[str, tuple[str, ...]] = {
    "en": tuple("the of and to a in is that it for was on with as be by this are at from not or have an they which you had we there can all been has will one if their more when".split()),
    "de": tuple("der die und in den von zu das mit sich des auf für ist im nicht dem ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über".split()),
    "fr": tuple("de la le et les des en un du une que pour est par qui dans avec sur pas au il plus ne se ce son cette aux mais ou sont nous ses ont elle leur comme même été faire".split()),
    "es": tuple("de la que el en y los se del las un por con no su una para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son donde".split()),
}
N_WORDS = 40
#: A document counts in its language's reference by its shares, in so many parts, whatever its length.
PARTS = 1_000_000
#: Documents of fewer words are kept: a short sample diverges by chance alone.
MIN_WORDS = 40
#: The square of a distance may be base + noise / n_words: the chance divergence of n draws falls as 1 / n.
CLASS_BASE, CLASS_NOISE = 0.03, 2.0
WORD_BASE, WORD_NOISE = 0.06, 5.0
#: Texts of so many bytes, and rows of so many histograms, are worked on at once: a worker's arrays take up to 60 times the former.
PART_BYTES, PART_ROWS = 1 << 18, 1024


def _lists() -> tuple[list[str], np.ndarray, np.ndarray]:
    langs = sorted(COMMON_WORDS)
    hashes = np.stack([tk.hash_words(list(COMMON_WORDS[x])) for x in langs])
    order = np.argsort(hashes, axis=1)
    return langs, np.take_along_axis(hashes, order, 1), order


def _histograms(texts: pa.Array, langs: pa.Array) -> pa.Array:
    """Per text: class counts, then counts of the language's common words, then of other words."""
    known, hashes, order = _lists()
    width, parts, at = tk.N_CLASSES + N_WORDS + 1, [], 0
    codes = np.array([known.index(x) if x in known else -1 for x in langs.to_pylist()], np.int64)
    for part in slices(texts, PART_BYTES):
        n = len(part)
        points, offsets = tk.code_points(part)
        words = tk.words(points, offsets)
        code = codes[at : at + n][words.owner]
        place = np.full(len(words.hashes), N_WORDS, np.int64)
        for k in range(len(known)):
            own = np.flatnonzero(code == k)
            if len(own):
                found = np.minimum(np.searchsorted(hashes[k], words.hashes[own]), N_WORDS - 1)
                hit = hashes[k][found] == words.hashes[own]
                place[own[hit]] = order[k][found[hit]]
        counted = np.bincount(words.owner * (N_WORDS + 1) + place, minlength=n * (N_WORDS + 1))
        parts.append(np.hstack([tk.class_histogram(points, offsets), counted.reshape(n, -1)]))
        at += n
    flat = np.concatenate(parts) if parts else np.empty((0, width), np.int64)
    return list_column(flat.ravel(), np.arange(len(flat) + 1) * width, pa.int64())


def _histogram(text: Column, lang: Column) -> Column:
    @F.arrow_udf("array<long>")
    def histogram(texts: pa.Array, langs: pa.Array) -> pa.Array:
        return _histograms(texts, langs)

    return histogram(text, lang)


def _jsd(mine: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence, base 2, row by row; 0 where either side is empty."""
    sizes = mine.sum(axis=1), reference.sum(axis=1)
    p, q = mine / np.maximum(sizes[0], 1)[:, None], reference / np.maximum(sizes[1], 1)[:, None]
    m = (p + q) / 2
    part = lambda x: np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0).sum(axis=1)
    return np.where((sizes[0] > 0) & (sizes[1] > 0), np.maximum(part(p) + part(q), 0) / 2, 0.0)


def _divergences(mine: pa.Array, references: pa.Array) -> pa.Array:
    k, width = tk.N_CLASSES, tk.N_CLASSES + N_WORDS + 1
    columns = [np.empty(0)], [np.empty(0)], [np.empty(0, np.int64)]
    for low in range(0, len(mine), PART_ROWS):
        own, other = mine.slice(low, PART_ROWS), references.slice(low, PART_ROWS)
        known = other.is_valid().to_numpy(zero_copy_only=False).astype(bool)
        a, b = own.flatten().to_numpy(zero_copy_only=False).reshape(-1, width), np.zeros((len(own), width), np.int64)
        b[known] = other.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        for column, values in zip(columns, (_jsd(a[:, :k], b[:, :k]), _jsd(a[:, k:], b[:, k:]), a[:, k:].sum(axis=1)), strict=True):
            column.append(values)
    return pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in columns], ["class", "word", "n_words"])


_DIVERGENCE = "struct<class:double,word:double,n_words:long>"


def _scores(text: Column, lang: Column, reference: Column) -> Column:
    @F.arrow_udf(_DIVERGENCE)
    def scores(texts: pa.Array, langs: pa.Array, references: pa.Array) -> pa.Array:
        return _divergences(_histograms(texts, langs), references)

    return scores(text, lang, reference)


def _mean(counted: DataFrame) -> DataFrame:
    """(rl, ref) of (l, h): the mean histogram of each language, every document in PARTS parts."""
    k, n = tk.N_CLASSES, tk.N_CLASSES + N_WORDS + 1
    total = lambda low, high: F.aggregate(F.slice("h", low + 1, high - low), F.lit(0).cast("long"), lambda a, v: a + v)
    sized = counted.select("l", "h", total(0, k).alias("chars"), total(k, n).alias("words"))
    shares = [F.coalesce(F.sum(F.expr(f"h[{i}] * {PARTS} div nullif({'chars' if i < k else 'words'}, 0)")), F.lit(0).cast("long")) for i in range(n)]
    return checked_broadcast(sized.groupBy("l").agg(F.array(*shares).alias("ref")).withColumnRenamed("l", "rl"), 1000)


def _nearer_half(counted: DataFrame) -> DataFrame:
    """The (l, h) that have MIN_WORDS and are no farther from the mean of their language than its median."""

    @F.arrow_udf(_DIVERGENCE)
    def divergence(mine: pa.Array, references: pa.Array) -> pa.Array:
        return _divergences(mine, references)

    met = counted.join(_mean(counted), F.col("l").eqNullSafe(F.col("rl")), "left").select("l", "h", divergence("h", "ref").alias("d"))
    placed = materialise(met.filter(F.col("d.n_words") >= MIN_WORDS).select("l", "h", F.round(F.col("d.class") + F.col("d.word"), 4).alias("d")))
    steps = placed.groupBy("l", "d").count()  # at most 20,001 steps a language
    own = Window.partitionBy("l")
    cut = steps.withColumns({"upto": F.sum("count").over(own.orderBy("d")), "all": F.sum("count").over(own)})
    median = cut.filter("2 * upto >= all").groupBy("l").agg(F.min("d").alias("median")).withColumnRenamed("l", "ml")
    return placed.join(checked_broadcast(median, 100), F.col("l").eqNullSafe(F.col("ml"))).filter("d <= median").select("l", "h")


def _scored(docs: DataFrame, text: str, lang: str, trusted: DataFrame | None) -> DataFrame:
    """(row struct, n_words, class_distance, word_distance, rejected) for every row of docs."""
    counted = materialise((docs if trusted is None else trusted).select(F.col(lang).alias("l"), _histogram(F.col(text), F.col(lang)).alias("h")))
    references = _mean(_nearer_half(counted) if trusted is None else counted)
    rows = docs.select(F.struct("*").alias("row"))  # each text once: all columns of a batch wait in memory for its scores
    said, spoken = F.col("row")[text], F.col("row")[lang]
    joined = rows.join(references, spoken.eqNullSafe(F.col("rl")), "left")
    listed = spoken.isin(*COMMON_WORDS)
    compared = joined.select("row", _scores(said, spoken, F.col("ref")).alias("d"))
    scored = compared.select(
        "row",
        F.col("d.n_words").alias("n_words"),
        F.round(F.sqrt("d.class"), 6).alias("class_distance"),
        F.round(F.sqrt(F.when(listed, F.col("d.word"))), 6).alias("word_distance"),
    )
    limit = lambda base, noise: F.sqrt(F.lit(base) + F.lit(noise) / F.col("n_words"))
    far = (F.col("class_distance") > limit(CLASS_BASE, CLASS_NOISE)) | (F.coalesce("word_distance", F.lit(0.0)) > limit(WORD_BASE, WORD_NOISE))
    return scored.withColumn("rejected", F.when(F.col("n_words") < MIN_WORDS, F.lit(False)).otherwise(far))


def quality_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", trusted: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_words, class_distance, word_distance, rejected), one row for every row of docs.

    The references come from trusted, a table with the same text and lang columns,
    or else from the documents of MIN_WORDS in docs. Null and empty texts have no words and are never rejected; a
    language without a word list (null included) has a null word_distance and is
    judged by its character classes alone, against that same language; one without
    any reference is at distance 0. Repeated rows count and
    appear as often as they occur. Very long texts are read whole. Other columns
    of docs, whatever their names, play no part. An empty table gives an empty
    result.
    """
    return _scored(docs, text, lang, trusted).select(F.col("row")[doc_id].alias("doc_id"), "n_words", "class_distance", "word_distance", "rejected")


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", trusted: DataFrame | None = None) -> DataFrame:
    """The rows of docs that quality_scores does not reject, with all columns of docs.

    Null, empty and short texts stay; a repeated row stays or goes as often as it
    occurs. An empty table gives an empty result.
    """
    return _scored(docs, text, lang, trusted).filter(~F.col("rejected")).select("row.*")


def _oracle() -> str:
    cut = lambda p: f"length(regexp_replace(text, '[^{p}]', '', 'g'))"
    sentence = ".,;:?''\"()\\-"
    classes = [
        cut("\\p{Lu}"), cut("\\p{Ll}"), cut("\\p{Lt}\\p{Lm}\\p{Lo}\\p{M}"), cut("\\p{N}"),
        cut("\\p{Z}\\t\\n\\v\\f\\r\\x{1c}-\\x{1f}\\x{85}"), cut(sentence),
        f"length(regexp_replace(regexp_replace(text, '[{sentence}#%&*@\\\\]', '', 'g'), '[^\\p{{P}}]', '', 'g'))",
        cut("\\p{S}#%&*@\\\\"),
    ]
    names = [f"c{i}" for i in range(9)]
    lists = " UNION ALL ".join(f"SELECT '{k}' AS l, {i} AS place, '{w}' AS word" for k, v in COMMON_WORDS.items() for i, w in enumerate(v))
    jsd = lambda p, q: f"((CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END) + (CASE WHEN {q} > 0 THEN {q} * log2({q} / (({p} + {q}) / 2)) ELSE 0 END)) / 2"

    def judged(ref: str, members: str) -> str:
        """References from some rows, and the scores of all rows against them; names end in ref."""
        return f"""
class_ref{ref} AS (SELECT lang, place, coalesce(sum(v * {PARTS} // nullif(t, 0)), 0) AS v FROM (SELECT *, sum(v) OVER (PARTITION BY r) AS t FROM classes WHERE {members}) GROUP BY ALL),
class_share{ref} AS (SELECT c.r, c.v / nullif(sum(c.v) OVER (PARTITION BY c.r), 0) AS p, f.v / nullif(sum(f.v) OVER (PARTITION BY c.r), 0) AS q
  FROM classes c JOIN class_ref{ref} f ON c.place = f.place AND c.lang IS NOT DISTINCT FROM f.lang),
class_jsd{ref} AS (SELECT r, coalesce(sum({jsd('p', 'q')}), 0) AS j FROM class_share{ref} GROUP BY r),
word_ref{ref} AS (SELECT n.lang, mine.place, sum(mine.v * {PARTS} // n.n_words) AS v FROM mine JOIN n USING (r) WHERE {members} GROUP BY ALL),
both{ref} AS (SELECT r, place FROM mine UNION SELECT n.r, f.place FROM n JOIN word_ref{ref} f ON n.lang IS NOT DISTINCT FROM f.lang),
word_share{ref} AS (SELECT n.r, coalesce(mine.v, 0) / n.n_words AS p, coalesce(f.v, 0) / sum(f.v) OVER (PARTITION BY n.r) AS q
  FROM n JOIN both{ref} b USING (r) LEFT JOIN word_ref{ref} f ON n.lang IS NOT DISTINCT FROM f.lang AND f.place = b.place LEFT JOIN mine ON mine.r = n.r AND mine.place = b.place WHERE n.n_words > 0),
word_jsd{ref} AS (SELECT r, sum({jsd('p', 'q')}) AS j FROM word_share{ref} GROUP BY r),
scored{ref} AS (SELECT n.r, n.doc_id, n.n_words, round(sqrt(greatest(class_jsd{ref}.j, 0)), 6) AS class_distance,
  CASE WHEN n.lang IN ({', '.join(f"'{x}'" for x in COMMON_WORDS)}) THEN round(sqrt(greatest(coalesce(word_jsd{ref}.j, 0), 0)), 6) END AS word_distance
  FROM n LEFT JOIN class_jsd{ref} USING (r) LEFT JOIN word_jsd{ref} USING (r)),
judged{ref} AS (SELECT *, n_words >= {MIN_WORDS} AND (coalesce(class_distance, 0) > sqrt({CLASS_BASE} + {CLASS_NOISE} / n_words) OR coalesce(word_distance, 0) > sqrt({WORD_BASE} + {WORD_NOISE} / n_words)) AS rejected FROM scored{ref})"""

    return f"""
WITH raw AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text FROM documents),
counted AS (SELECT r, lang, length(text) AS total, {', '.join(f'{e} AS c{i}' for i, e in enumerate(classes))} FROM raw),
classes AS (SELECT r, lang, unnest([{', '.join(names[:8])}, total - {' - '.join(names[:8])}]) AS v, unnest(range(9)) AS place FROM counted),
lists AS ({lists}),
said AS (SELECT r, lang, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}]+')) AS word FROM raw),
placed AS (SELECT said.r, said.lang, coalesce(lists.place, {N_WORDS}) AS place FROM said LEFT JOIN lists ON lists.l = said.lang AND lists.word = said.word),
mine AS (SELECT r, place, count(*) AS v FROM placed GROUP BY ALL),
n AS (SELECT raw.r, raw.doc_id, raw.lang, coalesce(sum(mine.v), 0)::BIGINT AS n_words FROM raw LEFT JOIN mine USING (r) GROUP BY ALL),{judged('1', 'true')},
near AS (SELECT n.r, n.lang, round(coalesce(c.j, 0) + coalesce(w.j, 0), 4) AS d FROM n LEFT JOIN class_jsd1 c USING (r) LEFT JOIN word_jsd1 w USING (r) WHERE n_words >= {MIN_WORDS}),
half AS (SELECT r FROM near JOIN (SELECT lang, quantile_disc(d, 0.5) AS m FROM near GROUP BY lang) k ON near.lang IS NOT DISTINCT FROM k.lang WHERE d <= m),{judged('2', 'r IN (SELECT r FROM half)')}
SELECT doc_id, n_words, coalesce(class_distance, 0) AS class_distance, word_distance, rejected FROM judged2
"""


ORACLE = _oracle()
