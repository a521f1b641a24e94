"""Secret scans by corpus-wide ownership frequency.

Candidates are cut from the text by one regular expression, hashed, and counted
over the whole corpus by distinct documents, repositories and owners. A value
that many owners hold is an example that was copied around; one that few hold
and that looks random is a live credential.
"""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docbraid.llm.common import fits, materialise, row_key

_KEYWORD = r"(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Pp]assword|PASSWORD|[Pp]asswd|[Aa]pi[_-]?[Kk]ey|API[_-]?KEY|[Pp]rivate[_-]?[Kk]ey|PRIVATE[_-]?KEY)"
#: Words that may follow a keyword (_KEY, _access_key, AccessKey), and the separator.
_ASSIGNED = r"""(?:[_A-Z-][A-Za-z0-9_-]*)?["']?[ \t]*(?:=|:)[ \t]*"""
_BRANCHES = (
    rf"""{_KEYWORD}{_ASSIGNED}(?:"([^"\s]{{8,}})"|'([^'\s]{{8,}})')""",
    rf"""(?:[Pp]assword|PASSWORD|[Pp]asswd){_ASSIGNED}["']?([A-Za-z0-9_/+.\-&!@#$%^*?~=]{{8,}})""",
    rf"""{_KEYWORD}{_ASSIGNED}["']?([A-Za-z0-9_/+.\-]{{16,}})""",
    r"""-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:([\s\S]+?)-----END|([A-Za-z0-9+/=\\\s]{16,}))""",
    r"""(?:[Bb]earer|BEARER)[ \t]+([A-Za-z0-9_.~+/=-]{16,})""",
    r"""\b(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*)""",
    r"""://[^\s/:@"'<>]*:([^\s/@"'<>]{8,})@""",
    r"""\b(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{35})""",
)
#: One of its groups is the value. Keyed assignments, and formats that show what they are.
PATTERN = "|".join(_BRANCHES)
_GROUPS = re.compile(PATTERN).groups
#: Every match of PATTERN contains one of these.
ANCHORS = (
    *("oken", "OKEN", "ecret", "ECRET", "assword", "ASSWORD", "asswd"),
    *(f"{a}{b}{c}" for a, k in (("pi", ("key", "Key")), ("PI", ("KEY",))) for b in ("_", "-", "") for c in k),
    *("rivatekey", "rivateKey", "rivate_key", "rivate_Key", "rivate-key", "rivate-Key", "PRIVATEKEY", "PRIVATE_KEY", "PRIVATE-KEY", "PRIVATE KEY"),
    *("earer", "BEARER", "eyJ", "://"),
    *("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk-", "AIza"),
)
#: Values that more owners hold are copied examples.
MAX_OWNERS = 2
#: A live-looking value has this many different characters, digits among them, and no word of PLACEHOLDER.
MIN_DISTINCT = 8
PLACEHOLDER = "example|sample|dummy|placeholder|changeme|your|xxxx"
#: Nor is it, as a whole, part of one of these: digits and letters in their order.
SERIES = "0123456789012345678901234567890123456789|abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyz|1234567890abcdefghijklmnopqrstuvwxyz|0123456789abcdef0123456789abcdef0123456789abcdef|abcdef0123456789abcdef0123456789abcdef0123456789|abcdef1234567890abcdef1234567890abcdef1234567890|1234567890abcdef1234567890abcdef1234567890abcdef"


def candidates(text: Column) -> Column:
    """Distinct candidate values of a text, sorted; empty for null.

    Only texts that hold an anchor, which every match contains, meet the expression.
    """
    possible = functools.reduce(operator.or_, [text.contains(a) for a in ANCHORS])
    value = lambda m: F.concat(*[F.regexp_extract(m, PATTERN, n + 1) for n in range(_GROUPS)])
    found = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), value)))
    return F.when(possible, found).otherwise(F.array().cast("array<string>"))


def _looks_live(value: Column) -> Column:
    kinds = F.size(F.array_distinct(F.filter(F.split(value, ""), lambda c: c != "")))
    counted = F.lit(SERIES).contains(F.regexp_replace(F.lower(value), "[^a-z0-9]", ""))
    return (kinds >= MIN_DISTINCT) & value.rlike("[0-9]") & ~F.lower(value).rlike(PLACEHOLDER) & ~counted


def _verdicts(found: DataFrame) -> DataFrame:
    """One row for each hash: counts by distinct documents, repositories, owners, and the verdict."""
    counted = found.groupBy("secret_hash").agg(
        F.countDistinct("doc").alias("n_docs"),
        F.countDistinct("repository").alias("n_repositories"),
        F.countDistinct("owner").alias("n_owners"),
        F.first("live").alias("live"),
    )
    return counted.withColumn("verdict", F.when(F.col("n_owners") > MAX_OWNERS, "copied_example").when(F.col("live"), "live").otherwise("placeholder"))


def _found(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    listed = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(text).alias("text"),
        F.coalesce(F.col(source), F.lit("")).alias("repository"),
        candidates(F.col(text)).alias("values"),
    ).filter(F.size("values") > 0)
    k1, k2 = row_key(F.col("doc_id"), F.col("text"))
    exploded = listed.select("doc_id", k1.alias("k1"), k2.alias("k2"), "repository", F.explode("values").alias("value"))
    return exploded.withColumns(
        {
            "doc": F.struct("k1", "k2"),
            "owner": F.substring_index("repository", "/", 1),
            "secret_hash": F.sha2("value", 256),
            "live": _looks_live(F.col("value")),
        }
    )


def secret_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, secret_hash, n_docs, n_repositories, n_owners, verdict), a row for each document and candidate.

    The source is the repository and its part before the first slash the owner;
    a null source counts as one repository and owner of its own, "". Null and
    empty texts hold no candidate. A value that repeats in a document counts
    once; a row repeated in full counts as one document but appears as often as
    it occurs. Values are never returned, only their SHA-256. verdict is
    "copied_example" (over MAX_OWNERS owners), "live" or "placeholder".
    Other columns of docs play no part. An empty table gives an empty result.
    """
    found = _found(docs, doc_id, text, source)
    report = found.select("doc_id", "secret_hash").join(_verdicts(found), "secret_hash")
    return report.select("doc_id", "secret_hash", "n_docs", "n_repositories", "n_owners", "verdict")


def redact_live(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", n_chars: str | None = "n_chars") -> DataFrame:
    """docs with every live secret replaced by [SECRET], all rows and columns kept.

    One pass finds the candidates, of which only hashes are stored; the
    rows of the documents with live ones, if they are few enough to be
    broadcast, meet the table by key, and only their texts are searched again.
    Beyond that only the rows that hold candidates are shuffled. Longer secrets
    are replaced first, so none is left as a part of another. Null and
    empty texts stay as they are, rows repeated in full are redacted alike, a
    text of any length is searched whole. n_chars, if docs has it, follows the
    new text. An empty table gives an empty result.
    """
    found = materialise(_found(docs, doc_id, text, source).select("k1", "k2", "doc", "repository", "owner", "secret_hash", "live"))
    live = _verdicts(found).filter("verdict = 'live'").select("secret_hash")
    holders = materialise(found.join(live, "secret_hash").groupBy("k1", "k2").agg(F.collect_set("secret_hash").alias("live")))
    k1, k2 = row_key(F.col(doc_id), F.col(text))
    keyed = docs.select(F.struct("*").alias("row"), k1.alias("k1"), k2.alias("k2"))
    if fits(holders, 64 + 72 * F.size("live")):
        joined, rest = keyed.join(F.broadcast(holders), ["k1", "k2"], "left"), None
    else:
        holds = F.size(candidates(F.col(f"row.`{text}`"))) > 0
        joined, rest = keyed.filter(holds).join(holders, ["k1", "k2"], "left"), keyed.filter(~holds).select("row.*")
    old = F.col(f"row.`{text}`")
    item = lambda v: F.struct((-F.length(v)).alias("size"), v.alias("value"))
    values = F.array_sort(F.transform(F.filter(candidates(old), lambda v: F.array_contains("live", F.sha2(v, 256))), item))
    clean = F.aggregate(values, old, lambda t, x: F.replace(t, x["value"], F.lit("[SECRET]")))
    made = joined.select("row", F.when(F.col("live").isNull(), old).otherwise(clean).alias("clean"), F.col("live").isNotNull().alias("changed"))
    columns = []
    for name in docs.columns:
        own = F.col(f"row.`{name}`")
        if name == text:
            columns.append(F.col("clean").alias(text))
        elif name == n_chars:
            columns.append(F.when(F.col("changed"), F.length("clean").cast(docs.schema[name].dataType)).otherwise(own).alias(name))
        else:
            columns.append(own.alias(name))
    out = made.select(*columns)
    return out if rest is None else rest.unionByName(out)


def _oracle() -> str:
    quoted = PATTERN.replace("'", "''")
    groups = ", ".join(f"regexp_extract_all(text, '{quoted}', {n + 1})" for n in range(_GROUPS))
    return f"""
WITH listed AS (SELECT doc_id, text, coalesce(source, '') AS repository,
  list_distinct(list_filter(flatten([{groups}]), lambda x: x <> '')) AS vals FROM documents WHERE regexp_matches(text, '{"|".join(ANCHORS)}')),
found AS (SELECT doc_id, text, repository, string_split(repository, '/')[1] AS owner, unnest(vals) AS value FROM listed),
counted AS (SELECT value, count(DISTINCT (doc_id, text)) AS n_docs, count(DISTINCT repository) AS n_repositories, count(DISTINCT owner) AS n_owners FROM found GROUP BY value)
SELECT doc_id, sha256(value) AS secret_hash, n_docs, n_repositories, n_owners,
  CASE WHEN n_owners > {MAX_OWNERS} THEN 'copied_example'
       WHEN list_unique(string_split(value, '')) >= {MIN_DISTINCT} AND regexp_matches(value, '[0-9]') AND NOT regexp_matches(lower(value), '{PLACEHOLDER}')
         AND NOT contains('{SERIES}', regexp_replace(lower(value), '[^a-z0-9]', '', 'g')) THEN 'live'
       ELSE 'placeholder' END AS verdict
FROM found JOIN counted USING (value)
"""


ORACLE = _oracle()
