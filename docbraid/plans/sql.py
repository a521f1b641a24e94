"""Building blocks of the DuckDB side of the queries."""

from __future__ import annotations

from docbraid.functions import text as T


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


EMPTY = "[]::VARCHAR[]"


def pieces(text: str, most: int) -> str:
    found = f"regexp_extract_all({text}, '[^.?!।]+[.?!।]+\\s*|[^.?!।]+$')"
    items = f"list_transform(CASE WHEN len({found}) > 0 THEN {found} ELSE [{text}] END, lambda s: {{'p': {EMPTY}, 'c': s}})"
    fold = f"list_reduce({items}, lambda a, x: CASE WHEN a.c <> '' AND length(a.c) + length(x.c) > {most} THEN {{'p': list_append(a.p, {trim('a.c')}), 'c': x.c}} ELSE {{'p': a.p, 'c': a.c || x.c}} END, {{'p': {EMPTY}, 'c': ''}})"
    return f"list_transform([{fold}], lambda f: CASE WHEN {trim('f.c')} <> '' THEN list_append(f.p, {trim('f.c')}) ELSE f.p END)[1]"


def parts(bare: str) -> str:
    found = f"list_filter(list_transform(regexp_extract_all({bare}, '[^.?!।]*[.?!।]+|\\S[^.?!।]*$'), lambda p: {trim('p')}), lambda p: p <> '')"
    return f"CASE WHEN len({found}) > 0 THEN {found} ELSE [{bare}] END"


def slices(s: str, size: int) -> str:
    return f"list_transform(range(0, greatest(1, length({s})), {size}), lambda o: substring({s}, o + 1, {size}))"


def _items(p: str) -> str:
    return f"list_transform({p}, lambda s: {{'p': {EMPTY}, 'c': s}})"


def _add(size: int) -> str:
    return f"CASE WHEN a.c <> '' AND length(a.c) + length(x.c) + 1 > {size} THEN {{'p': list_append(a.p, a.c), 'c': x.c}} ELSE {{'p': a.p, 'c': CASE WHEN a.c = '' THEN x.c ELSE a.c || ' ' || x.c END}} END"


def _end(fold: str) -> str:
    return f"list_transform([{fold}], lambda f: CASE WHEN f.c <> '' THEN list_append(f.p, f.c) ELSE f.p END)[1]"


def units(text: str, size: int = 280, cap: bool = True) -> str:
    bare = trim(text)
    packed = _end(f"list_reduce({_items(parts(bare))}, lambda a, x: {_add(size)}, {{'p': {EMPTY}, 'c': ''}})")
    if cap:
        packed = f"flatten(list_transform({packed}, lambda u: CASE WHEN length(u) <= {2 * size} THEN [u] ELSE {slices('u', size)} END))"
    return f"CASE WHEN {bare} = '' THEN {EMPTY} ELSE {packed} END"


def limited(text: str, limit: int = 900) -> str:
    step = f"CASE WHEN length(x.c) > {limit} THEN {{'p': (CASE WHEN a.c <> '' THEN list_append(a.p, a.c) ELSE a.p END) || {slices('x.c', limit)}, 'c': ''}} ELSE {_add(limit)} END"
    return f"CASE WHEN length({text}) <= {limit} THEN [{text}] ELSE {_end(f'list_reduce({_items(parts(text))}, lambda a, x: {step}, {{{chr(39)}p{chr(39)}: {EMPTY}, {chr(39)}c{chr(39)}: {chr(39)}{chr(39)}}})')} END"


def exploded(expr: str, table: str = "documents", name: str = "source") -> str:
    """(doc_id, idx, name) of a list expression."""
    return f"SELECT doc_id, unnest(range(len(l)))::INTEGER AS idx, unnest(l) AS {name} FROM (SELECT doc_id, {expr} AS l FROM {table})"


def rng(lang: str) -> str:
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in T.LANGUAGES[lang][2])


def ratio(text: str, lang: str) -> str:
    kept = f"regexp_replace({text}, '{T.SKIPPED}', '', 'g')"
    return f"(CASE WHEN length({kept}) = 0 THEN 1.0::DOUBLE ELSE length(regexp_replace({kept}, '[^{rng(lang)}]', '', 'g'))::DOUBLE / length({kept}) END)"


def indic(text: str) -> str:
    tests = " ".join(f"WHEN regexp_matches({text}, '[\\x{{{s:X}}}-\\x{{{s + 0x7F:X}}}]') THEN '{label}'" for label, s in T.SCRIPT_LABELS)
    return f"(CASE {tests} WHEN regexp_matches({text}, '[\\x{{600}}-\\x{{6FF}}]') THEN 'ur' END)"


_Q = "''"
_WORD = T.WORD.replace("'", _Q)


def words(text: str) -> str:
    return f"list_filter(regexp_extract_all(regexp_replace({text}, '{T.URL}', ' ', 'g'), '{_WORD}'), lambda w: NOT regexp_matches(w, '^[A-Z]{{2,4}}$') AND NOT (regexp_matches(w, '^[A-Z][a-z]+$') AND length(w) > 3))"


def run(text: str) -> str:
    bare = f"list_transform(regexp_split_to_array(regexp_replace({text}, '{T.URL}', ' ', 'g'), '\\s+'), lambda t: regexp_replace(t, '^[^A-Za-z]+|[^A-Za-z]+$', '', 'g'))"
    flag = f"list_transform({bare}, lambda w: CASE WHEN regexp_full_match(w, '{_WORD}') AND NOT regexp_matches(w, '^([A-Z]{{2,4}}|[A-Z][a-z]+)$') THEN 'E' ELSE '-' END)"
    return f"coalesce(list_max(list_transform(regexp_extract_all(array_to_string({flag}, ''), 'E+'), lambda r: length(r)))::INTEGER, 0)"


def leak(text: str, least: int = 3) -> str:
    return f"(CASE WHEN {indic(text)} IS NOT NULL AND {run(text)} >= {least} THEN 'mixed' WHEN {indic(text)} IS NULL AND len({words(text)}) > 0 THEN 'full_english' END)"


def preview(text: str) -> str:
    return f"(CASE WHEN length({text}) <= 240 THEN {text} ELSE left({text}, 120) || ' […] ' || right({text}, 120) END)"


def mock(rows: str, lang: str = "hi") -> str:
    """(doc_id, idx, source, said): rows with their pseudo-translation, token by distinct token."""
    base = T.LANGUAGES[lang][2][0][0] + 0x20
    letters = "[" + ", ".join(f"'{chr(base + i)}'" for i in range(24)) + "]"
    size = "greatest(2, least(8, length(regexp_replace(tok, '[^\\p{L}]', '', 'g'))))"
    h = "list_reduce(list_transform(string_split(tok, ''), lambda c: unicode(c)::BIGINT), lambda a, c: (a * 31 + c) % 4294967296, 0::BIGINT)"
    return f"""SELECT r.doc_id, r.idx, any_value(r.source) AS source, coalesce(string_agg(w.said, '' ORDER BY t.k), '') AS said FROM ({rows}) r
LEFT JOIN (SELECT doc_id, idx, unnest(l) AS tok, unnest(range(len(l))) AS k FROM (SELECT doc_id, idx, regexp_extract_all(source, '\\s+|\\S+') AS l FROM ({rows}))) t USING (doc_id, idx)
LEFT JOIN (SELECT tok, CASE WHEN regexp_matches(tok, '^\\s+$') OR regexp_matches(tok, '[0-9]') OR regexp_replace(lower(tok), '[^\\p{{L}}\\p{{N}}]', '', 'g') = '' THEN tok
  ELSE array_to_string(list_transform(range({size}), lambda i: {letters}[(h + 7 * i) % 24 + 1]), '') END AS said
  FROM (SELECT tok, {h} AS h FROM (SELECT DISTINCT unnest(regexp_extract_all(source, '\\s+|\\S+')) AS tok FROM ({rows})))) w USING (tok)
GROUP BY r.doc_id, r.idx"""


def routed(lang: str = "hi") -> str:
    """(doc_id, idx, source, translated, engine, ok, attempts list) of the demo engines."""
    e = "{'engine': '%s', 'success': %s, 'cost': %s, 'error': %s}"  # latencies follow from the engine: see latency()
    cost = "(length(source) * 15)::BIGINT"
    return f"""SELECT doc_id, idx, source, CASE WHEN engine IS NULL THEN source ELSE said END AS translated, engine, engine IS NOT NULL AS ok, attempts FROM (SELECT *,
CASE WHEN spot % 3 = 1 THEN 'INDICTRANS2' WHEN spot % 3 = 2 THEN 'AMAZON_TRANSLATE' WHEN spot % 7 <> 0 THEN 'MOCK' END AS engine,
CASE WHEN spot % 3 = 1 THEN [{e % ('INDICTRANS2', 'true', '0::BIGINT', 'NULL::VARCHAR')}]
 WHEN spot % 3 = 2 THEN [{e % ('INDICTRANS2', 'false', '0::BIGINT', "'call failed'")}, {e % ('AMAZON_TRANSLATE', 'true', cost, 'NULL::VARCHAR')}]
 ELSE [{e % ('INDICTRANS2', 'false', '0::BIGINT', "'call failed'")}, {e % ('AMAZON_TRANSLATE', 'false', '0::BIGINT', "CASE WHEN spot % 2 = 0 THEN 'empty output' ELSE 'call failed' END")},
  CASE WHEN spot % 7 <> 0 THEN {e % ('MOCK', 'true', '0::BIGINT', 'NULL::VARCHAR')} ELSE {e % ('MOCK', 'false', '0::BIGINT', "'call failed'")} END] END AS attempts
FROM (SELECT *, doc_id + idx AS spot FROM ({mock(exploded(units('text')), lang)})))"""


def latency(engine: str, source: str) -> str:
    """Milliseconds that a demo engine says it took."""
    return f"CASE {engine} WHEN 'INDICTRANS2' THEN length({source}) WHEN 'AMAZON_TRANSLATE' THEN 2 * length({source}) ELSE 1 END"


def heading(line: str) -> str:
    return f"""(CASE WHEN length({line}) > 90 THEN NULL WHEN regexp_matches({line}, '(?i)^(chapter|part)\\b') THEN 1 WHEN regexp_matches({line}, '(?i)^section\\b') THEN 2
 WHEN regexp_matches({line}, '^(\\d+)(\\.\\d+)*\\.?\\s+\\S') THEN least(6, length({line}) - length(replace({line}, '.', '')) + 1)
 WHEN length({line}) < 60 AND regexp_matches({line}, '[A-Za-z]') AND {line} = upper(replace({line}, 'ß', 'SS')) AND NOT regexp_matches({line}, '[.?!]$') THEN 1 END)"""


def blocks(text: str = "text") -> str:
    """(doc_id, ord, type, level, text)"""
    item = "^([-*•]|\\d+[.)])\\s+"
    return f"""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY gi, li) - 1)::INTEGER AS ord, b.type AS type, b.level::INTEGER AS level, b.text AS text FROM (
SELECT doc_id, gi, unnest(bs) AS b, unnest(range(len(bs))) AS li FROM (SELECT doc_id, gi, CASE WHEN len(ls) = 0 THEN [] WHEN len(ls) = 1 AND {heading('ls[1]')} IS NOT NULL THEN [{{'type': 'heading', 'level': {heading('ls[1]')}, 'text': ls[1]}}]
 WHEN len(list_filter(ls, lambda l: regexp_matches(l, '{item}'))) = len(ls) THEN list_transform(ls, lambda l: {{'type': 'list_item', 'level': NULL::INTEGER, 'text': regexp_replace(l, '{item}', '')}})
 ELSE [{{'type': 'paragraph', 'level': NULL::INTEGER, 'text': array_to_string(ls, ' ')}}] END AS bs
 FROM (SELECT doc_id, gi, list_filter(list_transform(string_split(g, chr(10)), lambda l: {trim('l')}), lambda l: l <> '') AS ls FROM (
 SELECT doc_id, unnest(gs) AS g, unnest(range(len(gs))) AS gi FROM (SELECT doc_id, regexp_split_to_array(replace(replace({text}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\\n{{2,}}') AS gs FROM documents)))))"""


def chunks(text: str, most: int, context: int = 240) -> str:
    """(doc_id, chunk_index, chapter_index, section_title, source_text, prev_context): one fold over the blocks of a document."""
    joined = trim("array_to_string(a.parts, chr(10) || chr(10))")
    flushed = f"(CASE WHEN {joined} <> '' THEN list_append(a.done, {{'ch': a.ch, 'se': a.se, 'tx': {joined}}}) ELSE a.done END)"
    state = lambda ch, se, parts, n, done: f"{{'ty': '', 'lv': 0, 'tx': '', 'big': {EMPTY}, 'ch': {ch}, 'se': {se}, 'parts': {parts}, 'n': {n}, 'done': {done}}}"
    none = "[]::STRUCT(ch INTEGER, se VARCHAR, tx VARCHAR)[]"
    return f"""SELECT doc_id, i::INTEGER AS chunk_index, c.ch AS chapter_index, c.se AS section_title, c.tx AS source_text,
CASE WHEN i > 0 THEN CASE WHEN length(p) <= {context} THEN p ELSE '…' || right(p, {context}) END END AS prev_context
FROM (SELECT doc_id, i, c, lag(c.tx) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM (
SELECT doc_id, unnest(range(len(cs))) AS i, unnest(cs) AS c FROM (SELECT doc_id, {flushed.replace('a.', 'f.')} AS cs FROM (
SELECT doc_id, list_reduce(items, lambda a, x: CASE
 WHEN x.ty = 'heading' THEN {state("a.ch + CASE WHEN x.lv <= 1 THEN 1 ELSE 0 END", f"CASE WHEN {trim('x.tx')} <> '' THEN {trim('x.tx')} ELSE a.se END", f"[{trim('x.tx')}]", "length(x.tx)", flushed)}
 WHEN len(x.big) > 0 THEN {state("a.ch", "a.se", EMPTY, "0", f"{flushed} || list_transform(x.big, lambda t: {{'ch': a.ch, 'se': a.se, 'tx': t}})")}
 WHEN a.n + length(x.tx) > {most} AND len(a.parts) > 0 THEN {state("a.ch", "a.se", "[x.tx]", "length(x.tx)", flushed)}
 ELSE {state("a.ch", "a.se", "list_append(a.parts, x.tx)", "a.n + length(x.tx)", "a.done")} END,
 {{'ty': '', 'lv': 0, 'tx': '', 'big': {EMPTY}, 'ch': 0, 'se': NULL::VARCHAR, 'parts': {EMPTY}, 'n': 0, 'done': {none}}}) AS f
FROM (SELECT doc_id, list({{'ty': type, 'lv': coalesce(level, 1), 'tx': text, 'big': CASE WHEN type <> 'heading' AND length(text) > {most} THEN {pieces('text', most)} ELSE {EMPTY} END, 'ch': 0, 'se': NULL::VARCHAR, 'parts': {EMPTY}, 'n': 0, 'done': {none}}} ORDER BY ord) AS items FROM ({blocks(text)}) GROUP BY doc_id)))))"""
