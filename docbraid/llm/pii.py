"""Surrogates for personal data: keyed, type-consistent, distinct and coreferent.

An entity's surrogate is a keyed permutation of the values of its own format:
digits become digits, vowels vowels and consonants consonants of the same case
and alphabet, a first name another one of the same gender and script, a card
number keeps its issuer digit and its check property, a bank account its country
and length with the right check digits, a phone number its country, an address
stays private or public and keeps its zero groups. Found are e-mail and IP
addresses of both versions, card, IBAN, US social security and phone numbers
(national 3-3-4 groups, or any groups after + and a country code), full names that
begin with a listed first name, and names after a title, which shows the gender
and stays. Who holds the key can undo all of it, so every function takes it from
the caller. The same entity has the same surrogate wherever it occurs, and
different entities of a format have different ones, because a permutation
cannot map two values to one.

What a permutation cannot exclude is that a surrogate equals a real entity of
the corpus. That is checked over the whole corpus: such entities are permuted
again under another tweak until their surrogates are neither real nor
taken; those still open after some rounds get the free values of their format by
rank. Only where a format has fewer free values than it needs does an entity keep
a surrogate that is real (another entity's value or its own).
"""

from __future__ import annotations

import functools
import hashlib
import ipaddress
import math
import re
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docbraid.llm.common import checked_broadcast, materialise, row_key

#: After so many tries the entities still open get the free values of their format by rank.
MAX_ATTEMPTS = 16

FIRST_NAMES: dict[tuple[str, str], tuple[str, ...]] = {
    ("f", "latin"): tuple("emma olivia sophia isabella charlotte amelia emily elizabeth margaret katherine barbara jessica sarah karen lisa nancy sandra ashley kimberly donna michelle carol amanda melissa deborah stephanie rebecca laura cynthia kathleen angela brenda pamela nicole samantha julia claudia ursula sabine petra monika heike camille chloé manon juliette margaux valérie nathalie isabelle carmen lucía paula beatriz dolores pilar rosario priya ananya lakshmi sunita kavita deepika aishwarya fatima aisha khadija zainab maryam yasmin noura mei xiuying yuki sakura haruka nguyet thuy linh agnieszka katarzyna małgorzata joanna zuzanna giulia chiara francesca valentina alessandra ayşe zeynep elif amara chiamaka adaeze wanjiku ingrid astrid freya johanna mariana gabriela camila juliana".split()),
    ("m", "latin"): tuple("james robert michael william david richard joseph thomas charles christopher matthew anthony steven andrew kenneth joshua kevin brian george timothy ronald jason edward jeffrey ryan jacob nicholas jonathan stephen gregory benjamin samuel patrick alexander frank dennis wolfgang jürgen klaus dieter stefan thorsten pierre jacques philippe françois antoine étienne gérard carlos miguel javier fernando alejandro francisco ignacio rodrigo rahul amit sanjay rajesh vikram arjun suresh ramesh mohammed muhammad ahmed hassan hussein omar youssef abdullah khalid hiroshi takashi kenji haruto wei jian zhiwei xiaoming nguyễn minh piotr krzysztof tomasz andrzej marek giovanni giuseppe alessandro matteo lorenzo mehmet mustafa emre chinedu emeka kwame kofi lars anders henrik bjørn joão thiago gustavo rafael".split()),
    ("f", "cyrillic"): tuple("анна мария елена ольга наталья татьяна ирина светлана екатерина юлия людмила галина дарья полина ксения".split()),
    ("m", "cyrillic"): tuple("александр сергей дмитрий андрей алексей михаил иван николай владимир евгений павел максим олег виктор юрий".split()),
    ("f", "greek"): tuple("μαρία ελένη κατερίνα βασιλική σοφία αγγελική γεωργία δήμητρα ιωάννα παναγιώτα".split()),
    ("m", "greek"): tuple("γιώργος δημήτρης κώστας νίκος γιάννης παναγιώτης βασίλης χρήστος αθανάσιος μιχάλης".split()),
}
_GENDER = {n: (kind, i) for kind, names in FIRST_NAMES.items() for i, n in enumerate(names)}

#: Values of one class take each other's places.
ALPHABETS = (
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ",
    "àáâäãåèéêëìíîïòóôöõùúûüýÿ", "ÀÁÂÄÃÅÈÉÊËÌÍÎÏÒÓÔÖÕÙÚÛÜÝŸ", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕЁИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ",
    "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
)
_CLASS = {c: (a, i) for a in ALPHABETS for i, c in enumerate(a)}

_NAMES = "|".join(sorted({f for n in _GENDER for f in (n.capitalize(), n.upper())}, key=len, reverse=True))
_L = "A-Za-z0-9À-ÖØ-öø-ɏͰ-ӿ"  # letters of addresses
PATTERN = re.compile(
    rf"(?P<email>(?<![\w.+-])[{_L}_+-]+(?:\.[{_L}_+-]+)*@[{_L}-]+(?:\.[{_L}-]+)*\.[A-Za-zÀ-ɏͰ-ӿ]{{2,24}}(?!\w))"
    r"|(?P<ipv6>(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:]))"
    r"|(?P<ip>(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9.]*[0-9]))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<card>(?<![\w-])[0-9]{4}(?P<gap>[ -]?)[0-9]{4}(?P=gap)[0-9]{4}(?P=gap)[0-9]{4}(?![\w-]))"
    r"|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])"
    r"|(?<![\w+])\+[1-9][0-9]{0,3}(?:[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,5})){1,6}(?![\w-]))",
)
_KINDS = ("email", "ipv6", "ip", "iban", "card", "ssn", "phone")
_BIG = r"[^\W\d_a-zà-ÿа-яα-ω]"
_WORD = rf"{_BIG}(?:['’]{_BIG})?[^\W\d_]+(?:[-'’][^\W\d_]{{2,}})*"
NAME = re.compile(rf"(?<!\w)(?:{_NAMES}) {_WORD}(?!\w)")
_TITLES = r"Mr\.?|Mrs\.?|Ms\.?|Dr\.?|Prof\.?|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|г-н|г-жа|κ\."
#: A title and one to three capitalised words; the words are the entity.
TITLED = re.compile(rf"(?<!\w)(?:{_TITLES}) ({_WORD}(?: {_WORD}){{0,2}})(?!\w)")
#: Calling codes of one and two digits; all others have three.
_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: Every entity matches this (RE2, over a whole batch); other texts meet no Python.
MAYBE = rf"[0-9@]|::|(?:{_NAMES}|{_TITLES}) "


def permute(x: int, n: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(n): a Feistel network with cycle walking."""
    if n < 2:
        return x
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    low = (1 << half) - 1
    while True:
        a, b = x >> half, x & low
        for i in range(8):
            mixed = hashlib.blake2b(b"%d|%d|" % (i, b) + tweak.encode(), key=key, digest_size=(half + 7) // 8 + 1).digest()
            a, b = b, a ^ (int.from_bytes(mixed, "big") & low)
        x = a << half | b
        if x < n:
            return x


def shape(s: str) -> str:
    """The classes of a text's characters: texts of one shape are permuted among themselves."""
    return "".join(_CLASS[c][0][0] if c in _CLASS else c for c in s)


def recast(s: str, key: bytes, tweak: str) -> str:
    """The keyed permutation of all texts of s's shape."""
    n, x = 1, 0
    for c in s:
        if c in _CLASS:
            alphabet, i = _CLASS[c]
            x, n = x * len(alphabet) + i, n * len(alphabet)
    return _filled(s, permute(x, n, key, f"{tweak}|{shape(s)}"))


def _filled(s: str, x: int) -> str:
    """The x-th text of s's shape."""
    out = []
    for c in reversed(s):
        if c in _CLASS:
            alphabet = _CLASS[c][0]
            x, i = divmod(x, len(alphabet))
            out.append(alphabet[i])
        else:
            out.append(c)
    return "".join(reversed(out))


def _walk(value: str, step: Callable[[str], str], same: Callable[[str], object]) -> str:
    """Steps on until the property is the value's own: a permutation within the property's class."""
    want, new = same(value), step(value)
    while same(new) != want:
        new = step(new)
    return new


def luhn(digits: str) -> bool:
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def check_digits(country: str, account: str) -> str:
    """The two digits that make a bank account number valid."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02d}"


def _groups(ip: str) -> list[int]:
    return [int(x, 16) for x in ip.split(":")]


def _national(phone: str) -> str:
    """The digits without + and the calling code, ten at most."""
    digits = re.sub(r"\D", "", phone)
    if phone.startswith("+"):
        digits = digits[next((n for n in (1, 2) if digits[:n] in _CODES), 3) :]
    return digits[-10:]


def _kept(ip: str) -> int:
    """How many leading octets of an address stay: those that make it private, local or special."""
    a, b, *_ = map(int, ip.split("."))
    if (a, b) in ((192, 168), (169, 254)) or (a == 172 and 16 <= b < 32):
        return 2
    return int(a in (0, 10, 127) or a >= 224)


@functools.cache
def _public() -> tuple[int, ...]:
    """The first two octets of the addresses that keep none."""
    return tuple(x for x in range(1 << 16) if not _kept(f"{x >> 8}.{x & 255}.0.0"))


def canonical(kind: str, found: str) -> str:
    """What all spellings of one entity share."""
    if kind == "email":
        return found.lower()
    if kind == "phone":
        return _national(found)
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", found)
    if kind == "iban":
        return found.replace(" ", "")
    if kind == "ip":
        return ".".join(str(int(x)) for x in found.split("."))
    if kind == "ipv6":
        return ipaddress.IPv6Address(found).exploded
    return " ".join(found.lower().split())


def surrogate(kind: str, entity: str, key: bytes, attempt: int = 0) -> str:
    """The canonical form's replacement, in canonical form."""
    if attempt > MAX_ATTEMPTS:
        return ranked(kind, entity, key, attempt - MAX_ATTEMPTS - 1)
    tweak = f"{kind}|{attempt}"
    if kind == "email":
        local, domain = entity.rsplit("@", 1)
        name, top = domain.rsplit(".", 1)
        return f"{recast(local, key, tweak + '|' + domain)}@{recast(name, key, kind)}.{top}"
    if kind == "card":
        return _walk(entity, lambda s: s[0] + recast(s[1:], key, tweak + s[0]), luhn)
    if kind == "ip":
        kept = _kept(entity)

        def step(s: str) -> str:
            octets = list(map(int, s.split(".")))
            x = permute(int.from_bytes(bytes(octets[kept:])), 1 << 8 * (4 - kept), key, f"{tweak}|{octets[:kept]}")
            return ".".join(map(str, [*octets[:kept], *x.to_bytes(4 - kept)]))

        return _walk(entity, step, _kept)
    if kind == "iban":
        account = recast(entity[4:], key, f"{tweak}|{entity[:2]}")
        return f"{entity[:2]}{check_digits(entity[:2], account)}{account}"
    if kind == "ipv6":
        groups = _groups(entity)
        some = [i for i in range(1, 8) if groups[i]]  # the first group, which tells the scope, and zeros stay
        x = sum((groups[i] - 1) * 65535**k for k, i in enumerate(some))
        return _ipv6(groups, some, permute(x, 65535 ** len(some), key, f"{tweak}|{groups[0]}|{some}"))
    if kind == "person":  # as the surname of a full name, so that one is known by the other
        return recast(entity, key, f"name|{attempt}")
    if kind == "name":
        first, last = entity.split(" ", 1)
        group, i = _GENDER[first]
        names = FIRST_NAMES[group]
        # First names are permuted without the attempt, so that they corefer on their own.
        return f"{names[(permute(i, len(names), key, kind + group[0] + group[1]))]} {recast(last, key, tweak)}"
    return recast(entity, key, tweak)


def _ipv6(groups: list[int], some: list[int], x: int) -> str:
    """The address with the x-th values that are not zero at these groups."""
    new = list(groups)
    for i in some:
        x, part = divmod(x, 65535)
        new[i] = part + 1
    return ":".join(f"{g:04x}" for g in new)


def cell(kind: str, entity: str) -> str:
    """What a canonical form shares with all those that could take its place."""
    if kind == "email":
        local, domain = entity.rsplit("@", 1)
        return f"{shape(local)}@{domain}"
    if kind == "card":
        return f"{entity[0]}|{len(entity)}|{luhn(entity)}"
    if kind == "ip":
        return ".".join(entity.split(".")[: _kept(entity)])
    if kind == "iban":
        return entity[:2] + shape(entity[4:])
    if kind == "ipv6":
        return f"{entity[:4]}{[bool(g) for g in _groups(entity)]}"
    if kind == "name":
        first, last = entity.split(" ", 1)
        return f"{first} {shape(last)}"
    return shape(entity)


def room(kind: str, entity: str) -> int:
    """How many values the entity's cell has."""
    if kind == "card":
        return 10 ** (len(entity) - 2) * (1 if luhn(entity) else 9)
    if kind == "ip":
        kept = _kept(entity)
        return 1 << 8 * (4 - kept) if kept else len(_public()) << 16
    if kind == "ipv6":
        return 65535 ** sum(map(bool, _groups(entity)[1:]))
    varied = entity[4:] if kind == "iban" else entity.rsplit("@", 1)[0] if kind == "email" else entity.split(" ", 1)[1] if kind == "name" else entity
    return math.prod(len(_CLASS[c][0]) for c in varied if c in _CLASS)


def ranked(kind: str, entity: str, key: bytes, rank: int) -> str:
    """The value of that rank, in a keyed order, of the cell of the entity's surrogates."""
    new = surrogate(kind, entity, key)
    where = cell(kind, new)
    x = permute(rank, room(kind, new), key, f"{kind}|rank|{where}")
    if kind == "email":
        local, domain = new.rsplit("@", 1)
        return f"{_filled(local, x)}@{domain}"
    if kind == "card":
        x, other = (x, None) if luhn(new) else divmod(x, 9)
        body = f"{new[0]}{x:0{len(new) - 2}d}"
        check = next(d for d in range(10) if luhn(f"{body}{d}"))
        return f"{body}{check if other is None else (check + 1 + other) % 10}"
    if kind == "ip":
        kept = _kept(new)
        head = list(map(int, new.split(".")[:kept])) if kept else list(_public()[x >> 16].to_bytes(2))
        return ".".join(map(str, [*head, *(x if kept else x & 65535).to_bytes(4 - len(head))]))
    if kind == "iban":
        account = _filled(new[4:], x)
        return f"{new[:2]}{check_digits(new[:2], account)}{account}"
    if kind == "ipv6":
        groups = _groups(new)
        return _ipv6(groups, [i for i in range(1, 8) if groups[i]], x)
    if kind == "name":
        first, last = new.split(" ", 1)
        return f"{first} {_filled(last, x)}"
    return _filled(new, x)


def dress(kind: str, found: str, new: str) -> str:
    """The canonical surrogate in the format of what was found."""
    if kind in ("card", "ssn", "phone"):
        digits, out, skip = list(new), [], len(re.sub(r"\D", "", found)) - len(new)
        for c in found:
            if c.isdigit() and skip > 0:
                skip -= 1
                out.append(c)
            else:
                out.append(digits.pop(0) if c.isdigit() else c)
        return "".join(out)
    if kind == "iban":
        chars = iter(new)
        return "".join(c if c == " " else next(chars) for c in found)
    if kind == "ipv6":
        parts = found.split(":")
        short = str(ipaddress.IPv6Address(new)) if "::" in found else new if all(len(x) == 4 for x in parts) else ":".join(f"{g:x}" for g in _groups(new))
        return short.upper() if found.upper() == found and found.lower() != found else short
    if kind == "email":
        if len(found) != len(new):
            return new
        return "".join(n.upper() if o.isupper() and len(n.upper()) == 1 else n for o, n in zip(found, new, strict=True))
    if kind in ("name", "person"):
        cased = []
        for old, part in zip(found.split(), new.split(), strict=True):
            cased.append(part.upper() if old.isupper() else part if old.islower() else re.sub(r"(?:^|[-'’])\w", lambda m: m[0].upper(), part))
        return " ".join(cased)
    return new


def entities(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, as written) of all entities of a text, in order, without overlaps."""
    if not text:
        return []
    found = [(m.start(), m.end(), kind, m[0]) for m in PATTERN.finditer(text) if _valid(kind := _kind(m), m[0])]
    names = [(m.start(), m.end(), "name", m[0]) for m in NAME.finditer(text)]
    for m in TITLED.finditer(text):
        first, _, rest = m[1].partition(" ")
        names.append((m.start(1), m.end(1), "name" if rest and first.lower() in _GENDER else "person", m[1]))
    out: list[tuple[int, int, str, str]] = []
    for x in sorted(found + names):
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


def _possible(texts: pa.Array) -> list[bool]:
    return pc.fill_null(pc.match_substring_regex(texts, MAYBE), False).to_pylist()


def _kind(m: re.Match) -> str:
    return next(k for k in _KINDS if m[k] is not None)


def _valid(kind: str, found: str) -> bool:
    """Whether what looks like an entity is one."""
    if kind == "iban":
        bare = found.replace(" ", "")
        return 15 <= len(bare) <= 34 and check_digits(bare[:2], bare[4:]) == bare[2:4]
    if kind == "ipv6":
        if sum(c != ":" for c in found) < 5 or not any(c.isdigit() for c in found):
            return False
        try:
            return ipaddress.IPv6Address(found) is not None
        except ValueError:
            return False
    return kind != "phone" or 8 <= sum(c.isdigit() for c in found) <= 15


def replace(text: str, key: bytes, attempts: dict[tuple[str, str], int] | None = None) -> tuple[str, int]:
    """The text with surrogates, and how many entities it had."""
    parts, at, n = [], 0, 0
    for start, end, kind, found in entities(text):
        entity = canonical(kind, found)
        new = surrogate(kind, entity, key, (attempts or {}).get((kind, entity), 0))
        parts += [text[at:start], dress(kind, found, new)]
        at, n = end, n + 1
    return "".join([*parts, text[at:]]), n


_ENTITY = "struct<kind:string,entity:string,new:string>"


def _extracted(text: Column, key: bytes) -> Column:
    @F.arrow_udf(f"array<{_ENTITY}>")
    def extracted(texts: pa.Array) -> pa.Array:
        rows = []
        for i, maybe in enumerate(_possible(texts)):
            found = entities(texts[i].as_py()) if maybe else ()
            own = dict.fromkeys((kind, canonical(kind, x)) for _, _, kind, x in found)
            rows.append([{"kind": k, "entity": e, "new": surrogate(k, e, key)} for k, e in own])
        return pa.array(rows, pa.list_(pa.struct([(n, pa.string()) for n in ("kind", "entity", "new")])))

    return extracted(text)


def _again(kind: Column, entity: Column, attempt: Column, key: bytes) -> Column:
    @F.arrow_udf("string")
    def again(kinds: pa.Array, names: pa.Array, tries: pa.Array) -> pa.Array:
        return pa.array([surrogate(k, e, key, n) for k, e, n in zip(kinds.to_pylist(), names.to_pylist(), tries.to_pylist(), strict=True)], pa.string())

    return again(kind, entity, attempt)


def _cells(kind: Column, value: Column) -> Column:
    @F.arrow_udf("struct<cell:string,room:bigint>")
    def cells(kinds: pa.Array, values: pa.Array) -> pa.Array:
        rows = [{"cell": cell(k, v), "room": min(room(k, v), 1 << 62)} for k, v in zip(kinds.to_pylist(), values.to_pylist(), strict=True)]
        return pa.array(rows, pa.struct([("cell", pa.string()), ("room", pa.int64())]))

    return cells(kind, value)


def _by_rank(still: DataFrame, blocked: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, attempt) that give the open entities free values of their cells, as far as these go.

    Of a cell with b blocked values and m open entities, the first b + m values
    hold m free ones, or they are the whole cell.
    """
    first = still.withColumn("new", _again(F.col("kind"), F.col("entity"), F.lit(0), key))
    placed = materialise(first.select("kind", "entity", _cells(F.col("kind"), F.col("new")).alias("c")).select("kind", "entity", "c.*"))
    cells = placed.groupBy("kind", "cell").agg(F.min("entity").alias("one"), F.first("room").alias("room"), F.count("*").alias("m"))
    full = blocked.select("kind", _cells(F.col("kind"), F.col("new"))["cell"].alias("cell")).groupBy("kind", "cell").agg(F.count("*").alias("b"))
    size = F.least("room", F.col("m") + F.coalesce("b", F.lit(0)))
    step = 1 << 12
    parts = cells.join(full, ["kind", "cell"], "left").select("kind", "cell", "one", size.alias("size"))
    parts = parts.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(step).cast("long")))).repartition("kind", "cell", "at")
    ranks = parts.withColumn("attempt", F.explode(F.sequence(F.col("at") + MAX_ATTEMPTS + 1, F.least(F.col("at") + step, "size") + MAX_ATTEMPTS)))
    values = materialise(ranks.select("kind", "cell", "attempt", _again(F.col("kind"), F.col("one"), F.col("attempt"), key).alias("new")))
    order = lambda c: F.row_number().over(Window.partitionBy("kind", "cell").orderBy(c))
    free = values.join(blocked, ["kind", "new"], "left_anti").withColumn("n", order("attempt"))
    return materialise(placed.withColumn("n", order("entity")).join(free, ["kind", "cell", "n"]).select("kind", "entity", "attempt"))


def retries(found: DataFrame, key: bytes) -> DataFrame | None:
    """(kind, entity, attempt) for entities whose first surrogate is real or taken; None if there are none.

    found has the distinct (kind, entity, new) of the corpus. Each round is a
    join of the entities still open with the real and the taken values. What
    MAX_ATTEMPTS rounds leave open gets free values by rank. An entity is without
    a row though its first surrogate is real only if its format has no free value
    left; its surrogate then still is no other entity's surrogate.
    """
    real = found.select("kind", F.col("entity").alias("new"))

    def split(tried: DataFrame, taken: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """(accepted, open): of equal new surrogates the least entity's is accepted."""
        blocked = real if taken is None else real.unionByName(taken)
        free = tried.join(blocked, ["kind", "new"], "left_anti")
        first = free.groupBy("kind", "new").agg(F.min("entity").alias("entity"))
        return first, tried.join(first, ["kind", "entity"], "left_anti")

    accepted, still = split(found, None)
    still = materialise(still.select("kind", "entity"))
    if still.isEmpty():
        return None
    taken = materialise(accepted.select("kind", "new"))
    done = None
    for attempt in range(1, MAX_ATTEMPTS + 1):
        tried = materialise(still.select("kind", "entity", _again(F.col("kind"), F.col("entity"), F.lit(attempt), key).alias("new")))
        accepted, still = split(tried, taken)
        accepted, still = materialise(accepted), materialise(still.select("kind", "entity"))
        rows = accepted.select("kind", "entity", F.lit(attempt).cast("long").alias("attempt"))
        done = rows if done is None else done.unionByName(rows)
        taken = taken.unionByName(accepted.select("kind", "new"))
        if still.isEmpty():
            return done
    return done.unionByName(_by_rank(still, real.unionByName(taken), key))


def pseudonymise(docs: DataFrame, key: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, n_entities): every text with surrogates, under the caller's secret key, in place of its personal data.

    Null texts stay null with 0 entities; texts without entities stay as they
    are. Very long texts are searched whole. Every row of docs is returned,
    repeated ones as often as they occur and with equal surrogates; null ids
    stay null. Other columns of docs play no part. An empty table gives an empty
    result. Only distinct entities are shuffled; texts are, only for documents
    with an entity that needs another attempt.
    """

    @F.arrow_udf("struct<text:string,n:int>")
    def replaced(texts: pa.Array, attempts: pa.Array) -> pa.Array:
        maybe = _possible(texts)
        counts, new = [0] * len(texts), []
        for i in range(len(texts)):
            if maybe[i]:
                again = {(a["kind"], a["entity"]): a["attempt"] for a in attempts[i].as_py() or ()}
                text, counts[i] = replace(texts[i].as_py(), key, again)
                new.append(text)
        whole = pc.replace_with_mask(texts, pa.array(maybe, pa.bool_()), pa.array(new, texts.type))
        return pa.StructArray.from_arrays([whole, pa.array(counts, pa.int32())], ["text", "n"])

    k1, k2 = row_key(F.col(doc_id), F.col(text))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), k1.alias("k1"), k2.alias("k2"))
    holding = rows.select("k1", "k2", F.explode(_extracted(F.col("text"), key)).alias("e")).select("k1", "k2", "e.*")
    holding = materialise(holding)
    again = retries(materialise(holding.select("kind", "entity", "new").distinct()), key)
    none = F.lit(None).cast("array<struct<kind:string,entity:string,attempt:bigint>>")
    finish = lambda df, column: df.select("doc_id", replaced(F.col("text"), column).alias("r")).select("doc_id", F.col("r.text").alias("text"), F.col("r.n").alias("n_entities"))
    if again is None:
        return finish(rows, none)
    item = F.struct("kind", "entity", "attempt")
    lists = holding.join(again, ["kind", "entity"]).groupBy("k1", "k2").agg(F.array_sort(F.collect_set(item)).alias("again"))
    lists = checked_broadcast(lists, 64 + F.length(F.to_json("again")))
    return finish(rows.join(lists, ["k1", "k2"], "left"), F.col("again"))
