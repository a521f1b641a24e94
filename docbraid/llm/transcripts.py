"""Transcript parsing: a hidden Markov model recovers who speaks, then turns are rendered in one form.

A line's hidden state is a role and whether the line begins that role's turn.
It is seen through four features: the kind of speaker marker, the length, how
the line ends, and whether a blank line precedes. A marker is a word known for a
role, or any other name, told apart by the order in which the transcript's names
appear. Probabilities are counted from labelled conversations; Viterbi finds
the likeliest states of all transcripts of a slice at once, one step for each
line number.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docbraid.llm.common import materialise, slices

ROLES = ("system", "user", "assistant")
#: State 2 r begins a turn of role r, state 2 r + 1 continues it.
N_STATES = 2 * len(ROLES)
#: Values of each feature: marker, length, ending, what precedes.
SIZES = (7, 5, 4, 3)
SMOOTHING = 0.5

_WORDS = {
    1: "system instructions instruction context prompt",
    2: "user human customer client question q me caller",
    3: "assistant ai bot agent answer a model chatbot",
}
_KIND = {w: k for k, words in _WORDS.items() for w in words.split()}
MARKER = re.compile(r"\s*(?:[\[(<]|\*\*|#{1,3} ?)?([^\W\d_][\w ]{0,19}?)(?:[\])>]|\*\*)?\s*:(?:\*\*)?(?:\s+|$)")


def marker_kind(line: str) -> tuple[int, int]:
    """(0 none, 1 system, 2 user, 3 assistant, 4 some other name; where the text after the marker starts)."""
    m = MARKER.match(line)
    if not m:
        return 0, 0
    return _KIND.get(m[1].lower(), 4), m.end()


def features(lines: list[str]) -> np.ndarray:
    """One row of four small numbers for each line; names that no role is known by are 4, 5, and 6 from the third on."""
    out = np.empty((len(lines), 4), np.int64)
    before = 2
    names: dict[str, int] = {}
    for i, line in enumerate(lines):
        s = line.rstrip()
        n = len(s)
        last = s[-1:] if s else ""
        kind = marker_kind(line)[0]
        if kind == 4:
            kind += min(names.setdefault(MARKER.match(line)[1].lower(), len(names)), 2)
        out[i] = (
            kind,
            0 if not n else 1 if n < 40 else 2 if n < 120 else 3 if n < 400 else 4,
            0 if not s else 1 if last == "?" else 2 if last in ".!:;" else 3,
            before,
        )
        before = 0 if s else 1
    return out


@dataclass(frozen=True)
class Model:
    """Log probabilities: of the first state, of the next state, and of each feature's value by state."""

    start: np.ndarray
    move: np.ndarray
    emit: tuple[np.ndarray, ...]


N_COUNTS = N_STATES + N_STATES**2 + N_STATES * sum(SIZES)


def _allowed() -> np.ndarray:
    move = np.zeros((N_STATES, N_STATES), bool)
    move[:, 0::2] = True
    for r in range(len(ROLES)):
        move[2 * r : 2 * r + 2, 2 * r + 1] = True
    return move


def model_from_counts(counts: np.ndarray) -> Model:
    """The model of summed counts, smoothed; impossible moves stay impossible."""
    start, move, rest = counts[:N_STATES], counts[N_STATES : N_STATES + N_STATES**2].reshape(N_STATES, N_STATES), counts[N_STATES + N_STATES**2 :]
    begins = np.arange(N_STATES) % 2 == 0
    with np.errstate(divide="ignore"):
        first = np.log(np.where(begins, start + SMOOTHING, 0) / (start[begins] + SMOOTHING).sum())
        weight = np.where(_allowed(), move + SMOOTHING, 0)
        following = np.log(weight / weight.sum(axis=1, keepdims=True))
    emit, at = [], 0
    for size in SIZES:
        part = rest[at : at + N_STATES * size].reshape(N_STATES, size) + SMOOTHING
        emit.append(np.log(part / part.sum(axis=1, keepdims=True)))
        at += N_STATES * size
    return Model(first, following, tuple(emit))


def count(lines: list[str], states: list[int]) -> np.ndarray:
    """Counts of one labelled transcript."""
    s, f = np.array(states), features(lines)
    parts = [np.bincount(s[:1], minlength=N_STATES), np.bincount(s[:-1] * N_STATES + s[1:], minlength=N_STATES**2)]
    parts += [np.bincount(s * size + f[:, k], minlength=N_STATES * size) for k, size in enumerate(SIZES)]
    return np.concatenate(parts)


def viterbi(model: Model, observed: list[np.ndarray]) -> list[np.ndarray]:
    """The likeliest states of each sequence of features; of equally likely ones, the lower states."""
    sizes = np.array([len(x) for x in observed], np.int64)
    order = np.argsort(-sizes, kind="stable")
    rows = [observed[i] for i in order]
    size = sizes[order]
    if not len(size) or not size[0]:
        return [np.empty(0, np.int64) for _ in observed]
    whole = np.concatenate(rows)
    seen = sum(model.emit[k][:, whole[:, k]].T for k in range(len(SIZES)))
    first = np.cumsum(size) - size
    n = int((size > 0).sum())
    score = model.start + seen[first[:n]]
    back = np.zeros((len(whole), N_STATES), np.int8)
    last = np.zeros((len(size), N_STATES))
    last[:n] = score
    for t in range(1, int(size[0])):
        n = int((size > t).sum())
        tried = last[:n, :, None] + model.move[None, :, :]
        back[first[:n] + t] = tried.argmax(axis=1)
        last[:n] = tried.max(axis=1) + seen[first[:n] + t]
    found = np.zeros(len(whole), np.int64)
    state = last.argmax(axis=1)
    for t in range(int(size[0]) - 1, -1, -1):
        n = int((size > t).sum())
        at = first[:n] + t
        if t < size[0] - 1:
            longer = int((size > t + 1).sum())
            state[:longer] = back[first[:longer] + t + 1, found[first[:longer] + t + 1]]
        found[at] = state[:n]
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(observed)
    for k, i in enumerate(order.tolist()):
        out[i] = found[first[k] : first[k] + size[k]]
    return out


def turns(lines: list[str], states: np.ndarray) -> list[tuple[str, str]]:
    """(role, text) of each turn: markers and surrounding blank lines dropped."""
    out: list[tuple[str, list[str]]] = []
    for line, state in zip(lines, states.tolist(), strict=True):
        if state % 2 == 0:
            kind, at = marker_kind(line)
            out.append((ROLES[state // 2], [line[at:] if kind else line]))
        else:
            out[-1][1].append(line)
    return [(role, "\n".join(text).strip()) for role, text in out]


def canonical(parsed: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{text}\n<|end|>\n" for role, text in parsed)


def split_lines(text: str | None) -> list[str]:
    return text.replace("\r\n", "\n").replace("\r", "\n").split("\n") if text and not text.isspace() else []


def train(labelled: DataFrame, transcript: str = "transcript", states: str = "states") -> Model:
    """Counts every labelled transcript once, in Arrow batches; the sums are one row."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N_COUNTS, np.int64)
        for batch in batches:
            for text, own in zip(batch.column("t").to_pylist(), batch.column("s").to_pylist(), strict=True):
                lines = split_lines(text)
                if lines and own is not None and len(own) == len(lines):
                    total += count(lines, own)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(N_COUNTS)), pa.array(total)], ["k", "n"])

    parts = labelled.select(F.col(transcript).alias("t"), F.col(states).alias("s")).mapInArrow(counted, "k long, n long")
    sums = np.zeros(N_COUNTS, np.int64)
    for row in parts.groupBy("k").agg(F.sum("n").alias("n")).collect():  # N_COUNTS rows, whatever the corpus
        sums[row["k"]] = row["n"]
    return model_from_counts(sums)


def parse_transcripts(rows: DataFrame, model: Model, conv_id: str = "conv_id", transcript: str = "transcript") -> DataFrame:
    """(conv_id, n_turns, roles, rendered) for every row.

    A null, empty or blank transcript has no turns and an empty rendering.
    Transcripts without any marker are parsed by their lines alone; long ones are
    parsed whole; equal rows parse equally; null ids are kept. Ties between
    states go to the earlier role. Other columns play no part. An empty table
    gives an empty result.
    """

    @F.arrow_udf("struct<roles:array<string>,rendered:string>")
    def parsed(texts: pa.Array) -> pa.Array:
        every = []
        for part in slices(texts, most_rows=2048):
            lines = [split_lines(x) for x in part.to_pylist()]
            found = viterbi(model, [features(x) for x in lines])
            every += [turns(x, s) for x, s in zip(lines, found, strict=True)]
        roles = pa.array([[role for role, _ in t] for t in every], pa.list_(pa.string()))
        return pa.StructArray.from_arrays([roles, pa.array([canonical(t) for t in every], pa.string())], ["roles", "rendered"])

    done = rows.select(F.col(conv_id).alias("conv_id"), parsed(F.col(transcript)).alias("p"))
    return done.select("conv_id", F.size("p.roles").alias("n_turns"), F.col("p.roles").alias("roles"), F.col("p.rendered").alias("rendered"))


STYLES = (
    ("System: ", "User: ", "Assistant: "),
    ("Instructions: ", "Human: ", "AI: "),
    ("Context: ", "Q: ", "A: "),
    ("[system]: ", "[customer]: ", "[agent]: "),
    ("**System**: ", "**Me**: ", "**Bot**: "),
    ("Scene: ", "Dana: ", "Kai: "),
    ("<Rules>: ", "<Señor Ruiz>: ", "<Olga>: "),
)
#: Of the conversations that the query parses with the same model.
FOLDS = 2


def write_transcripts(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, transcript, states): conversations as raw transcripts, with the true state of each line.

    Styles of markers differ by conversation; a fifth of the turns have no marker
    and three tenths no blank line after them, chosen by hash. A null or unknown
    role counts as user, a null text as an empty line, a null turn comes last;
    turns of equal number are ordered by role and text. Rows with a null conv_id
    are one conversation, as in GROUP BY.
    """
    c, t = F.col(conv_id), F.col(turn)
    number = F.coalesce(F.array_position(F.array(*map(F.lit, ROLES)), F.col(role)).cast("int"), F.lit(0))
    number = F.when(number == 0, 1).otherwise(number - 1)
    draw = lambda salt, n: F.pmod(F.xxhash64(c, t, F.lit(salt)), F.lit(n))
    styles = F.array(*[F.array(*map(F.lit, s)) for s in STYLES])
    marker = F.element_at(F.element_at(styles, (F.pmod(F.xxhash64(c), F.lit(len(STYLES))) + 1).cast("int")), number + 1)
    body = F.concat(F.when(draw(1, 5) == 0, "").otherwise(marker), F.coalesce(F.col(text), F.lit("")), F.when(draw(2, 10) < 7, "\n").otherwise(""))
    item = F.struct(t.isNull().alias("x"), t.alias("t"), number.alias("r"), body.alias("b"))
    rows = conversations.select(c.alias("conv_id"), item.alias("item")).groupBy("conv_id").agg(F.array_sort(F.collect_list("item")).alias("turns"))
    states = F.flatten(F.transform("turns", lambda x: F.concat(F.array(2 * x["r"]), F.array_repeat(2 * x["r"] + 1, F.size(F.split(x["b"], "\n")) - 1))))
    return rows.select("conv_id", F.array_join(F.transform("turns", lambda x: x["b"]), "\n").alias("transcript"), states.alias("states"))


def parse_conversations(conversations: DataFrame) -> DataFrame:
    """Writes conversations as transcripts and parses them all, each with a model that has not seen it.

    Conversations fall into FOLDS parts by a hash of their id; a part is parsed with
    the counts of the others. Nulls, ties and repeated rows are those of
    write_transcripts: each conversation is one row, however often its turns
    repeat, and one of blank turns has no turns. Texts of any length are parsed
    whole, other columns play no part, an empty table gives an empty result.
    """
    fold = F.pmod(F.xxhash64("conv_id"), F.lit(FOLDS))
    written = materialise(write_transcripts(conversations).withColumn("fold", fold))
    parts = [parse_transcripts(written.filter(F.col("fold") == k), train(written.filter(F.col("fold") != k))) for k in range(FOLDS)]
    return functools.reduce(DataFrame.unionByName, parts)
