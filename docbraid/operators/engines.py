"""Translation services as columns: adapters, retries, rotation over providers, post-editing, fixed terms.

A transport is a function (service, payload) -> reply that is shipped to the
executors; it raises Unavailable for an HTTP status. Services are called in Arrow
batches by a small pool of threads, and whatever a call raises becomes an error
of its row, never of the job.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from docbraid.functions.kernels import mapped
from docbraid.functions.text import FLORES

Send = Callable[[str, dict], dict]
REPLY = "struct<text:string,error:string,latency_ms:long,cost:long>"
BATCHED = "array<struct<text:string,provider:string,ok:boolean>>"


class Unavailable(Exception):
    """An HTTP status other than success."""

    def __init__(self, status: int) -> None:
        super().__init__(f"status {status}")
        self.status = status

    def __reduce__(self):
        return Unavailable, (self.status,)


@dataclass(frozen=True)
class Retry:
    """Tries again after 429 and 5xx, waiting twice as long each time."""

    attempts: int = 4
    first: float = 0.5
    longest: float = 8.0

    def call(self, send: Send, service: str, payload: dict, sleep: Callable[[float], None] = time.sleep) -> dict:
        for n in range(self.attempts):
            try:
                return send(service, payload)
            except Unavailable as e:
                if (e.status != 429 and e.status < 500) or n + 1 == self.attempts:
                    raise
                sleep(min(self.longest, self.first * 2**n))
        raise ValueError("no attempts")


@dataclass(frozen=True)
class Adapter:
    """How a service is asked, where its text and its cost in micro-dollars are."""

    service: str
    build: Callable[[str, str], dict]
    text: Callable[[dict], str | None]
    cost: Callable[[str, dict], int] = lambda source, reply: 0


def nmt(url: str) -> Adapter:
    return Adapter(url, lambda s, target: {"text": s, "source": FLORES["en"], "target": FLORES[target]}, lambda r: r.get("translation"))


def llm(url: str, instructions: str) -> Adapter:
    cost = lambda s, r: int(r.get("input_tokens", 0) * 3 + r.get("output_tokens", 0) * 15 + 0.5)
    return Adapter(url, lambda s, target: {"system": instructions, "target": target, "prompt": s}, lambda r: r.get("text"), cost)


def amazon(region: str) -> Adapter:
    return Adapter(region, lambda s, target: {"Text": s, "SourceLanguageCode": "en", "TargetLanguageCode": target}, lambda r: r.get("TranslatedText"), lambda s, r: len(s) * 15)


def client(adapter: Adapter, send: Send, target: str, retry: Retry = Retry(), threads: int = 8) -> Callable[[Column], Column]:
    """source -> REPLY. Null sources are not sent and have a null reply; blank replies are errors."""

    def one(source: str | None) -> dict | None:
        if source is None:
            return None
        start, text, cost, error = time.monotonic(), None, 0, None
        try:
            reply = retry.call(send, adapter.service, adapter.build(source, target))
            text = adapter.text(reply)
            if text is None or not text.strip():
                text, error = None, "empty output"
            else:
                cost = adapter.cost(source, reply)
        except Exception as e:  # noqa: BLE001  (the attempt's record)
            error = f"{type(e).__name__}: {e}"
        return {"text": text, "error": error, "latency_ms": int(1000 * (time.monotonic() - start)), "cost": cost}

    kind = pa.struct([("text", pa.string()), ("error", pa.string()), ("latency_ms", pa.int64()), ("cost", pa.int64())])

    def translate(source: Column) -> Column:
        @F.arrow_udf(REPLY)
        def said(sources: pa.Array) -> pa.Array:
            with ThreadPoolExecutor(threads) as pool:
                return pa.array(list(pool.map(one, sources.to_pylist())), kind)

        return said.asNondeterministic()(source)  # a call is made once, wherever the plan needs its reply

    return translate


def _items(reply: dict, n: int) -> list[str] | None:
    """The n texts of a reply that holds a JSON array, or null."""
    raw = reply.get("text") or ""
    low, high = raw.find("["), raw.rfind("]")
    try:
        items = json.loads(raw[low : high + 1]) if 0 <= low < high else None
    except ValueError:
        return None
    good = isinstance(items, list) and len(items) == n and all(isinstance(x, str) and x.strip() for x in items)
    return items if good else None


def _asked(send: Send, providers: Sequence[str], first: int, payload: Callable[[], dict], n: int, retry: Retry) -> tuple[list[str], str] | None:
    """The first good answer of the providers, in turn from the first on."""
    for k in range(len(providers)):
        provider = providers[(first + k) % len(providers)]
        try:
            items = _items(retry.call(send, provider, payload()), n)
        except Exception:  # noqa: BLE001  (the next provider is asked)
            continue
        if items is not None:
            return items, provider
    return None


def _worked(lists: list[list], size: int, send: Send, providers: Sequence[str], keys: tuple[str, ...], kept: int, retry: Retry) -> list[dict]:
    """Batches of parallel lists, in rotation; a batch that no provider answers is asked one by one, and keeps lists[kept] where that fails."""
    out: list[dict] = []
    for low in range(0, len(lists[0]), size):
        parts, turn = [x[low : low + size] for x in lists], low // size
        n = len(parts[0])
        payload = lambda a, b, p=parts: {k: x[a:b] for k, x in zip(keys, p, strict=True)}
        found = _asked(send, providers, turn, lambda: payload(0, n), n, retry)  # noqa: B023
        if found:
            out += [{"text": x, "provider": found[1], "ok": True} for x in found[0]]
            continue
        for i in range(n):
            one = _asked(send, providers, turn, lambda: payload(i, i + 1), 1, retry) if n > 1 else None  # noqa: B023
            out.append({"text": one[0][0], "provider": one[1], "ok": True} if one else {"text": parts[kept][i], "provider": None, "ok": False})
    return out


_BATCHED = pa.list_(pa.struct([("text", pa.string()), ("provider", pa.string()), ("ok", pa.bool_())]))


def batch_translate(sources: Column, providers: Sequence[str], send: Send, size: int = 64, retry: Retry = Retry()) -> Column:
    """BATCHED, one item for each of the array's texts, in order.

    Batches go to the providers in turn; one that fails or answers with another
    number of texts is followed by the next; then every text is tried alone, and
    what still fails keeps its source. The array stays in its row: no shuffle. As
    for any Python function, Spark can't plan sources in which a lambda captures
    the variable of one around it; split has no such.
    """

    @F.arrow_udf(BATCHED)
    def said(column: pa.Array) -> pa.Array:
        return mapped(lambda x: None if x is None else _worked([x], size, send, providers, ("texts",), 0, retry), _BATCHED, column)

    return said.asNondeterministic()(sources)


def post_edit(sources: Column, drafts: Column | Callable[[str], str], providers: Sequence[str], send: Send, size: int = 64, retry: Retry = Retry()) -> Column:
    """BATCHED: drafts refined in batches; where that fails the draft stays.

    Drafts that are a function of a source text are made beside the call, so
    that neither they nor sources made in Python are held in a second worker.
    """
    edit = lambda s, t: None if s is None or t is None else _worked([s, t], size, send, providers, ("texts", "drafts"), 1, retry)

    if not isinstance(drafts, Column):

        @F.arrow_udf(BATCHED)
        def drafted(column: pa.Array) -> pa.Array:
            return mapped(lambda s: edit(s, s and [None if x is None else drafts(x) for x in s]), _BATCHED, column)

        return drafted.asNondeterministic()(sources)

    @F.arrow_udf(BATCHED)
    def refined(column: pa.Array, made: pa.Array) -> pa.Array:
        return mapped(edit, _BATCHED, column, made)

    return refined.asNondeterministic()(sources, drafts)


def with_fixed_terms(terms: Sequence[tuple[str, str]], translate: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """An engine that renders terms as given: longest first they become numbered marks, which engines leave alone, and then their renderings."""
    ordered = sorted(terms, key=lambda p: (-len(p[0]), p[0]))

    def fixed(source: Column) -> Column:
        for i, (term, _) in enumerate(ordered):
            source = F.replace(source, F.lit(term), F.lit(f" ⟦{i}⟧ "))
        out = translate(source)
        for i, (_, rendering) in enumerate(ordered):
            out = F.replace(out, F.lit(f" ⟦{i}⟧ "), F.lit(rendering))
        return out

    return fixed
