import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from docbraid.llm import repair, tokens, unigram
from tests.llm.cases import awkward, empty

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary files")


def texts(seed, n=250):
    r = random.Random(seed)
    bits = ["the", " of", "  ", "\n", "\n\n", "é", "1", "!", "'s", "ß", "𝒳", " ", "ing", "\t", " ", "▁", "日本"]
    return ["", " ", "a  b", " lead", "trail ", "a\n b", None, "x" * 500] + ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(n)]


def test_ids_are_those_of_the_plain_encoder():
    e = tokens.Encoder(tokens.VOCABULARY)
    sample = texts(1)
    ids, ends = e.encode(pa.array(sample, pa.string()))
    lengths = e.lengths(pa.array(sample, pa.string()))
    for i, t in enumerate(sample):
        want = e.encoding.encode_ordinary(t or "")
        assert ids[ends[i] : ends[i + 1]].tolist() == want, t
        assert lengths[i] == len(want)


def sequential(ids, ends, first_rule, min_count):
    """Re-Pair one pair at a time: (symbols left, rules). Pairs are counted left to right without overlap, within documents."""
    docs, low = [], 0
    for high in ends:
        docs.append(list(ids[low:high]))
        low = high
    rules = 0

    def pairs(doc):
        at = 0
        while at + 1 < len(doc):
            yield at, (doc[at], doc[at + 1])
            at += 1

    def count():
        n = Counter()
        for doc in docs:
            last = {}
            for at, p in pairs(doc):
                if p[0] != p[1] or last.get(p) != at - 1:
                    n[p] += 1
                    last[p] = at
        return n

    while (n := count()) and max(n.values()) >= min_count:
        top = max(n, key=lambda p: (n[p], p))
        for k, doc in enumerate(docs):
            out, at = [], 0
            while at < len(doc):
                hit = at + 1 < len(doc) and (doc[at], doc[at + 1]) == top
                out.append(first_rule + rules if hit else doc[at])
                at += 2 if hit else 1
            docs[k] = out
        rules += 1
    return sum(map(len, docs)), rules


def left_pairs(g, min_count):
    """Pairs of the finished symbols that are still frequent."""
    n, low = Counter(), 0
    for high in g.ends:
        doc, low, last = g.symbols[low:high].tolist(), high, {}
        for at, p in enumerate(zip(doc, doc[1:], strict=False)):
            if p[0] != p[1] or last.get(p) != at - 1:
                n[p] += 1
                last[p] = at
    return {p for p, k in n.items() if k >= min_count}


def zipf(seed, n, kinds):
    r = random.Random(seed)
    phrases = [[r.randrange(kinds) for _ in range(r.randint(2, 9))] for _ in range(30)]
    out = []
    while len(out) < n:
        out += r.choice(phrases[: r.randint(1, 30)]) if r.random() < 0.6 else [int(r.paretovariate(1)) % kinds]
    return np.array(out[:n], np.int32)


@pytest.mark.parametrize("seed", range(6))
def test_rounds_come_close_to_sequential_repair(seed):
    ids = zipf(seed, 2500, 50)
    ends = np.array([0, 700, 700, 1900, 2500])
    for min_count in (2, repair.MIN_COUNT, 8):
        g = repair.compress(ids, ends, 50, min_count)
        assert repair.expand(g, 0, len(g.symbols)) == ids.tolist()
        symbols, rules = sequential(ids.tolist(), ends, 50, min_count)
        assert not left_pairs(g, min_count)
        assert len(g.symbols) + 2 * len(g.left) <= 1.05 * (symbols + 2 * rules)


def test_repeats_of_one_symbol_do_not_stop_the_rounds():
    ids = np.array([7] * 9 + [1, 2] * 4 + [3, 1, 2, 3], np.int32)
    g = repair.compress(ids, np.array([len(ids)]), 10, min_count=5)
    assert not left_pairs(g, 5) and len(g.symbols) == len(ids) - 5
    assert repair.expand(g, 0, len(g.symbols)) == ids.tolist()


def test_grammar_round_trip_and_random_access():
    r = random.Random(2)
    for _ in range(150):
        n = r.randint(0, 80)
        ids = np.array([r.randint(0, 3) for _ in range(n)], np.int32)
        ends = np.array(sorted(r.randint(0, n) for _ in range(3)) + [n])
        g = repair.compress(ids, ends, 4, min_count=2)
        assert repair.expand(g, 0, len(g.symbols)) == ids.tolist()
        low = 0
        for d, high in enumerate(ends):
            a, b = sorted((r.randint(0, 30), r.randint(0, 30)))
            assert repair.tokens_at(g, d, a, b) == ids[low:high][a:b].tolist()
            low = high
        for left, right, size in zip(g.left, g.right, g.length, strict=True):
            part = lambda x: 1 if x < 4 else g.length[x - 4]  # noqa: B023, E731
            assert size == part(left) + part(right)


def test_no_frequent_pair_is_left():
    ids = np.array([1, 2, 3] * 200 + [2, 3] * 100, np.int32)
    g = repair.compress(ids, np.array([len(ids)]), 10, min_count=4)
    assert len(g.symbols) < 20
    assert repair.expand(g, 0, len(g.symbols)) == ids.tolist()


def test_long_shards_take_the_other_sort(monkeypatch):
    ids = np.array([5, 6, 7, 5, 6] * 50, np.int32)
    a = repair.compress(ids, np.array([len(ids)]), 10, 2)
    monkeypatch.setattr(repair, "_SYMBOL_BITS", 7)  # positions no longer fit beside the pair
    b = repair.compress(ids, np.array([len(ids)]), 10, 2)
    assert repair.expand(b, 0, len(b.symbols)) == repair.expand(a, 0, len(a.symbols)) == ids.tolist()


def test_corpus_shards_hold_every_row(spark):
    docs = awkward(spark)
    rows = repair.compress_corpus(docs, shard_tokens=500).collect()
    e = tokens.Encoder(tokens.VOCABULARY)
    want = sorted((str(r.doc_id), e.encoding.encode_ordinary(r.text or "")) for r in docs.collect())
    got = []
    for row in rows:
        g = repair.from_row(row)
        for d, key in enumerate(row.doc_ids):
            got.append((str(key), repair.tokens_at(g, d, 0, 10**9)))
        assert row.n_tokens == row.token_ends[-1]
    assert sorted(got) == want
    assert repair.compress_corpus(empty(spark)).count() == 0
    named = repair.compress_corpus(docs.selectExpr("concat('d', doc_id) AS doc_id", "text"), shard_tokens=500)
    assert dict(named.dtypes)["doc_ids"] == "array<string>"
    assert Counter(k for r in named.collect() for k in r.doc_ids) == Counter(k and f"d{k}" for k in (r.doc_id for r in docs.collect()))


def brute_unigram(v, text):
    if not text:
        return []
    d = bytes([unigram.MARK]) + text.encode().replace(b" ", bytes([unigram.MARK]))
    vocab = {v.pieces[i]: i for i in set(v.value[v.value >= 0].tolist())}
    best, back = [-1e18] * (len(d) + 1), [None] * (len(d) + 1)
    best[0] = 0.0
    for i in range(len(d)):
        if best[i] < -1e17:
            continue
        w = 1 if d[i] < 0x80 or d[i] == 255 else 2 if d[i] < 0xE0 else 3 if d[i] < 0xF0 else 4
        one = False
        for n in range(1, v.longest + 1):
            k = vocab.get(d[i : i + n]) if i + n <= len(d) else None
            if k is not None:
                one |= n == w
                if best[i] + v.scores[k] > best[i + n]:
                    best[i + n], back[i + n] = best[i] + v.scores[k], (i, k)
        if not one and best[i] + v.unknown > best[i + w]:
            best[i + w], back[i + w] = best[i] + v.unknown, (i, -1)
    out, p = [], len(d)
    while p:
        i, k = back[p]
        out = ([int(v.byte_ids[b]) for b in d[i:p]] if k < 0 else [k]) + out
        p = i
    return out


def test_unigram_is_viterbi_and_decodes():
    v = unigram.vocabulary()
    sample = texts(3)
    ids, ends = unigram.encode(v, pa.array(sample, pa.string()))
    back = unigram.decode(v, ids, ends).to_pylist()
    for i, t in enumerate(sample):
        assert ids[ends[i] : ends[i + 1]].tolist() == brute_unigram(v, t), t
        assert back[i] == (t or "")


def test_double_array_finds_exactly_its_keys():
    keys = {bytes(w, "ascii"): i for i, w in enumerate("a ab abc b bca c cab zz".split())}
    base, check, value = unigram.double_array(keys)

    def look(word):
        s = 0
        for c in word:
            t = base[s] + c
            if check[t] != s or base[s] == 0:
                return -1
            s = t
        return value[s]

    for w, i in keys.items():
        assert look(w) == i
    assert look(b"ac") == look(b"bc") == look(b"z") == look(b"abcd") == -1


def test_unigram_corpus(spark):
    out = unigram.encode_corpus(awkward(spark)).collect()
    assert len(out) == 12 and all(r.round_trip for r in out if r.doc_id != 5 and r.ids) and sum(not r.ids for r in out) == 4
    assert unigram.encode_corpus(empty(spark)).count() == 0
