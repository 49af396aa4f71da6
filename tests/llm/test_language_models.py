"""Context-tree weighting and Kneser-Ney against direct implementations."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quantmere.llm import ctw as C
from quantmere.llm import kneser_ney as K
from quantmere.llm.grams import lowered


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 7, 100.5, 1e6])
    np.testing.assert_allclose(C.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-11, atol=1e-11)


def naive_ctw(train, texts, depth):
    """ln P of texts by recursion over explicit nodes."""
    n = defaultdict(lambda: [0, 0])
    kids = defaultdict(set)

    def walk(text):
        full = b"\xff" * depth + text + b"\xff"
        for t in range(depth, len(full)):
            ctx = full[t - depth : t][::-1]
            for level in range(8):
                node = (1 << level) | (full[t] >> (8 - level))
                yield ctx, node, (full[t] >> (7 - level)) & 1

    for text in train:
        for ctx, node, bit in walk(text):
            for d in range(depth + 1):
                n[ctx[:d], node][bit] += 1
                if d:
                    kids[ctx[: d - 1], node].add(ctx[:d])

    memo = {}

    def own(key):
        a, b = n[key]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def pw(key):
        if key not in memo:
            ctx, node = key
            kt = own(key)
            memo[key] = kt if len(ctx) == depth else np.logaddexp(math.log(0.5) + kt, math.log(0.5) + sum(pw((c, node)) for c in kids[key]))
        return memo[key]

    def predict(ctx, node, bit):
        p = 0.5
        for d in range(depth, -1, -1):
            key = (ctx[:d], node)
            if key not in n or not sum(n[key]):
                continue
            a, b = n[key]
            kt = ((b if bit else a) + 0.5) / (a + b + 1)
            if d == depth:
                p = kt
            else:
                beta = math.exp(min(60, max(-60, own(key) - sum(pw((c, node)) for c in kids[key]))))
                p = (beta * kt + p) / (beta + 1)
        return p

    return [sum(math.log(predict(*x)) for x in walk(t)) for t in texts]


ROWS = [(k, t) for k, t in enumerate(["Abra cadabra abra", "abba baab\nabra", "", None, "zebra zoo", "The cat. the CAT!", "naïve café", "aaaa aaaa"] * 6)]


def test_ctw_matches_naive(spark):
    docs = spark.createDataFrame([(k, t, "x") for k, t in ROWS], "doc_id long, text string, score string")
    out = {r.doc_id: r for r in C.score_corpus(docs, depth=3).collect()}
    train = [lowered(t) for k, t in ROWS if zlib.crc32(str(k).encode()) % 7 != 2]
    want = naive_ctw(train, [lowered(t) for _, t in ROWS], 3)
    for (k, _), w in zip(ROWS, want, strict=True):
        assert out[k].score == pytest.approx(w / math.log(10), rel=1e-4)
    count = Counter(x for t in train for x in (*t.split(), b"<end>"))
    total, distinct = sum(count.values()), len(count)
    for k, t in ROWS:
        toks = [*lowered(t).split(), b"<end>"]
        assert out[k].base_score == pytest.approx(sum(math.log10((count[x] + 1) / (total + distinct + 1)) for x in toks))
        assert (out[k].n_tokens, out[k].n_known, out[k].train_tokens) == (len(toks), sum(count[x] > 0 for x in toks), total)
        assert out[k].held_out == (zlib.crc32(str(k).encode()) % 7 == 2)


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    for m in (C.train_ctw(docs, depth=2), K.train_kneser_ney(docs, depth=3)):
        for ctx in (b"abr", b"zzz", b"\xff\xff\xff"):
            key = 0
            for b in ctx[::-1][: m.depth]:
                key = key << 8 | b
            p = np.exp(m.log_probs(np.array([(key << 8) | s for s in range(256)], np.int64)))
            assert p.sum() == pytest.approx(1, abs=1e-5)


def naive_kn(train, depth):
    raw = [Counter() for _ in range(depth + 1)]
    for t in train:
        full = b"\xff" * depth + t + b"\xff"
        for i in range(depth, len(full)):
            raw[depth][full[i - depth : i + 1]] += 1
    for d in range(depth - 1, -1, -1):
        raw[d] = Counter(g[1:] for g in raw[d + 1])
    disc = [K.discounts(K.count_of_counts(np.array(list(c.values()) or [0]))) for c in raw]
    by = [defaultdict(list) for _ in raw]
    for d, c in enumerate(raw):
        for g, n in c.items():
            by[d][g[:-1]].append(n)

    def prob(ctx, s, d):
        low = 1 / 256 if d == 0 else prob(ctx[1:], s, d - 1)
        ns = by[d].get(ctx)
        if not ns:
            return low
        c = raw[d].get(ctx + bytes([s]), 0)
        off = 0 if not c else disc[d][min(c, 3) - 1]
        free = sum(disc[d][min(n, 3) - 1] for n in ns)
        return (c - off + free * low) / sum(ns)

    def score(t):
        full = b"\xff" * depth + t + b"\xff"
        return sum(math.log(prob(full[i - depth : i], full[i], depth)) for i in range(depth, len(full)))

    return score


def test_kneser_ney_matches_naive(spark):
    rng = random.Random(0)
    texts = ["".join(rng.choice("abcd e") for _ in range(rng.randint(0, 60))) for _ in range(50)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    m = K.train_kneser_ney(docs, depth=3)
    want = naive_kn([lowered(t) for t in texts], 3)
    probe = [b"abcd", b"", b"zz q", lowered(texts[3])]
    np.testing.assert_allclose(m.score(probe), [want(t) for t in probe], rtol=1e-9)


def test_quality_filter(spark):
    rng = random.Random(1)
    good = lambda: " ".join(rng.choice(["the", "cat", "sat", "on", "mat", "and", "dog"]) for _ in range(40))
    junk = lambda: "".join(rng.choice("@#$%^&*XQ9") for _ in range(200))
    rows = [(k, junk() if k % 10 == 9 else good(), "en" if k % 2 else "fr", "s") for k in range(400)] + [(None, good(), None, "s"), (500, None, "en", "s"), (7, rows_7 := good(), "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, keep string")
    labels = spark.createDataFrame([(k, int(k % 10 != 9)) for k in range(0, 400) if k % 3] + [(None, 1)], "doc_id long, quality int")
    out = K.quality_filter(docs, labels, least=10).toPandas()
    assert len(out) == len(rows) and rows_7
    known = out[out["doc_id"].between(0, 399)]
    is_junk = known["doc_id"] % 10 == 9
    assert not known.loc[is_junk, "keep"].any() and known.loc[~is_junk, "keep"].mean() > 0.95
    assert K.quality_filter(docs, labels.limit(0)).filter("NOT keep").count() == 0
    assert K.quality_filter(docs.limit(0), labels).count() == 0
