"""Targets by water-filling, quotas by highest quotients, words taken."""

from __future__ import annotations

import heapq
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quantmere.llm import mixing as X


def brute(votes, seats, most):
    got = [0] * len(votes)
    heap = [(-v, k) for k, v in enumerate(votes) if v > 0 and most[k] > 0]
    heapq.heapify(heap)
    while seats and heap:
        _, k = heapq.heappop(heap)
        got[k] += 1
        seats -= 1
        if got[k] < most[k]:
            heapq.heappush(heap, (-votes[k] / (2 * got[k] + 1), k))
    return got


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=8), st.integers(0, 60), st.data())
def test_highest_quotients(votes, seats, data):
    most = data.draw(st.lists(st.integers(0, 30), min_size=len(votes), max_size=len(votes)))
    assert X.highest_quotients(np.array(votes), seats, np.array(most)).tolist() == brute([float(v) for v in votes], seats, most)


def fill(sizes, weights, budget, cap):
    """Targets by repeated resharing."""
    total, open_ = budget * sum(sizes), set(range(len(sizes)))
    out = [0.0] * len(sizes)
    while open_:
        left = total - sum(out[k] for k in range(len(sizes)) if k not in open_)
        share = {k: left * weights[k] / sum(weights[j] for j in open_) for k in open_}
        over = {k for k in open_ if share[k] > cap * sizes[k]}
        for k in over or open_:
            out[k] = cap * sizes[k] if over else share[k]
        if not over:
            break
        open_ -= over
    return out


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string, quota string")


def test_mix(spark):
    rng = random.Random(3)
    rows = [(k, "w " * rng.randint(0, 90), rng.choice(["b", "a", None, "é", "Z"]) if k % 3 else "hot", "x", "y") for k in range(600)]
    rows += [rows[5]] * 3 + [(None, "a b c", "a", "", ""), (601, None, "b", "", ""), (602, "q " * 20000, "b", "", ""), (603, "", "empty", "", "")]
    docs = docs_of(spark, rows)
    out = X.mix_sources(docs, shard_words=3000).toPandas()
    again = X.mix_sources(docs.repartition(7), shard_words=3000).toPandas()
    assert len(out) == len(rows)
    key = lambda d: sorted(map(str, d[["doc_id", "source", "size", "taken"]].to_numpy().tolist()))
    assert key(out) == key(again)
    assert (out["taken"] <= 2 * out["size"]).all() and (out["taken"] >= 0).all()
    names = sorted({r[2] for r in rows if r[2] is not None}, key=lambda s: s.encode()) + [None]
    sizes = [sum(len((t or "").split()) for _, t, s, *_ in rows if s == n) for n in names]
    want = fill(sizes, [(3, 1, 2)[k % 3] for k in range(len(names))], 1.5, 2.0)
    for n, size, w in zip(names, sizes, want, strict=True):
        part = out[out["source"].isna()] if n is None else out[out["source"] == n]
        assert (part["source_size"] == size).all()
        assert np.allclose(part["target"], w)
        assert abs(part["taken"].sum() - w) <= 64 * 1.5, n


def test_empty(spark):
    assert X.mix_sources(docs_of(spark, [])).count() == 0


def test_source_quotas_by_brute_force(spark):
    rng = random.Random(9)
    for n in (1, 2, 3, 40):
        target = [float(rng.choice([0, 0, 1, 20, 31, 33, 64, 640, 640, 5000, rng.randint(1, 9000)])) for _ in range(n)]
        frame = spark.createDataFrame([(k + 1, t) for k, t in enumerate(target)], "rank long, target double")
        got = [r.quota for r in X.source_quotas(frame, 64).orderBy("rank").collect()]
        seats = int(round(sum(target) / 64))
        assert got == brute(target, seats, [seats] * n), target


def test_small_sources_get_their_words(spark):
    docs = docs_of(spark, [(k, "w " * n, s, "", "") for k, (n, s) in enumerate([(1, "a"), (3, "b"), (9, "c"), (30, "d"), (4000, "e"), (0, "f")])])
    out = X.mix_sources(docs).toPandas()
    small = out[out["target"] < 64]
    assert len(small) >= 4 and (small["taken"] - small["target"].round()).abs().max() <= 1


def test_mixed_documents(spark, tmp_path):
    rows = [(k, "w " * (k % 50 + 1), "ab"[k % 2], "x", "y") for k in range(300)] + [(300, None, "a", "", ""), (300, "", "a", "", ""), (5, "w " * 6, "b", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy0 string, row string")
    docs.write.parquet(f"{tmp_path}/docs")
    read = spark.read.parquet(f"{tmp_path}/docs")
    out = X.mixed_documents(read)
    assert out.columns == docs.columns
    got = sorted(map(str, out.collect()))
    assert got == sorted(map(str, X.mixed_documents(docs.repartition(3)).collect()))
    words = sum(len((r.text or "").split()) for r in out.collect())
    assert abs(words / (1.5 * sum(len((t or "").split()) for _, t, *_ in rows)) - 1) < 0.1
    assert X.mixed_documents(read.limit(0)).count() == 0
