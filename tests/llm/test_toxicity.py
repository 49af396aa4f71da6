"""The classifier: gradients, held-out accuracy, thresholds, odd inputs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from quantmere.llm import toxicity as T
from quantmere.llm.common import crc_mod

SMALL = T.CnnConfig(buckets=1 << 14, epochs=6)


def sample(n, seed=0):
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in ("ba", "ko", "mi", "tu", "re") for b in ("na", "sol", "ter", "li", "vek", "dor")]
    texts, labels = [], []
    for _ in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(5, 120))]
        y = rng.random() < 0.2
        if y:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["vilecur", "grimsod", "snagrot" + rng.choice(vocab)]))
        texts.append(" ".join(w))
        labels.append(int(y))
    return texts, labels


def test_learns_words_and_compounds():
    x, y = sample(900)
    m = T.train(x, y, SMALL)
    tx, ty = sample(400, 1)
    p = m.score_texts(tx) >= 0.5
    assert (p == np.array(ty)).mean() > 0.97


def plain_logit(m, words):
    """Forward pass by loops over words, filters and positions."""
    pad = max(m.config.widths) - 1
    rows = [T.hashed_rows([w], m.config.buckets)[0] for w in words] + [np.zeros(T.ROWS_PER_WORD, int)] * (pad + (pad == 0))
    x = [sum(m.embed[r] for r in row) for row in rows]
    z = m.out_bias
    for w, (width, kernel, bias) in enumerate(zip(m.config.widths, m.kernels, m.biases, strict=True)):
        for f in range(m.config.filters):
            best = 0.0
            for at in range(len(x) - width + 1):
                best = max(best, float(np.concatenate(x[at : at + width]) @ kernel[:, f] + bias[f]))
            z += best * m.out[w * m.config.filters + f]
    return z


def plain_loss(m, docs, y, weight):
    z = np.array([plain_logit(m, d) for d in docs])
    return float(np.mean(weight * (np.log1p(np.exp(z)) - y * z)))


def doubles(m):
    m.embed, m.kernels, m.biases = m.embed.astype(float), [k.astype(float) for k in m.kernels], [b.astype(float) + 0.05 for b in m.biases]
    return m


def test_forward_pass_and_gradients_by_brute_force():
    m = doubles(T.init_model(T.CnnConfig(buckets=64, dim=3, widths=(1, 2, 3), filters=2)))
    docs = [[b"one", b"two", b"three", b"two"], [b"two"], [b"four", b"five", b"one", b"six", b"two"]]
    ids = [m.ids(b" ".join(d).decode()) for d in docs]
    m.settle(vectors=True)
    z = np.array([plain_logit(m, d) for d in docs])
    np.testing.assert_allclose(m.scores(ids), 1 / (1 + np.exp(-z)), rtol=1e-5)
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([0.7, 1.3, 1.0])
    grad, eps = T.gradients(m, ids, y, weight), 1e-6

    def slope(array, at):
        old, out = array[at], []
        for step in (eps, -eps):
            array[at] = old + step
            out.append(plain_loss(m, docs, y, weight))
        array[at] = old
        return (out[0] - out[1]) / (2 * eps)

    for k in range(len(m.out)):
        assert slope(m.out, k) == pytest.approx(grad.out[k], abs=1e-6)
    for w, kernel in enumerate(m.kernels):
        for at in np.ndindex(kernel.shape):
            assert slope(kernel, at) == pytest.approx(grad.kernels[w][at], abs=1e-5)
        for f in range(m.config.filters):
            assert slope(m.biases[w], f) == pytest.approx(grad.biases[w][f], abs=1e-5)
    dense = np.zeros_like(m.embed)
    dense[grad.rows] = grad.embed
    for row in range(1, 64):
        for k in range(3):
            assert slope(m.embed, (row, k)) == pytest.approx(dense[row, k], abs=1e-5)


def test_scores_do_not_depend_on_slices():
    x, y = sample(200)
    m = T.train(x, y, SMALL)
    whole = m.score_texts(x)
    one = np.concatenate([m.score_texts([t]) for t in x])
    np.testing.assert_allclose(whole, one, atol=1e-5)
    assert 0 <= m.score_texts([None, "", "!!", "a " * 50_000]).min() <= 1


def test_one_class_is_constant():
    assert T.train(["a", "b"], [0, 0], SMALL).score_texts(["x", None]).tolist() == [0.01, 0.01]
    assert len(T.train([], [], SMALL).score_texts(["x"])) == 1


def test_calibration_by_language():
    s = np.array([0.1, 0.2, 0.9, 0.8] * 20)
    y = np.array([0, 0, 1, 1] * 20)
    cut = T.calibrate(s, y, ["en", None, "en", "fr"] * 20, least=20)
    assert set(cut) == {"", "en", "fr"} and 0.2 < cut["en"] < 0.9


def test_tables(spark):
    x, y = sample(400)
    docs = spark.createDataFrame([(k, t, "en", 0.5) for k, t in enumerate(x)] + [(None, "a", None, 0.1), (5, x[5], "en", 0.0), (990, None, "xx", 0.0), (991, "", None, 0.0)], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(k, 1, v) for k, v in enumerate(y)] + [(None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    m = T.fit_toxicity(docs, labels, SMALL)
    out = T.score_toxicity(docs, m).toPandas()
    assert len(out) == 404 and out["score"].between(0, 1).all()
    kept = T.remove_toxic(docs, labels, SMALL)
    assert kept.columns == docs.columns
    bad = {k for k, v in enumerate(y) if v}
    gone = set(range(400)) - {r.doc_id for r in kept.collect()}
    assert len(gone & bad) / len(bad) > 0.9 and len(gone - bad) <= 4
    assert T.remove_toxic(docs.limit(0), labels, SMALL).count() == 0


def test_held_out_rows_teach_nothing(spark):
    docs = spark.createDataFrame([(k, f"word{k}") for k in range(60)], "doc_id long, text string").selectExpr("*", "'en' AS lang")
    held = docs.filter(crc_mod("doc_id", 5) == 0)
    labels = held.selectExpr("doc_id", "CAST(1 AS INT) AS toxic")
    m = T.fit_toxicity(docs, labels, SMALL)
    assert not len(m.out) and m.prior == pytest.approx(0.01)


def test_bytes_are_filled_by_hash(spark):
    x, y = sample(300)
    rows = [(1000, "big " * 100_000, "en"), *[(k, t, ("de", "en", "fr")[k // 100]) for k, t in enumerate(x)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    labels = spark.createDataFrame([(1000, 0), *enumerate(y)], "doc_id long, toxic int")
    seen = []
    fit, T.train = T.train, lambda texts, ys, c: seen.append((texts, ys)) or fit(texts, ys, c)
    try:
        for most, part in ((200_000, (0.99, 1.0)), (40_000, (0.1, 0.6))):
            c = T.CnnConfig(buckets=1 << 14, epochs=2, max_bytes=most)
            m = T.fit_toxicity(docs, labels, c)
            texts, ys = seen.pop()
            assert len(m.out) and sum(map(len, texts)) <= most and set(ys) == {0, 1}
            use = [k for k, t in enumerate(x) if t in set(texts)]
            assert {k // 100 for k in use} == {0, 1, 2}
            trained = sum(map(len, x[:300])) * 0.64
            assert part[0] * 0.8 < sum(map(len, texts)) / trained < part[1] * 1.25
            T.fit_toxicity(docs.orderBy(docs.doc_id.desc()), labels, c)
            assert seen.pop() == (texts, ys)
    finally:
        T.train = fit


def test_what_does_not_fit_is_passed_over():
    assert T.fitting([5, 100, 3, 0, 4], [1, 1, 2, 3, 1], 14) == [1, 0, 2, 3, 0]


def test_every_labelled_row_teaches(spark):
    docs = spark.range(16_000).selectExpr("id AS doc_id", "concat('w', id % 97, ' x', id % 13, if(id % 16 = 3, ' grimsod', ''), ' y', id % 7) AS text", "if(id % 3 = 0, null, 'en') AS lang")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 16 = 3 AS INT) AS toxic")
    c = T.CnnConfig(buckets=1 << 12, epochs=2, steps=1)
    m = T.fit_toxicity(docs, labels, c)
    used = labels.filter(crc_mod("doc_id", 5) != 0).selectExpr("toxic", f"pmod(xxhash64({c.seed}, doc_id), 5) = 0 AS held").toPandas()
    assert m.prior == pytest.approx(used.toxic[~used.held].mean(), abs=1e-12)  # of all rows, not of a sample
    again = T.fit_toxicity(docs.orderBy(docs.doc_id.desc()), labels, c)
    assert (m.embed == again.embed).all() and m.thresholds == again.thresholds and set(m.thresholds) == {"", "en"}
    p = m.score_texts(["w1 x2 grimsod y3", "w1 x2 y3"])
    assert p[0] > 0.9 and p[1] < 0.1
