"""ProbMinHash estimates, exact similarity, classes against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from quantmere.llm import near_dedup as N
from quantmere.llm.common import words_of
from quantmere.llm.graph import connected_components


def test_estimates_probability_jaccard():
    rng = np.random.default_rng(0)
    docs = []
    for _ in range(60):
        a = [b"w%d" % x for x in rng.integers(0, 400, 300)]
        b = list(a)
        for k in rng.integers(0, 300, int(rng.integers(0, 20))):
            b[k] = b"z%d" % k
        docs += [a, b + a[:40]]
    doc, h, w = N.weighted_shingles(docs)
    sig = N.prob_minhash(doc, h, w, len(docs), 512)
    exact, est = [], []
    for k in range(0, len(docs), 2):
        sets = [(h[doc == k + i], w[doc == k + i]) for i in (0, 1)]
        exact.append(N.probability_jaccard(*sets))
        est.append((sig[k] == sig[k + 1]).mean())
    assert np.abs(np.array(exact) - est).max() < 0.1 and abs(np.mean(np.array(exact) - est)) < 0.01


def test_early_end_equals_long_horizon():
    doc, h, w = N.weighted_shingles([[b"a%d" % k for k in range(n)] for n in (1, 5, 7, 40, 900)])
    a = N.prob_minhash(doc, h, w, 5, 64, reach=0.0)
    b = N.prob_minhash(doc, h, w, 5, 64, reach=12.0)
    assert (a == b).all()


def test_weights_matter_by_ratio():
    one, two = [b"x"] * 5 + [b"y"] * 5, ([b"x"] * 5 + [b"y"] * 5) * 2
    (_, ha, wa), (_, hb, wb) = N.weighted_shingles([one]), N.weighted_shingles([two])
    assert 0 < N.probability_jaccard((ha, wa), (hb, wb)) <= 1
    assert N.probability_jaccard((ha, wa), (ha, wa * 3)) == pytest.approx(1)
    assert N.probability_jaccard((ha[:0], wa[:0]), (hb, wb)) == 0


def corpus():
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefghijklmnop") + str(rng.randint(0, 99))
    rows, k = [], 0
    for _ in range(25):  # chains of edits, copies among them
        text = [word() for _ in range(80)]
        for _ in range(rng.randint(1, 12)):
            rows.append((k, " ".join(text)))
            k += 1
            if rng.random() < 0.6:
                text = list(text)
                text[rng.randrange(80)] = word()
    rows += [(k, "Same, words!"), (k + 1, "same words"), (k + 2, None), (k + 3, ""), (k + 4, "..."), (None, "same WORDS"), (k + 5, " ".join(word() for _ in range(6000)))]
    return rows


def brute_classes(rows, similar=0.8):
    shingles = [N.weighted_shingles([words_of(t)])[1:] for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if N.probability_jaccard(shingles[a], shingles[b]) >= similar:
                label[find(a)] = find(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(rows[k][0])
    return sorted(sorted(map(str, g)) for g in groups.values())


def test_classes_match_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, label string")
    out = N.near_duplicates(docs).toPandas()
    assert len(out) == len(rows)
    groups = {}
    for d, c in zip(out["doc_id"], out["class_id"], strict=True):
        groups.setdefault(c, []).append("None" if np.isnan(d) else str(int(d)))
    assert sorted(map(sorted, groups.values())) == brute_classes(rows)
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert {str(r.doc_id) for r in kept.collect()} >= {str(int(c)) for c in groups if not np.isnan(c)}


def test_repeats_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")] * 3 + [(2, "a b c d e f")], "doc_id long, text string")
    assert {(r.class_id, r.class_size) for r in N.near_duplicates(docs).collect()} == {(1, 4)}
    assert [r.doc_id for r in N.keep_one(docs).collect()] == [1]
    assert N.near_duplicates(docs.limit(0)).count() == 0 and N.keep_one(docs.limit(0)).count() == 0


def test_other_ids_and_clashing_columns(spark, tmp_path):
    names = "doc_id string, text string, key int, sig int, node int, file int, row int, label int, _metadata int"
    rows = [("x1", "one two three four five six"), ("x0", "One two, three four five six!"), (None, "other words"), ("y", None)]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6, 7) for r in rows], names)
    docs.write.parquet(f"{tmp_path}/docs")
    for d in (docs, spark.read.parquet(f"{tmp_path}/docs")):
        assert sorted((str(r.doc_id), str(r.class_id), r.class_size) for r in N.near_duplicates(d).collect()) == [("None", "None", 1), ("x0", "x0", 2), ("x1", "x0", 2), ("y", "y", 1)]
        kept = N.keep_one(d)
        assert kept.schema.names == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["None", "x0", "y"]


def test_blocks_split_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 4)
    texts = [" ".join(f"w{k * 100 + x}" for x in range(30)) for k in range(18)]
    texts[7], texts[11], texts[12], texts[17] = texts[2] + " end", texts[0] + " end", "start " + texts[5], texts[13] + " end"
    doc, h, w = N.weighted_shingles([N.words_of(t) for t in texts])
    sigs = (N.prob_minhash(doc, h, w, 18, 20) >> np.uint64(48)).astype("<u2")
    sigs[:, :5] = 1  # all share the first band
    label = [100 if k >= 12 else k for k in range(18)]  # the last six are one class already
    members = spark.createDataFrame([(64, k, label[k]) for k in range(18)], "bucket long, node long, label long")
    nodes = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in enumerate(sigs)], "node long, sig binary")
    known = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    dealt = N.block_pairs(members)
    met = {tuple(sorted((a.node, b.node))) for _, g in dealt.toPandas().groupby(["bucket", "i", "j"]) for a in g.itertuples() for b in g.itertuples() if a.own == a.i and b.own == a.j and a.node != b.node}
    assert met >= {(a, b) for b in range(18) for a in range(b) if label[a] != label[b]}
    assert not any(a >= 12 for a, _ in met)  # the main class isn't compared with itself
    near = N.near_members(dealt.join(nodes, "node"), 0.5, 5)
    out = N.compare_blocks(near, known, similar=0.8, least=0.5, rows=5, size=5)
    assert {(r.a, r.b) for r in out.collect()} == {(2, 7), (0, 11), (5, 12)}


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[102] == 100 and len(got) == 44
