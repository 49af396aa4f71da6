"""Suffix arrays against direct window matching."""

from __future__ import annotations

import hashlib
import random

from quantmere.llm import decontamination as D
from quantmere.llm.common import words_of


def brute(docs, items, window=10):
    wins = {}
    for i, t in items:
        w = words_of(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + window]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, names = words_of(t), set(), set()
        for n in {len(k) for k in wins}:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in wins:
                    hit |= set(range(p, p + n))
                    names |= wins[tuple(w[p : p + n])]
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def make():
    rng = random.Random(2)
    word = lambda: rng.choice(["the", "of", "a", "in"] + [f"w{k}" for k in range(40)])
    items = [(k, " ".join(word() for _ in range(rng.randint(1, 40)))) for k in range(20)] + [(30, None), (31, ""), (32, "The OF"), (32, "in a"), (None, "w1 w2 w3")]
    docs = []
    for k in range(80):
        w = [word() for _ in range(rng.randint(0, 120))]
        if rng.random() < 0.5:
            _, text = rng.choice(items)
            cut = (text or "").split()
            at = rng.randint(0, len(w))
            w[at:at] = cut[: rng.randint(0, len(cut))]
        docs.append((k, ", ".join(w).upper() if k % 7 == 0 else " ".join(w)))
    return docs + [(90, None), (91, ""), (None, items[3][1]), (3, docs[3][1]), (92, "the of " * 9000)], items


def test_matches_brute_force(spark, monkeypatch):
    docs, items = make()
    d = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, items string")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    for size in (8 << 20, 300):  # one block, then many
        monkeypatch.setattr(D, "BLOCK_BYTES", size)
        got = D.find_contamination(d, b)
        rows = [tuple(r) for r in got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()]
        assert sorted(rows, key=str) == brute(docs, items)
    kept = D.remove_contaminated(d, b)
    assert kept.columns == d.columns
    assert sorted((str(r.doc_id) for r in kept.collect())) == sorted(str(r[0]) for r in brute(docs, items) if not r[5])


def test_longest_match(spark):
    text = " ".join(f"t{k}" for k in range(30))
    d = spark.createDataFrame([(1, f"x y {text} z"), (2, "nothing")], "doc_id long, text string")
    b = spark.createDataFrame([(5, f"{text} end")], "item_id long, text string")
    row = D.find_contamination(d, b).orderBy("doc_id").first()
    assert (row.longest, row.longest_item, row.longest_start) == (30, "5", 2)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in D.find_contamination(d, b).collect()] == [0]
    assert D.find_contamination(d.limit(0), b).count() == 0
    assert D.remove_contaminated(d, b).count() == 1
