"""The stages in order, on a small table with planted cases."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd

import corpus_pipeline as P


def make(tmp_path, spark):
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefghijkl") + rng.choice(["an", "or", "is"]) + str(rng.randint(0, 60))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(k, text(25)) for k in range(5)]
    rows, labels, bad, leak, copies = [], [], set(), set(), {}
    for k in range(260):
        t = text(rng.randint(30, 90))
        if k % 4 == 0:
            t = t.split()
            t[5:5] = ["foulword", "vilething", "foulword"]
            t = " ".join(t)
            bad.add(k)
        elif k % 13 == 1:
            t += " " + items[k % 5][1]
            leak.add(k)
        elif k % 17 == 2 and k > 20:
            base = next(r for r in rows if r[0] == k - 1 or r[0] == k - 3)
            if base[0] not in bad | leak:
                t = base[1]
                copies[k] = base[0]
        rows.append((k, t, "en", f"s{k % 3}", len(t)))
        labels.append((k, 1, int(k in bad)))
    rows += [(300, None, None, None, None), (301, "", "en", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows, bad, leak, copies


def test_stages(spark, tmp_path):
    rows, bad, leak, copies = make(tmp_path, spark)
    docs = P.table(spark, str(tmp_path), "documents")
    names = docs.columns
    seen = {}
    for name, stage in P.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.toPandas()
        if name != "token-ids":
            assert docs.columns == names
    ids = lambda n: set(seen[n]["doc_id"])
    everyone = {r[0] for r in rows}
    assert len((everyone - ids("toxicity")) & bad) > 0.9 * len(bad) and len(everyone - ids("toxicity") - bad) <= 8
    assert not {k for k, b in copies.items() if b in ids("near-dedup")} & ids("near-dedup")
    assert ids("toxicity") - ids("near-dedup") <= set(copies)
    assert ids("near-dedup") - ids("decontamination") == leak & ids("near-dedup")
    mixed, before = seen["mixing"], seen["decontamination"]
    sizes = before.assign(n=before["text"].fillna("").map(lambda t: len(t.split())))
    assert mixed.groupby("doc_id").size().max() <= 2
    taken = mixed["text"].map(lambda t: len(t.split())).sum()
    assert abs(taken / (1.5 * sizes["n"].sum()) - 1) < 0.15
    out = seen["token-ids"].sort_values("start")
    assert len(out) == len(mixed) and (out["start"].to_numpy() == np.concatenate([[0], out["n_tokens"].cumsum().to_numpy()[:-1]])).all()
    assert isinstance(out, pd.DataFrame) and P.ORACLE_SQL is None


def test_workers_give_their_caches_back(spark):
    from quantmere.llm import common as C

    def owners(claimed):
        def run(batches):
            if claimed:
                C.claim(claimed)
            yield from (pd.DataFrame({"owner": [C._OWNER[0]] * len(b)}) for b in batches)

        return {r.owner for r in spark.range(0, 8, 1, 8).mapInPandas(run, "owner string").collect()}

    assert owners("tokens") == {"tokens"}
    C.give_back(spark)
    assert owners(None) == {""}
