"""Language-model scoring by context-tree weighting over bytes.

Each byte is coded as eight binary decisions; decision node s under a context
of d bytes has a Krichevsky-Trofimov estimate from its counts, and its weighted
probability is the even mixture of that estimate and of the product of its
children (contexts one byte longer), for depths 0..D:

    P_w(s) = 1/2 P_kt(s) + 1/2 prod P_w(children),   P_w = P_kt at depth D.

With counts frozen after training, the next decision's probability is a chain
of mixtures from the deepest known context up: weight b / (1 + b) for the node's
own estimate, b = P_kt(s) / prod P_w(children).

Counting is distributed (distinct grams per task, then sums).  All nodes with
the same two most recent context bytes are in one partition, where the tree is
computed bottom-up and written as sorted arrays; only the tables of depth 0 and
1, at most 65 791 nodes, pass through the driver.  Scoring looks up each task's
distinct grams in the sorted files.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, crc_mod, get_file, keep_cache, put_array, put_file, saved, shared_path, slices
from .grams import SLICE_BYTES, Shards, counted, gram_counts, gram_keys, lowered, token_counts, token_key, write_count_shards

DEPTH = 5
CACHE_GRAMS = 1_500_000
LN10 = np.log(10)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x > 0: Stirling's series after eight steps up."""
    x = np.asarray(x, float)
    low = np.ones_like(x)
    for k in range(8):
        low *= x + k
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - np.log(low)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the KT probability of n0 zeros and n1 ones, in any order."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - np.log(np.pi) - log_gamma(n0 + n1 + 1.0)


@dataclass
class Level:
    """Nodes of one depth: key = context << 8 | decision, counts, ln P_w."""

    key: np.ndarray
    n0: np.ndarray
    n1: np.ndarray
    log_pw: np.ndarray
    weight: np.ndarray  # of the node's own estimate


def decisions(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Decision nodes (sorted key, n0, n1) of sorted (context << 8 | byte) counts."""
    keys, n0s, n1s = [], [], []
    sym, context = key & 0xFF, key & ~np.int64(0xFF)
    for level in range(8):
        node = context | (1 << level) | (sym >> (8 - level))
        at = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        one = (sym >> (7 - level)) & 1
        keys.append(node[at])
        n1s.append(np.add.reduceat(n * one, at))
        n0s.append(np.add.reduceat(n * (1 - one), at))
    k, a, b = (np.concatenate(x) for x in (keys, n0s, n1s))
    order = np.argsort(k, kind="stable")
    return k[order], a[order], b[order]


def parents(key: np.ndarray) -> np.ndarray:
    """Keys of the same decision under the context without its oldest byte."""
    return (key >> 16 << 8) | (key & 0xFF)


def level_of(key: np.ndarray, n: np.ndarray, child: tuple[np.ndarray, np.ndarray] | None) -> Level:
    """One depth, given the children's (parent key, sum of ln P_w)."""
    node, n0, n1 = decisions(key, n)
    own = log_kt(n0, n1)
    if child is None:
        return Level(node, n0, n1, own, np.ones(len(node)))
    total = np.zeros(len(node))
    np.add.at(total, np.searchsorted(node, child[0]), child[1])
    half = np.log(0.5)
    weight = 1 / (1 + np.exp(np.clip(total - own, -60, 60)))
    return Level(node, n0, n1, np.logaddexp(half + own, half + total), weight)


def build_levels(key: np.ndarray, n: np.ndarray, depth: int, least: int) -> tuple[dict[int, Level], tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Levels depth..least of complete subtrees; then the (key, n) grams one level up, and child sums for it."""
    levels: dict[int, Level] = {}
    child = None
    for d in range(depth, least - 1, -1):
        levels[d] = level_of(key, n, child)
        up = parents(levels[d].key)
        u, inverse = np.unique(up, return_inverse=True)
        child = (u, np.bincount(inverse, levels[d].log_pw, len(u)))
        key, n = counted(parents(key), n)
    return levels, (key, n), child


class CtwModel:
    """Dense tables of depths 0 and 1, sorted files for the rest."""

    def __init__(self, depth: int, top: list[tuple[np.ndarray, np.ndarray]], shards: list[tuple[int, int, str]]) -> None:
        self.depth, self.top, self.manifest = depth, top, shards
        self.ready()

    def ready(self) -> None:
        self.shards = Shards(self.manifest)
        self.keys, self.logs = np.zeros(0, np.int64), np.zeros(0)

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("depth", "top", "manifest")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.ready()

    def log_probs(self, keys: np.ndarray) -> np.ndarray:
        """ln P(byte | context) of sorted distinct grams."""
        sym = keys & 0xFF
        out = np.zeros(len(keys))
        bounds = list(self.shards.parts(keys >> (8 * (self.depth - 1))))  # by the two most recent bytes
        for level in range(8):
            decision = (1 << level) | (sym >> (8 - level))
            one = ((sym >> (7 - level)) & 1).astype(bool)
            p = np.full(len(keys), 0.5)
            for path, part in bounds:
                q, s = p[part], one[part]
                for d in range(self.depth, 1, -1):
                    node = (keys[part] >> (8 * (self.depth + 1 - d)) << 8) | decision[part]
                    known = self.shards.array(f"{path}.{d}.key.npy")
                    at = np.minimum(np.searchsorted(known, node), len(known) - 1)
                    hit = known[at] == node
                    p1 = self.shards.array(f"{path}.{d}.p.npy")[at]
                    w = self.shards.array(f"{path}.{d}.w.npy")[at]
                    q = np.where(hit, w * np.where(s, p1, 1 - p1) + (1 - w) * q, q)
                p[part] = q
            for d in (1, 0):
                table_p, table_w = self.top[d]
                node = decision if d == 0 else (keys >> (8 * self.depth) << 8) | decision
                p1, w = table_p[node], table_w[node]
                p = w * np.where(one, p1, 1 - p1) + (1 - w) * p
            out += np.log(p)
        return out

    def known_logs(self, keys: np.ndarray) -> np.ndarray:
        """log_probs through the worker's cache."""
        at = np.searchsorted(self.keys, keys)
        hit = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        hit[inside] = self.keys[at[inside]] == keys[inside]
        out = np.empty(len(keys))
        out[hit] = self.logs[at[hit]]
        if not hit.all():
            new = keys[~hit]
            out[~hit] = logs = self.log_probs(new)
            if len(self.keys) + len(new) > CACHE_GRAMS:
                self.keys, self.logs = new, logs
            else:
                merged = np.concatenate([self.keys, new])
                order = np.argsort(merged, kind="stable")
                self.keys, self.logs = merged[order], np.concatenate([self.logs, logs])[order]
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """ln probability of each text, its end included."""
        keys, lengths = gram_keys(texts, self.depth)
        codes, distinct = pd.factorize(keys)
        order = np.argsort(distinct)
        logs = np.empty(len(distinct))
        logs[order] = self.known_logs(distinct[order])
        return np.add.reduceat(logs[codes], np.cumsum(lengths) - lengths)


def train_ctw(docs: DataFrame, text_col: str = "text", depth: int = DEPTH) -> CtwModel:
    spark = docs.sparkSession
    out_dir = shared_path(spark, "ctw-nodes")
    counts = saved(gram_counts(docs, F.col(text_col), depth), "ctw-grams")

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = f"{TaskContext.get().partitionId()}-{TaskContext.get().taskAttemptId()}"
        held: list[tuple[np.ndarray, np.ndarray]] = []
        seq = 0

        def done(key: np.ndarray, n: np.ndarray) -> pd.DataFrame:
            levels, (up_key, up_n), child = build_levels(key, n, depth, 2)
            path = f"{out_dir}/{part}-{seq}"
            for d, lv in levels.items():
                put_array(f"{path}.{d}.key.npy", lv.key)
                put_array(f"{path}.{d}.p.npy", ((lv.n1 + 0.5) / (lv.n0 + lv.n1 + 1)).astype(np.float32))
                put_array(f"{path}.{d}.w.npy", lv.weight.astype(np.float32))
            top = key >> (8 * (depth - 1))
            rows = [("shard", int(top[0]), int(top[-1]), 0.0, path)]
            rows += [("gram", int(k), 0, float(v), "") for k, v in zip(up_key, up_n, strict=True)]
            rows += [("child", int(k), 0, float(v), "") for k, v in zip(*child, strict=True)]
            return pd.DataFrame(rows, columns=["kind", "key", "hi", "value", "path"])

        size = 0
        for batch in batches:
            if not len(batch):
                continue
            held.append((batch["key"].to_numpy(np.int64), batch["n"].to_numpy(np.int64)))
            size += len(batch)
            if size >= 400_000:  # cut where the two most recent bytes change
                key, n = (np.concatenate([h[k] for h in held]) for k in (0, 1))
                pair = key >> (8 * (depth - 1))
                cut = int(np.searchsorted(pair, pair[-1]))
                if cut:
                    yield done(key[:cut], n[:cut])
                    seq += 1
                held, size = [(key[cut:], n[cut:])], len(key) - cut
        if held:
            yield done(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))

    pair = F.shiftright("key", 8 * (depth - 1))
    nodes = saved(counts.repartitionByRange(pair).sortWithinPartitions("key").mapInPandas(build, "kind string, key long, hi long, value double, path string"), "ctw-parts")
    shards = [(r.key, r.hi, r.path) for r in nodes.filter("kind = 'shard'").collect()]  # one row per file
    small = nodes.filter("kind <> 'shard'").groupBy("kind", "key").agg(F.sum("value").alias("value")).toPandas()  # at most 2 x 65536 rows
    top = []
    gram, child = (small[small["kind"] == k].sort_values("key") for k in ("gram", "child"))
    key, n = gram["key"].to_numpy(np.int64), gram["value"].to_numpy()
    sums = (child["key"].to_numpy(np.int64), child["value"].to_numpy())
    for d in (1, 0):
        p, w = np.full(1 << (8 * (d + 1)), 0.5), np.full(1 << (8 * (d + 1)), 0.5)
        if len(key):
            lv = level_of(key, n, sums)
            p[lv.key], w[lv.key] = (lv.n1 + 0.5) / (lv.n0 + lv.n1 + 1), lv.weight
            up, inverse = np.unique(parents(lv.key), return_inverse=True)
            sums = (up, np.bincount(inverse, lv.log_pw, len(up)))
            key, n = counted(parents(key), n)
        top.insert(0, (p, w))
    return CtwModel(depth, top, shards)


_LOADED: dict[str, tuple] = {}
keep_cache("ctw", _LOADED.clear)


def _load(path: str) -> tuple:
    claim("ctw")
    if path not in _LOADED:
        _LOADED.clear()
        model, tokens, total, distinct = pickle.loads(get_file(path))
        _LOADED[path] = (model, Shards(tokens), total, distinct, {})
    return _LOADED[path]


def score_corpus(docs: DataFrame, *, held_mod: int = 7, held_rest: int = 2, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every text by a model of those whose crc32(id as text) mod 7 is not 2.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one
    unigrams), score (log10 probability of the lower-cased text and its end by the
    context tree), n_bytes and bits_per_byte.  Null texts are empty: one end.
    With nothing to learn from all decisions are even.  Rows are kept one to one.
    """
    spark = docs.sparkSession
    train = docs.filter(crc_mod(id_col, held_mod) != held_rest)
    model = train_ctw(train, text_col, depth)
    tokens, total, distinct = write_count_shards(token_counts(train, F.col(text_col)), "token-counts")
    path = shared_path(spark, "ctw-model") + ".pkl"
    put_file(path, pickle.dumps((model, tokens, total, distinct)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, shards, total, distinct, cache = _load(path)
        norm = np.log10(total + distinct + 1)
        for batch in batches:
            texts = [lowered(t) for t in batch["text"].tolist()]
            for a, b in slices([len(t) + 1 for t in texts], SLICE_BYTES):
                some = texts[a:b]
                scores = model.score(some) / LN10
                words = [t.split() for t in some]
                if len(cache) > 400_000:
                    cache.clear()
                new = list({w for ws in words for w in ws}.union({b""}).difference(cache))
                keys = np.fromiter(map(token_key, new), np.int64, len(new))
                order = np.argsort(keys)
                counts = np.zeros(len(new), np.int64)
                counts[order] = shards.find(keys[order])
                cache.update(zip(new, counts.tolist(), strict=True))
                n_tokens = np.array([len(w) + 1 for w in words], np.int64)
                c = np.fromiter((cache[x] for ws in words for x in (*ws, b"")), np.int64, n_tokens.sum())
                starts = np.cumsum(n_tokens) - n_tokens
                base = np.add.reduceat(np.log10(c + 1) - norm, starts)
                n_bytes = np.array([len(t) for t in some], np.int64)
                yield pd.DataFrame(
                    {
                        "doc_id": batch["doc_id"].iloc[a:b].to_numpy(),
                        "held_out": batch["held_out"].iloc[a:b].to_numpy(),
                        "n_tokens": n_tokens,
                        "n_known": np.add.reduceat((c > 0).astype(np.int64), starts),
                        "train_tokens": total,
                        "base_score": base,
                        "score": scores,
                        "n_bytes": n_bytes,
                        "bits_per_byte": -scores / np.log10(2) / np.maximum(n_bytes + 1, 1),
                    }
                )

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), (crc_mod(id_col, held_mod) == held_rest).alias("held_out"), F.col(text_col).alias("text"))
    out = rows.mapInPandas(run, "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
