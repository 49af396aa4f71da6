"""Quality by an interpolated modified Kneser-Ney model of trusted text.

The model predicts bytes from up to ``depth`` bytes before them.  The longest
grams keep their counts; shorter ones count the distinct bytes that precede
them (continuation counts).  Three discounts for each order come from the
counts of counts.  Grams are counted per task, summed by a shuffle and sorted
into shard files; scoring joins each task's distinct grams with those sorted
shards, order by order, so texts never move.  Documents are kept if their
perplexity is at most a quantile of their language's trusted documents that
took no part in training.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, crc_mod, get_file, keep_cache, put_array, put_file, saved, shared_path, slices
from .ctw import CACHE_GRAMS, parents
from .grams import SLICE_BYTES, Shards, counted, gram_counts, gram_keys, lowered, write_count_shards

DEPTH = 5


def context_stats(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts of sorted (context << 8 | byte) counts; per context total and how many counts are 1, 2, more."""
    context = key >> 8
    at = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(key) else np.zeros(0, np.int64)
    cols = (n, n == 1, n == 2, n > 2)
    return context[at], np.stack([np.add.reduceat(c.astype(np.int64), at) if len(at) else np.zeros(0, np.int64) for c in cols], axis=1)


def count_of_counts(n: np.ndarray) -> np.ndarray:
    return np.array([(n == k).sum() for k in (1, 2, 3, 4)], np.int64)


def discounts(n: np.ndarray) -> np.ndarray:
    """Discounts of counts 1, 2 and more; where a count of counts is 0, the plain ones of half a count."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if min(n1, n2, n3, n4) <= 0:
        return np.array([0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    d = np.array([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(d, 0.05, [0.95, 1.9, 2.9])


def lower_order(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Continuation counts one byte shorter, from the distinct grams."""
    return counted(parents(key))


def mix_order(p: np.ndarray, c: np.ndarray, stats: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Interpolate: discounted share plus the mass set free times the shorter order's p."""
    total = stats[:, 0]
    off = np.where(c <= 0, 0, np.where(c == 1, d[0], np.where(c == 2, d[1], d[2])))
    free = stats[:, 1] * d[0] + stats[:, 2] * d[1] + stats[:, 3] * d[2]
    with np.errstate(divide="ignore", invalid="ignore"):
        q = (c - off + free * p) / total
    return np.where(total > 0, q, p)


class KneserNeyModel:
    """Dense tables for contexts of 0 and 1 bytes, sorted files for longer ones."""

    def __init__(self, depth: int, top: list[np.ndarray], discount: list[np.ndarray], shards: list[tuple[int, int, str]]) -> None:
        self.depth, self.top, self.discount, self.manifest = depth, top, discount, shards
        self.ready()

    def ready(self) -> None:
        self.shards = Shards(self.manifest)
        self.keys, self.logs = np.zeros(0, np.int64), np.zeros(0)
        self.stats = []
        for d, table in enumerate(self.top):
            n = table.reshape(1 << (8 * d), 256)
            self.stats.append(np.stack([n.sum(1), (n == 1).sum(1), (n == 2).sum(1), (n > 2).sum(1)], axis=1))

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("depth", "top", "discount", "manifest")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.ready()

    def log_probs(self, keys: np.ndarray) -> np.ndarray:
        """ln P(byte | context) of sorted distinct grams."""
        p = np.full(len(keys), 1 / 256)
        for d in (0, 1):
            gram = (keys >> (8 * (self.depth + 1 - d)) << 8) | (keys & 0xFF)
            p = mix_order(p, self.top[d][gram], self.stats[d][gram >> 8], self.discount[d])
        for path, part in self.shards.parts(keys >> (8 * (self.depth - 1))):
            q = p[part]
            for d in range(2, self.depth + 1):
                gram = (keys[part] >> (8 * (self.depth + 1 - d)) << 8) | (keys[part] & 0xFF)
                known, n = (self.shards.array(f"{path}.{d}.{x}.npy") for x in ("key", "n"))
                at = np.minimum(np.searchsorted(known, gram), len(known) - 1)
                c = np.where(known[at] == gram, n[at], 0)
                contexts, stats = (self.shards.array(f"{path}.{d}.{x}.npy") for x in ("context", "stats"))
                at = np.minimum(np.searchsorted(contexts, gram >> 8), len(contexts) - 1)
                s = np.where((contexts[at] == gram >> 8)[:, None], stats[at], 0)
                q = mix_order(q, c, s, self.discount[d])
            p[part] = q
        return np.log(p)

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


def train_kneser_ney(docs: DataFrame, text_col: str = "text", depth: int = DEPTH) -> KneserNeyModel:
    spark = docs.sparkSession
    out_dir = shared_path(spark, "kn-shards")
    counts = saved(gram_counts(docs, F.col(text_col), depth), "kn-grams")

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = f"{TaskContext.get().partitionId()}-{TaskContext.get().taskAttemptId()}"
        held: list[tuple[np.ndarray, np.ndarray]] = []
        seq = size = 0

        def done(key: np.ndarray, n: np.ndarray) -> pd.DataFrame:
            path = f"{out_dir}/{part}-{seq}"
            top = key >> (8 * (depth - 1))
            rows = [("shard", int(top[0]), int(top[-1]), 0.0, path)]
            for d in range(depth, 1, -1):
                context, stats = context_stats(key, n)
                for name, array in (("key", key), ("n", n), ("context", context), ("stats", stats)):
                    put_array(f"{path}.{d}.{name}.npy", array)
                rows += [("often", 4 * d + k, 0, float(v), "") for k, v in enumerate(count_of_counts(n))]
                key, n = lower_order(key)
            rows += [("gram", int(k), 0, float(v), "") for k, v in zip(key, n, strict=True)]
            return pd.DataFrame(rows, columns=["kind", "key", "hi", "value", "path"])

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
    parts = saved(counts.repartitionByRange(pair).sortWithinPartitions("key").mapInPandas(build, "kind string, key long, hi long, value double, path string"), "kn-parts")
    shards = [(r.key, r.hi, r.path) for r in parts.filter("kind = 'shard'").collect()]  # one row per file
    small = parts.filter("kind <> 'shard'").groupBy("kind", "key").agg(F.sum("value").alias("value")).toPandas()  # at most 65536 and 4 per order
    often = np.zeros(4 * (depth + 1), np.int64)
    rows = small[small["kind"] == "often"]
    often[rows["key"].to_numpy(np.int64)] = rows["value"].to_numpy()
    rows = small[small["kind"] == "gram"].sort_values("key")
    one = np.zeros(1 << 16, np.int64)
    one[rows["key"].to_numpy(np.int64)] = rows["value"].to_numpy()
    zero = np.zeros(1 << 8, np.int64)
    if len(rows):
        k, n = lower_order(rows["key"].to_numpy(np.int64))
        zero[k] = n
    often[0:4], often[4:8] = count_of_counts(zero), count_of_counts(one)
    return KneserNeyModel(depth, [zero, one], [discounts(often[4 * d : 4 * d + 4]) for d in range(depth + 1)], shards)


_LOADED: dict[str, object] = {}
keep_cache("kneser_ney", _LOADED.clear)


def _load(path: str):
    claim("kneser_ney")
    if path not in _LOADED:
        if len(_LOADED) > 2:
            _LOADED.clear()
        _LOADED[path] = pickle.loads(get_file(path))
    return _LOADED[path]


def id_filter(ids: DataFrame, name: str):
    """A pandas UDF that tells whether an id is among ``ids`` (column key), by sorted files instead of a shuffle of texts."""
    manifest, _, _ = write_count_shards(ids.filter("key IS NOT NULL").distinct().withColumn("n", F.lit(1).cast("long")), name)
    path = shared_path(ids.sparkSession, name) + ".pkl"
    put_file(path, pickle.dumps(Shards(manifest)))

    def among(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        shards = _load(path)
        for batch in batches:
            valid = batch.notna().to_numpy()
            out = np.zeros(len(batch), bool)
            keys = batch[valid].to_numpy(np.int64)
            order = np.argsort(keys)
            hits = np.zeros(len(keys), bool)
            hits[order] = shards.find(keys[order]) > 0
            out[valid] = hits
            yield pd.Series(out)

    return F.pandas_udf(among, "boolean", F.PandasUDFType.SCALAR_ITER)


SCORED = "doc_id string, lang string, calibrates boolean, n_bytes long, log10_prob double, perplexity double"


def quality_filter(docs: DataFrame, labels: DataFrame, *, depth: int = DEPTH, quantile: float = 0.99, calibration_mod: int = 5, least: int = 30) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity (per byte), threshold and keep of every row.

    Trusted are the documents that ``labels`` marks with quality 1; one in five of
    them (crc32 of the id) is held out of training and sets the thresholds.  A
    language with fewer than ``least`` such documents, or null, uses the threshold
    over all languages; without any, everything is kept.  Null texts are empty:
    their perplexity is that of the end alone.  Rows are kept one to one.
    """
    spark = docs.sparkSession
    trusted = id_filter(labels.filter(F.col("quality") == 1).select(F.col("doc_id").alias("key")), "trusted-ids")
    own = docs.select(F.col("doc_id"), F.col("text"), F.col("lang"))
    held = crc_mod("doc_id", calibration_mod) == 0
    model = train_kneser_ney(own.filter(~held).filter(trusted(F.col("doc_id"))), "text", depth)
    path = shared_path(spark, "kn-model") + ".pkl"
    put_file(path, pickle.dumps(model))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _load(path)
        for batch in batches:
            texts = [lowered(t) for t in batch["text"].tolist()]
            for a, b in slices([len(t) + 1 for t in texts], SLICE_BYTES):
                logs = model.score(texts[a:b])
                n = np.array([len(t) for t in texts[a:b]], np.int64)
                out = batch.iloc[a:b][["doc_id", "lang", "calibrates"]].copy()
                out["n_bytes"], out["log10_prob"], out["perplexity"] = n, logs / np.log(10), np.exp(-logs / (n + 1))
                yield out

    rows = own.withColumn("calibrates", held & trusted(F.col("doc_id"))).select(F.col("doc_id").cast("string").alias("doc_id"), "lang", "calibrates", "text")
    scored = saved(rows.mapInPandas(run, SCORED), "kn-scores")
    at = F.percentile_approx("perplexity", F.lit(quantile), F.lit(10000))
    cal = scored.filter("calibrates")
    overall = cal.agg(at.alias("t")).first().t
    by_lang = saved(cal.filter("lang IS NOT NULL").groupBy("lang").agg(at.alias("threshold"), F.count("*").alias("n")).filter(F.col("n") >= least).select("lang", "threshold"), "kn-thresholds")
    default = F.lit(float("inf") if overall is None else float(overall))
    out = scored.join(by_lang, "lang", "left").withColumn("threshold", F.coalesce("threshold", default))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "n_bytes", "perplexity", "threshold", (F.col("perplexity") <= F.col("threshold")).alias("keep"))
