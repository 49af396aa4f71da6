"""Exact top-k inner products by branch and bound over vertical blocks.

Vectors are integers, floor(scale * x).  Candidates are packed into block files in
vertical layout (one row of memory per dimension); so are the queries.  A task
reads a few candidate blocks and takes query blocks past them one after another.
For each query the scores are accumulated a few dimensions at a time; after each
step it keeps the candidates whose score so far plus the Cauchy-Schwarz bound of the
remaining dimensions still reaches its threshold, and the survivors are
compacted.  Thresholds start from a first block that all queries see (real
candidates, so no result can be lost) and rise from block to block of a task.

Dimensions are visited in the order of their mass over the candidates of the
block, largest first, which makes the remaining mass small early.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import get_file, put_file, saved, shared_path

ROWS = 4096  # candidates in a block
QUERIES = 512  # queries in a block
TOGETHER = 16  # blocks of either kind that a task reads
STEP = 8  # dimensions in a vertical block
EXACT = 2**53


def usable(vec: Column) -> Column:
    """Not null, and every component finite."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(True))


def quantized(vec: Column, scale: int) -> Column:
    return F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def packed(rows: DataFrame, n_blocks: int, name: str) -> DataFrame:
    """(block, path) of files with the ids, the vectors dimension by dimension, and how often each row occurs."""
    out = shared_path(rows.sparkSession, name)

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id")
        width = int(group["vec"].map(len).max())
        peak = max((abs(int(x)) for v in group["vec"] for x in (v.min(initial=0), v.max(initial=0))), default=0)
        kind = "<i2" if peak < 1 << 15 else "<i4" if peak < 1 << 31 else "<i8"
        data = np.zeros((len(group), width), kind)  # shorter vectors are padded with zeros
        for k, v in enumerate(group["vec"]):
            data[k, : len(v)] = v
        block = int(group["block"].iloc[0])
        path = f"{out}/{block}.pkl"
        put_file(path, pickle.dumps((group["vec_id"].to_numpy(np.int64), np.ascontiguousarray(data.T), group["times"].to_numpy(np.int64))))
        return pd.DataFrame({"block": [block], "path": [path]})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "vec"), F.lit(n_blocks)))
    return saved(dealt.groupBy("block").applyInPandas(pack, "block long, path string"), name)


def _padded(data: np.ndarray, full: int) -> np.ndarray:
    out = np.zeros((full, data.shape[1]), np.int64)
    out[: len(data)] = data
    return out


class QueryBlock:
    """Queries with their best results so far: score, id and times of each candidate row."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, k: int, floor: np.ndarray | None = None) -> None:
        n = len(ids)
        self.ids, self.q, self.k = ids, _padded(data, len(data)), k
        self.best: list[np.ndarray] = [np.zeros((3, 0), np.int64)] * n
        self.floor = np.full(n, np.iinfo(np.int64).min) if floor is None else floor.copy()  # a k-th best score known to exist
        self.peak = int(np.abs(self.q).max(initial=0))

    def search(self, ids: np.ndarray, data: np.ndarray, times: np.ndarray) -> None:
        full = max(len(data), len(self.q))
        cand, q = _padded(data, full), _padded(self.q, full)
        mass = (cand.astype(float) ** 2).sum(1)
        order = np.argsort(-mass * ((q.astype(float) ** 2).sum(1) + 1), kind="stable")
        cand, q = cand[order], q[order]
        exact = full * self.peak * int(np.abs(cand).max(initial=0)) < EXACT  # doubles hold every sum
        if exact:
            cand, q = cand.astype(float), q.astype(float)
        # norms of what remains after each step, rounded up by a hair
        tail = lambda m: np.sqrt(np.cumsum((m.astype(float) ** 2)[::-1], axis=0)[::-1]) * (1 + 1e-9)
        rest_c, rest_q = tail(cand), tail(q)
        first = min(2 * STEP, full)
        start = q[:first].T @ cand[:first]  # the first vertical block for all queries at once
        for j in range(q.shape[1]):
            alive = ids != self.ids[j]
            at, score = np.flatnonzero(alive), start[j][alive]
            floor, done = self.floor[j], first
            while True:
                if done < full:
                    reach = score + rest_q[done, j] * rest_c[done, at] + 1e-6
                    keep = reach >= floor
                else:
                    keep = score >= floor
                if not keep.all():
                    at, score = at[keep], score[keep]
                if done >= full or not at.size:
                    break
                upto = min(full, done + STEP)
                score = score + q[done:upto, j] @ cand[done:upto, at]
                done = upto
            if at.size:
                if len(at) > 4 * self.k:  # ties at the k-th score stay
                    cut = np.partition(score, len(score) - self.k)[len(score) - self.k]
                    at, score = at[score >= cut], score[score >= cut]
                best = np.concatenate([self.best[j], np.stack([score.astype(np.int64), ids[at], times[at]])], axis=1)
                self.best[j] = best = best[:, np.lexsort((best[1], -best[0]))[: self.k]]
                if best.shape[1] == self.k:
                    self.floor[j] = max(self.floor[j], best[0, -1])

    def rows(self) -> pd.DataFrame:
        score, ids, times = np.concatenate(self.best, axis=1) if len(self.best) else np.zeros((3, 0), np.int64)
        return pd.DataFrame({"query_id": np.repeat(self.ids, [b.shape[1] for b in self.best]), "vec_id": ids, "score": score, "times": times})


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every query but rows with its own id.

    Every candidate row counts, so a row that is there twice may hold two ranks;
    equal query rows are one query, and query rows of one id and different vectors
    share its k ranks.  Ties go to the smaller id.  Vectors that are null, or hold
    null or non-finite components, and rows with a null id take no part; shorter
    vectors are padded with zeros; other columns are ignored.  An empty table
    gives no rows.
    """
    cols = [F.col(id_col).cast("long").alias("vec_id"), quantized(F.col(vec_col), scale).alias("vec")]
    use = usable(F.col(vec_col)) & F.col(id_col).isNotNull()
    cand = vectors.filter(use).select(*cols).groupBy("vec_id", "vec").agg(F.count("*").alias("times"))
    asked = queries.filter(use).select(*cols).distinct().withColumn("times", F.lit(1).cast("long"))
    n_c, n_q = cand.count(), asked.count()
    c_blocks = packed(cand, max(1, -(-n_c // ROWS)), "candidate-blocks")
    q_blocks = packed(asked, max(1, -(-n_q // QUERIES)), "query-blocks")
    seed = c_blocks.orderBy("block").first()  # thresholds: the k-th best of one block
    floors = shared_path(vectors.sparkSession, "query-floors")

    def with_floor(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = pickle.loads(get_file(seed["path"]))
        for batch in batches:
            paths = []
            for block, path in zip(batch["block"], batch["path"], strict=True):
                ids, data, _ = pickle.loads(get_file(path))
                queries = QueryBlock(ids, data, k)
                queries.search(*first)
                paths.append(f"{floors}/{block}.pkl")
                put_file(paths[-1], pickle.dumps((ids, data, queries.floor)))
            yield pd.DataFrame({"block": batch["block"], "path": paths})

    if seed:
        q_blocks = saved(q_blocks.repartition(max(1, -(-n_q // QUERIES)), "block").mapInPandas(with_floor, "block long, path string"), "query-blocks")
    together = lambda blocks, name: blocks.groupBy(F.floor(F.col("block") / TOGETHER).alias(name)).agg(F.collect_list("path").alias(f"{name}_paths"))
    slices = -(-max(1, -(-n_q // QUERIES)) // TOGETHER)
    units = together(c_blocks, "c").withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long")))).join(together(q_blocks, "q"), "q")
    tasks = slices * max(1, -(-n_c // (ROWS * TOGETHER)))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for c_paths, q_paths in zip(batch["c_paths"], batch["q_paths"], strict=True):
                blocks = [pickle.loads(get_file(p)) for p in c_paths]
                for path in q_paths:
                    ids, data, floor = pickle.loads(get_file(path))
                    queries = QueryBlock(ids, data, k, floor)
                    for block in blocks:
                        queries.search(*block)
                    yield queries.rows()

    spread = units.repartition(min(tasks, 20_000), "c", "q").select("c_paths", "q_paths")
    partial = spread.mapInPandas(scan, "query_id long, vec_id long, score long, times long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    rows = partial.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)  # the first k hold the first k copies
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("times", F.lit(k)))))
    ranked = copies.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
