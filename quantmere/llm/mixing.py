"""Mixing sources to target weights by Sainte-Laguë apportionment.

1. Every source gets a target by water-filling: its weight's share of
   ``budget`` times all words, held at ``max_repeat`` times its own size, the
   excess reshared by weight.
2. Blocks of ``block`` words are allocated to sources by highest quotients
   target / (2k + 1).
3. A source is cut into shards by hash; its quota goes to its shards by highest
   quotients of their sizes, so each shard has an integer quota.
4. Within a shard the documents stand in seeded order on a line that is cut
   into equal blocks; the quota takes whole passes over the line, then blocks
   in a seeded permutation, the last one cut to measure.

Only sizes travel: the texts are read once to count words.  All state per
source or shard is a few numbers; a hot source is spread over its shards.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved
from .positions import mark_column, placed, write_marks

#: Multipliers of the block permutation: primes above any number of blocks in a shard.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497)


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def highest_quotients(votes: np.ndarray, seats: int, most: np.ndarray | None = None) -> np.ndarray:
    """Sainte-Laguë: seats to the highest quotients votes / (2k + 1), ties to the first.

    ``most`` bounds the seats of each.  The threshold is found by bisection,
    which leaves only ties to hand out one by one.
    """
    votes = np.asarray(votes, float)
    most = np.full(len(votes), seats, np.int64) if most is None else np.asarray(most, np.int64)
    most = np.where(votes > 0, most, 0)
    seats = int(min(seats, most.sum()))
    if not len(votes) or seats <= 0:
        return np.zeros(len(votes), np.int64)

    def at(level: float) -> np.ndarray:
        return np.minimum(np.floor((votes / level + 1) / 2).astype(np.int64), most)

    lo, hi = votes[votes > 0].min() / (4.0 * seats + 4), votes.max() * 2  # at(lo) >= seats > at(hi)
    while at(lo).sum() < seats:
        lo /= 4
    for _ in range(200):
        mid = (lo * hi) ** 0.5
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if at(mid).sum() >= seats else (lo, mid)
    quota = at(hi)
    order = np.lexsort((np.arange(len(votes)), -(votes / (2 * quota + 1))))
    while (left := seats - int(quota.sum())) > 0:  # ties at the threshold
        open_ = order[quota[order] < most[order]][:left]
        quota[open_] += 1
    return quota


def source_targets(sources: DataFrame, weights: tuple[float, ...], budget: float, max_repeat: float) -> DataFrame:
    """Adds rank, weight and target to (source, source_size); water-filling in one sorted pass.

    With sources in the order of cap / weight, the level is fixed by the first
    source that stays below its cap.  One row per source goes through the two
    windows; they spill, so memory doesn't grow with the number of sources.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cases = [F.lit(float(w)) for w in weights]
    pick = F.element_at(F.array(*cases), (F.pmod(F.col("rank") - 1, F.lit(len(cases))) + 1).cast("int"))
    ranked = sources.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", pick)
    cap = F.col("source_size") * F.lit(float(max_repeat))
    ratio = F.when(F.col("weight") > 0, cap / F.col("weight")).otherwise(F.lit(float("inf")))
    prior = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        ranked.withColumn("cap", cap)
        .withColumn("ratio", ratio)
        .withColumn("all_size", F.sum("source_size").over(whole))
        .withColumn("all_weight", F.sum("weight").over(whole))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(prior), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(prior), F.lit(0.0)))
        .withColumn("level", F.try_divide(F.lit(float(budget)) * F.col("all_size") - F.col("cap_before"), F.col("all_weight") - F.col("weight_before")))
    )
    fixed = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "rank", "level"))).over(whole)["level"]
    filled = level.withColumn("level", F.coalesce(fixed, F.lit(float("inf"))))
    target = F.when(F.col("weight") > 0, F.least(F.col("cap"), F.col("weight") * F.col("level"))).otherwise(F.lit(0.0))
    return filled.select("source", "source_size", "rank", "weight", target.cast("double").alias("target"))


def source_quotas(targets: DataFrame, block: int) -> DataFrame:
    """Sainte-Laguë over sources without gathering them: one aggregate and one sort.

    At the level total / (2 seats - n) of n sources at most all seats are given, at
    total / (2 seats + n) at least all; the quotients between, about two a source,
    are sorted for the seats that are left.  Ties go to the lower rank.
    """
    total, n = targets.agg(F.sum("target"), F.count("*")).first()
    seats = int(round((total or 0) / block))
    if not seats:
        return targets.withColumn("quota", F.lit(0).cast("long"))

    def at(level: float) -> Column:
        return F.floor((F.col("target") / F.lit(level) + 1) / 2)

    sure = at(total / (2 * seats - n)) if 2 * seats > n else F.lit(0).cast("long")
    bound = targets.withColumn("sure", sure).withColumn("most", at(total / (2 * seats + n)) + 1)
    left = seats - bound.agg(F.sum("sure")).first()[0]
    open_ = bound.select("rank", F.explode(F.sequence("sure", F.col("most"))).alias("seat"), "target").filter("target > 0")
    order = Window.orderBy((F.col("target") / (2 * F.col("seat") + 1)).desc(), "rank", "seat")
    won = open_.withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= left).groupBy("rank").agg(F.count("*").alias("won"))
    return bound.join(won, "rank", "left").select(*targets.columns, (F.col("sure") + F.coalesce("won", F.lit(0))).cast("long").alias("quota"))


def shard_quotas(seats_col: str, block: int, max_repeat: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A source's quota to its shards; a shard takes at most ``max_repeat`` of its own size."""

    def allocate(shards: pd.DataFrame) -> pd.DataFrame:
        shards = shards.sort_values("shard")
        size = shards["shard_size"].to_numpy()
        most = np.ceil(size * max_repeat / block).astype(np.int64)
        shards["quota"] = highest_quotients(size, int(shards[seats_col].iloc[0]), most)
        return shards[["source_key", "shard", "shard_size", "quota"]]

    return allocate


def mix_sources(
    docs: DataFrame,
    *,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    budget: float = 1.5,
    max_repeat: float = 2.0,
    block: int = 64,
    shard_words: int = 65536,
    max_shards: int = 4096,
    seed: int = 17,
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """Words that the mix takes of every document.

    Input needs doc_id, text and source.  Returns doc_id, source, size,
    source_size, target, taken and repeats (whole passes over its shard), with the
    columns named in ``extra`` carried along; other columns are ignored.  Null
    or empty texts have size 0 and are never taken; a null source is a source
    of its own, last in order; equal rows are kept as rows, and where rows share
    an id their texts decide their order; an empty table gives an empty
    result.  A source whose target is below one block gets its rounded target in
    words, beside the seats.
    """
    key = F.struct(F.col("source").isNull().alias("none"), F.coalesce(F.col("source"), F.lit("")).alias("name"))
    sized = saved(docs.select("doc_id", *extra, key.alias("source_key"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")), "mix-sizes")
    sources = sized.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    sources = sources.select(F.when(~F.col("source_key.none"), F.col("source_key.name")).alias("source"), "source_key", "source_size")
    targets = source_targets(sources.select("source", "source_size"), weights, budget, max_repeat)
    quotas = saved(source_quotas(saved(targets, "mix-targets"), block), "mix-quotas")
    small = F.col("target") < block
    quotas = quotas.withColumn("words", F.when(small, F.round("target").cast("long")).otherwise(F.col("quota") * block))
    quotas = quotas.withColumn("quota", F.when(small, F.ceil(F.col("words") / block)).otherwise(F.col("quota")).cast("long"))
    quotas = quotas.withColumn("source_key", key).withColumn(
        "n_shards", F.greatest(F.lit(1), F.least(F.lit(max_shards), F.ceil(F.col("source_size") / shard_words))).cast("long")
    )
    # the source table is joined without a hint: Spark broadcasts it only below its checked threshold
    joined = sized.join(quotas.select("source_key", "source", "source_size", "target", "quota", "words", "n_shards"), "source_key")
    spread = joined.withColumnRenamed("quota", "seats").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.col("n_shards")))
    shards = spread.groupBy("source_key", "shard").agg(F.sum("size").alias("shard_size"), F.first("seats").alias("seats"))
    shard_schema = "source_key struct<none:boolean,name:string>, shard long, shard_size long, quota long"
    shares = shards.groupBy("source_key").applyInPandas(shard_quotas("seats", block, max_repeat), shard_schema)
    line = Window.partitionBy("source_key", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "size", "tie")
    placed = spread.withColumn("end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    rows = placed.join(shares, ["source_key", "shard"])
    return rows.select("doc_id", *extra, "source", "size", "source_size", "target", *taken_words(block, max_repeat, seed))


def taken_words(block: int, max_repeat: float, seed: int) -> tuple[Column, Column]:
    """(taken, repeats) from end, size, shard_size, the shard's quota and the source's words."""
    want = F.least(F.col("quota") * block, F.col("words"), F.floor(F.col("shard_size") * F.lit(max_repeat)).cast("long"))
    passes = F.coalesce(F.floor(F.try_divide(want, F.col("shard_size"))), F.lit(0)).cast("long")
    left = want - passes * F.col("shard_size")
    # block b is the ((b * prime + shift) mod blocks)-th to be taken
    blocks = F.greatest(F.lit(1), F.ceil(F.col("shard_size") / block)).cast("long")
    draw = F.pmod(F.xxhash64(F.lit(seed + 2), "source_key", "shard"), F.lit(1 << 20))
    prime = F.element_at(F.array(*[F.lit(p) for p in PRIMES]), (F.pmod(draw, F.lit(len(PRIMES))) + 1).cast("int"))
    start, end = F.col("end") - F.col("size"), F.col("end")
    # the line's last block may be short: blocks before it in turn are whole unless it is among them
    short = blocks * block - F.col("shard_size")
    last_turn = F.pmod((blocks - 1) * prime + draw, blocks)

    def part(b: Column) -> Column:
        turn = F.pmod(b * prime + draw, blocks)
        before = turn * block - F.when(last_turn < turn, short).otherwise(F.lit(0))
        from_, to = b * block, F.least((b + 1) * block, F.col("shard_size"))
        to = F.least(to, from_ + F.greatest(F.lit(0), left - before))
        return F.greatest(F.lit(0), F.least(to, end) - F.greatest(from_, start))

    touched = F.sequence(F.floor(start / block), F.floor((end - 1) / block))
    extra = F.aggregate(touched, F.lit(0).cast("long"), lambda acc, b: acc + part(b))
    taken = F.when(F.col("size") > 0, passes * F.col("size") + extra).otherwise(F.lit(0)).cast("long")
    return taken.alias("taken"), passes.alias("repeats")


def mixed_documents(docs: DataFrame, *, seed: int = 17, **options) -> DataFrame:
    """Whole documents, as often as the mix takes them: the rows of ``docs``, all columns kept.

    The mix takes words in blocks; a row stands once for each whole pass and, if
    the blocks beyond hold the share p of its words, once more with probability p
    by a seeded hash of its id and text.  Rows without words, of which nothing can
    be taken, go; equal rows are rows of their own and drawn alike.  Only sizes and places are
    shuffled, not texts; no name of a column can clash.
    """
    docs, file, row = placed(docs)
    mixed = mix_sources(docs.select("doc_id", "text", "source", file.alias("file"), row.alias("row"), F.xxhash64("doc_id", "text").alias("draw")), extra=("file", "row", "draw"), seed=seed, **options)
    share = F.try_divide(F.col("taken") - F.col("repeats") * F.col("size"), F.col("size"))
    draw = F.pmod(F.xxhash64(F.lit(seed + 3), "draw"), F.lit(1 << 30)) / float(1 << 30)
    times = F.col("repeats") + (draw < F.coalesce(share, F.lit(0.0))).cast("long")
    folder = write_marks(mixed.filter("size > 0").select("file", "row", times.alias("value")).filter("value > 0"), "mix-times")
    free = next(name for k in range(len(docs.columns) + 1) if (name := f"copy{k}") not in docs.columns)
    copies = F.explode(F.array_repeat(F.lit(0), mark_column(folder, file, row).cast("int")))
    return docs.select("*", copies.alias(free)).drop(free)
