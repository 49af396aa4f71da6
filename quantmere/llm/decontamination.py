"""Benchmark decontamination with suffix arrays over shards of the corpus.

Every slice of documents is a shard.  Its words become ids of the benchmark's
vocabulary (0: any other word, also the border between documents), and a suffix
array is built over the positions from which a window of benchmark words can
start: a suffix with another word inside its first window can't match, so
leaving it out loses nothing.  Every test suffix is then looked up by binary
search; the interval of suffixes that begin with its window gives all
occurrences, and adjacent occurrences are chained to longest verbatim matches.

The benchmark is dealt into blocks of bounded size that are files in the shared
folder; workers read them one after another, so it may be of any size.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import get_file, put_file, ranges, saved, shared_path, slices, words_of

WINDOW = 10
BLOCK_BYTES = 8 << 20  # benchmark text in a block
SHARD_BYTES = 6 << 20  # corpus text in a shard


def _write_block(items: list[tuple[int | None, list[bytes]]], window: int) -> bytes:
    """Vocabulary, word ids of all items in a row, and per item id, offset and window length."""
    vocab: dict[bytes, int] = {}
    ids, offsets, names = [], [0], []
    for name, words in items:
        if not words:
            continue
        ids += [vocab.setdefault(w, len(vocab) + 1) for w in words]
        offsets.append(len(ids))
        names.append("" if name is None else str(name))
    out = io.BytesIO()
    np.savez(out, ids=np.array(ids, np.int32), offsets=np.array(offsets, np.int64), names=np.array("\n".join(names).encode()), vocab=np.array(b"\n".join(vocab)), window=window)
    return out.getvalue()


def benchmark_blocks(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> list[str]:
    """Paths of the block files: one per ``BLOCK_BYTES`` of benchmark text."""
    out_dir = shared_path(benchmark.sparkSession, "benchmark")
    size = benchmark.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = 1 + size // BLOCK_BYTES

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = [(None if pd.isna(i) else i, words_of(t)) for b in batches for i, t in zip(b["id"], b["text"], strict=True)]
        if items:
            path = f"{out_dir}/block-{TaskContext.get().partitionId()}-{TaskContext.get().taskAttemptId()}.npz"
            put_file(path, _write_block(items, window))
            yield pd.DataFrame({"path": [path]})

    rows = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).distinct()
    blocks = rows.repartition(n, F.xxhash64("id", "text")).mapInPandas(write, "path string")
    return sorted(r.path for r in saved(blocks, "benchmark-blocks").collect())  # one short path per block


class Block:
    """Test suffixes of one benchmark block, sorted, equal windows once."""

    def __init__(self, data: bytes) -> None:
        z = np.load(io.BytesIO(data))
        self.ids, self.offsets, window = z["ids"], z["offsets"], int(z["window"])
        self.names = bytes(z["names"]).decode().split("\n") if len(self.offsets) > 1 else []
        self.vocab = {w: k + 1 for k, w in enumerate(bytes(z["vocab"]).split(b"\n"))} if len(self.ids) else {}
        lengths = np.diff(self.offsets)
        count = np.maximum(lengths - window, 0) + 1
        self.item = np.repeat(np.arange(len(lengths)), count)  # of each test suffix
        self.at = np.repeat(self.offsets[:-1], count) + ranges(count)
        self.size = np.repeat(np.minimum(lengths, window), count)
        padded = np.concatenate([self.ids, np.zeros(window, self.ids.dtype)])
        key = padded[self.at[:, None] + np.arange(window)] if len(self.at) else np.zeros((0, window), np.int32)
        key = np.where(np.arange(window) < self.size[:, None], key, 0)
        self.windows, self.which = np.unique(key, axis=0, return_inverse=True)
        self.which = self.which.ravel()
        self.window_size = (self.windows > 0).sum(1)
        self.shortest = int(self.window_size.min()) if len(self.windows) else 0
        order = np.argsort(self.which, kind="stable")
        self.by_window = order  # test suffixes of window w: by_window[first[w]:first[w + 1]]
        self.first = np.searchsorted(self.which[order], np.arange(len(self.windows) + 1))
        self.window = window


def suffix_array(ids: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Positions ``at`` in the order of the ``depth`` ids from them (prefix doubling)."""
    if not len(at):
        return at
    rank = ids.astype(np.int64)
    h = 1
    while h < depth:
        nxt = np.zeros(len(rank), np.int64)
        nxt[:-h or None] = rank[h:]
        key = rank * (int(rank.max()) + 1) + nxt
        live = np.flatnonzero(ids)  # 0 stays 0: nothing matches across it
        _, inverse = np.unique(key[live], return_inverse=True)
        rank = np.zeros(len(rank), np.int64)
        rank[live] = inverse + 1
        h *= 2
    return at[np.argsort(rank[at], kind="stable")]


def find_windows(ids: np.ndarray, sa: np.ndarray, windows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary search: the interval of ``sa`` whose suffixes begin with each window."""
    width = windows.shape[1]
    padded = np.concatenate([ids, np.zeros(width, ids.dtype)])

    def bound(upper: bool) -> np.ndarray:
        lo, hi = np.zeros(len(windows), np.int64), np.full(len(windows), len(sa), np.int64)
        while (live := np.flatnonzero(lo < hi)).size:
            mid = (lo[live] + hi[live]) // 2
            before = np.full(live.size, upper)  # equal so far: goes right for the upper bound
            open_ = np.arange(live.size)
            for k in range(width):
                open_ = open_[sizes[live[open_]] > k]
                if not open_.size:
                    break
                a, b = padded[sa[mid[open_]] + k], windows[live[open_], k]
                before[open_[a < b]], before[open_[a > b]] = True, False
                open_ = open_[a == b]
            lo[live[before]] = mid[before] + 1
            hi[live[~before]] = mid[~before]
        return lo

    return bound(False), bound(True)


def match_shard(words: list[list[bytes]], block: Block) -> tuple[np.ndarray, pd.DataFrame]:
    """(hit mask over all words in a row, maximal matches: doc, item, start, length)."""
    lengths = np.array([len(w) for w in words], np.int64)
    get = block.vocab.get
    base = np.concatenate([[0], np.cumsum(lengths + 1)])  # one border after each document
    ids = np.zeros(base[-1], np.int32)
    for w, b in zip(words, base, strict=False):
        ids[b : b + len(w)] = np.fromiter((get(x, 0) for x in w), np.int32, len(w))
    none = pd.DataFrame({"doc": [], "item": [], "start": [], "length": []}, dtype=np.int64)
    mask = np.zeros(len(ids), bool)
    if not block.shortest:
        return mask, none
    ends = np.flatnonzero(ids == 0)
    run = ends[np.searchsorted(ends, np.arange(len(ids)))] - np.arange(len(ids)) if len(ends) else np.zeros(0, np.int64)
    at = np.flatnonzero(run >= block.shortest)
    if not at.size:
        return mask, none
    keep = np.zeros(len(ids) + 1, np.int64)  # ids outside the runs that matter needn't be ranked
    np.add.at(keep, at, 1)
    np.add.at(keep, at + run[at], -1)
    live = np.where(np.cumsum(keep)[:-1] > 0, ids, 0)
    sa = suffix_array(live, at, block.window)
    lo, hi = find_windows(live, sa, block.windows, block.window_size)
    found = np.flatnonzero(hi > lo)
    if not found.size:
        return mask, none
    n = (hi - lo)[found]
    pos = sa[np.repeat(lo[found], n) + ranges(n)]
    size = np.repeat(block.window_size[found], n)
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, pos, 1)
    np.add.at(edge, pos + size, -1)
    mask = np.cumsum(edge)[:-1] > 0
    # every occurrence with every test suffix of its window, chained along its diagonal
    window = np.repeat(found, n)
    tests = (block.first[1:] - block.first[:-1])[window]
    test = block.by_window[np.repeat(block.first[window], tests) + ranges(tests)]
    pos, size = np.repeat(pos, tests), np.repeat(size, tests)
    item, diagonal = block.item[test], pos - block.at[test]
    order = np.lexsort((pos, diagonal, item))
    item, diagonal, pos, size = item[order], diagonal[order], pos[order], size[order]
    new = np.ones(len(pos), bool)
    new[1:] = (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (pos[1:] != pos[:-1] + 1)
    starts = np.flatnonzero(new)
    last = np.append(starts[1:], len(pos)) - 1
    doc = np.searchsorted(base, pos[starts], side="right") - 1
    return mask, pd.DataFrame({"doc": doc, "item": item[starts], "start": pos[starts] - base[doc], "length": pos[last] + size[last] - pos[starts]})


SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, longest long, longest_item string, longest_start long"


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", keep_text: bool = False) -> DataFrame:
    """Per document row: hit words, matched items and the longest verbatim match.

    Null texts have no words.  Items without words never match; an item shorter
    than the window matches as a whole.  Items with equal id and text count once,
    a null item id reads as ''.  Empty tables give no rows, or rows without hits.
    Rows are kept one to one; a document is never split.
    """
    paths = benchmark_blocks(benchmark, window, item_id, item_text)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loaded: dict[str, Block] = {}

        def block(path: str) -> Block:
            if path not in loaded:
                loaded.clear()  # one at a time
                loaded[path] = Block(get_file(path))
            return loaded[path]

        for batch in batches:
            texts = batch["__text"].tolist()
            ids = batch["__id"].tolist()
            for a, b in slices([len(t or "") for t in texts], SHARD_BYTES):
                words = [words_of(t) for t in texts[a:b]]
                lengths = np.array([len(w) for w in words], np.int64)
                base = np.concatenate([[0], np.cumsum(lengths + 1)])
                mask = np.zeros(base[-1], bool)
                items: list[set[str]] = [set() for _ in words]
                longest: list[tuple[int, str | None, int | None]] = [(0, None, None)] * len(words)
                for path in paths:
                    now, found = match_shard(words, blk := block(path))
                    mask |= now
                    for d, i in found[["doc", "item"]].drop_duplicates().itertuples(index=False):
                        items[d].add(blk.names[i])
                    best = found.sort_values(["length", "item", "start"], ascending=[False, True, True]).drop_duplicates("doc")
                    for d, i, s, n in best[["doc", "item", "start", "length"]].itertuples(index=False):
                        if n > longest[d][0]:
                            longest[d] = (int(n), blk.names[i], int(s))
                hits = np.add.reduceat(mask, base[:-1]).tolist()
                names = [sorted(x) for x in items]
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array([None if pd.isna(x) else int(x) for x in ids[a:b]], "Int64"),
                        "n_words": lengths,
                        "n_hit": np.array(hits, np.int64),
                        "n_items": [len(x) for x in names],
                        "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names],
                        "contaminated": [h > 0 for h in hits],
                        "items": names,
                        "longest": [x[0] for x in longest],
                        "longest_item": [x[1] for x in longest],
                        "longest_start": pd.array([x[2] for x in longest], "Int64"),
                    }
                )

    return docs.select(F.col(id_col).cast("string").alias("__id"), F.col(text_col).alias("__text")).mapInPandas(scan, SCHEMA)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` without a benchmark window, all columns kept, in one pass."""
    paths = benchmark_blocks(benchmark, window, item_id, item_text)

    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        loaded: dict[str, Block] = {}
        for texts in batches:
            texts = texts.tolist()
            out = np.zeros(len(texts), bool)
            for a, b in slices([len(t or "") for t in texts], SHARD_BYTES):
                words = [words_of(t) for t in texts[a:b]]
                base = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])
                for path in paths:
                    if path not in loaded:
                        loaded.clear()
                        loaded[path] = Block(get_file(path))
                    mask, _ = match_shard(words, loaded[path])
                    out[a:b] |= np.logical_or.reduceat(mask, base[:-1])
            yield pd.Series(out)

    hit = F.pandas_udf(clean, "boolean", F.PandasUDFType.SCALAR_ITER)
    return docs.filter(~hit(F.col(text_col)))
