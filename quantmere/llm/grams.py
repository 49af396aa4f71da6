"""Counts of byte grams and words, and sorted count shards in the shared folder.

A gram is a context of D bytes and the byte after it, packed into one integer
with the most recent context byte on top and the predicted byte last, so grams
that share recent context stand together in sorted order.  Texts are lower-cased
(A-Z); 0xFF, which UTF-8 never uses, stands before a text and ends it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_TABLE, get_array, put_array, saved, shared_path, slices, to_bytes

END = 0xFF
SLICE_BYTES = 2 << 20
HELD_GRAMS = 1_500_000  # distinct keys that a task holds before it passes them on


def lowered(text: str | None) -> bytes:
    return to_bytes(text).translate(LOWER_TABLE)


def gram_keys(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys of all positions in a row, lengths): each text gives its bytes and its end."""
    pad = bytes([END]) * depth
    buf = np.frombuffer(b"".join(x for t in texts for x in (pad, t, pad[:1])), np.uint8)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    keep = np.ones(len(buf), bool)
    starts = np.cumsum(lengths + depth) - (lengths + depth)
    for k in range(depth):
        keep[starts + k] = False
    key = buf.astype(np.int64)
    for k in range(depth):  # context byte k + 1 back
        key[k + 1 :] |= buf[: len(buf) - k - 1].astype(np.int64) << (8 * (depth - k))
    return key[keep], lengths


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their (summed) counts."""
    if counts is None:
        keys = np.sort(keys)
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return keys[at], np.diff(np.append(at, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


class Tally:
    """Key counts of one task, handed on when they grow too many."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.size += len(keys)
        if self.size > HELD_GRAMS:
            self.merge()

    def merge(self) -> None:
        keys, counts = (np.concatenate([p[k] for p in self.parts]) if self.parts else np.zeros(0, np.int64) for k in (0, 1))
        self.parts = [counted(keys, counts)]
        self.size = len(self.parts[0][0])

    def frames(self, everything: bool) -> Iterator[pd.DataFrame]:
        if self.size > HELD_GRAMS * 2 // 3 or everything:
            self.merge()
            if self.size > HELD_GRAMS * 2 // 3 or everything:
                keys, counts = self.parts[0]
                for k in range(0, len(keys), 200_000):
                    yield pd.DataFrame({"key": keys[k : k + 200_000], "n": counts[k : k + 200_000]})
                self.parts, self.size = [], 0


def gram_counts(docs: DataFrame, text: Column, depth: int) -> DataFrame:
    """(key, n) over all texts; tasks count first, so few rows are shuffled."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally = Tally()
        for batch in batches:
            texts = [lowered(t) for t in batch["text"].tolist()]
            for a, b in slices([len(t) + 1 for t in texts], SLICE_BYTES):
                tally.add(*counted(gram_keys(texts[a:b], depth)[0]))
                yield from tally.frames(False)
        yield from tally.frames(True)

    return docs.select(text.alias("text")).mapInPandas(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def token_key(token: bytes) -> int:
    """A 63-bit hash; the end token, b'', has key -1."""
    return xxhash.xxh3_64_intdigest(token) >> 1 if token else -1


def token_counts(docs: DataFrame, text: Column) -> DataFrame:
    """(key, n) of all tokens: words ``[^\\x20\\x09-\\x0D]+`` lower-cased, and one end for each text."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally = Tally()
        for batch in batches:
            texts = [lowered(t) for t in batch["text"].tolist()]
            for a, b in slices([len(t) + 1 for t in texts], SLICE_BYTES):
                seen: dict[bytes, int] = {}
                for w in b"\n".join(texts[a:b]).split():
                    seen[w] = seen.get(w, 0) + 1
                seen[b""] = b - a
                keys = np.fromiter(map(token_key, seen), np.int64, len(seen))
                tally.add(*counted(keys, np.fromiter(seen.values(), np.int64, len(seen))))
                yield from tally.frames(False)
        yield from tally.frames(True)

    return docs.select(text.alias("text")).mapInPandas(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


class Shards:
    """Sorted arrays in files, each shard a range of keys; looked up by sorted queries.

    Files are memory-mapped where the store has local paths: a task touches the
    pages it needs, whatever the size of the whole.
    """

    def __init__(self, manifest: list[tuple[int, int, str]]) -> None:
        self.manifest = sorted(manifest)
        self.starts = np.array([lo for lo, _, _ in self.manifest], np.int64)
        self.open: dict[str, np.ndarray] = {}

    def array(self, uri: str) -> np.ndarray:
        if uri not in self.open:
            if len(self.open) > 512:
                self.open.clear()
            self.open[uri] = get_array(uri)
        return self.open[uri]

    def parts(self, keys: np.ndarray) -> Iterator[tuple[str, slice]]:
        """(path of a shard, the slice of the sorted keys that falls into it)."""
        if not len(self.manifest):
            return
        owner = np.searchsorted(self.starts, keys, side="right") - 1
        ends = np.searchsorted(owner, np.arange(len(self.manifest)), side="right")
        a = np.searchsorted(owner, 0)
        for k, b in enumerate(ends.tolist()):
            if b > a:
                yield self.manifest[k][2], slice(int(a), b)
            a = max(a, b)

    def find(self, keys: np.ndarray, column: str = "n") -> np.ndarray:
        """Values of sorted keys, 0 where a key isn't there."""
        out = np.zeros(len(keys), np.int64)
        for path, part in self.parts(keys):
            known = self.array(f"{path}.key.npy")
            at = np.minimum(np.searchsorted(known, keys[part]), len(known) - 1)
            hit = known[at] == keys[part]
            out[part] = np.where(hit, self.array(f"{path}.{column}.npy")[at], 0)
        return out


def write_count_shards(counts: DataFrame, name: str) -> tuple[list[tuple[int, int, str]], int, int]:
    """Sort (key, n) into shard files; returns the manifest, the sum and the number of keys."""
    spark = counts.sparkSession
    out_dir = shared_path(spark, name)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = f"{TaskContext.get().partitionId()}-{TaskContext.get().taskAttemptId()}"
        seq, held, size = 0, [], 0

        def done() -> pd.DataFrame:
            keys, n = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            path = f"{out_dir}/{part}-{seq}"
            put_array(f"{path}.key.npy", keys)
            put_array(f"{path}.n.npy", n)
            return pd.DataFrame({"lo": [keys[0]], "hi": [keys[-1]], "path": [path], "total": [n.sum()], "size": [len(keys)]})

        for batch in batches:
            if len(batch):
                held.append((batch["key"].to_numpy(np.int64), batch["n"].to_numpy(np.int64)))
                size += len(batch)
            if size >= 4_000_000:
                yield done()
                seq, held, size = seq + 1, [], 0
        if held:
            yield done()

    files = saved(counts.repartitionByRange("key").sortWithinPartitions("key").mapInPandas(write, "lo long, hi long, path string, total long, size long"), f"{name}-manifest")
    rows = files.collect()  # one row per shard file
    return [(r.lo, r.hi, r.path) for r in rows], sum(r.total for r in rows), sum(r["size"] for r in rows)


