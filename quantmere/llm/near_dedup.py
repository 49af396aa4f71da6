"""Near-duplicate classes by ProbMinHash, banding and exact verification.

A document is the multiset of its five-word shingles; similarity is the
probability Jaccard of the shingle counts (the plain Jaccard where no shingle
repeats).

1. Equal word sequences are one node, found by a 128-bit hash; a node is known by
   a number and by the place of one of its rows.
2. ProbMinHash: every distinct shingle is a Poisson process whose rate is its
   count; each arrival falls on one of the signature's components, and a
   component keeps the shingle of its earliest arrival.  Arrivals are drawn
   only up to a horizon by which every component is filled (early
   termination); documents that still have an empty one get a longer horizon.
   Sixteen bits of each component are kept.
3. Bands of the signature are buckets.  In each bucket the members are linked
   to its first and its last member; links that share ``SURE`` buckets are
   verified on the texts.
4. In buckets that still hold more than one class, every pair of different
   classes whose signatures agree often enough is verified.  The members of a
   bucket's largest class aren't compared with one another, buckets of any size
   are cut into block pairs, and only members with a partner bring their text.

Only numbers and signatures are shuffled for all documents; texts are read
where they stand, by place, and move only for the links to verify.  Classes are
the connected components of the verified links, so no link between different
texts is lost although copies and large groups are never expanded into all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import Scratch, claim, keep_cache, slices, words_of
from .graph import connected_components
from .positions import mark_column, placed, write_marks

SHINGLE, SIMILAR, BANDS, ROWS = 5, 0.8, 24, 5
SURE = 3  # buckets that a link shares to be verified before the rest is compared
SLICE_BYTES = 1 << 20
BLOCK = 1024
STEP = 24  # components of signatures compared at a time
HELD_SHINGLES = 2_000_000  # of documents that a verifying task keeps at hand
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(z: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = WordHashes()
keep_cache("near-dedup", _HASHES.clear)


def shingle_hashes(docs: list[list[bytes]], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document number, shingle hash) of all shingles in a row; a shorter document is one shingle."""
    lengths = np.array([len(w) for w in docs], np.int64)
    flat = np.fromiter(map(_HASHES.__getitem__, chain.from_iterable(docs)), np.uint64, lengths.sum())
    flat = np.concatenate([flat, np.zeros(size, np.uint64)])
    starts = np.cumsum(lengths) - lengths
    with np.errstate(over="ignore"):
        acc = np.zeros(len(flat) - size, np.uint64)
        left = np.repeat(starts + lengths, lengths) - np.arange(len(acc))  # words from here to the end
        for k in range(size):
            acc = np.where(left > k, acc * np.uint64(0x100000001B3) + flat[k : k + len(acc)] + np.uint64(1), acc)
    keep = (left >= size) | (np.repeat(lengths < size, lengths) & (np.arange(len(acc)) == np.repeat(starts, lengths)))
    return np.repeat(np.arange(len(docs)), lengths)[keep], mix(acc[keep])


def weighted_shingles(docs: list[list[bytes]], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, hash, count) of the distinct shingles of each document."""
    doc, h = shingle_hashes(docs, size)
    ends = np.searchsorted(doc, np.arange(len(docs) + 1))
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def prob_minhash(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, m: int, reach: float = 3.0) -> np.ndarray:
    """Signatures, one row of m element hashes for each document (0 where it has no elements).

    Arrivals of document d are drawn up to the horizon m / W (ln m + reach), W its
    total count; the few documents in which a component is still empty then are
    drawn anew, with the same streams, to a longer horizon.
    """
    total = np.bincount(doc, weight, n_docs)
    horizon = m / np.maximum(total, 1) * (np.log(m) + reach)
    times, places, values = [], [], []
    state = h.copy()
    who, elem, rate, x, step = doc, h, weight, np.zeros(len(doc)), np.uint64(0)
    while len(who):
        step += np.uint64(1)
        with np.errstate(over="ignore"):
            u = mix(state + step * GOLDEN)
        x = x - np.log(((u >> np.uint64(11)) + np.uint64(1)) * 2.0**-53) / rate
        live = np.flatnonzero(x <= horizon[who])
        who, elem, rate, x, state = who[live], elem[live], rate[live], x[live], state[live]
        with np.errstate(over="ignore"):
            part = mix(elem ^ (step * np.uint64(0xD6E8FEB86659FD93)))
        times.append(x)
        places.append(who * m + ((part >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64))
        values.append(elem)
    t, p, v = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (times, places, values))
    order = np.argsort(-t)
    sig = np.zeros(n_docs * m, np.uint64)
    filled = np.zeros(n_docs * m, bool)
    sig[p[order]] = v[order]  # the earliest arrival is written last
    filled[p] = True
    sig, lacking = sig.reshape(n_docs, m), ~filled.reshape(n_docs, m).all(1) & (total > 0)
    if lacking.any():
        again = np.flatnonzero(lacking)
        keep = lacking[doc]
        sig[again] = prob_minhash(np.searchsorted(again, doc[keep]), h[keep], weight[keep], len(again), m, 2 * reach + 6)
    return sig


def key_of(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact J_P of two weighted sets, each (sorted hashes, counts)."""
    (ha, wa), (hb, wb) = a, b
    if not len(ha) or not len(hb):
        return 0.0
    _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    ca, cb = wa[ia].astype(float), wb[ib].astype(float)
    only_a, only_b = wa.sum() - ca.sum(), wb.sum() - cb.sum()
    ratio, which = np.unique(ca / cb, return_inverse=True)
    gain = np.bincount(which, ca)
    return float(sum(g / (only_a + r * only_b + np.maximum(ca, r * cb).sum()) for r, g in zip(ratio, gain, strict=True)))


def sketch_column(text: Column, bands: int, rows: int, size: int) -> Column:
    """struct<key, sig> of each text: the node's key (null without words) and its signature, 16 bits a component.

    In a slice of texts only the first of equal ones has the signature.
    """
    m = bands * rows

    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        claim("near-dedup")
        for batch in batches:
            texts = batch.tolist()
            keys: list[bytes | None] = []
            sigs: list[bytes | None] = []
            for a, b in slices([len(t or "") for t in texts], SLICE_BYTES):
                words = [words_of(t) for t in texts[a:b]]
                own = [key_of(w) if w else None for w in words]
                first: dict[bytes, int] = {}
                for k, key in enumerate(own):
                    if key is not None:
                        first.setdefault(key, k)  # copies in a slice are sketched once
                doc, h, w = weighted_shingles([words[k] for k in first.values()], size)
                sig = (prob_minhash(doc, h, w, len(first), m) >> np.uint64(48)).astype("<u2")
                found: list[bytes | None] = [None] * len(words)
                for i, k in enumerate(first.values()):
                    found[k] = sig[i].tobytes()
                keys += own
                sigs += found
            yield pd.DataFrame({"key": keys, "sig": sigs})

    return F.pandas_udf(sketch, "key binary, sig binary", F.PandasUDFType.SCALAR_ITER)(text)


def buckets_of(sig: Column, bands: int, rows: int) -> Column:
    """Array of the buckets of a signature; the last six bits of a bucket are its band."""
    if bands > 64:
        raise ValueError("at most 64 bands")
    each = [F.shiftleft(F.xxhash64(F.substring(sig, 1 + 2 * rows * k, 2 * rows)), 6).bitwiseOR(F.lit(k)) for k in range(bands)]
    return F.array(*each)


class Known:
    """Weighted shingles of texts at hand, forgotten when there are too many."""

    def __init__(self, size: int) -> None:
        self.size, self.sets, self.held = size, {}, 0

    def of(self, node: int, text: str) -> tuple[np.ndarray, np.ndarray]:
        if node not in self.sets:
            if self.held > HELD_SHINGLES:
                self.sets, self.held = {}, 0
            _, h, w = weighted_shingles([words_of(text)], self.size)
            self.sets[node] = (h, w)
            self.held += len(h)
        return self.sets[node]


def node_texts(base: DataFrame, text: Column, places: tuple[Column, Column], nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the wanted nodes, read from the rows that stand for them."""
    marks = nodes.join(wanted, "node", "left_semi").select("file", "row", F.col("node").alias("value"))
    node = mark_column(write_marks(marks, "wanted-texts"), *places, default=-1)
    return base.select(node.alias("node"), text.alias("text")).filter("node >= 0")


def verify(links: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """links (a, b) with their exact similarity."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("near-dedup")
        known = Known(size)
        for batch in batches:
            cols = [batch[c].tolist() for c in ("a", "b", "text_a", "text_b")]
            sims = [probability_jaccard(known.of(a, x), known.of(b, y)) for a, b, x, y in zip(*cols, strict=True)]
            yield pd.DataFrame({"a": cols[0], "b": cols[1], "similarity": sims})

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = links.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return both.mapInPandas(check, "a long, b long, similarity double")


def block_pairs(rest: DataFrame) -> DataFrame:
    """(bucket, i, j, own, node, label): members of open buckets, dealt to the block pairs in which they are compared.

    The largest class of a bucket (the least label among equals) is its main one;
    blocks of the others come first and meet all blocks from their own on, so
    members of the main class never meet one another.
    """
    sizes = rest.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    plan = sizes.groupBy("bucket").agg(F.max(F.struct("n", (-F.col("label")).alias("least"))).alias("top"), F.sum("n").alias("all"))
    plan = plan.select("bucket", (-F.col("top.least")).alias("main"), F.ceil((F.col("all") - F.col("top.n")) / BLOCK).alias("others"), F.ceil(F.col("top.n") / BLOCK).alias("mains"))
    in_main = F.col("label") == F.col("main")
    spread = F.xxhash64("node")
    own = F.when(in_main, F.col("others") + F.pmod(spread, "mains")).otherwise(F.pmod(spread, "others"))
    last = F.when(in_main, F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1
    met = rest.join(plan, "bucket").withColumn("own", own).withColumn("met", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return met.select("bucket", F.least("own", "met").alias("i"), F.greatest("own", "met").alias("j"), "own", "node", "label")


KEYS = ["bucket", "i", "j"]


def whole_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by block pair, joined to chunks that end where a block pair ends: many small ones at once."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = batch[KEYS].to_numpy()
        start = len(batch) - int((keys == keys[-1]).all(1).sum())
        if start:
            yield pd.concat([*held, batch[:start]], ignore_index=True)
            held = [batch[start:]]
        elif held and (held[0][KEYS].iloc[0].to_numpy() != keys[0]).any():
            yield pd.concat(held, ignore_index=True)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pd.concat(held, ignore_index=True)


class Chunk:
    """Members of whole block pairs, with the partners of each that may be similar."""

    def __init__(self, rows: pd.DataFrame, least: float, band_rows: int) -> None:
        self.bucket, self.i, self.j, self.own, self.label = (rows[c].to_numpy() for c in (*KEYS, "own", "label"))
        self.sig = np.frombuffer(b"".join(rows["sig"]), "<u2").reshape(len(rows), -1)
        self.rows, self.most = band_rows, int((1 - least) * self.sig.shape[1] + 1e-9)
        keys = np.stack([self.bucket, self.i, self.j])
        self.starts = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(0)))
        self.ends = np.append(self.starts[1:], len(rows))

    def first_band(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the bucket's band is the first that the pairs share."""
        shared = (self.sig[a] == self.sig[b]).reshape(len(a), self.sig.shape[1] // self.rows, self.rows).all(2)
        return shared.argmax(1) == (self.bucket[a] & 63)

    def pairs(self) -> Iterator[tuple[int, np.ndarray]]:
        """A row and its partners in the same block pair, most agreeing first; each pair once."""
        size = self.ends - self.starts
        a = self.starts[size == 2]  # most block pairs are of two members
        b = a + 1
        ok = (self.label[a] != self.label[b]) & ((self.i[a] == self.j[a]) | (self.own[a] != self.own[b]))
        a, b = a[ok], b[ok]
        ok = (self.sig[a] != self.sig[b]).sum(1) <= self.most
        a, b = a[ok], b[ok]
        ok = self.first_band(a, b)
        yield from zip(a[ok].tolist(), b[ok][:, None], strict=True)
        for start, end in zip(self.starts[size > 2].tolist(), self.ends[size > 2].tolist(), strict=True):
            own = np.arange(start, end)
            i, j = self.i[start], self.j[start]
            left, right = own[self.own[own] == i], own[self.own[own] == j]
            # component by component: partners fall away as soon as they can't agree enough
            places, label = np.ascontiguousarray(self.sig[right].T), self.label[right]
            for k in left:
                at = np.flatnonzero((label != self.label[k]) & ((right > k) if i == j else True))
                missed = np.zeros(len(at), np.int64)
                for p in range(0, len(places), STEP):
                    if not len(at):
                        break
                    missed += (places[p : p + STEP, at] != self.sig[k, p : p + STEP, None]).sum(0)
                    keep = missed <= self.most
                    at, missed = at[keep], missed[keep]
                if len(at):
                    here = self.first_band(np.full(len(at), k), right[at])
                    at, missed = at[here], missed[here]
                    if len(at):
                        yield int(k), right[at[np.argsort(missed, kind="stable")]]


def _by_block_pair(rows: DataFrame) -> DataFrame:
    return rows.repartition(*KEYS).sortWithinPartitions(*KEYS)


def near_members(dealt: DataFrame, least: float, rows: int) -> DataFrame:
    """(bucket, i, j, own, node, label, sig) of those members of block pairs that have a partner there."""

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("near-dedup")
        for some in whole_groups(batches):
            used = np.zeros(len(some), bool)
            for k, partners in Chunk(some, least, rows).pairs():
                used[k] = used[partners] = True
            yield some[used]

    cols = ("bucket", "i", "j", "own", "node", "label", "sig")
    return _by_block_pair(dealt.select(*cols)).mapInPandas(pick, "bucket long, i long, j long, own long, node long, label long, sig binary")


def compare_blocks(near: DataFrame, texts: DataFrame, *, similar: float, least: float, rows: int, size: int) -> DataFrame:
    """Links (a, b, similarity) between different classes inside block pairs, compared exactly.

    A pair isn't compared once its classes are joined in the task, so the output is links, not pairs.
    """

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("near-dedup")
        known = Known(size)
        for some in whole_groups(batches):
            code = pd.factorize(some["label"])[0]
            root = np.arange(code.max() + 1)

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            node, text, out = some["node"].tolist(), some["text"].tolist(), []
            for k, partners in Chunk(some, least, rows).pairs():
                for x in partners.tolist():
                    a, b = find(code[k]), find(code[x])
                    if a == b:
                        continue
                    value = probability_jaccard(known.of(node[k], text[k]), known.of(node[x], text[x]))
                    if value >= similar:
                        out.append((min(node[k], node[x]), max(node[k], node[x]), value))
                        root[a] = b
            yield pd.DataFrame(out, columns=["a", "b", "similarity"])

    return _by_block_pair(near.join(texts, "node")).mapInPandas(links, "a long, b long, similarity double")


def with_labels(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members with their class: their own number where no link was found."""
    return members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def relabel(labels: DataFrame, links: DataFrame, save: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(node, label) after joining the classes that the links connect."""
    sides = with_labels(links.select(F.col("a").alias("node"), "b"), labels).select(F.col("label").alias("la"), F.col("b").alias("node"))
    sides = with_labels(sides, labels).filter("la <> label").select(F.col("la").alias("a"), F.col("label").alias("b"))
    merged = connected_components(sides, save=save)
    old = labels.join(merged.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    fresh = merged.join(labels, "node", "left_anti").select("node", "label")
    return save(old.union(fresh), "node-labels")


def open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, node, label) of the buckets that hold more than one class."""
    labelled = with_labels(members, labels)
    ends = labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
    return labelled.join(ends.select("bucket"), "bucket", "left_semi").select("bucket", "node", "label")


def classify(docs: DataFrame, scratch: Scratch, *, size: int = SHINGLE, similar: float = SIMILAR, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, file, row, order, key), nodes (node, key, file, row, sig), their labels (node, label) and the links (a, b, similarity) verified.

    ``order`` is the order in which rows of a class stand for it: by id, nulls last, then by text and place.
    """
    base, file, row = placed(docs)
    here = [F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), file.alias("file"), row.alias("row")]
    sketched = base.select(*here, sketch_column(F.col(text_col), bands, rows, size).alias("s"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("hash"), "file", "row")
    sketches = scratch.saved(sketched.select("doc_id", "file", "row", order.alias("order"), "s.key", "s.sig"), "sketches")
    one = sketches.filter(F.col("sig").isNotNull()).groupBy("key").agg(F.min(F.struct("file", "row", "sig")).alias("r"))
    nodes = scratch.saved(one.select(F.monotonically_increasing_id().alias("node"), "key", "r.file", "r.row", "r.sig"), "nodes")
    spread = nodes.select("node", F.explode(buckets_of(F.col("sig"), bands, rows)).alias("bucket"))
    ends = spread.groupBy("bucket").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first <> last")
    members = scratch.saved(spread.join(ends, "bucket"), "bucket-members")
    star = members.select("node", F.explode(F.array("first", "last")).alias("hub")).filter("node <> hub")
    star = star.groupBy(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).agg(F.count("*").alias("n"))
    sure = scratch.saved(star.filter(F.col("n") >= min(SURE, bands)).select("a", "b"), "sure-links")
    members = members.select("bucket", "node")
    texts_of = lambda wanted: node_texts(base, F.col(text_col), (file, row), nodes, wanted)
    first = scratch.saved(verify(sure, texts_of(_ends(sure)), size), "star-links")
    none = nodes.select("node", F.col("node").alias("label")).limit(0)
    labels = relabel(none, first.filter(F.col("similarity") >= similar), scratch.saved)
    # buckets that still hold more than one class are compared exactly
    rest = scratch.saved(open_members(members, labels), "open-buckets")
    slack = 4 * (similar * (1 - similar) / (bands * rows)) ** 0.5
    dealt = block_pairs(rest).join(nodes.select("node", "sig"), "node")
    near = scratch.saved(near_members(dealt, similar - slack, rows), "near-members")
    seen = Observation()
    exact = compare_blocks(near, texts_of(near.select("node").distinct()), similar=similar, least=similar - slack, rows=rows, size=size)
    exact = scratch.saved(exact.observe(seen, F.count("*").alias("n")), "exact-links")
    if seen.get["n"]:
        labels = relabel(labels, exact, scratch.saved)
    return sketches.drop("sig"), nodes, labels, first.union(exact).filter(F.col("similarity") >= similar)


def _ends(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row per input row: doc_id, class_id (the least id of its class) and class_size (rows).

    Rows without words (null, empty or only separators) are alone in their class.
    A null id is a member like any other and never names a class that has an id.
    Ids keep their type; repeated rows are members of one class; very long texts
    are read whole.  Extra columns are ignored, whatever their names; an empty
    table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "near-dedup")
    rows, nodes, labels, _ = classify(docs, scratch, **options)
    # copies are counted before anything is shuffled by class
    keys = rows.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    classed = scratch.saved(with_labels(nodes.select("node", "key"), labels).join(keys, "key").select("key", "label", "least", "n"), "node-classes")
    named = classed.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    by_key = classed.select("key", "label").join(named, "label").select(F.col("key").alias("node_key"), "class_id", "class_size")
    alone = F.col("key").isNull()
    out = rows.join(by_key, F.col("key") == F.col("node_key"), "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size")
    )
    out = Scratch(docs.sparkSession, "near-dedup-classes").saved(out, "classes")
    scratch.remove()
    return out


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with one document of each class: that of the least id (nulls last), then of the least text hash and place.

    Rows without words are all kept.  Only the places of the kept rows are
    shuffled; no column is added, so extra columns may have any name.
    """
    docs, file, row = placed(docs)
    scratch = Scratch(docs.sparkSession, "near-dedup")
    rows, nodes, labels, _ = classify(docs, scratch, id_col=id_col, text_col=text_col, **options)
    of_key = rows.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("order").alias("order"))
    best = with_labels(nodes.select("node", "key"), labels).join(of_key, "key").groupBy("label").agg(F.min("order").alias("order"))
    kept = best.select("order.file", "order.row").union(rows.filter(F.col("key").isNull()).select("file", "row"))
    folder = write_marks(kept.withColumn("value", F.lit(1).cast("long")), "kept-rows")
    scratch.remove()
    return docs.filter(mark_column(folder, file, row) > 0)
