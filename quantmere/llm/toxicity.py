"""Toxicity: a convolutional text classifier in numpy.

Words, their beginnings and their endings are hashed to embedding rows, whose
sum is the word's vector (compounds share parts); filters of several widths slide over the
whole text, the maximum of each filter over all positions feeds a logistic
unit.  Training reads every labelled row: rows are dealt by hash to shards, a
task for each shard descends from the common weights over its own rows, and the
weights are averaged after each round.  Thresholds are counted over all rows set
aside for them.  Scoring runs over every row, in Arrow batches.  The score depends
on the text alone; the language only picks the threshold that a filter compares it
with.  A caller may bound the rows to learn from (``max_positive``,
``max_negative``, ``max_bytes``); then training runs on the driver.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, crc_mod, get_file, keep_cache, put_file, saved, shared_path, slices, words_of
from .positions import mark_column, placed, write_marks

SLICE_WORDS = 60_000
SHARD_ROWS = 8192  # of a training shard about
SHARD_BYTES = 32 << 20  # of text at which a shard is cut
BLOCKS = 16  # in which embedding rows are averaged
GRID = np.linspace(0.05, 0.95, 91)  # thresholds to choose from
CACHE_WORDS = 200_000
ROWS_PER_WORD = 6


@dataclass(frozen=True)
class CnnConfig:
    buckets: int = 1 << 16
    dim: int = 16
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    epochs: int = 6  # at least
    steps: int = 400  # at least, while that takes no more than most_epochs
    most_epochs: int = 60
    batch: int = 64
    rate: float = 0.01
    decay: float = 1e-4
    seed: int = 7
    max_positive: int | None = None  # toxic rows to learn from at most, None: all
    max_negative: int | None = None
    max_bytes: int | None = None  # of training text at most; whole texts only
    held_out_mod: int = 5


def hashed_rows(words: list[bytes], buckets: int) -> np.ndarray:
    """Embedding rows of each word: of itself, of its beginnings and of its endings."""
    crc, n = zlib.crc32, buckets - 1  # row 0 pads
    rows = [(crc(w) % n + 1, crc(w[:4], 1) % n + 1, crc(w[:6], 2) % n + 1, crc(w[:8], 3) % n + 1, crc(w[-3:], 4) % n + 1, crc(w[-5:], 5) % n + 1) for w in words]
    return np.array(rows, np.int32).reshape(len(words), ROWS_PER_WORD)


class Vocabulary(dict):
    """Word to local number, numbers from 1; ``fresh`` lists words met since the last look."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self) + 1
        self.fresh.append(word)
        return k


@dataclass
class ToxicityModel:
    config: CnnConfig
    embed: np.ndarray
    kernels: list[np.ndarray]  # one (width * dim, filters) for each width
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    prior: float = 0.5  # used where there is nothing to learn from
    thresholds: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.vocab = Vocabulary()
        self.rows = np.zeros((1, ROWS_PER_WORD), np.int32)  # of each local word, for training
        self.vectors = np.zeros((1, self.config.dim), np.float32)  # the sum of those rows, for scoring

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("vocab", "rows", "vectors")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def ids(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.vocab.__getitem__, words), np.int32, len(words))

    def settle(self, vectors: bool) -> None:
        """Rows (and vectors) of the words met since the last call."""
        if self.vocab.fresh:
            rows = hashed_rows(self.vocab.fresh, self.config.buckets)
            self.vocab.fresh = []
            self.rows = np.concatenate([self.rows, rows])
            if vectors:
                self.vectors = np.concatenate([self.vectors, self.embed[rows].sum(1)])

    def features(self, docs: list[np.ndarray], fixed: bool = True) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
        """Pooled features, responses of each width, padded ids and where documents start."""
        pad = max(self.config.widths) - 1
        gap = np.zeros(pad + (pad == 0), np.int32)
        ids = np.concatenate([x for d in docs for x in (d, gap)])  # padding behind each document
        starts = np.concatenate([[0], np.cumsum([len(d) + len(gap) for d in docs])[:-1]])
        ends = np.append(starts[1:], len(ids))
        if fixed:
            x = self.vectors[ids]
        else:
            words, local = np.unique(ids, return_inverse=True)
            x = self.embed[self.rows[words]].sum(1)[local]
        pooled, responses = [], []
        for width, kernel, bias in zip(self.config.widths, self.kernels, self.biases, strict=True):
            dim = self.config.dim
            r = x @ kernel[:dim]
            for k in range(1, width):
                r[:-k] += x[k:] @ kernel[k * dim : (k + 1) * dim]
            r += bias
            np.maximum(r, 0, out=r)
            for k in range(1, width):  # such windows would reach into the next document
                r[ends - k] = 0
            responses.append(r)
            pooled.append(np.maximum.reduceat(r, starts, axis=0))
        return np.concatenate(pooled, axis=1), responses, ids, starts

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        if not len(self.out):
            return np.full(len(docs), self.prior)
        pooled = self.features(docs)[0]
        z = pooled.astype(np.float64) @ self.out + self.out_bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score_texts(self, texts: list[str | None]) -> np.ndarray:
        out = []
        for a, b in slices([len(t or "") // 5 + 4 for t in texts], SLICE_WORDS):
            if len(self.vocab) > CACHE_WORDS:
                self.forget()
            ids = [self.ids(t) for t in texts[a:b]]
            self.settle(vectors=True)
            out.append(self.scores(ids))
        return np.concatenate(out) if out else np.zeros(0)


def init_model(c: CnnConfig) -> ToxicityModel:
    rng = np.random.default_rng(c.seed)
    embed = rng.normal(0, 0.1, (c.buckets, c.dim)).astype(np.float32)
    embed[0] = 0
    kernels = [rng.normal(0, (2 / (w * c.dim)) ** 0.5, (w * c.dim, c.filters)).astype(np.float32) for w in c.widths]
    biases = [np.zeros(c.filters, np.float32) for _ in c.widths]
    out = rng.normal(0, 0.3, c.filters * len(c.widths))
    return ToxicityModel(c, embed, kernels, biases, out, -1.0)


class Adam:
    """Moments for whole arrays, or for the touched rows only."""

    def __init__(self, rate: float) -> None:
        self.rate, self.state = rate, {}

    def step(self, name: str, value: np.ndarray, grad: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        m, v, t = self.state.setdefault(name, [np.zeros_like(value), np.zeros_like(value), 0])
        t += 1
        self.state[name][2] = t
        m[rows] = 0.9 * m[rows] + 0.1 * grad
        v[rows] = 0.99 * v[rows] + 0.01 * grad * grad
        value[rows] -= self.rate * (m[rows] / (1 - 0.9**t)) / (np.sqrt(v[rows] / (1 - 0.99**t)) + 1e-8)


@dataclass
class Gradients:
    """Of the mean weighted log loss of a batch; of the embedding only the rows that it touches."""

    out: np.ndarray
    out_bias: float
    kernels: list[np.ndarray]
    biases: list[np.ndarray]
    rows: np.ndarray
    embed: np.ndarray


def gradients(model: ToxicityModel, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> Gradients:
    c, dim = model.config, model.config.dim
    pooled, responses, ids, starts = model.features(docs, fixed=False)
    z = pooled @ model.out + model.out_bias
    g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight / len(docs)
    grad_pool = g[:, None] * model.out
    spans = np.diff(np.append(starts, len(ids)))
    kernels, biases, rows_all, grads_all = [], [], [], []
    for w, (width, kernel, r) in enumerate(zip(c.widths, model.kernels, responses, strict=True)):
        top = pooled[:, w * c.filters : (w + 1) * c.filters]
        gp = (grad_pool[:, w * c.filters : (w + 1) * c.filters] * (top > 0)).astype(np.float32)
        at, col = np.nonzero((r == np.repeat(top, spans, axis=0)) & (r > 0))
        doc = np.searchsorted(starts, at, side="right") - 1
        _, first = np.unique(doc * c.filters + col, return_index=True)  # the first position of a maximum
        at, col, doc = at[first], col[first], doc[first]
        gv = gp[doc, col]
        where = at[:, None] + np.arange(width)
        inside = where < len(ids)
        tokens = np.where(inside, ids[np.minimum(where, len(ids) - 1)], 0)
        x = model.embed[model.rows[tokens]].sum(2).reshape(len(at), width * dim)
        onehot = np.zeros((len(at), c.filters), np.float32)
        onehot[np.arange(len(at)), col] = gv
        grads_all.append(np.repeat((kernel.T[col] * gv[:, None]).reshape(-1, dim), ROWS_PER_WORD, axis=0))
        rows_all.append(model.rows[tokens].ravel())
        kernels.append(x.T @ onehot)
        biases.append(onehot.sum(0))
    rows, inverse = np.unique(np.concatenate(rows_all), return_inverse=True)
    total = np.zeros((len(rows), dim), np.float32)
    np.add.at(total, inverse, np.concatenate(grads_all))
    live = rows > 0
    return Gradients(pooled.T @ g, float(g.sum()), kernels, biases, rows[live], total[live])


def train(texts: list[str | None], labels: list[int], config: CnnConfig = CnnConfig()) -> ToxicityModel:
    """Fit by mini-batches of log loss; a sample of one class (or none) gives a constant score."""
    c, y = config, np.asarray(labels, float)
    model = init_model(c)
    if not len(y) or y.min() == y.max():
        model.out, model.prior = np.zeros(0), float(y[0] * 0.98 + 0.01) if len(y) else 0.01
        return model
    docs = [model.ids(t) for t in texts]
    model.settle(vectors=False)
    rng, adam = np.random.default_rng(c.seed + 1), Adam(c.rate)
    share = y.mean()
    weight = class_weights(y, share)
    epochs = epochs_of(c, len(docs))
    for epoch in range(epochs):
        adam.rate = c.rate * (1 - epoch / epochs)
        descend(model, adam, docs, y, weight, rng.permutation(len(docs)))
    model.prior = float(share)
    model.forget()
    return model


def class_weights(y: np.ndarray, share: float) -> np.ndarray:
    """Classes weigh alike in the loss."""
    return np.where(y == 1, 0.5 / share, 0.5 / (1 - share))


def epochs_of(c: CnnConfig, n: int) -> int:
    return max(c.epochs, min(c.most_epochs, -(-c.steps * c.batch // n)))


def descend(model: ToxicityModel, adam: Adam, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray, order: np.ndarray) -> None:
    """One pass over the documents in the order given."""
    c = model.config
    for a, b in slices([len(docs[k]) + 4 for k in order], SLICE_WORDS):
        for k in range(a, b, c.batch):
            pick = order[k : min(b, k + c.batch)]
            grad = gradients(model, [docs[i] for i in pick], y[pick], weight[pick])
            adam.step("out", model.out, grad.out + c.decay * model.out)
            bias = np.array([model.out_bias])
            adam.step("out_bias", bias, np.array([grad.out_bias]))
            model.out_bias = float(bias[0])
            for w, kernel in enumerate(model.kernels):
                adam.step(f"k{w}", kernel, grad.kernels[w] + c.decay * kernel)
                adam.step(f"b{w}", model.biases[w], grad.biases[w])
            if len(grad.rows):
                adam.step("embed", model.embed, grad.embed + c.decay * model.embed[grad.rows], grad.rows)


def _best(bins: np.ndarray, n: np.ndarray, toxic: np.ndarray) -> float:
    """Middle of the best F1 plateau; ``bins``: how many of GRID a score reaches, with the rows and toxic rows there."""
    total = toxic.sum()
    if not total:
        return 0.5
    above, tp = (np.bincount(bins, v, len(GRID) + 1)[::-1].cumsum()[::-1][1:] for v in (n, toxic))
    f1 = 2 * tp / np.maximum(above + total, 1)
    return float(np.median(GRID[f1 >= f1.max() - 1e-9]))


def bins_of(scores: np.ndarray) -> np.ndarray:
    return np.searchsorted(GRID, scores, side="right")


def calibrate(scores: np.ndarray, labels: np.ndarray, langs: list[str | None], least: int = 20) -> dict[str, float]:
    """Threshold of each language: the middle of the best F1 plateau on calibration rows.

    '' holds the threshold over all languages, used where a language has fewer
    than ``least`` toxic rows.
    """
    bins, toxic = bins_of(scores), (labels == 1).astype(int)
    one = np.ones(len(bins), int)
    out = {"": _best(bins, one, toxic)}
    keys = np.array(["" if x is None else x for x in langs])
    for lang in np.unique(keys):
        own = keys == lang
        if lang and toxic[own].sum() >= least:
            out[str(lang)] = _best(bins[own], one[own], toxic[own])
    return out


def fitting(sizes: list[int], counts: list[int], most: int) -> list[int]:
    """How many of each text are taken, in their order, if all taken have ``most`` letters; one that doesn't fit is passed over."""
    out = []
    for size, n in zip(sizes, counts, strict=True):
        take = n if size == 0 else min(n, most // size)
        out.append(take)
        most -= take * size
    return out


def _labelled(labels: DataFrame, config: CnnConfig) -> DataFrame:
    """lab_id, lab_toxic and a draw of each id that may be learned from."""
    lab = labels.select(F.col("doc_id").alias("lab_id"), F.col("toxic").alias("lab_toxic"))
    lab = lab.filter(F.col("lab_id").isNotNull() & F.col("lab_toxic").isin(0, 1) & (crc_mod("lab_id", config.held_out_mod) != 0))
    return lab.groupBy("lab_id").agg(F.max("lab_toxic").alias("lab_toxic")).withColumn("draw", F.xxhash64(F.lit(config.seed), "lab_id"))


def fit_toxicity(docs: DataFrame, labels: DataFrame, config: CnnConfig = CnnConfig()) -> ToxicityModel:
    """Train on labelled rows whose crc32(doc_id as text) mod 5 is not 0.

    Every such row is used, one in five by hash to calibrate the thresholds, the
    others to train.  Rows with a null id, label or text teach nothing; an id
    labelled twice counts once; repeated rows of documents count each.  The result
    doesn't depend on the order of the tables.
    """
    if (config.max_positive, config.max_negative, config.max_bytes) != (None, None, None):
        return _fit_bounded(docs, labels, config)
    shards = _shards(docs, labels, config)
    n, toxic = sum(s.n for s in shards), sum(s.toxic for s in shards)
    model = init_model(config)
    if not n or toxic in (0, n):
        model.out, model.prior = np.zeros(0), float(toxic / n * 0.98 + 0.01) if n else 0.01
    else:
        model.prior = toxic / n
        paths = [s.path for s in shards if s.n]
        local = -(-epochs_of(config, n) // config.epochs)
        for k in range(config.epochs):
            _round(docs.sparkSession, model, paths, k, local)
    if any(s.held for s in shards):
        model.thresholds = _thresholds(docs.sparkSession, model, [s.path for s in shards if s.held])
    return model


def _shards(docs: DataFrame, labels: DataFrame, config: CnnConfig) -> list:
    """Word numbers of all labelled rows in files of the shared folder: path, rows to train on, toxic ones of them, rows to calibrate on."""
    spark, c = docs.sparkSession, config
    out = shared_path(spark, "toxicity-shards")
    base, file, row = placed(docs.select("doc_id", "text", "lang"))
    lab = _labelled(labels, config)
    ids = base.select(F.col("doc_id"), file.alias("file"), row.alias("row")).filter(F.col("doc_id").isNotNull())
    # labels are dealt to rows by place, so that the texts of other rows stay where they are
    marks = saved(ids.join(lab, F.col("doc_id") == F.col("lab_id")).select("file", "row", F.col("lab_toxic").cast("long").alias("value")), "toxicity-marks")
    count = marks.count()
    if not count:
        return []
    folder = write_marks(marks, "toxicity-places")
    draw = F.xxhash64(F.lit(c.seed), "doc_id")
    rows = base.filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", c.held_out_mod) != 0))
    rows = rows.select("text", "lang", draw.alias("draw"), mark_column(folder, file, row, -1).alias("y")).filter(F.col("y") >= 0)
    rows = rows.withColumn("key", F.xxhash64("text")).withColumn("shard", F.pmod(F.xxhash64(F.lit(c.seed + 1), "draw"), F.lit(-(-count // SHARD_ROWS))))
    dealt = rows.repartition("shard").sortWithinPartitions("shard", "draw", "key", "lang")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("toxicity")
        shard, part, size, held = None, 0, 0, []
        vocab = Vocabulary()

        def done() -> pd.DataFrame:
            table = np.concatenate([np.zeros((1, ROWS_PER_WORD), np.int32), hashed_rows(vocab.fresh, c.buckets)])
            ids, y, hold, langs = ([h[k] for h in held] for k in range(4))
            path = f"{out}/{shard}-{part}.pkl"
            y, hold = np.array(y, np.int8), np.array(hold, bool)
            put_file(path, pickle.dumps((table, ids, y, hold, [x for x, h in zip(langs, hold, strict=True) if h])))
            vocab.clear()
            vocab.fresh = []
            return pd.DataFrame({"shard": [shard], "part": [part], "path": [path], "n": [int((~hold).sum())], "toxic": [int(y[~hold].sum())], "held": [int(hold.sum())]})

        for batch in batches:
            for text, lang, draw_, y, key in zip(batch["text"], batch["lang"], batch["draw"], batch["y"], batch["shard"], strict=True):
                if key != shard or size >= SHARD_BYTES or len(held) >= 4 * SHARD_ROWS:
                    if held:
                        yield done()
                    shard, part, size, held = key, part + 1 if key == shard else 0, 0, []
                words = words_of(text)
                held.append((np.fromiter(map(vocab.__getitem__, words), np.int32, len(words)), y, draw_ % 5 == 0, lang))
                size += len(text)
        if held:
            yield done()

    made = saved(dealt.mapInPandas(write, "shard long, part long, path string, n long, toxic long, held long"), "toxicity-shard-list")
    return made.orderBy("shard", "part").collect()


def _tasks(spark, paths: list[str], run, schema: str) -> DataFrame:
    """A task for each path; ``run`` gives the frames of one, told its number."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("toxicity")
        for batch in batches:
            for k in batch["id"]:
                yield from run(int(k), pickle.loads(get_file(paths[k])))

    return spark.range(0, len(paths), 1, len(paths)).mapInPandas(each, schema)


def _round(spark, model: ToxicityModel, paths: list[str], k: int, local: int) -> None:
    """Every shard descends ``local`` times over its rows; the changes are averaged into the model.

    A shard weighs as its rows; an embedding row is averaged over the shards that
    changed it, so that rare words learn as fast as frequent ones.
    """
    c, share, start = model.config, model.prior, save_model(model, spark)
    edges = np.linspace(0, c.buckets, BLOCKS + 1).astype(int)

    def run(shard: int, data: tuple) -> Iterator[pd.DataFrame]:
        own, (table, ids, y, hold, _) = pickle.loads(get_file(start)), data
        before = own.embed.copy()
        own.rows = table
        docs, y = [d for d, h in zip(ids, hold, strict=True) if not h], y[~hold].astype(float)
        rng, adam, weight = np.random.default_rng([c.seed + 1, shard, k]), Adam(c.rate), class_weights(y, share)
        for e in range(local):
            adam.rate = c.rate * (1 - (k + e / local) / c.epochs)
            descend(own, adam, docs, y, weight, rng.permutation(len(docs)))
        delta = own.embed - before
        found = [(-1, pickle.dumps((own.out, own.out_bias, own.kernels, own.biases)))]
        for b, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            at = np.flatnonzero(delta[lo:hi].any(1))
            found.append((b, pickle.dumps((at.astype(np.int32), delta[lo:hi][at]))))
        yield pd.DataFrame({"block": [b for b, _ in found], "shard": shard, "n": len(docs), "data": [x for _, x in found]})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, total = None, None

        def done() -> pd.DataFrame:
            if block < 0:
                out = [x / total[0] for x in total[1]]
            else:
                out = (total[1] / np.maximum(total[0], 1)[:, None]).astype(np.float32)
            return pd.DataFrame({"block": [block], "data": [pickle.dumps(out)]})

        for batch in batches:
            for b, n, data in zip(batch["block"], batch["n"], batch["data"], strict=True):
                if b != block:
                    if block is not None:
                        yield done()
                    block, total = b, None
                x = pickle.loads(data)
                if b < 0:
                    flat = [np.asarray(v, float) * n for v in (x[0], x[1], *x[2], *x[3])]
                    total = [total[0] + n, [p + q for p, q in zip(total[1], flat, strict=True)]] if total else [n, flat]
                else:
                    if total is None:
                        total = [np.zeros(edges[b + 1] - edges[b]), np.zeros((edges[b + 1] - edges[b], c.dim))]
                    total[0][x[0]] += n
                    total[1][x[0]] += n * x[1].astype(float)
        if block is not None:
            yield done()

    parts = _tasks(spark, paths, run, "block long, shard long, n long, data binary")
    for r in parts.repartition("block").sortWithinPartitions("block", "shard").mapInPandas(merge, "block long, data binary").collect():
        x, w = pickle.loads(r.data), len(c.widths)
        if r.block < 0:
            model.out, model.out_bias = x[0], float(x[1])
            model.kernels, model.biases = ([v.astype(np.float32) for v in part] for part in (x[2 : 2 + w], x[2 + w :]))
        else:
            model.embed[edges[r.block] : edges[r.block + 1]] += x


def _thresholds(spark, model: ToxicityModel, paths: list[str], least: int = 20) -> dict[str, float]:
    """As calibrate() gives them, counted over all calibration rows of the shards."""
    start = save_model(model, spark)

    def run(_: int, data: tuple) -> Iterator[pd.DataFrame]:
        own, (table, ids, y, hold, langs) = _model(start), data
        own.forget()
        own.vectors = own.embed[table].sum(1)
        docs = [d for d, h in zip(ids, hold, strict=True) if h]
        scores = [own.scores(docs[a:b]) for a, b in slices([len(d) + 4 for d in docs], SLICE_WORDS)]
        own.forget()
        found = pd.DataFrame({"lang": pd.Series(langs, dtype=object), "bin": bins_of(np.concatenate(scores)), "n": 1, "toxic": y[hold].astype(int)})
        yield found.groupby(["lang", "bin"], dropna=False, as_index=False).sum().astype({"lang": object}).replace({"lang": {np.nan: None}})

    rows = _tasks(spark, paths, run, "lang string, bin long, n long, toxic long")
    hist = saved(rows.groupBy("lang", "bin").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")), "toxicity-counts")
    often = hist.filter(F.length("lang") > 0).groupBy("lang").agg(F.sum("toxic").alias("all")).filter(F.col("all") >= least).select("lang")
    every = hist.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).toPandas()
    out = {"": _best(every["bin"].to_numpy(), every["n"].to_numpy(), every["toxic"].to_numpy())}
    for lang, own in hist.join(often, "lang").toPandas().groupby("lang"):
        out[str(lang)] = _best(own["bin"].to_numpy(), own["n"].to_numpy(), own["toxic"].to_numpy())
    return out


def _fit_bounded(docs: DataFrame, labels: DataFrame, config: CnnConfig) -> ToxicityModel:
    """Train on the driver, on no more rows than the caller's bounds.

    At most ``max_positive`` toxic and ``max_negative`` other rows are taken, the
    lowest by hash; one in five of them calibrates the thresholds.  ``max_bytes``
    is shared by the labels as their rows are, what one leaves goes to the other,
    and is filled in hash order too.
    """
    lab = _labelled(labels, config)
    bound = {1: config.max_positive, 0: config.max_negative}
    max_bytes = config.max_bytes if config.max_bytes is not None else 1 << 62
    picked = [rows if n is None else rows.orderBy("draw").limit(n) for rows, n in ((lab.filter(F.col("lab_toxic") == k), n) for k, n in bound.items())]
    rows = docs.select("doc_id", "text", "lang").join(picked[0].unionByName(picked[1]), F.col("doc_id") == F.col("lab_id")).filter(F.col("text").isNotNull())
    rows = rows.select("draw", F.xxhash64("text").alias("key"), "lang", F.length("text").alias("size"), F.col("lab_toxic").cast("int").alias("y"), "text")
    # sizes first, so that the bound doesn't depend on the order of the table
    found = rows.groupBy("draw", "key", "lang", "size", "y").agg(F.count("*").alias("n")).collect()
    found.sort(key=lambda r: (r.draw, r.key, r.lang or "", r.lang is None))
    by_label = {k: [r for r in found if r.y == k] for k in (0, 1)}
    needs = {k: sum(r.size * r.n for r in v) for k, v in by_label.items()}
    toxic, other = config.max_positive, config.max_negative
    part = max_bytes // 3 if toxic is None or other is None else max_bytes * toxic // max(toxic + other, 1)
    most = {1: max(part, max_bytes - needs[0]), 0: max(max_bytes - part, max_bytes - needs[1])}
    taken = {}
    for k, v in by_label.items():
        for r, n in zip(v, fitting([r.size for r in v], [r.n for r in v], most[k]), strict=True):
            if n:
                taken[r.draw, r.key, r.lang] = n
    unread = dict(taken)
    kept = []
    wanted = rows.filter(F.col("size") <= max((r.size for r in found if (r.draw, r.key, r.lang) in taken), default=-1))
    for r in wanted.select("draw", "key", "lang", "y", "text").toLocalIterator():
        n = unread.pop((r.draw, r.key, r.lang), 0)
        kept += [r] * n
    kept.sort(key=lambda r: (r.draw, r.key, r.lang or "", r.lang is None))
    texts, ys, langs, draws = ([r[c] for r in kept] for c in ("text", "y", "lang", "draw"))
    hold = np.array([d % 5 == 0 for d in draws], bool)
    y = np.array(ys, int)
    model = train([t for t, h in zip(texts, hold, strict=True) if not h], y[~hold].tolist(), config)
    if hold.any():
        model.thresholds = calibrate(model.score_texts([t for t, h in zip(texts, hold, strict=True) if h]), y[hold], [x for x, h in zip(langs, hold, strict=True) if h])
    return model


def save_model(model: ToxicityModel, spark) -> str:
    path = shared_path(spark, "toxicity-model") + ".pkl"
    put_file(path, pickle.dumps(model))
    return path


_MODELS: dict[str, ToxicityModel] = {}
keep_cache("toxicity", _MODELS.clear)


def _model(path: str) -> ToxicityModel:
    claim("toxicity")
    if path not in _MODELS:
        _MODELS.clear()
        _MODELS[path] = pickle.loads(get_file(path))
    return _MODELS[path]


def score_column(path: str):
    """Pandas UDF from text to score; null and empty texts get the score of no words."""

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _model(path)
        for texts in batches:
            yield pd.Series(model.score_texts(texts.tolist()), dtype="float64")

    return F.pandas_udf(score, "double", F.PandasUDFType.SCALAR_ITER)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score (0 to 1), threshold of the row's language and whether it is rejected.

    One row per input row, repeated rows and null ids included; ids keep their
    type; very long texts are read whole; other columns are ignored; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    score = score_column(save_model(model, spark))
    cut = F.lit(model.thresholds.get("", 0.5))
    for lang, t in model.thresholds.items():
        if lang:
            cut = F.when(F.col("lang") == lang, F.lit(t)).otherwise(cut)
    scored = docs.select("doc_id", "lang", score("text").alias("score"))
    return scored.select("doc_id", "score", cut.alias("threshold"), (F.col("score") >= cut).alias("rejected"))


def remove_toxic(docs: DataFrame, labels: DataFrame, config: CnnConfig = CnnConfig()) -> DataFrame:
    """The rows of ``docs`` whose score is below their language's threshold, all columns kept, repeated rows too.

    Null and empty texts have the score of no words; a null language uses the
    threshold over all.  Without labels nothing is learned and every score is
    0.01, so every row stays.
    """
    model = fit_toxicity(docs, labels, config)
    score = score_column(save_model(model, docs.sparkSession))
    cut = F.lit(model.thresholds.get("", 0.5))
    for lang, t in model.thresholds.items():
        if lang:
            cut = F.when(F.col("lang") == lang, F.lit(t)).otherwise(cut)
    return docs.filter(score(F.col("text")) < cut)
