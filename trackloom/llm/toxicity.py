"""Toxicity by non-negative positive-unlabelled learning: a numpy logistic model over words and word beginnings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import Scratch, by_bytes, doc_fold, lookup, tidy
from trackloom.llm.decontaminate import WORD_BYTES
from trackloom.llm.hashing import blocks, hashed, joined

#: Bits of a hashed feature, and features.
BITS = 18
FEATURES = 1 << BITS
#: Lengths in bytes of word beginnings that are features, which stand for inflected forms.
HEADS = (4, 5)
#: Features of at least so many positives take part whose share among the positives is so many standard errors above,
#: and so many times, that among all documents; so a long text's common words don't outweigh a few telling ones.
LEAST_DOCS, LEAST_Z, LEAST_LIFT = 3, 4.0, 1.5
#: The fit's first steps run on so many positive and so many of all documents at most; the others on all rows.
FIRST_ROWS = 10_000
FIRST_STEPS, STEPS = 300, 12
RATE, DECAY = 0.1, 1e-3
#: Parts of one in which tasks' sums are added up as whole numbers, so that their order changes nothing. Sums stay in
#: range for 10**11 rows; beyond that Spark raises an error.
UNIT = 1 << 20
#: Bytes of text whose features a task holds at a time.
BATCH_BYTES = 1 << 20


def features(texts: list[str | None], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of each text's distinct features, in order: hashes of its words, and of the first 4 and 5 bytes
    of longer ones. With ``wanted``, a flag per feature, only such features."""
    raw, ends = joined(texts, WORD_BYTES)
    if len(texts) == 1 and len(raw) > 2 * BATCH_BYTES:  # a long text, a block at a time
        on = np.zeros(FEATURES, bool)
        for a, e in blocks(raw):
            _, words, heads = hashed(raw[a:e], HEADS)
            for h in (words, *(h for _, h in heads)):
                on[h >> np.uint64(64 - BITS)] = True
        f = np.flatnonzero(on if wanted is None else on & wanted)
        return np.zeros(len(f), np.int64), f
    start, words, heads = hashed(raw, HEADS)
    doc = np.searchsorted(ends, start, side="right")
    pairs = []
    for number, h in [(slice(None), words), *heads]:
        f = (h >> np.uint64(64 - BITS)).astype(np.int64)
        d = doc[number]
        if wanted is not None:
            keep = wanted[f]
            d, f = d[keep], f[keep]
        pairs.append((d << BITS) | f)
    pairs = np.unique(np.concatenate(pairs))
    return pairs >> BITS, pairs & (FEATURES - 1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability of each text: the sum of the weights of its distinct features."""
        doc, f = features(texts, self.weights != 0)
        return sigmoid(self.bias + np.bincount(doc, self.weights[f], len(texts)))


@dataclass
class Sums:
    """Over some rows: numbers of positives and of all, sums of the losses, and of the gradients of both parts."""

    size: int
    n: np.ndarray = field(default_factory=lambda: np.zeros(2))
    loss: np.ndarray = field(default_factory=lambda: np.zeros(2))
    gradient: np.ndarray | None = None  # (2, size + 1): of the positives' rows, of all rows
    count: np.ndarray | None = None  # positives with each feature, and all positives

    def __post_init__(self):
        self.gradient = np.zeros((2, self.size + 1)) if self.gradient is None else self.gradient
        self.count = np.zeros(self.size + 1) if self.count is None else self.count

    def add(self, x: np.ndarray, positive: np.ndarray, row: np.ndarray, col: np.ndarray) -> None:
        """Rows with their flag, and the pairs (row, feature) that are set, at weights ``x`` (the last is the bias)."""
        z = np.bincount(row, x[col], len(positive)) + x[-1]
        s, loss = sigmoid(z), np.logaddexp(0, z)  # loss of calling a row not toxic, and its slope
        for k, w in enumerate((positive.astype(float), np.ones(len(z)))):
            self.n[k] += w.sum()
            self.loss[k] += w @ loss
            g = s * w
            self.gradient[k, :-1] += np.bincount(col, g[row], self.size)
            self.gradient[k, -1] += g.sum()
        on = positive[row]
        self.count[:-1] += np.bincount(col[on], minlength=self.size)
        self.count[-1] += positive.sum()

    def pack(self) -> bytes:
        return np.concatenate([self.n, self.loss, self.gradient.ravel(), self.count]).tobytes()

    @classmethod
    def unpack(cls, parts: list[bytes], size: int) -> Sums:
        flat = np.sum([np.frombuffer(p) for p in parts], 0) if parts else np.zeros(4 + 3 * (size + 1))
        return cls(size, flat[:2], flat[2:4], flat[4 : 4 + 2 * (size + 1)].reshape(2, -1), flat[4 + 2 * (size + 1) :])

    def step(self, prior: float) -> np.ndarray:
        """Gradient of the non-negative risk with logistic loss l,

            prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)]);

        where the second term, the estimated risk on negatives, is below zero, the step goes against it instead.
        """
        p, u = self.gradient / np.maximum(self.n, 1)[:, None]
        negative = self.loss[1] / max(self.n[1], 1) - prior * self.loss[0] / max(self.n[0], 1)
        if negative < 0:
            return prior * p - u
        return u - prior * self.count / max(self.n[0], 1)


class Adam:
    """Adam with weight decay on all but the bias."""

    def __init__(self, x: np.ndarray, prior: float):
        self.x, self.prior, self.t, self.m, self.v = x, prior, 0, np.zeros_like(x), np.zeros_like(x)

    def step(self, g: np.ndarray, rate: float) -> None:
        g = g + DECAY * self.prior * np.r_[self.x[:-1], 0]
        self.t += 1
        self.m, self.v = 0.9 * self.m + 0.1 * g, 0.999 * self.v + 0.001 * g * g
        self.x = self.x - rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-9)


def rows_of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positive, row, col) of a batch of (positive, packed features)."""
    packed = b.column(1).to_pylist()
    col = np.frombuffer(b"".join(packed), "<i4").astype(np.int64)
    return np.array(b.column(0).to_pylist(), bool), np.repeat(np.arange(len(packed)), [len(p) // 4 for p in packed]), col


def feature_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of positives and of all rows with each feature, and the numbers of both; ``rows``: (positive, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, FEATURES + 1), np.int64)
        for b in by_bytes(batches, 1, most=BATCH_BYTES):
            positive = np.array(b.column(0).to_pylist(), bool)
            doc, f = features(b.column(1).to_pylist())
            n[0, :-1] += np.bincount(f[positive[doc]], minlength=FEATURES)
            n[1, :-1] += np.bincount(f, minlength=FEATURES)
            n[:, -1] += positive.sum(), len(positive)
        f = np.flatnonzero(n[1])
        yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(n[0, f]), pa.array(n[1, f])], ["f", "p", "u"])

    got = rows.mapInArrow(tidy(run), "f long, p long, u long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).toArrow()
    n = np.zeros((2, FEATURES + 1))
    n[:, got.column("f").to_numpy()] = got.column("p").to_numpy(), got.column("u").to_numpy()
    return n[0, :-1], n[1, :-1], n[:, -1]


def chosen(with_p: np.ndarray, with_u: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Numbers of the features that take part in the fit."""
    if not n[0]:
        return np.empty(0, np.int64)
    share = (with_u + 0.5) / (n[1] + 1)
    z = (with_p / n[0] - share) / np.sqrt(share * (1 - share) * (1 / n[0] + 1 / n[1]))
    return np.flatnonzero((z >= LEAST_Z) & (with_p >= LEAST_DOCS) & (with_p / n[0] >= LEAST_LIFT * share))


def train(documents: DataFrame, labels: DataFrame) -> Model:
    """Fit on all documents outside the held-out fold: confirmed toxic ones, and all, toxic or not, as unlabelled.

    Features are counted and chosen over all rows. The first steps of the fit, which bring the weights near their place,
    run in the driver on the rows with the smallest hash of doc_id, FIRST_ROWS of either kind at most; then STEPS steps
    follow the gradient of the risk over all rows, summed by tasks. The class prior is the share of toxic ones among all
    labelled rows outside the fold. Rows with a null doc_id or label teach nothing, null and empty texts have no features,
    labels of no document are in the prior only. Without confirmed documents the model is the prior alone.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "toxicity")
    fold = F.col("doc_id").isNotNull() & (doc_fold(F.col("doc_id")) != 0)
    known = labels.select("doc_id", "toxic").where(F.col("toxic").isNotNull() & fold)
    prior = known.agg(F.avg(F.when(F.col("toxic") == 1, 1.0).otherwise(0.0))).first()[0] or 0.0
    prior = float(np.clip(prior, 1e-4, 0.9))
    start = float(np.log(prior / (1 - prior)))
    positive = scratch.save(known.where("toxic = 1").select("doc_id").distinct().withColumn("positive", F.lit(True)), "positive")
    rows = lookup(documents.select("doc_id", "text").where(fold), positive, ["doc_id"], "left").withColumn("positive", F.coalesce("positive", F.lit(False)))

    with_p, with_u, n = feature_counts(rows.select("positive", "text"))
    used = chosen(with_p, with_u, n)
    size = len(used)
    if not size:
        return Model(np.zeros(FEATURES), start)
    place = np.full(FEATURES, -1, np.int64)
    place[used] = np.arange(size)
    shared = spark.sparkContext.broadcast(place)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value >= 0
        for b in by_bytes(batches, 2, most=BATCH_BYTES):
            doc, f = features(b.column(2).to_pylist(), wanted)
            cut = np.searchsorted(doc, np.arange(b.num_rows + 1))
            flat = shared.value[f].astype("<i4")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([flat[i:j].tobytes() for i, j in zip(cut, cut[1:], strict=False)], pa.binary())], ["positive", "h", "features"])

    packed = rows.select("positive", F.xxhash64("doc_id", F.lit(6)).alias("h"), "text").mapInArrow(tidy(pack), "positive boolean, h long, features binary")
    packed = scratch.save(packed, "packed")

    fit = Adam(np.r_[np.zeros(size), start], prior)
    some = lambda d: d.orderBy("h", "features").limit(FIRST_ROWS).select("positive", "features").toArrow().combine_chunks().to_batches()
    first = [rows_of(b) for b in [*some(packed.where("positive")), *some(packed)] if b.num_rows]
    # the positives' part is that of the confirmed sample, the other that of the sample of all
    first = [(p, r, c) for p, r, c in first]
    for t in range(FIRST_STEPS):
        sums = Sums(size)
        for k, (p, r, c) in enumerate(first):
            own = Sums(size)
            own.add(fit.x, p, r, c)
            part = 0 if k == 0 else 1
            sums.n[part], sums.loss[part], sums.gradient[part] = own.n[part], own.loss[part], own.gradient[part]
            if not part:
                sums.count = own.count
        fit.step(sums.step(prior), RATE * (1 + np.cos(np.pi * t / FIRST_STEPS)) / 2)

    for t in range(STEPS):
        now = spark.sparkContext.broadcast(fit.x)

        def add(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            sums = Sums(size)
            for b in batches:
                if b.num_rows:
                    sums.add(now.value, *rows_of(b))
            flat = np.rint(np.frombuffer(sums.pack()) * UNIT).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["k", "v"])

        # tasks' sums are added up before the driver, which gets 3 numbers a feature however many tasks there are
        got = packed.select("positive", "features").mapInArrow(add, "k long, v long").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
        flat = np.zeros(4 + 3 * (size + 1))
        flat[got.column("k").to_numpy()] = got.column("v").to_numpy() / UNIT
        fit.step(Sums.unpack([flat.tobytes()], size).step(prior), 0.2 * RATE * (1 - t / STEPS))
        now.destroy()
    weights = np.zeros(FEATURES)
    weights[used] = fit.x[:-1]
    return Model(weights, float(fit.x[-1]))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """Add ``score`` to rows that have ``text``; it looks at nothing else. Null text is scored as empty; a very long one
    is read whole, a piece at a time; equal texts get equal scores. A column ``score`` is replaced."""
    spark, documents = documents.sparkSession, documents.drop("score")
    shared = spark.sparkContext.broadcast(model)
    names = documents.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in by_bytes(batches, at, most=BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([*p.columns, pa.array(shared.value.scores(p.column(at).to_pylist()))], [*names, "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields)
    return documents.mapInArrow(tidy(run), f"{kinds}, score double")


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 at a score of 0.5 or more). An empty table gives an
    empty result, and empty labels a low score for all; repeated rows get equal scores, repeated labels count as often
    in the prior; a null doc_id counts as empty text for ``held_out`` only. Other columns of either table are not read."""
    scored = score(documents.select("doc_id", "text"), train(documents, labels)).drop("text")
    return scored.select("doc_id", (doc_fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
