"""Language ID: the nearest of several centroids per language, by cosine of normalised TF-IDF n-gram vectors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.llm.common import Scratch, by_bytes, doc_fold, lookup, tidy

#: Bits of a hashed n-gram; n-grams are 3 bytes of the lower-cased UTF-8 text.
BITS = 12
SIZE = 1 << BITS
#: Documents per language that the centroids are fitted on, at most, and centroids per language.
MOST_PER_LANG = 1_500
CENTROIDS = 4
#: A text is rejected if its best cosine is below this share of the fit's first percentile for that centroid.
REJECT = 0.5
UNKNOWN = "und"
#: Bytes of a text that are counted at a time.
PIECE = 1 << 20
#: Texts whose vectors a task holds at a time.
ROWS = 256
LETTER = re.compile(r"[^\W\d_]")

#: A-Z lower-cased; other ASCII but letters, and white space, become spaces.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def counts(texts: list[str | None]) -> np.ndarray:
    """Term frequencies of each text's hashed n-grams: (texts, SIZE). A long text is counted PIECE bytes at a time."""
    out = np.zeros((len(texts), SIZE), np.int64)
    for k, t in enumerate(texts):
        raw = (" " + (t or "") + " ").encode("utf-8", "surrogatepass").translate(LETTERS)
        for at in range(0, len(raw) - 2, PIECE):
            b = np.frombuffer(raw, np.uint8, min(PIECE + 2, len(raw) - at), at).astype(np.uint32)
            v = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
            v = (v[v != 0x202020] * np.uint32(2654435761)) >> np.uint32(32 - BITS)
            out[k] += np.bincount(v, minlength=SIZE)
    return out


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(tf.astype(np.float32)) * idf.astype(np.float32)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


@dataclass
class Centroids:
    idf: np.ndarray
    centers: np.ndarray
    langs: list[str]
    floor: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine (0 to 1) and whether it is too far from the centroid to be trusted."""
        letters = np.array([t is not None and any(m[0].isalpha() for m in LETTER.finditer(t)) for t in texts], bool)
        if not len(self.langs):
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        sim = vectors(counts(texts), self.idf) @ self.centers.T
        best = sim.argmax(1)
        top = np.where(letters, np.clip(sim[np.arange(len(texts)), best], 0, 1), 0).astype(float)
        langs = [self.langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
        return langs, top, ~letters | (top < REJECT * self.floor[best])


def clustered(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Unit centroids of spherical k-means; starts from the farthest of those chosen so far."""
    centers = [x.mean(0)]
    for _ in range(min(k, len(x)) - 1):
        centers.append(x[(x @ np.array(centers).T).max(1).argmin()])
    c = np.array(centers)
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        sums = np.array([x[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c


def learnt(documents: DataFrame) -> DataFrame:
    """Rows to learn from: those outside the held-out fold that have a text and a language."""
    own = documents.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    return own.where(doc_fold(F.col("doc_id")) != 0).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))


def weights(own: DataFrame) -> np.ndarray:
    """Inverse document frequencies of the hashed n-grams, over all rows."""

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(SIZE, np.int64), 0
        for texts in by_bytes(batches, 0, ROWS):
            tf = counts(texts.column(0).to_pylist())
            df += (tf > 0).sum(0)
            n += len(tf)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SIZE + 1)), pa.array(np.r_[df, n])], ["dim", "n"])

    seen = own.select("text").mapInArrow(tidy(frequencies), "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(SIZE + 1)
    for r in seen:
        df[r["dim"]] = r["n"]
    return np.log((1 + df[SIZE]) / (1 + df[:SIZE])) + 1


def train(documents: DataFrame) -> Centroids:
    """Document frequencies over all documents outside the held-out fold that have a language; centroids on at most
    MOST_PER_LANG distinct ones of each language, those with the smallest hash of doc_id and text.

    The fit's rows are labelled. Each language is clustered in a task of its own, from a sample of bounded size; the
    driver holds the centroids, CENTROIDS * SIZE floats a language.
    """
    own = learnt(documents)
    idf = weights(own)
    # each language's share of hash space that holds about one and a half times the sample, then the smallest of it;
    # rows that repeat are one, before they meet in a task
    h = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(7)), 1)
    per = scratch_counts(own)
    near = lookup(own.withColumn("h", h), per, ["lang"]).where(F.col("h") <= F.lit(float(1 << 63)) * F.lit(1.5 * MOST_PER_LANG) / F.col("n"))
    near = near.groupBy("lang", "h").agg(F.first("text").alias("text"))
    few = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= MOST_PER_LANG).select("lang", "text")

    def cluster(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tf = np.concatenate([counts(p.column(1).to_pylist()).astype(np.float32) for p in by_bytes(batches, 1, ROWS)])
        x = vectors(tf[np.lexsort(tf.T[:8])], idf)  # in an order that does not hang on how the rows came
        c = clustered(x, CENTROIDS)
        sim = x @ c.T
        mine = sim.argmax(1)
        floor = [float(np.quantile(sim[mine == j, j], 0.01)) if (mine == j).any() else 0.0 for j in range(len(c))]
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(c), pa.string()), pa.array(floor), pa.array([v.astype("<f4").tobytes() for v in c], pa.binary())], ["lang", "floor", "center"])

    found = few.groupBy("lang").applyInArrow(cluster, "lang string, floor double, center binary").collect()
    found.sort(key=lambda r: r["lang"])
    centers = [np.frombuffer(r["center"], "<f4") for r in found]
    return Centroids(idf, np.stack(centers) if centers else np.zeros((0, SIZE), np.float32), [r["lang"] for r in found], np.array([r["floor"] for r in found]))


def scratch_counts(own: DataFrame) -> DataFrame:
    return Scratch(own.sparkSession, "language").save(own.groupBy("lang").agg(F.count("*").alias("n")), "languages")


def identify(documents: DataFrame, model: Centroids) -> DataFrame:
    """Add lang_pred, score and rejected to rows with ``text``; nothing else of a row is looked at. Columns of
    these names are replaced.

    lang_pred is a learned language, or ``und`` for null texts, empty ones and those without a letter (score 0,
    rejected). A text that is too far from its centroid keeps its nearest language, and is ``rejected``. Of centroids
    at the same cosine, that of the first language in order of names wins. A very long text is read whole, a piece at a
    time. Repeated rows get equal results.
    """
    documents = documents.drop("lang_pred", "score", "rejected")
    shared = documents.sparkSession.sparkContext.broadcast(model)
    names = documents.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in by_bytes(batches, at, ROWS):
            lang, score, far = shared.value.predict(p.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*p.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(far)], [*names, "lang_pred", "score", "rejected"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields)
    return documents.mapInArrow(tidy(run), f"{kinds}, lang_pred string, score double, rejected boolean")


def language(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected. Without any language to learn from all are
    ``und``; an empty table gives an empty result; repeated rows get equal results."""
    found = identify(documents.select("doc_id", "text"), train(documents)).drop("text")
    return found.select("doc_id", (doc_fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "rejected")
