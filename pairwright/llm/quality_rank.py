"""Operator 2, a quality classifier by Bradley-Terry pairwise ranking."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, pieces, read, texts, word_hashes

#: Bounds of training: labelled rows of each class, preference pairs of a step, steps.
SAMPLE_PER_CLASS, PAIRS, STEPS = 6000, 2048, 400
CHUNK_BYTES = 2 << 20
_EDGES = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 1 << 40])


def features(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of numbers for each text, from its bytes and words alone.

    Roots of the shares of byte values (letters of a case together, the bytes of non-ASCII letters together),
    shares of word lengths and of bytes that end words, the share of words seen before in the text, that of words
    equal to the one before, and the log of the length.
    """
    n = len(off) - 1
    cls = np.arange(256)
    cls[65:91], cls[97:123], cls[128:], cls[48:58] = 65, 97, 128, 48
    _, cls = np.unique(cls, return_inverse=True)
    kinds = int(cls.max()) + 1
    gap = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
    out = np.zeros((n, 2 * kinds + len(_EDGES) + 3), np.float64)
    hashes, words = word_hashes(raw, off)
    bounds = np.concatenate([[0], np.cumsum(words)])
    for i in range(n):
        body = raw[off[i] : off[i + 1]]
        if not len(body):
            continue
        out[i, :kinds] = np.sqrt(np.bincount(cls[body], minlength=kinds) / len(body))
        blank = np.flatnonzero(np.concatenate([[True], gap[body], [True]]))
        size = np.diff(blank) - 1
        ends = blank[1:][size > 0] - 2
        size = size[size > 0]
        if not len(size):
            continue
        out[i, kinds : 2 * kinds] = np.sqrt(np.bincount(cls[body[ends]], minlength=kinds) / len(size))
        out[i, 2 * kinds : -3] = np.bincount(np.searchsorted(_EDGES, size), minlength=len(_EDGES)) / len(size)
        h = hashes[bounds[i] : bounds[i + 1]]
        out[i, -3:] = 1 - len(np.unique(h)) / len(h), np.count_nonzero(h[1:] == h[:-1]) / len(h), math.log1p(len(body)) / 10
    return out


@dataclass
class Ranker:
    """weights on standardised features; a document's score is the logistic of scale * (weights . x - threshold)."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    scale: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.scale * (z - self.threshold), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, share_low: float, seed: int = 7) -> Ranker:
    """Bradley-Terry: of a pair (label 1, label 0) the first wins with the logistic of the difference of their scores.

    Steps of Adam on random pairs descend the mean logistic loss of feature differences.  The threshold is the
    quantile `share_low` of the scores, each class weighted to its share of all labels.  With one class only, all
    weights are 0 and every score is 0.5 or above for label 1 and below for label 0.
    """
    mean, spread = x.mean(0) if len(x) else np.zeros(x.shape[1]), np.maximum(x.std(0), 1e-3) if len(x) else np.ones(x.shape[1])
    z = np.clip((x - mean) / spread, -8, 8)
    high, low = z[y == 1], z[y == 0]
    w = np.zeros(x.shape[1])
    if not len(high) or not len(low):
        return Ranker(mean, spread, w, -1.0 if len(high) or not len(low) else 1.0, 1.0)
    rng = np.random.default_rng(seed)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        d = high[rng.integers(0, len(high), PAIRS)] - low[rng.integers(0, len(low), PAIRS)]
        g = -(d / (1 + np.exp(np.clip(d @ w, -30, 30)))[:, None]).mean(0) + 1e-3 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    s = np.concatenate([high @ w, low @ w])
    weight = np.concatenate([np.full(len(high), (1 - share_low) / len(high)), np.full(len(low), share_low / len(low))])
    order = np.argsort(s, kind="stable")
    s, total = s[order], np.cumsum(weight[order])
    at = min(int(np.searchsorted(total, share_low)), len(s) - 1)
    threshold = (s[at] + s[max(at - 1, 0)]) / 2
    return Ranker(mean, spread, w, float(threshold), float(4 / max(np.std(s), 1e-6)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, modulus: int, held_out: int, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, label, text) of at most per_class documents of each label outside the held-out fold, and the counts of all such labels.

    Those with the least digest of doc_id are taken, so the choice is the same at any layout.  Only their ids are
    broadcast (at most 2 * per_class).  A doc_id with several labels has the largest.
    """
    usable = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold("doc_id", modulus) != held_out)).groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r.label: r.n for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    picked = None
    for value in (0, 1):
        some = usable.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    body = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return body.join(F.broadcast(picked), "doc_id").select("doc_id", "label", "text"), counts


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = SAMPLE_PER_CLASS, doc_id: str = "doc_id", text: str = "text") -> Ranker:
    """A ranker from a bounded sample of labelled documents; feature rows of the sample reach the driver, texts don't."""
    sample, counts = labelled_sample(docs, labels, label, per_class, 3, 1, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = texts(batch.column(2))
            for i, j in pieces(off, CHUNK_BYTES):
                x = features(raw, off[i : j + 1]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i).cast(pa.int32()), pa.array(list(x), pa.list_(pa.float32()))], names=["doc_id", "label", "x"])

    rows = sample.withColumn("label", F.col("label").cast("int")).mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, label int, x array<float>").toArrow()
    rows = rows.sort_by([("doc_id", "ascending")])
    width = features(np.zeros(0, np.uint8), np.zeros(1, np.int64)).shape[1]
    x = np.asarray(rows.column("x").combine_chunks().values if rows.num_rows else np.zeros(0), np.float64).reshape(-1, width)
    y = rows.column("label").to_numpy()
    return fit(x, y, counts.get(0, 0) / max(1, sum(counts.values())))


def score_documents(docs: DataFrame, ranker: Ranker, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), one per row of docs.

    A null or empty text is scored as one without features; null ids and repeated rows are kept; other columns
    aren't read; an empty table gives no rows.  The broadcast is the ranker, of fixed size.
    """
    model = docs.sparkSession.sparkContext.broadcast(ranker)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = texts(batch.column(1))
            score = np.concatenate([np.zeros(0), *(model.value.score(features(raw, off[i : j + 1])) for i, j in pieces(off, CHUNK_BYTES))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, learned from labels outside the held-out fold."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return score_documents(docs, train(docs, read(spark, sf_dir, "labels", "doc_id", "quality")))
