"""Operator 9, a convolutional text classifier for toxicity, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, pieces, read, texts, word_hashes
from .quality_rank import labelled_sample

#: Bounds of training: labelled documents of each class, bytes of a document's text, passes.
SAMPLE_PER_CLASS, SAMPLE_BYTES, PASSES = 3000, 1 << 20, 5
#: Every so manieth document of the sample isn't trained on: it sets thresholds.
CALIBRATION = 4
BITS, WIDTH, FILTERS, SPANS, TOP = 20, 8, 8, (1, 2, 3), 3
#: A word has a bucket for itself and one for each of these prefixes, in bytes; its embedding is their sum.
PREFIXES = (4, 5, 6, 7)
#: Documents that a bucket's tie to the label is held against at first.
SHRINK = 4.0
#: Languages are told apart by this many frequent words of the sample, in at most so many groups.
FREQUENT, GROUPS, LEAST = 200, 8, 10
CHUNK_BYTES, BLOCK_WORDS, BATCH_DOCUMENTS, BATCH_WORDS = 2 << 20, 1 << 15, 64, 40_000
#: Bytes between words: all ASCII but letters, digits and the apostrophe.
_GAPS = np.array([b < 128 and not chr(b).isalnum() and chr(b) != "'" for b in range(256)])
_COLUMNS = len(SPANS) * FILTERS


def buckets(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of every word (the word, its prefixes; 0 for none), and the number of words of each text."""
    h, n = word_hashes(raw, off, _GAPS, prefixes=PREFIXES)
    return (h >> np.uint64(64 - BITS)).astype(np.int32), n


@dataclass
class Languages:
    """Groups of texts that share their frequent words, found without labels: a text's language as it shows in the text."""

    index: np.ndarray  # by bucket: 1 + number of a frequent word, or 0
    centres: np.ndarray

    def of(self, words: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The nearest group of each text; the number of groups for one without a frequent word."""
        hit = self.index[words[:, 0]] if len(words) else np.zeros(0, np.int16)
        own = np.repeat(np.arange(len(n)), n)[hit > 0]
        k = self.centres.shape[1]
        seen = np.bincount(own * k + hit[hit > 0] - 1, minlength=len(n) * k).reshape(len(n), k) > 0
        return np.where(seen.any(1), (seen @ self.centres.T).argmax(1) if len(self.centres) else 0, len(self.centres))


def find_languages(docs: list[np.ndarray]) -> Languages:
    """Spherical k-means over the frequent words of the sample's texts, from centres that lie far apart."""
    held = [np.unique(d[:, 0]) for d in docs]
    found, count = np.unique(np.concatenate([*held, np.zeros(0, np.int32)]), return_counts=True)
    top = found[np.argsort(-count, kind="stable")[:FREQUENT]]
    index = np.zeros(1 << BITS, np.int16)
    index[top] = np.arange(1, len(top) + 1)
    x = np.zeros((len(docs), len(top)))
    for i, h in enumerate(held):
        x[i, index[h][index[h] > 0] - 1] = 1
    x = x[x.any(1)]
    if not len(x):
        return Languages(index, np.zeros((0, len(top))))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    picks = [int(x.sum(1).argmax())]
    while len(picks) < min(GROUPS, len(x)):
        near = (x @ x[picks].T).max(1)
        if near.min() > 0.999:
            break
        picks.append(int(near.argmin()))
    centres = x[picks]
    for _ in range(10):
        group = (x @ centres.T).argmax(1)
        centres = np.stack([x[group == g].mean(0) if (group == g).any() else centres[g] for g in range(len(centres))])
        centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    return Languages(index, centres)


@dataclass
class Convolution:
    """Hashed embeddings; filters over windows of each span; the TOP largest values of each filter over the text; a
    rectifier and a logistic layer.

    Every bucket is embedded; one that the sample lacks is zeros.  threshold has, by shown language, the logit that
    becomes 0.7.
    """

    embedding: np.ndarray  # buckets by WIDTH
    filters: list[np.ndarray]  # for each span: (span, WIDTH, FILTERS)
    bias: np.ndarray  # TOP by filters of all spans
    out: np.ndarray
    out_bias: float
    languages: Languages
    threshold: np.ndarray

    def values(self, words: np.ndarray, left: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(embeddings of words, values of all filters at the windows that begin at each word).

        left: how many words the text has from here; a window that goes beyond them sees blanks.  more: what to add
        to the first number of each embedding.
        """
        x = self.embedding[words[:, 0]]
        for c in range(1, words.shape[1]):
            x = x + self.embedding[words[:, c]]
        if more is not None:
            x[:, 0] += more
        out = np.zeros((len(words), _COLUMNS), np.float32)
        for k, f in enumerate(self.filters):
            block = out[:, k * FILTERS : (k + 1) * FILTERS]
            for i in range(len(f)):
                v = x[i:] @ f[i]
                block[: len(v)] += np.where((left[: len(v)] > i)[:, None], v, 0)
        return x, out

    def pooled(self, words: np.ndarray, n: np.ndarray) -> np.ndarray:
        """(texts, TOP, filters): the largest values in ascending order; windows of blanks, with value 0, are always there.

        Long texts go through in blocks whose largest values are joined.
        """
        top = np.zeros((len(n), TOP, _COLUMNS), np.float32)
        bounds = np.concatenate([[0], np.cumsum(n)])
        left = np.repeat(bounds[1:], n) - np.arange(len(words))
        for at in range(0, len(words), BLOCK_WORDS):
            stop = min(at + BLOCK_WORDS, len(words))
            ahead = min(stop + max(SPANS) - 1, len(words))
            v = self.values(words[at:ahead], left[at:ahead])[1][: stop - at]
            for t in range(int(np.searchsorted(bounds, at, "right")) - 1, int(np.searchsorted(bounds, stop, "left"))):
                mine = np.concatenate([v[max(bounds[t], at) - at : bounds[t + 1] - at], top[t]])
                top[t] = np.partition(mine, len(mine) - np.arange(TOP, 0, -1), axis=0)[-TOP:] if len(mine) > TOP else mine
        return top

    def logit(self, words: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (np.maximum(self.pooled(words, n) + self.bias, 0) * self.out).sum((1, 2), dtype=np.float64) + self.out_bias

    def score(self, words: np.ndarray, n: np.ndarray) -> np.ndarray:
        z = self.logit(words, n) - self.threshold[self.languages.of(words, n)] + np.log(0.7 / 0.3)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def ties(docs: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How much each bucket is tied to the label: the log of the odds of label 1 among documents that hold it, against
    the odds of all, shrunk; and what a document of label 0, and of label 1, must add to leave itself out."""
    counts = np.zeros((2, 1 << BITS), np.float32)
    for d, label in zip(docs, y.tolist(), strict=True):
        counts[label, np.unique(d)] += 1
    share = float(y.mean())

    def odds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        p = (a + SHRINK * share) / (a + b + SHRINK)
        return np.log(p / (1 - p)) - np.log(share / (1 - share))

    b, a = counts
    every = np.where(a + b > 0, odds(a, b), 0).astype(np.float32)
    without = [np.where(own > 0, odds(a - (k == 1) * (a > 0), b - (k == 0) * (b > 0)) - every, 0).astype(np.float32) for k, own in ((0, b), (1, a))]
    for t in (every, *without):
        t[0] = 0
    return every, *without


def fit(docs: list[np.ndarray], y: np.ndarray, weigh: tuple[float, float] = (1.0, 1.0), seed: int = 11) -> Convolution:
    """Adam on the logistic loss; docs are the buckets of each text's words, y their labels.

    A bucket's first number starts as its tie to the label, with each training document left out of its own ties;
    the others start at 0 and learn from the windows that filters choose.  Each label counts as much in all.  Every
    CALIBRATION-th document is set aside: thresholds are, for each language with LEAST of either label there, the
    logit that errs least on them (errors on labels 0 and 1 weigh as given), else that over all of them.  With one
    label only, every text scores for that label (for 0 if there is no label at all).
    """
    rng = np.random.default_rng(seed)
    one = np.zeros(0, np.float32)
    languages = find_languages(docs)
    m = Convolution(np.zeros((1 << BITS, WIDTH), np.float32), [rng.normal(0, 0.3, (s, WIDTH, FILTERS)).astype(np.float32) for s in SPANS], np.zeros((TOP, _COLUMNS), np.float32), np.full((TOP, _COLUMNS), 0.05, np.float32), -1.0, languages, np.zeros(len(languages.centres) + 1))
    if len(docs) == 0 or y.min() == y.max():
        m.out[:] = 0
        m.threshold[:] = 10.0 if not len(docs) or y.max() == 0 else -10.0
        return m
    for f in m.filters:
        f[:, 0] = np.abs(f[:, 0]) + 0.2
    apart = np.zeros(len(docs), bool)
    for label in (0, 1):
        apart[np.flatnonzero(y == label)[CALIBRATION - 1 :: CALIBRATION]] = True
    trained = np.flatnonzero(~apart)
    tie, *without = ties([docs[i] for i in trained], y[trained])
    m.embedding[:, 0] = tie
    moments: dict = {}
    squares = np.full(1 << BITS, 1e-6, np.float32)

    def adam(name, value: np.ndarray, g: np.ndarray, rate: float) -> None:
        a, b, t = moments.setdefault(name, [np.zeros_like(value), np.zeros_like(value), 0])
        moments[name][2] = t = t + 1
        a[:], b[:] = 0.9 * a + 0.1 * g, 0.99 * b + 0.01 * g * g
        value -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-7)

    weight = np.where(y == 1, 0.5 / (y[trained] == 1).mean(), 0.5 / (y[trained] == 0).mean())
    for epoch in range(PASSES):
        rate = 0.01 * (1 - epoch / PASSES) + 0.001
        for group in _batches(rng.permutation(trained), docs):
            words = np.concatenate([docs[i] for i in group])
            n = np.array([len(docs[i]) for i in group])
            bounds = np.concatenate([[0], np.cumsum(n)])
            left = np.repeat(bounds[1:], n) - np.arange(len(words))
            more = np.concatenate([*(without[y[i]][docs[i]].sum(1) for i in group), one])
            x, v = m.values(words, left, more)
            v = np.concatenate([v, np.zeros((1, _COLUMNS), np.float32)])  # the window of blanks
            place = np.full((len(group), TOP, _COLUMNS), len(words))
            for t in range(len(group)):
                mine = np.concatenate([np.arange(bounds[t], bounds[t + 1]), np.full(TOP, len(words))])
                best = np.argsort(v[mine], axis=0, kind="stable")[-TOP:] if len(mine) < 64 else _largest(v[mine])
                place[t] = mine[best]
            hidden = np.maximum(np.take_along_axis(v[None], place.reshape(1, -1, _COLUMNS), 1).reshape(place.shape) + m.bias, 0)
            z = (hidden * m.out).sum((1, 2)) + m.out_bias
            d = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[group]) * weight[group] / len(group)).astype(np.float32)
            g = d[:, None, None] * m.out * (hidden > 0)
            at, slope = [], []
            for k, f in enumerate(m.filters):
                block = slice(k * FILTERS, (k + 1) * FILTERS)
                p, gp = place[..., block].reshape(-1, FILTERS), g[..., block].reshape(-1, FILTERS)
                gf = 1e-4 * f
                for i in range(len(f)):
                    has = (p < len(words)) & (np.append(left, 0)[p] > i)
                    for q in range(FILTERS):
                        ok = has[:, q] & (gp[:, q] != 0)
                        own = p[ok, q] + i
                        gf[i, :, q] += gp[ok, q] @ x[own]
                        at.append(own)
                        slope.append(gp[ok, q, None] * f[i, :, q])
                adam(f"f{k}", f, gf, rate)
            _descend(m.embedding, squares, words[np.concatenate(at)], np.concatenate(slope), rate)
            adam("b", m.bias, g.sum(0), rate)
            adam("o", m.out, (d[:, None, None] * hidden).sum(0) + 1e-4 * m.out, rate)
            bias = np.array([m.out_bias])
            adam("ob", bias, np.array([d.sum()]), rate)
            m.out_bias = float(bias[0])
    aside = np.flatnonzero(apart)
    if not 0 < y[aside].sum() < len(aside):
        aside = trained
    logit = np.concatenate([m.logit(np.concatenate([docs[i] for i in g]), np.array([len(docs[i]) for i in g])) for g in _batches(aside, docs)])
    group = np.concatenate([languages.of(docs[i], np.array([len(docs[i])])) for i in aside])
    label = y[aside]
    m.threshold[:] = _cut(logit, label, weigh)
    for k in range(len(m.threshold)):
        mine = group == k
        if min((label[mine] == 1).sum(), (label[mine] == 0).sum()) >= LEAST:
            m.threshold[k] = _cut(logit[mine], label[mine], weigh)
    return m


def _largest(v: np.ndarray) -> np.ndarray:
    """Places of the TOP largest values of each column, in ascending order of value."""
    some = np.argpartition(v, len(v) - TOP, axis=0)[-TOP:]
    return np.take_along_axis(some, np.argsort(np.take_along_axis(v, some, 0), axis=0, kind="stable"), 0)


def _batches(order: np.ndarray, docs: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Documents in their order, at most BATCH_DOCUMENTS of BATCH_WORDS words together, or one."""
    batch, size = [], 0
    for i in order.tolist():
        if batch and (len(batch) == BATCH_DOCUMENTS or size + len(docs[i]) > BATCH_WORDS):
            yield np.array(batch)
            batch, size = [], 0
        batch.append(i)
        size += len(docs[i])
    if batch:
        yield np.array(batch)


def _descend(embedding: np.ndarray, squares: np.ndarray, words: np.ndarray, slope: np.ndarray, rate: float) -> None:
    """A step of Adagrad on the buckets of words, each of which gets its word's slope."""
    found, place = np.unique(words.ravel(), return_inverse=True)
    total = np.zeros((len(found), embedding.shape[1]), np.float32)
    for c in range(words.shape[1]):
        np.add.at(total, place.reshape(words.shape)[:, c], slope)
    squares[found] += (total * total).mean(1)
    embedding[found] -= rate * total / np.sqrt(squares[found])[:, None]
    embedding[0] = 0


def _cut(logit: np.ndarray, y: np.ndarray, weigh: tuple[float, float] = (1.0, 1.0)) -> float:
    """The middle of the widest stretch of logits that err least; errors on labels 0 and 1 weigh as given."""
    order = np.argsort(logit, kind="stable")
    s, t = logit[order], y[order]
    errors = weigh[1] * np.concatenate([[0], np.cumsum(t == 1)]) + weigh[0] * np.concatenate([np.cumsum((t == 0)[::-1])[::-1], [0]])
    edges = np.concatenate([[s[0] - 4], s, [s[-1] + 4]])
    errors = np.where(np.diff(edges) > 1e-9, errors, np.inf)  # equal logits can't be told apart
    least = np.flatnonzero(errors <= errors.min() + 1e-9)
    k = least[np.argmax(edges[least + 1] - edges[least])]
    return float((edges[k] + edges[k + 1]) / 2)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = SAMPLE_PER_CLASS, doc_id: str = "doc_id", text: str = "text") -> Convolution:
    """A classifier from a bounded sample of labelled documents, whose hash buckets reach the driver.

    The sample has at most per_class documents of each label, of texts of at most SAMPLE_BYTES bytes.
    """
    sample, counts = labelled_sample(docs, labels, label, per_class, 3, 1, doc_id, text)
    sample = sample.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES).select("doc_id", F.col("label").cast("int").alias("label"), "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = texts(batch.column(2))
            for i in range(batch.num_rows):
                words, _ = buckets(raw, off[i : i + 2])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([words.ravel()], pa.list_(pa.int32()))], names=["doc_id", "label", "words"])

    rows = sample.mapInArrow(hashed, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, label int, words array<int>").toArrow().sort_by([("doc_id", "ascending")])
    found = [np.asarray(x.values, np.int32).reshape(-1, 1 + len(PREFIXES)) for x in rows.column("words")]
    y = rows.column("label").to_numpy()
    held = [max(1, int((y == v).sum())) for v in (0, 1)]
    model = fit(found, y, (counts.get(0, 0) / held[0], counts.get(1, 0) / held[1]))
    del found, rows
    pa.default_memory_pool().release_unused()  # else the driver keeps room for a sample
    return model


def _scorer(docs: DataFrame, model: Convolution):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(column: pa.Array) -> np.ndarray:
        raw, off = texts(column)
        return np.concatenate([np.zeros(0), *(shared.value.score(*buckets(raw, off[i : j + 1])) for i, j in pieces(off, CHUNK_BYTES))])

    return scores


def score_documents(docs: DataFrame, model: Convolution, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), one per row of docs.

    A null or empty text, or one without words, has every filter at 0.  Null ids and repeated rows are kept; other
    columns aren't read; an empty table gives no rows.  The broadcast is the classifier, of fixed size.
    """
    scores, kind = _scorer(docs, model), docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch.column(1)), pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Convolution, text: str = "text") -> DataFrame:
    """The rows of docs that score under 0.7, with their columns."""
    names = docs.columns
    scores, at = _scorer(docs, model), names.index(text)
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(at)) < 0.7))

    return plain.mapInArrow(run, plain.schema).toDF(*names)


def op9_convolutional_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from labels outside the held-out fold."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return score_documents(docs, train(docs, read(spark, sf_dir, "labels", "doc_id", "toxic")))
