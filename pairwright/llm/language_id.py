"""Operator 6, language identification by unigram pieces with all segmentations summed."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, fold, materialise, pieces, read, texts

#: Bounds of training: sample documents of a language; and rounds of expectation maximisation.
SAMPLE_DOCUMENTS, ROUNDS = 500, 3
#: Parts of a language among which its sample is sought at first.
SALTS = 64
#: Sample ids (documents by languages) up to which they are broadcast.
BROADCAST_IDS = 200_000
#: What a piece counts before any is seen.
PRIOR = 0.02
#: Texts and words looked at together, in bytes, and log probabilities (words by languages) that a worker remembers.
CHUNK_BYTES, WORD_BYTES, MEMO_CELLS = 8 << 20, 64 << 10, 1_600_000
WORD = regex.compile(r"\p{L}+")
#: Sums are scaled again after so many bytes.
RESCALE = 16


class Pieces:
    """The letter pieces of a public vocabulary of byte-level ranks, in lower case and without a leading space; and all bytes."""

    def __init__(self, path: str):
        found = {bytes([b]) for b in range(256)}
        for line in open(path, "rb"):
            raw = base64.b64decode(line.split()[0])
            try:
                text = raw.decode()
            except UnicodeDecodeError:
                continue
            text = text.removeprefix(" ").lower()
            if text.isalpha():
                found.add(text.encode())
        by_size = sorted(found, key=lambda p: (len(p), p))
        self.n, self.longest = len(by_size), len(by_size[-1])
        #: A piece as a number, by a polynomial over its bytes; sorted, with the piece's index.
        codes = np.array([self.code(p) for p in by_size], np.uint64)
        order = np.argsort(codes)
        self.codes, self.index = codes[order], order.astype(np.int64)
        if (self.codes[1:] == self.codes[:-1]).any():
            raise ValueError("two pieces of the vocabulary have one code")

    @staticmethod
    def code(p: bytes) -> int:
        value = 0
        for b in p:
            value = (value * 0x9E3779B97F4A7C15 + b + 1) % 2**64
        return value

    def spans(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(size, word, begin, end, piece): every place at which a piece stands in a word, of any length."""
        size = np.array([len(w) for w in words], np.int64)
        n = int(size.sum())
        raw = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64) + np.uint64(1)
        own = np.repeat(np.arange(len(words)), size)
        at = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
        left = size[own] - at  # bytes up to the word's end
        value, place, out = np.zeros(n, np.uint64), np.arange(n), []
        for length in range(1, self.longest + 1):
            fit = left[place] >= length
            place, value = place[fit], value[fit]
            if not len(place):
                break
            value = value * np.uint64(0x9E3779B97F4A7C15) + raw[place + length - 1]
            k = np.minimum(np.searchsorted(self.codes, value), self.n - 1)
            good = np.flatnonzero(self.codes[k] == value)
            hit = place[good]
            out.append((own[hit], at[hit], at[hit] + length, self.index[k[good]]))
        word, begin, end, piece = (np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64) for c in range(4))
        return size, word, begin, end, piece


_loaded: dict[str, Pieces] = {}


def vocabulary(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def sweep(size: np.ndarray, word: np.ndarray, begin: np.ndarray, end: np.ndarray, piece: np.ndarray, prob: np.ndarray, longest: int, every: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """The forward algorithm: log of the probability, summed over all segmentations, of each word in each language.

    Words come sorted by size, longest first, so step i works on a prefix of them; every byte is a piece, so each of
    them has a piece that ends there.  Only the last `longest` columns are held, and scaled every RESCALE steps, so
    a word may have any length.  With every, also the log sums of all prefixes: row (first of word) + bytes.
    """
    order = np.lexsort((word, end))
    word, begin, end, piece = word[order], begin[order], end[order], piece[order]
    steps = int(size[0]) if len(size) else 0
    cuts = np.searchsorted(end, np.arange(1, steps + 2))
    ring = longest + 1
    alpha = np.zeros((ring, len(size), prob.shape[1]))
    alpha[0] = 1
    scale = np.zeros((len(size), prob.shape[1]))
    final = np.zeros((len(size), prob.shape[1]))
    first = np.cumsum(size + 1) - size - 1
    prefixes = np.zeros((int((size + 1).sum()), prob.shape[1])) if every else None
    active = np.searchsorted(-size, -np.arange(steps + 2), "right")  # words of i bytes or more
    for i in range(1, steps + 1):
        some = slice(cuts[i - 1], cuts[i])
        w = word[some]
        value = alpha[begin[some] % ring, w] * prob[piece[some]]
        k = int(active[i])
        now = alpha[i % ring]
        now[:k] = np.add.reduceat(value, np.flatnonzero(np.diff(w, prepend=-1)), axis=0)
        if i % RESCALE == 0:
            most = alpha[:, :k].max(0)
            alpha[:, :k] /= most
            scale[:k] += np.log(most)
        ends = slice(int(active[i + 1]), k)
        final[ends] = np.log(now[ends]) + scale[ends]
        if every:
            prefixes[first[:k] + i] = np.log(now[:k]) + scale[:k]
    return final, prefixes


def _batches(words: list[bytes]) -> Iterator[np.ndarray]:
    """Places of the words, longest first, in batches of at most WORD_BYTES or one word."""
    order = np.argsort([-len(w) for w in words], kind="stable")
    done = np.concatenate([[0], np.cumsum([len(words[k]) for k in order.tolist()])])
    at = 0
    while at < len(order):
        stop = max(at + 1, int(np.searchsorted(done, done[at] + WORD_BYTES, "right")) - 1)
        yield order[at:stop]
        at = stop


def word_log_probabilities(vocab: Pieces, words: list[bytes], prob: np.ndarray) -> np.ndarray:
    """log P(word | language) of each word, all segmentations of the whole word summed."""
    out = np.zeros((len(words), prob.shape[1]))
    for some in _batches(words):
        out[some] = sweep(*vocab.spans([words[k] for k in some.tolist()]), prob, vocab.longest)[0]
    return out


def expected_counts(vocab: Pieces, words: list[bytes], counts: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """How often each piece is used, over all segmentations of the words by their probability under one language."""
    out = np.zeros(vocab.n)
    p = prob[:, None]
    for some in _batches(words):
        size, word, begin, end, piece = vocab.spans([words[k] for k in some.tolist()])
        total, before = sweep(size, word, begin, end, piece, p, vocab.longest, True)
        _, after = sweep(size, word, size[word] - end, size[word] - begin, piece, p, vocab.longest, True)
        first = np.cumsum(size + 1) - size - 1
        use = before[first[word] + begin, 0] + np.log(prob[piece]) + after[first[word] + size[word] - end, 0] - total[word, 0]
        out += np.bincount(piece, np.asarray(counts)[some][word] * np.exp(use), vocab.n)
    return out


@dataclass
class Model:
    vocabulary: str
    languages: list[str]
    prob: np.ndarray  # pieces by languages


def fit_one(path: str, words: list[bytes], seen: np.ndarray) -> np.ndarray:
    """Expectation maximisation from uniform piece probabilities, for one language."""
    vocab = vocabulary(path)
    prob = np.full(vocab.n, 1 / vocab.n)
    for _ in range(ROUNDS):
        got = expected_counts(vocab, words, seen, prob) + PRIOR
        prob = got / got.sum()
    return prob


def split(text: str) -> list[str]:
    return WORD.findall(text.lower())


def train(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Piece probabilities from the texts of at most SAMPLE_DOCUMENTS documents of each language outside the held-out fold.

    Those with the least digest of doc_id are taken, of every language there is; all their words count.  A
    language is fitted in one task from the words of its sample, and its probabilities reach the driver.  Sample ids
    are counted, and broadcast up to BROADCAST_IDS.
    """
    usable = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang")).where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", 4) != 2))
    picked = usable.withColumn("_salt", F.pmod(F.xxhash64("lang", "doc_id"), F.lit(SALTS)))
    for group in (["lang", "_salt"], ["lang"]):  # the first of each part of a language, then of all: no task gets a language whole
        nth = F.row_number().over(Window.partitionBy(*group).orderBy(F.xxhash64("doc_id"), "doc_id"))
        picked = picked.withColumn("_n", nth).where(F.col("_n") <= SAMPLE_DOCUMENTS)
    picked = materialise(picked.select("doc_id", "lang").distinct(), "sample")
    small = picked.count() <= BROADCAST_IDS
    body = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    sample = body.join(F.broadcast(picked) if small else picked, "doc_id").select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple[str, str], int] = {}
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in split(body):
                    counts[name, w] = counts.get((name, w), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])

    def fitted(key, group):
        prob = fit_one(path, [w.encode("utf-8", "replace") for w in group.column("word").to_pylist()], group.column("n").to_numpy())
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "prob": pa.array([prob], pa.list_(pa.float64()))})

    words = sample.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    found = words.groupBy("lang").applyInArrow(fitted, "lang string, prob array<double>").toArrow().sort_by("lang")
    discard(picked)
    columns = [np.asarray(x.values, np.float64) for x in found.column("prob")]
    return Model(path, found.column("lang").to_pylist(), np.stack(columns, 1) if columns else np.zeros((vocabulary(path).n, 0)))


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one per row of docs.

    The language with the greatest likelihood of all words of the whole text, ties to the first name; score is its
    share of the likelihoods, tempered to the root of the number of words.  `und` with score 0 for a null text, one
    without a letter, or a model without languages.  Null ids and repeated rows are kept; an empty table gives no
    rows.  The broadcast is the model: a column of piece probabilities for each language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        vocab, none = vocabulary(m.vocabulary), "und"
        known: dict[str, int] = {}
        table = np.zeros((0, len(m.languages)))
        for batch in batches:
            _, off = texts(batch.column(1))
            for i, j in pieces(off, CHUNK_BYTES):
                split_texts = [split(x) for x in batch.column(1).slice(i, j - i).fill_null("").to_pylist()]
                all_words = {w for s in split_texts for w in s}
                new = [w for w in all_words if w not in known]
                if (len(known) + len(new)) * max(1, len(m.languages)) > MEMO_CELLS:
                    known, table, new = {}, table[:0], list(all_words)
                known.update(zip(new, range(len(table), len(table) + len(new)), strict=True))
                table = np.concatenate([table, word_log_probabilities(vocab, [w.encode("utf-8", "replace") for w in new], m.prob)])
                preds, scores = [], []
                for s in split_texts:
                    if not s or not m.languages:
                        preds.append(none)
                        scores.append(0.0)
                        continue
                    total = table[[known[w] for w in s]].sum(0)
                    best = int(total.argmax())
                    share = np.exp((total - total[best]) / np.sqrt(len(s)))
                    preds.append(m.languages[best])
                    scores.append(float(1 / share.sum()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    found = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op6_marginal_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned outside the held-out fold."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return predict(docs.select("doc_id", "text"), train(docs, public_tokenizers.path(VOCABULARY)))
