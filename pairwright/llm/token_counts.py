"""Operator 7, token counts through a cache keyed by digests of content and tokenizer version."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import materialise, new_path, pieces, read, texts

#: Bytes of text counted at a time, and characters of words that a worker remembers.
CHUNK_BYTES, MEMO_CHARS = 2 << 20, 2_000_000
CACHE = "content_digest binary, tokenizer_digest string, n_tokens long"
_BLANKS = r"[ \t\n\x0B\f\r]+"


def spec_of(path: str) -> dict:
    return json.load(open(path, encoding="utf-8")) if path.endswith(".json") else {}


def _steps(node: dict | None, inner: str) -> list[dict]:
    return [] if not node else node.get(inner, [node])


def blank_runs_vanish(spec: dict) -> bool:
    """Whether a tokenizer file says that white space only separates: runs of it become one space, which no piece holds."""
    normal, pre = _steps(spec.get("normalizer"), "normalizers"), _steps(spec.get("pre_tokenizer"), "pretokenizers")
    one_space = any(n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"} and n["content"] == " " for n in normal)
    known = all(n["type"] in ("NFC", "Replace", "Lowercase") for n in normal) and sum(n["type"] == "Replace" for n in normal) == 1
    dropped = bool(pre) and pre[0]["type"] == "Split" and pre[0]["invert"] and pre[0]["behavior"] == "Removed" and not regex.compile(pre[0]["pattern"]["Regex"]).search(" ")
    plain = not any(c.isspace() for x in spec.get("added_tokens", ()) for c in x["content"])
    return one_space and known and dropped and plain


class WordCounter:
    """Tokens of texts by a `tokenizers` file whose pre-tokenizer isolates words: the library counts each distinct word once.

    Valid for files that normalise, then split by a pattern and model every piece by itself (no token spans two
    pieces); others raise ValueError.
    """

    def __init__(self, path: str):
        spec = spec_of(path)
        steps = _steps(spec.get("pre_tokenizer"), "pretokenizers")
        if not blank_runs_vanish(spec) or steps[1:] and (steps[1]["type"] != "ByteLevel" or steps[1]["use_regex"] or steps[1]["add_prefix_space"]) or steps[2:]:
            raise ValueError("the pre-tokenizer doesn't isolate words by a pattern")
        self.tokenizer = library(path)
        self.lowers = any(n["type"] == "Lowercase" for n in _steps(spec["normalizer"], "normalizers"))
        self.pattern = regex.compile(steps[0]["pattern"]["Regex"])
        self.added = [x["content"] for x in spec["added_tokens"]]
        self.split = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.memo: dict[str, int] = {}
        self.held = 0

    def words(self, text: str) -> list[str]:
        if text.isascii():
            return self.pattern.findall(text.lower() if self.lowers else text)
        return self.pattern.findall(self.tokenizer.normalizer.normalize_str(text))

    def counts(self, batch: list[str]) -> list[int]:
        split, out = [], []
        for text in batch:
            if any(x in text for x in self.added):
                parts = self.split.split(text)
                split.append((sum(x in self.added for x in parts), [w for x in parts if x not in self.added for w in self.words(x)]))
            else:
                split.append((0, self.words(text)))
        every = {w for _, words in split for w in words}
        new = every - self.memo.keys()
        if self.held + sum(map(len, new)) > MEMO_CHARS:
            self.memo, self.held, new = {}, 0, every
        fresh = list(new)
        for at in range(0, len(fresh), 1000):
            some = fresh[at : at + 1000]
            for w, e in zip(some, self.tokenizer.encode_batch(some, add_special_tokens=False), strict=True):
                self.memo[w] = len(e.ids)
                self.held += len(w)
        known = self.memo.__getitem__
        for n, words in split:
            out.append(n + sum(map(known, words)))
        return out


class TextCounter:
    """Tokens of whole texts by the library of a file: `tokenizers` for .json, `sentencepiece` for .model."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.one = lambda t: len(model.encode(t, num_threads=1))
        else:
            tokenizer = library(path)
            self.one = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)

    def counts(self, batch: list[str]) -> list[int]:
        return [self.one(t) for t in batch]


def library(path: str) -> Tokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the threads
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


_loaded: dict[str, WordCounter | TextCounter] = {}


def counter(path: str) -> WordCounter | TextCounter:
    if path not in _loaded:
        try:
            _loaded[path] = WordCounter(path) if path.endswith(".json") else TextCounter(path)
        except ValueError:
            _loaded[path] = TextCounter(path)
    return _loaded[path]


def version(path: str) -> str:
    """The digest of a tokenizer: its file and the rules by which it is used here."""
    return hashlib.sha256(open(path, "rb").read() + b"|no added specials|no truncation|3").hexdigest()


def content(text: Column, blanks: bool) -> Column:
    """Content that is the same for counting: a null is an empty text; with blanks, white space runs of ASCII are one space, trimmed."""
    text = F.coalesce(text, F.lit(""))
    return F.trim(F.regexp_replace(text, _BLANKS, " ")) if blanks else text


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit), one per row of docs.

    The cache is a table of CACHE rows at cache_path, made if it is missing.  First every row's digest, size and
    row hash are written, without its text.  Each digest is given one row, by the least hash (fixed-width values,
    met before the shuffle in each task); digests that the cache has go, and the rows that are left fetch their
    texts by a join on the row hash, are encoded and appended.  No copy's text stays behind that join, and no
    aggregate holds a text.  Counts meet the rows by digest, two plain tables, so a digest that a third of all rows
    share is split.  A failed run leaves whole files or none, and a digest that two runs append has the same count
    twice, which the join collapses.  White space runs count as one space only where the tokenizer's file says so.
    A null text has 0 bytes and 0 tokens; null doc_ids and repeated rows are kept; an empty table gives no rows.
    """
    spark = docs.sparkSession
    tag = version(tokenizer_path)
    blanks = blank_runs_vanish(spec_of(tokenizer_path))
    path = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        spark.createDataFrame([], CACHE).write.mode("append").parquet(cache_path)
    stored = lambda: spark.read.schema(CACHE).parquet(cache_path).where(F.col("tokenizer_digest") == tag).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    bare = F.coalesce(F.col(text), F.lit(""))
    row, check = F.xxhash64(F.col(doc_id), bare).alias("row"), F.crc32(bare.cast("binary")).alias("check")
    keys = materialise(docs.select(F.col(doc_id).alias("doc_id"), F.octet_length(bare).cast("long").alias("n_bytes"), F.unhex(F.sha2(content(F.col(text), blanks).cast("binary"), 256)).alias("content_digest"), row, check), "digests")
    first = keys.groupBy("content_digest").agg(F.min("row").alias("row"), F.min_by("check", "row").alias("check"))
    misses = first.join(stored(), "content_digest", "left_anti")
    chosen = docs.select(bare.alias("text"), row, check).join(misses.hint("shuffle_hash"), ["row", "check"]).select("content_digest", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path).counts
        done: set[bytes] = set()  # repeated rows of this task
        for batch in batches:
            new = []
            for d in batch.column(0).to_pylist():
                new.append(d not in done)
                done.add(d)
            batch = batch.filter(pa.array(new, pa.bool_()))
            for i, j in pieces(texts(batch.column(1))[1], CHUNK_BYTES):
                part = batch.slice(i, j - i)
                n = count(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([tag] * len(n), pa.string()), pa.array(n, pa.int64())], names=["content_digest", "tokenizer_digest", "n_tokens"])

    chosen.mapInArrow(run, CACHE).write.mode("append").parquet(cache_path)
    known = materialise(keys.select("content_digest").distinct().join(stored(), "content_digest"), "counts")
    return keys.join(known, "content_digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


VOCABULARY = "word_bpe_49k.json"


def op7_digest_cache_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, over a cache that starts empty with every call."""
    return count_tokens(read(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path(VOCABULARY), new_path(spark, "token-cache"))
