"""Operator 4, byte-pair encoding and decoding with a pair occurrence index."""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import pieces, read, texts

#: Bytes of text encoded at a time, and words that a worker remembers.
CHUNK_BYTES, MEMO_WORDS = 4 << 20, 150_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBPE:
    """A byte-level tokenizer file: its merges by pair, its tokens as bytes, its added tokens."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, alphabet = spec["model"], byte_alphabet()
        pre = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or model["type"] != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space") or model.get("ignore_merges"):
            raise ValueError(f"{path} isn't a byte-level tokenizer that splits by the usual pattern and normalises nothing")
        vocab = model["vocab"]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.size = 1 + max([*vocab.values(), *self.added.values()])
        self.token = [b""] * self.size
        for text, i in vocab.items():
            self.token[i] = bytes(alphabet[c] for c in text)
        for text, i in self.added.items():
            self.token[i] = text.encode()
        self.byte_id = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.byte_id[b] = vocab[c]
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = self.left * self.size + self.right
        self.rank_of = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank_of]
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.words = regex.compile(public_tokenizers.PATTERN)
        self.memo: dict[str, tuple[str, int, bytes]] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, or -1."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.rank_of[at], -1)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word.

        All words lie in one array of symbols.  The index maps each rank to the places where its pair begins;
        ranks are taken in ascending order, applied at all their places at once, and the pairs that come up left
        and right of a merged place join the lists of their own ranks.  Words don't affect each other, so this is
        the order in which each word by itself would apply its merges.
        """
        size = np.array([len(w) for w in words], np.int64)
        bounds = np.concatenate([[0], np.cumsum(size)])
        n = int(bounds[-1])
        symbol = np.full(n + 1, -1, np.int64)
        symbol[:n] = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[bounds[1:][size > 0] - 1] = n
        before[bounds[:-1][size > 0]] = n
        before[n] = after[n] = n
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(places: np.ndarray) -> None:
            rank = self.ranks(symbol[places], symbol[after[places]])
            places, rank = places[rank >= 0], rank[rank >= 0]
            if not len(rank):
                return
            order = np.argsort(rank, kind="stable")
            places, rank = places[order], rank[order]
            begins = np.flatnonzero(np.diff(rank, prepend=-1))
            for r, own in zip(rank[begins].tolist(), np.split(places, begins[1:]), strict=True):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(own)

        enter(np.arange(n))
        while active:
            r = heapq.heappop(active)
            places = index.pop(r)
            p = np.unique(np.concatenate(places)) if len(places) > 1 else np.sort(places[0])
            a, b = self.left[r], self.right[r]
            p = p[(symbol[p] == a) & (symbol[after[p]] == b)]
            if a == b and len(p) > 1:  # in a run of equal symbols every other place, from its left end
                begins = np.concatenate([[True], after[p[:-1]] != p[1:]])
                place = np.arange(len(p))
                p = p[(place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0]
            if not len(p):
                continue
            q = after[p]
            s = after[q]
            symbol[p], symbol[q] = self.made[r], -2
            after[p], before[s] = s, p
            left = before[p]
            enter(np.unique(np.concatenate([left[left < n], p[s < n]])))
        kept = symbol[:n] >= 0
        ends = np.concatenate([[0], np.cumsum(kept)])[bounds]
        return np.split(symbol[:n][kept], ends[1:-1]) if len(words) else []

    def learn(self, words: set[str]) -> None:
        """Encodes words that the memo lacks."""
        new = [w for w in words if w not in self.memo]
        if len(self.memo) + len(new) > MEMO_WORDS:
            self.memo.clear()
            new = list(words)
        token = self.token
        for word, ids in zip(new, self.encode_words([w.encode("utf-8", "surrogatepass") for w in new]), strict=True):
            ids = ids.tolist()
            self.memo[word] = (",".join(map(str, ids)), len(ids), b"".join([token[i] for i in ids]))

    def parts(self, text: str) -> list[tuple[str, list[str]]]:
        """A text as pieces between added tokens: (added token or "", words)."""
        if self.split is None or not any(x in text for x in self.added):
            return [("", self.words.findall(text))]
        return [(x, []) if x in self.added else ("", self.words.findall(x)) for x in self.split.split(text) if x]

    def encode_texts(self, batch: list[str]) -> Iterator[tuple[str, int, str]]:
        """(ids as decimals joined by commas, their number, the text decoded from the ids) of each text."""
        split = [self.parts(t) for t in batch]
        self.learn({w for parts in split for _, words in parts for w in words})
        memo = self.memo
        for parts in split:
            ids, n, raw = [], 0, []
            for added, words in parts:
                if added:
                    ids.append(str(self.added[added]))
                    raw.append(self.token[self.added[added]])
                    n += 1
                for w in words:
                    x = memo[w]
                    ids.append(x[0])
                    n += x[1]
                    raw.append(x[2])
            yield ",".join(ids), n, b"".join(raw).decode("utf-8", "replace")


_loaded: dict[str, ByteBPE] = {}


def tokenizer(path: str) -> ByteBPE:
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, vocabulary: str, digests: bool = False, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows (doc_id, n_tokens, ids, decoded), one per row of docs; ids are decimals joined by commas.

    With digests, ids and decoded are replaced by ids_sha256 and decoded_sha256.  A null text is an empty one: no
    ids, and the empty text decoded.  A null doc_id stays null; repeated rows give repeated rows; an empty table
    gives none.  Names of added tokens inside a text become those tokens, as the library does by default.  `keep`
    names columns of docs to carry along.  Texts are taken whole; a batch is encoded in chunks of CHUNK_BYTES.
    """
    out = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")] if digests else [("n_tokens", "long"), ("ids", "string"), ("decoded", "string")]
    keep = [doc_id] if keep is None else keep
    carried = docs.select(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(keep)], docs[f"`{text}`"].alias("_text"))
    schema = ", ".join([f"c{i} {carried.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(keep))] + [f"`_{n}` {t}" for n, t in out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(vocabulary)
        for batch in batches:
            _, off = texts(batch.column(len(keep)))
            for i, j in pieces(off, CHUNK_BYTES):
                part = batch.slice(i, j - i)
                ids, counts, back = [], [], []
                for x, n, y in coder.encode_texts(part.column(len(keep)).fill_null("").to_pylist()):
                    ids.append(hashlib.sha256(x.encode()).hexdigest() if digests else x)
                    counts.append(n)
                    back.append(hashlib.sha256(y.encode()).hexdigest() if digests else y)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=[*(f"c{k}" for k in range(len(keep))), *(f"_{n}" for n, _ in out)])

    return carried.mapInArrow(run, schema).toDF(*keep, *(n for n, _ in out))


VOCABULARY = "byte_bpe_50k.json"


def op4_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text of every document."""
    return encode_documents(read(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path(VOCABULARY), digests=True)
