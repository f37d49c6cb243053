"""Operator 3, benchmark decontamination by pigeonhole pieces and bit-parallel edit distance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, read, texts

CHUNK_BYTES = 8 << 20
_RUN = regex.compile(r"[^\p{L}\p{N}]+")


@dataclass(frozen=True)
class Budget:
    """Errors allowed: a share of an item's normalised length.  Items shorter than min_chars allow none, and count
    only between blanks or the ends of a text, for parts of words would hold them by chance.
    block_chars: how much benchmark text goes to the executors at once; more is done in several passes over the documents."""

    error_share: float = 0.06
    min_chars: int = 24
    block_chars: int = 4_000_000

    def of(self, length: int) -> int:
        return int(length * self.error_share) if length >= self.min_chars else 0


def normalise(text: str) -> str:
    """Lower case, every run of other characters than letters and digits as one space, trimmed."""
    return _RUN.sub(" ", text.lower()).strip()


def semi_global(pattern: str, text: str, most: int) -> tuple[int, int]:
    """(distance, end) of the best approximate occurrence of pattern anywhere in text, by Myers' bit-parallel columns.

    The distance is the least number of single-character insertions, deletions and substitutions that turn some
    substring of text into pattern; (most + 1, -1) if it is above `most`.  The bits are one Python integer of as
    many bits as the pattern has characters.
    """
    m = len(pattern)
    if m == 0:
        return 0, 0
    mask, high = (1 << m) - 1, 1 << (m - 1)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | (1 << i)
    vp, vn, score = mask, 0, m
    best, end = (m, 0) if m <= most else (most + 1, -1)
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | vn
        xh = (((eq & vp) + vp) ^ vp) | eq
        hp = vn | (~(xh | vp) & mask)
        hn = vp & xh
        if hp & high:
            score += 1
        elif hn & high:
            score -= 1
        hp = (hp << 1) & mask
        hn = (hn << 1) & mask
        vp = hn | (~(xv | hp) & mask)
        vn = hp & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def cut(text: str, budget: int) -> list[tuple[int, str]]:
    """A text in budget + 1 pieces of nearly equal length, with their places: so many errors leave one piece intact."""
    n, k = len(text), budget + 1
    edges = [n * i // k for i in range(k + 1)]
    return [(a, text[a:b]) for a, b in zip(edges, edges[1:], strict=False) if b > a]


class Matcher:
    """Pieces of the items of one block in an Aho-Corasick automaton."""

    def __init__(self, items: list[tuple[int, str]], budget: Budget):
        self.items, self.budget = [(i, t if len(t) >= budget.min_chars else f" {t} ") for i, t in items], budget
        where: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text) in enumerate(self.items):
            for at, piece in cut(text, self.errors(text)):
                where.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()
        self.empty = not where

    def errors(self, text: str) -> int:
        return 0 if text[0] == " " else self.budget.of(len(text))

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item_id, distance, end in the normalised text) of each item that occurs within its budget, best occurrence.

        A piece that starts at offset a of its item and hits at p puts the item's occurrence within
        [p - a - budget, p - a + length + budget]; windows of one item that overlap are verified as one.
        """
        if self.empty:
            return []
        text = f" {text} "
        spans: dict[int, list[tuple[int, int]]] = {}
        for stop, (size, places) in self.automaton.iter(text):
            begin = stop + 1 - size
            for k, at in places:
                n = len(self.items[k][1])
                e = self.errors(self.items[k][1])
                lo, hi = max(0, begin - at - e), min(len(text), begin - at + n + e)
                known = spans.setdefault(k, [])
                if known and known[-1][0] <= lo <= known[-1][1]:
                    known[-1] = (known[-1][0], max(hi, known[-1][1]))
                else:
                    known.append((lo, hi))
        out = []
        for k, windows in spans.items():
            item_id, pattern = self.items[k]
            most = self.errors(pattern)
            best = (most + 1, -1)
            for lo, hi in windows:
                at = text.find(pattern, lo, hi)
                d, end = (0, at - lo + len(pattern)) if at >= 0 else semi_global(pattern, text[lo:hi], most)
                if d < best[0]:
                    best = (d, lo + end)
            if best[0] <= most:
                out.append((item_id, best[0], best[1] - 1 - (pattern[0] == " ")))
        return out


def blocks(benchmark: DataFrame, budget: Budget, item_id: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The distinct normalised items in blocks of bounded size, streamed through the driver a block at a time."""
    bare = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).where(F.col("i").isNotNull() & F.col("t").isNotNull())
    block, size, seen = [], 0, set()
    for row in bare.orderBy("i", "t").toLocalIterator():
        t = normalise(row.t)
        if not t or (row.i, t) in seen:
            continue
        if block and size + len(t) > budget.block_chars:
            yield block
            block, size, seen = [], 0, set()
        seen.add((row.i, t))
        block.append((row.i, t))
        size += len(t)
    if block:
        yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, budget: Budget = Budget(), doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with _hits: array of struct(item_id long, distance int, end long), sorted, one for each item that occurs in the text.

    An item occurs if some stretch of the normalised text (see normalise) is at most error_share of the item's
    length away from it in edits; an item of under min_chars characters, if it stands there as whole words.  A null or empty text has no hits; null item ids or texts are left out, repeated
    items count once; other columns of docs are carried as they are, under any name.  Items come in blocks of
    block_chars; each block is one narrow pass over the documents, so what is broadcast has a fixed bound.
    """
    names = docs.columns
    kind = "array<struct<item_id:bigint,distance:int,end:bigint>>"
    at = names.index(text)
    plain = docs.toDF(*(f"c{i}" for i in range(len(names)))).withColumn("_hits", F.array().cast(kind))
    for block in blocks(benchmark, budget, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, budget)
            for batch in batches:
                _, off = texts(batch.column(at))
                for i, j in pieces(off, CHUNK_BYTES):
                    part = batch.slice(i, j - i)
                    found = [matcher.find(normalise(t)) for t in part.column(at).fill_null("").to_pylist()]
                    old = part.column(len(names))
                    hits = pa.array([o + [{"item_id": a, "distance": d, "end": e} for a, d, e in f] for o, f in zip(old.to_pylist(), found, strict=True)], old.type)
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], hits], schema=part.schema)

        plain = plain.mapInArrow(run, plain.schema)
    return plain.withColumn("_hits", F.array_sort("_hits")).toDF(*names, "_hits")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, budget: Budget = Budget(), text: str = "text") -> DataFrame:
    """The rows of docs in which no item occurs, with their columns."""
    names = docs.columns
    found = find_contamination(docs.toDF(*(f"d{i}" for i in range(len(names)))), benchmark, budget, text=f"d{names.index(text)}")
    return found.where(F.size("_hits") == 0).drop("_hits").toDF(*names)


def op3_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item: (doc_id, contaminated, item_ids, distances)."""
    found = find_contamination(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select("doc_id", (F.size("_hits") > 0).alias("contaminated"), F.col("_hits.item_id").alias("item_ids"), F.col("_hits.distance").alias("distances"))
