"""Operator 1, the n-gram Jaccard join: a size-aware heavy-light join on sets of word shingles."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialise, mix, pieces, read, texts, word_hashes

CHUNK_BYTES = 2 << 20
#: Cells of the frequency sketch (a power of 2): its size, and so that of the broadcast, is fixed.
CELLS = 1 << 20
#: Members of a bucket block that one task compares with another block, and bytes of sketches that it compares at a time.
BLOCK, COMPARE_BYTES = 2048, 4 << 20
#: Pairs that a task remembers, so as to send each once however many buckets they share.
SEEN_PAIRS = 200_000
#: First open keys of its set that a row has with it, by which a pair is left to the first bucket it shares.
EARLY = 8


@dataclass(frozen=True)
class Join:
    """words: shingle length.  percent: sets link when 100 * intersection >= percent * union."""

    words: int = 5
    percent: int = 80

    def overlap(self, n: int) -> int:
        """The least intersection of a set of n with any set it links with: ceil(percent * n / 100)."""
        return -(-self.percent * n // 100)

    def prefix(self, n: int, subset: int) -> int:
        """How many first elements, in a global order, two linked sets share at least `subset` of."""
        return n - self.overlap(n) + subset

    def linked(self, common: int, a: int, b: int) -> bool:
        return 100 * common >= self.percent * (a + b - common)

    def difference(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The largest symmetric difference of linked sets of a and b elements."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def sketch_bits(self, n: int) -> int:
        """A power of 2 of at least 512 and eight times the allowed difference of sets of n: few sets that differ more look nearer."""
        return 1 << max(9, math.ceil(math.log2(max(1.0, 8 * 2 * n * (100 - self.percent) / (100 + self.percent)))))


# ---- shingle sets ----------------------------------------------------------------------------------------------


def shingles(words: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every shingle: `size` words, or the whole sequence of a shorter text; none of an empty one."""
    h = np.zeros(len(words), np.uint64)
    bounds = np.concatenate([[0], np.cumsum(n)])
    own = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(words)) - bounds[own]
    left = n[own] - at
    for i in range(size):
        has = left > i
        nxt = np.zeros(len(words), np.uint64)
        nxt[: len(words) - i] = words[i:]
        h = np.where(has, mix(h * np.uint64(0xD6E8FEB86659FD93) + nxt + np.uint64(i + 1)), h)
    keep = (left >= size) | (at == 0)
    return h[keep], own[keep]


def sets(column: pa.Array, join: Join) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For row ranges i to j of a text column: (i, j, hash, row - i, size of each row's set); distinct hashes of a row, in no order."""
    raw, off = texts(column)
    for i, j in pieces(off, CHUNK_BYTES):
        h, own = shingles(*word_hashes(raw, off[i : j + 1]), join.words)
        order = np.lexsort((h, own))
        h, own = h[order], own[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
        h, own = h[first], own[first]
        yield i, j, h, own, np.bincount(own, minlength=j - i)


def frequency_levels(docs: DataFrame, join: Join) -> np.ndarray:
    """A level for each sketch cell: 0 for cells of rare shingles, more with each doubling beyond.

    Every shingle of every document is counted, in the cell of its low bits; a task sends one row for each cell it
    has met.  Rare shingles fill all cells alike, up to chance: a cell that stands four standard deviations above
    the mean holds one that many documents share.  So what counts as frequent follows the root of the corpus, not
    its size, and buckets of prefixes stay that small wherever a set has rarer elements.  Any levels give right
    results, as all sets are ordered by them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        for batch in batches:
            for _, _, h, _, _ in sets(batch.column(0), join):
                cells += np.bincount((h & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        met = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(cells[met], pa.int64())], names=["cell", "n"])

    found = docs.select("text").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most CELLS rows
    cell, n = found.column("cell").to_numpy(), found.column("n").to_numpy().astype(np.float64)
    mean = n.sum() / CELLS
    excess = (n - mean) / (4 * math.sqrt(mean) + 8)
    level = np.zeros(CELLS, np.int8)
    high = excess > 1
    level[cell[high]] = 1 + np.log2(excess[high]).astype(np.int8)
    return level


SETS = "doc_id long, n int, digest long, digest2 long, sketch binary, prefix array<long>"
#: What names a set: two digests of 64 bits, and its size.
NAME = ["digest", "digest2", "n"]


def describe(docs: DataFrame, join: Join, level: np.ndarray) -> DataFrame:
    """A row of SETS for each document: size, digests, parity sketch and ordered prefix of its set."""
    shared = docs.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value
        for batch in batches:
            for i, j, h, own, size in sets(batch.column(1), join):
                order = np.lexsort((h, level[(h & np.uint64(CELLS - 1)).astype(np.int64)], own))
                ordered = h[order].view(np.int64)
                begin = np.concatenate([[0], np.cumsum(size)])
                want = np.array([min(n, join.prefix(n, 2)) for n in size.tolist()], np.int64)
                place = np.arange(len(h)) - np.repeat(begin[:-1], size)
                full = size > 0
                digests = []
                for salt in (0x1234567, 0x5DEECE66D1F3A9B7):
                    d = np.zeros(j - i, np.uint64)
                    if full.any():
                        d[full] = mix(np.add.reduceat(mix(h ^ np.uint64(salt)), begin[:-1][full]))
                    digests.append(pa.array(d.view(np.int64)))
                sketches = []
                for k, n in enumerate(size.tolist()):
                    bits = join.sketch_bits(n)
                    odd = np.bincount((h[begin[k] : begin[k + 1]] >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
                    sketches.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
                prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(want)]), pa.int32()), pa.array(ordered[place < np.repeat(want, size)]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(size, pa.int32()), *digests, pa.array(sketches, pa.binary()), prefix], names=["doc_id", "n", "digest", "digest2", "sketch", "prefix"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SETS)


# ---- candidate buckets -----------------------------------------------------------------------------------------


def boundary(distinct: DataFrame, join: Join) -> int:
    """The largest set size for which enumerating pairs of prefix elements costs less than scanning inverted lists.

    Costs are counted in entries over all sets, in classes of size (eight to a doubling): a light set writes one
    entry for each pair of its prefix of two more; a heavy set one for each element of its prefix, plus the scan of
    those elements' lists (the sum of squared lengths, by the mean size of a list's members).
    """
    cls = lambda c: F.floor(F.log2(c) * 8).cast("int")
    n = F.col("n").cast("double")
    p = n - F.ceil(n * join.percent / 100) + 1
    own = {r.k: r for r in distinct.groupBy(cls(n).alias("k")).agg(F.sum(p).alias("lists"), F.sum((p + 1) * p / 2).alias("pairs"), F.max("n").alias("most")).collect()}
    lists = distinct.select("n", F.explode(F.slice("prefix", 1, p.cast("int"))).alias("e")).groupBy("e").agg(F.count("*").alias("c"), F.avg("n").alias("m")).where(F.col("c") > 1)
    scan = {r.k: r.s for r in lists.groupBy(cls(F.col("m")).alias("k")).agg(F.sum(F.col("c") * F.col("c")).alias("s")).collect()}
    best, at, gain = 0.0, 0, 0.0
    for k in sorted(own):
        gain += own[k].lists + scan.get(k, 0) - own[k].pairs
        if gain > best:
            best, at = gain, own[k].most
    return at


def entries(distinct: DataFrame, join: Join, light: int) -> DataFrame:
    """(key, id, n): light sets under every pair of their longer prefix, heavy ones under every element of theirs.

    Sets in reach of a heavy one, or too small to share two elements for sure, also stand in the inverted lists, so
    every linked pair meets under a key.
    """
    least = -(-200 // join.percent)  # smallest size whose links share two elements
    edge = join.overlap(light + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, prefix = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            values, off = np.asarray(prefix.values), np.asarray(prefix.offsets)
            keys, own = [], []
            for k, n in enumerate(sizes):
                e = values[off[k] : off[k + 1]].view(np.uint64)
                p = join.prefix(n, 1)
                if n >= edge or n * join.percent < 100 * least:
                    keys.append(e[:p])
                    own.append(k)
                if least <= n <= light:
                    at = np.array(list(combinations(range(len(e)), 2)), np.int64).reshape(-1, 2)
                    lo, hi = np.minimum(e[at[:, 0]], e[at[:, 1]]), np.maximum(e[at[:, 0]], e[at[:, 1]])
                    keys.append(mix(lo * np.uint64(0x9E3779B97F4A7C15) + hi))
                    own.append(k)
            if keys:
                own = np.repeat(np.array(own), [len(x) for x in keys])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.array(ids, np.int64)[own]), pa.array(np.array(sizes, np.int32)[own])], names=["key", "id", "n"])

    return distinct.select(F.col("doc_id").alias("id"), "n", "prefix").mapInArrow(run, "key long, id long, n int")


def leads(keyed: DataFrame) -> DataFrame:
    """(key, first, first_n, size): a bucket's smallest id, that set's size, and the count of members, two at least.

    Of buckets with the same members, by 128 bits of digest, first and count, one stays: all of them hold the same
    pairs, and near copies share hundreds of keys.
    """
    digests = [F.bit_xor(F.xxhash64("id", "n")).alias("m"), F.bit_xor(F.xxhash64("n", "id")).alias("m2")]
    found = keyed.groupBy("key").agg(F.min("id").alias("first"), F.min_by("n", "id").alias("first_n"), F.count("*").alias("size"), *digests).where("size > 1")
    return found.groupBy("first", "first_n", "size", "m", "m2").agg(F.min("key").alias("key")).select("key", "first", "first_n", "size")


# ---- verification ----------------------------------------------------------------------------------------------


def fold(sketch: bytes, size: int) -> bytes:
    """A sketch at fewer bits: its halves added without carry."""
    while len(sketch) > size:
        half = len(sketch) // 2
        sketch = (int.from_bytes(sketch[:half], "little") ^ int.from_bytes(sketch[half:], "little")).to_bytes(half, "little")
    return sketch


def near(pairs: DataFrame, distinct: DataFrame, join: Join) -> DataFrame:
    """The pairs (a, b) whose sketches differ in no more bits than the symmetric difference of linked sets may have elements."""
    side = lambda name: distinct.select(F.col("doc_id").alias(name), F.col("n").alias(f"n{name}"), F.col("sketch").alias(f"s{name}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "na", "nb", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy().astype(np.int64)
            most = join.difference(na, nb).tolist()
            keep = []
            for x, y, d in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), most, strict=True):
                size = min(len(x), len(y))
                keep.append((int.from_bytes(fold(x, size), "little") ^ int.from_bytes(fold(y, size), "little")).bit_count() <= d)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def verify(pairs: DataFrame, docs: DataFrame, join: Join) -> DataFrame:
    """The pairs (a, b) that link, by the sets of their whole texts.

    The partners of an a go to one of several salts, four for each shuffle partition, so that those of an a which
    meets a third of all rows are a quarter of a partition each; its text goes once to each salt that has one.
    """
    salts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(salts)).cast("int").alias("salt"))
    body = lambda name: docs.select(F.col("doc_id").cast("long").alias(name), F.coalesce("text", F.lit("")).alias("text"))
    firsts = salted.select("a", "salt").distinct().join(body("a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    others = salted.join(body("b"), "b").select("a", "salt", "b", "text")
    both = firsts.unionByName(others).repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.zeros(0, np.uint64)
        for batch in batches:
            a, b, keep = batch.column(0).to_pylist(), batch.column(2).to_pylist(), []
            for i, _, h, _, size in sets(batch.column(3), join):
                for k, mine in enumerate(np.split(h, np.cumsum(size)[:-1])):
                    if b[i + k] is None:
                        base = mine
                        continue
                    at = np.minimum(np.searchsorted(base, mine), max(0, len(base) - 1))
                    common = int((base[at] == mine).sum()) if len(base) else 0
                    if common and join.linked(common, len(base), len(mine)):
                        keep.append(i + k)
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in keep], pa.int64()), pa.array([b[k] for k in keep], pa.int64())], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long").distinct()


# ---- components ------------------------------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each linked id reaches.

    Alternating large-star and small-star steps, each a min by node and a join; every round is written to the
    shared folder.  Ends when a round changes nothing; the number of rounds grows with the log of the longest path.
    """
    spark = links.sparkSession
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    shuffle = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    state = shuffle(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("x"), "m", "u")
        old, edges = edges, materialise(small.select(F.col("x").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u > v").distinct(), "edges")
        discard(old)
        if (now := shuffle(edges)) == state:
            break
        state = now
    found = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    return found.union(found.select(F.col("component").alias("id"), "component").distinct()) if state[0] else spark.createDataFrame([], "id long, component long")


# ---- the join --------------------------------------------------------------------------------------------------


def across(members: DataFrame, labels: DataFrame, distinct: DataFrame, join: Join, nearest: bool) -> DataFrame:
    """Pairs (a, b) of different components that share a key and pass the sketches: all of them, each bucket compared whole.

    With nearest, only the one with the nearest sketch for each set: as many rows as members, which join most of what
    there is to join before all pairs between the components that are left are looked at.

    A bucket of more than BLOCK members is split in blocks and each two blocks meet in a task, so no task holds a
    bucket; buckets within one component are done.

    Near copies share many buckets, in as many tasks.  Each row has the EARLY smallest open keys of its set, and a
    bucket leaves a pair to an earlier one that both rows name.  The first bucket that a pair shares never leaves it,
    so none is lost; a pair that neither names in common is sent by each task that meets it.
    """
    named = members.join(labels, "id", "left").select("key", "id", "n", "size", F.coalesce("component", "id").alias("component"))
    mixed = materialise(named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key"), "mixed")  # a plain table, so that the join with it can split a hot key
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("id"), blocks).cast("int")
    open_ = named.join(mixed, "key").join(distinct.select(F.col("doc_id").alias("id"), "sketch"), "id")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.col("key").bitwiseXOR(F.lit(-(1 << 63)))))  # unsigned, as in prefixes
    open_ = open_.withColumn("place", place).withColumn("early", F.collect_list(F.when(F.col("place") <= EARLY, F.col("key"))).over(Window.partitionBy("id")))
    dealt = open_.select("key", "id", "n", "component", "sketch", "early", mine.alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "n", "id", "component", "sketch", "early")
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "n", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = None, set()

        def fresh(found: pa.RecordBatch) -> pa.RecordBatch:
            if len(seen) > SEEN_PAIRS:
                seen.clear()
            new = []
            for pair in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True):
                new.append(pair not in seen)
                seen.add(pair)
            return found.filter(pa.array(new, pa.bool_()))

        for batch in batches:
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            marks = np.stack([t.column(c).to_numpy() for c in ("key", "i", "j")])
            change = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0))
            last = int(change[-1]) + 1 if len(change) else 0  # the last bucket may go on in the next batch
            held = t.slice(last).combine_chunks()
            if last:
                yield from map(fresh, compare(t.slice(0, last).combine_chunks(), join, nearest))
        if held is not None and held.num_rows:
            yield from map(fresh, compare(held, join, nearest))

    return dealt.mapInArrow(run, "a long, b long").distinct()


class Sketches:
    """The sketches of many rows as matrices of words, one for each size; folded to smaller sizes on demand."""

    def __init__(self, column: pa.Array):
        values = column.to_pylist()
        self.size = np.array([len(x) for x in values], np.int64)
        self.place = np.zeros(len(values), np.int64)
        self.held: dict[tuple[int, int], np.ndarray] = {}
        for s in np.unique(self.size).tolist():
            at = np.flatnonzero(self.size == s)
            self.place[at] = np.arange(len(at))
            self.held[s, s] = np.frombuffer(b"".join(values[k] for k in at.tolist()), np.uint64).reshape(len(at), s // 8)

    def folded(self, size: int, to: int) -> np.ndarray:
        """The sketches of one size at fewer bits: halves added without carry."""
        if (size, to) not in self.held:
            wide = self.folded(size, 2 * to)
            half = wide.shape[1] // 2
            self.held[size, to] = wide[:, :half] ^ wide[:, half:]
        return self.held[size, to]

    def difference(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """In how many bits the sketches of rows a and b differ, at the size of the smaller one."""
        out = np.zeros(len(a), np.int64)
        x, y = self.size[a], self.size[b]
        for one, two in set(zip(x.tolist(), y.tolist(), strict=True)):
            to = min(one, two)
            m, n = self.folded(one, to), self.folded(two, to)
            at = np.flatnonzero((x == one) & (y == two))
            step = max(1, COMPARE_BYTES // to)
            for k in range(0, len(at), step):
                some = at[k : k + step]
                out[some] = np.bitwise_count(m[self.place[a[some]]] ^ n[self.place[b[some]]]).sum(1, dtype=np.int64)
        return out


def first_keys(column: pa.Array) -> np.ndarray:
    """Lists of at most EARLY keys, unsigned, as rows of a matrix; the rest holds the largest number, which is below no key."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values, off = np.asarray(column.values).view(np.uint64), np.asarray(column.offsets).astype(np.int64)
    out = np.full((len(column), EARLY), np.iinfo(np.uint64).max, np.uint64)
    own = np.repeat(np.arange(len(column)), np.diff(off))
    out[own, np.arange(off[0], off[-1]) - off[own]] = values[off[0] : off[-1]]
    return out


def compare(t: pa.Table, join: Join, nearest: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of the rows of whole buckets, sorted by (key, i, j, n): see across()."""
    column = lambda name: t.column(name).to_numpy().astype(np.int64)
    key, i, j, block, n, ids, comp = map(column, ("key", "i", "j", "block", "n", "id", "component"))
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
    place = np.cumsum(new) << 32
    last = np.searchsorted(place + n, place + n * 100 // join.percent, "right")  # sets that are not too large to link
    count = np.maximum(last - np.arange(len(n)) - 1, 0)
    done = np.concatenate([[0], np.cumsum(count)])
    sketches, early, at = Sketches(t.column("sketch")), first_keys(t.column("early")), 0
    while at < len(n):
        stop = max(at + 1, int(np.searchsorted(done, done[at] + (1 << 18), "right")) - 1)
        left = np.repeat(np.arange(at, stop), count[at:stop])
        right = left + 1 + np.arange(len(left)) - np.repeat(done[at:stop] - done[at], count[at:stop])
        fit = (comp[left] != comp[right]) & ((i[left] == j[left]) | (block[left] != block[right]))
        left, right = left[fit], right[fit]
        bits = sketches.difference(left, right)
        near_enough = bits <= join.difference(n[left], n[right])
        left, right, bits = left[near_enough], right[near_enough], bits[near_enough]
        elsewhere = np.zeros(len(left), bool)
        for k in range(EARLY):  # a key that both have, before this one
            mark = early[left, k]
            elsewhere |= (mark < key[left].view(np.uint64)) & (early[right] == mark[:, None]).any(1)
        left, right, bits = left[~elsewhere], right[~elsewhere], bits[~elsewhere]
        if nearest and len(left):
            order = np.lexsort((bits, left))
            left, right = left[order], right[order]
            first = np.concatenate([[True], left[1:] != left[:-1]])
            left, right = left[first], right[first]
        if len(left):
            a, b = ids[left], ids[right]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
        at = stop


def jaccard_components(docs: DataFrame, join: Join = Join(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), one per row of docs.

    Documents whose shingle sets link, directly or over others, have one component, named by its smallest doc_id.
    Equal sets, by 128 bits of digest and size, are one set from the start (met before the shuffle, in each task).
    Distinct sets meet under keys of
    the heavy-light scheme; first every set of a bucket is verified against the bucket's first, then against the
    nearest of another component by sketch, then, by sketches and texts, against all sets of other components, so no
    link between components is missed.  A text without
    words has 0 shingles and its own component; so has a row with a null doc_id, whose component_id is null.
    Repeated rows get equal results; doc_id is taken as unique otherwise.  Columns beside doc_id (an integer) and
    text aren't read.  An empty table gives no rows.
    """
    bare = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    described = materialise(describe(bare, join, frequency_levels(bare, join)), "sets")
    full = described.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    distinct = materialise(full.groupBy(*NAME).agg(F.min(F.struct("doc_id", "sketch", "prefix")).alias("s")).select(*NAME, "s.*"), "distinct")
    named = materialise(described.select("doc_id", *NAME), "names")  # all that is still asked of every document
    discard(described)
    keyed = entries(distinct, join, boundary(distinct, join))
    lead = materialise(leads(keyed), "leads")
    members = materialise(keyed.join(lead, "key").select("key", "id", "n", "size", "first", "first_n"), "members")
    discard(lead)
    fits = F.least("n", "first_n") * 100 >= F.greatest("n", "first_n") * join.percent
    stars = members.where(fits & (F.col("first") < F.col("id"))).select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = materialise(pairs, "pairs")  # verification reads them twice
        found = materialise(verify(pairs, bare, join), "links")
        discard(pairs)
        return found

    links = linked(near(stars, distinct, join))
    labels = components(links)
    for nearest in (True, False):
        more = linked(across(members, labels, distinct, join, nearest))
        if more.take(1):
            links = links.union(more)
            labels = components(links)
    discard(members)
    components_ = distinct.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(*NAME, F.coalesce("component", "doc_id").alias("component"))
    every = named.select("doc_id", "n", *(F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col(c)).alias(c) for c in NAME[:2]))
    return every.join(components_, NAME, "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, join: Join = Join(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, that of its smallest doc_id, with the columns of docs; repeated rows leave one.  Rows with a null doc_id stay."""
    found = jaccard_components(docs, join, doc_id, text)
    dropped = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone")).distinct()
    left = docs.join(dropped, F.col(doc_id).cast("long") == F.col("_gone"), "left_anti")
    again = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null")
    return left if not again.take(1) else left.where(F.col(doc_id).isNull()).unionByName(left.where(F.col(doc_id).isNotNull()).dropDuplicates([doc_id]))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by 3-word shingles at 90 percent."""
    return jaccard_components(read(spark, sf_dir, "documents", "doc_id", "text"), Join(3, 90))
