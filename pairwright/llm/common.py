"""Helpers shared by the corpus operators: scratch tables, table readers, byte-level word hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import discard, materialise, new_path  # noqa: F401


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def fold(doc_id: str, modulus: int):
    """The contracts' fold of a row: crc32 of doc_id as text, modulo a number; a null doc_id is in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus, F.lit(0))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string column as (bytes, offsets), without a copy; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    size = np.dtype(np.int64 if pa.types.is_large_string(column.type) else np.int32)
    n = len(column)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, size, n + 1, column.offset * size.itemsize).astype(np.int64) if n else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def pieces(off: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold at most `most` bytes; a longer text has a range of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1))
        yield i, j
        i = j


#: Parameters of the word hash: a byte table from a seeded generator and an odd base.
_STEP = 1 << 20
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: The byte table with A-Z as a-z.
_LOWER = _BYTE.copy()
_LOWER[65:91] = _LOWER[97:123]
_powers: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    """Powers of the base and of its inverse."""
    if not _powers:
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            out = np.empty(_STEP + 1, np.uint64)
            out[0] = done = 1
            while done <= _STEP:
                n = min(done, _STEP + 1 - done)
                out[done : done + n] = out[:n] * np.uint64(pow(base, done, 2**64))
                done += n
            _powers.append(out)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _last(gap: np.ndarray) -> int:
    """The last true place, or -1."""
    for size in (4096, len(gap)):
        if len(hits := np.flatnonzero(gap[-size:])):
            return int(hits[-1]) + max(0, len(gap) - size)
    return -1


def word_hashes(raw: np.ndarray, off: np.ndarray, space: np.ndarray = _SPACE, table: np.ndarray = _LOWER, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of the texts raw[off[i]:off[i+1]], and how many words each text has.

    With prefixes the hashes are rows: the word, then its first so many bytes for each entry (0 if it is shorter).

    Works on the bytes of UTF-8, on whole texts, in steps of at most 1 MiB that end between words; a single
    longer word is hashed slice by slice.
    """
    power, inverse = _tables()
    at, end = int(off[0]), int(off[-1])
    found, first = [np.zeros((0, 1 + len(prefixes)) if prefixes else 0, np.uint64)], [np.zeros(0, np.int64)]
    while at < end:
        stop = min(at + _STEP, end)
        body = raw[at:stop]
        gap = space[body]
        if stop < end:
            back = max(_last(gap) + 1, int(off[np.searchsorted(off, stop, "right") - 1]) - at)
            if back <= 0:  # a word of over a step
                first.append(np.array([at], np.int64))
                limit = int(off[np.searchsorted(off, at, "right")])
                h = np.zeros(1, np.uint64)
                while at < limit and not space[raw[at]]:
                    part = raw[at : min(at + _STEP, limit)]
                    rest = np.flatnonzero(space[part])[:1]
                    part = part[: rest[0]] if len(rest) else part
                    h = mix((h + np.uint64(len(part))) ^ (table[part] * power[: len(part)]).sum(dtype=np.uint64))
                    at += len(part)
                found.append(np.concatenate([h, np.zeros(len(prefixes), np.uint64)])[None] if prefixes else h)
                continue
            stop = at + back
            body, gap = body[:back], gap[:back]
        cut = np.unique(off[np.searchsorted(off, at, "right") : np.searchsorted(off, stop, "left")]) - at  # texts begin there
        word = ~gap
        begins, ends = word.copy(), word.copy()
        begins[1:] &= gap[:-1]
        ends[:-1] &= gap[1:]
        begins[cut] |= word[cut]
        ends[cut - 1] |= word[cut - 1]
        b, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        sums = np.zeros(len(body) + 1, np.uint64)
        np.cumsum(table[body] * power[: len(body)], out=sums[1:])
        h = mix((sums[e] - sums[b]) * inverse[b] + (e - b).astype(np.uint64))
        if prefixes:
            heads = [np.where(e - b >= k, mix((sums[np.minimum(b + k, e)] - sums[b]) * inverse[b] + np.uint64(k << 32)), np.uint64(0)) for k in prefixes]
            h = np.stack([h, *heads], 1)
        found.append(h)
        first.append(b + at)
        at = stop
    return np.concatenate(found), np.diff(np.searchsorted(np.concatenate(first), off))
