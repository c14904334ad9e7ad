"""Shared helpers: settled tables, unique rows, and vectorised word scanning over whole Arrow batches.

Texts are scanned as UTF-8 bytes. Both word classes used here consist of ASCII separators, so a byte scan finds exactly
the words a code-point scan finds. A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkframe.session import prepare, work_dir

CHUNK_BYTES = 1 << 20  # text handled by one vectorised pass
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, whatever their names."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns])


def numbered(df: DataFrame, keep: str) -> DataFrame:
    """``df`` with plain names in place of its own, but for ``keep``: Arrow functions don't take every name."""
    return df.toDF(*[c if c == keep else f"c{i}" for i, c in enumerate(df.columns)])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: later jobs neither recompute the rows nor depend on lost executors."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def column_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; nulls have length 0."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if pa.types.is_null(arr.type):
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    arr = arr.fill_null(b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, off, data = arr.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(off, kind, len(arr) + 1, arr.offset * kind().itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, one row at least."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1
        high = min(max(high, low + 1), n)
        yield low, high
        low = high


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijective scrambling of 64-bit values (xor-shift and multiply rounds)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def keys(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit multipliers."""
    with np.errstate(over="ignore"):
        step = U64(0x9E3779B97F4A7C15)
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed << 32)) * step) | U64(1)


def separators(word_bytes: str) -> np.ndarray:
    """256 flags, true where a byte separates words. ``space``: [\\x20\\x09-\\x0D]; ``alnum``: all ASCII but 0-9 a-z A-Z."""
    sep = np.zeros(256, bool)
    if word_bytes == "space":
        sep[[0x20, *range(0x09, 0x0E)]] = True
    else:
        sep[:0x80] = True
        for first, last in (("0", "9"), ("a", "z"), ("A", "Z")):
            sep[ord(first):ord(last) + 1] = False
    return sep


SPACE, ALNUM = separators("space"), separators("alnum")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS = keys(64, 1)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = keys(max(n, 2 * len(_POWERS)), 1)
    return _POWERS


@dataclass
class Words:
    """Words of several rows: byte range in the chunk, row number and a 64-bit hash each; ``first[r]`` is the row's first word."""

    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def scan(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray = SPACE, lower: bool = False, hashes: bool = True) -> Words:
    """All words of the rows ``offsets`` delimits in ``data``."""
    inside = ~sep[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    full = offsets[:-1] < offsets[1:]
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    begin[heads] = inside[heads]
    end[tails] = inside[tails]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    first = np.searchsorted(starts, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    if not hashes:
        return Words(starts, ends, row, first, np.zeros(0, U64))
    lens = ends - starts
    if not len(starts):
        return Words(starts, ends, row, first, np.zeros(0, U64))
    chars = data[inside]
    if lower:
        chars = LOWER[chars]
    at = np.cumsum(lens) - lens
    j = np.arange(len(chars)) - np.repeat(at, lens)
    with np.errstate(over="ignore"):
        h = np.add.reduceat(_powers(int(lens.max()))[j] * (chars.astype(U64) + U64(1)), at)
        h = mix(h + lens.astype(U64) * U64(0xD6E8FEB86659FD93))
    return Words(starts, ends, row, first, h)


def grams(w: Words, k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``k`` words from each word on, and whether they lie in one row. Both have one entry per word."""
    n = len(w.hash)
    out, ok = np.zeros(n, U64), np.zeros(n, bool)
    if n >= k:
        with np.errstate(over="ignore"):
            acc = np.zeros(n - k + 1, U64)
            for j, m in enumerate(keys(k, seed)):
                acc += w.hash[j:n - k + 1 + j] * m
            out[: n - k + 1] = mix(acc)
        ok[: n - k + 1] = w.row[: n - k + 1] == w.row[k - 1:]
    return out, ok


def binary_rows(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """A binary array whose row r holds the bytes of values[first[r]:first[r+1]]."""
    width = values.dtype.itemsize
    flat = np.ascontiguousarray(values)
    return pa.Array.from_buffers(
        pa.binary(), len(first) - 1, [None, pa.py_buffer((first * width).astype(np.int32)), pa.py_buffer(flat)]
    )


def with_row_id(df: DataFrame, name: str = "rid") -> DataFrame:
    """A unique id per row. Only stable once the result is settled."""
    return df.withColumn(name, F.monotonically_increasing_id())
