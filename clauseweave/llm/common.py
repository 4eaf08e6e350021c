"""Helpers shared by the operators: reading, numbering rows, words as hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text that one vectorised step works on.
STEP_BYTES = 1 << 21


def _trim():
    """glibc's call that returns freed memory to the system; nothing elsewhere."""
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return None


def give_back() -> None:
    """Return what a task has freed: a reused worker would keep it through all later stages."""
    pa.default_memory_pool().release_unused()
    trim = _trim()
    if trim is not None:
        trim(0)


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task function that gives its memory back when its last batch is out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    return run


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def gapless_index(df: DataFrame, group: list[str], order: Column, ties: list[Column], buckets: int, name: str, run: Column | None = None) -> DataFrame:
    """Number the rows of each group from 0 without gaps, ordered by a hashed bucket, then ``order`` and ``ties``.

    A group may hold any share of all rows: only rows of one (group, bucket)
    meet in a task, and the offsets come from counts of at most
    ``buckets`` rows a group. ``df`` has few narrow columns. ``run``, if given,
    takes the place of the hashed bucket: not null, and of bounded length.
    """
    bucket = F.pmod(F.xxhash64(order), F.lit(buckets)).cast("int") if run is None else run
    marked = df.withColumn("_bucket", bucket)
    counts = marked.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*group, "_bucket").orderBy(order, *ties)
    ranked = marked.withColumn("_rank", F.row_number().over(within) - 1)
    return ranked.join(offsets, [*group, "_bucket"]).withColumn(name, F.col("_offset") + F.col("_rank")).drop("_bucket", "_rank", "_offset")


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: The powers of a base up to the length of one step, made once a worker.
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The powers 0 to n of a base, modulo 2^64. Read only."""
    known = _POWERS.get(base)
    if known is not None and len(known) > n:
        return known[: n + 1]
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    out = np.multiply.accumulate(out)
    if n <= STEP_BYTES:
        _POWERS[base] = out
    return out


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each row; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def _word_hashes(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word of ``data``; no word crosses a cut."""
    n = len(data)
    inside = ~is_space(data)
    edge = np.zeros(n + 1, bool)
    edge[cuts] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:n]
    starts = np.flatnonzero(inside & ~before)
    after = np.concatenate((inside[1:], [False])) & ~edge[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    up, down = powers(BASE, n), powers(INVERSE, n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts]), starts, ends


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, start and end of every whitespace-separated word, A-Z in lower case.

    Works in steps of bounded size; a longer text is cut at white space, and
    only a single word longer than a step makes a step longer.
    """
    data = lower_ascii(data)
    total, parts, at, row = len(data), [], 0, 0
    while at < total:
        end = min(at + STEP_BYTES, total)
        if end < total:
            row = int(np.searchsorted(offsets, end, side="right")) - 1
            if offsets[row] > at:
                end = int(offsets[row])
            else:
                while end < min(total, int(offsets[row + 1])) and not is_space(data[end : end + 1])[0]:
                    end += 1
        lo, hi = np.searchsorted(offsets, [at, end])
        h, s, e = _word_hashes(data[at:end], np.unique(offsets[lo:hi]) - at)
        parts.append((h, s + at, e + at))
        at = end
    if not parts:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty, empty
    h, s, e = (np.concatenate(x) for x in zip(*parts, strict=True))
    return h, np.searchsorted(offsets, s, side="right") - 1, s, e


def shingles(word: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, and their row; a row of fewer words has one shingle of all its words."""
    n = len(word)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.concatenate(([True], row[1:] != row[:-1]))
    start = np.flatnonzero(first)
    length = np.diff(np.append(start, n))
    salt = [np.uint64(pow(BASE, 2 * i + 3, 1 << 64)) for i in range(size)]
    full = np.zeros(max(n - size + 1, 0), np.uint64)
    for i in range(size):
        full += word[i : n - size + 1 + i] * salt[i] if len(full) else np.uint64(0)
    same = row[: len(full)] == row[size - 1 :] if len(full) else np.zeros(0, bool)
    hashes, rows = mix64(full[same]), row[: len(full)][same]
    short = length < size
    if short.any():
        s, k = start[short], length[short]
        h = np.zeros(len(s), np.uint64)
        for i in range(size - 1):
            use = k > i
            h[use] += word[s[use] + i] * salt[i]
        hashes = np.concatenate((hashes, mix64(h + k.astype(np.uint64))))
        rows = np.concatenate((rows, row[s]))
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return hashes[keep], rows[keep]
