"""Exact duplicates by two passes over a Bloom filter.

Pass one sets the bits of every normalised text's hash and keeps the bits that
were set at least twice; a repeated hash has all its bits among them. Pass two
tests each row against those bits: rows that fail are alone and pass straight
through, only the rest shuffle, narrow, to be grouped by their digest.

The filter has at most ``max_bits`` bits, so what is broadcast is bounded at
every size of the input; with more rows than it is made for, more rows shuffle,
and the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseweave.llm.common import mix64, text_or_empty, tidy
from clauseweave.session import cut_lineage

#: Bits a row, hashes a row, bits of one piece of the filter, and bits of the largest filter (16 MB).
BITS_PER_ROW, HASHES, PIECE_BITS, MAX_BITS = 24, 3, 1 << 16, 1 << 27
SPACE = "[\\x20\\x09-\\x0D]+"


def positions(key: np.ndarray, bits: int) -> np.ndarray:
    """The cells of each key: HASHES a row."""
    key = key.view(np.uint64)
    return np.stack([mix64(key + np.uint64(i * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(bits) for i in range(HASHES)], axis=1)


def maybe_among(filled: np.ndarray, bits: int, key: pa.Array) -> np.ndarray:
    """Whether all cells of each key are set."""
    cells = positions(key.to_numpy(zero_copy_only=False), bits)
    return ((filled[cells >> np.uint64(3)] >> (np.uint8(7) - (cells & np.uint64(7)).astype(np.uint8))) & 1).all(axis=1)


def filter_bits(rows: int, most: int = MAX_BITS) -> int:
    """Bits of the filter for so many rows."""
    return min(most, 1 << max(13, (rows * BITS_PER_ROW - 1).bit_length()))


def _fill(bits: int):
    """Each task: the bits it set, and those it set twice, in pieces."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for cell in positions(batch.column("key").to_numpy(zero_copy_only=False), bits).T:
                cell = np.sort(cell)
                place = (cell >> np.uint64(3)).astype(np.int64)
                mask = np.uint8(128) >> (cell & np.uint64(7)).astype(np.uint8)
                first = np.flatnonzero(np.append(True, place[1:] != place[:-1])[: len(place)])
                if not len(first):
                    continue
                again = np.flatnonzero(cell[1:] == cell[:-1])
                np.bitwise_or.at(twice, place[again], mask[again])
                here, at = np.bitwise_or.reduceat(mask, first), place[first]
                before = once[at]
                twice[at] |= before & here
                once[at] = before | here
        step = min(bits, PIECE_BITS) // 8
        for piece in range(bits // 8 // step):
            part = slice(piece * step, (piece + 1) * step)
            if once[part].any():
                yield pa.RecordBatch.from_pydict({"piece": pa.array([piece], pa.int32()), "once": [once[part].tobytes()], "twice": [twice[part].tobytes()]})

    return tidy(fill)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bits of one piece that were set at least twice in all tasks together."""
    once = twice = None
    for batch in batches:
        for a, b in zip(batch.column("once"), batch.column("twice"), strict=True):
            a, b = np.frombuffer(a.as_py(), np.uint8), np.frombuffer(b.as_py(), np.uint8)
            once, twice = (a, b) if once is None else (once | a, twice | b | (once & a))
        piece = batch.column("piece")[:1]
    yield pa.RecordBatch.from_arrays([piece, pa.array([twice.tobytes()])], ["piece", "twice"])


def repeated_bits(keys: DataFrame, bits: int) -> np.ndarray:
    """The filter of possibly repeated keys, as packed bits."""
    pieces = keys.mapInArrow(_fill(bits), "piece int, once binary, twice binary")
    merged = pieces.groupBy("piece").applyInArrow(_merge, "piece int, twice binary")
    step = min(bits, PIECE_BITS)
    out = np.zeros(bits // 8, np.uint8)
    for row in merged.collect():  # at most MAX_BITS bits
        out[row.piece * step // 8 : (row.piece + 1) * step // 8] = np.frombuffer(row.twice, np.uint8)
    return out


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): SHA-256 of the text with each run of white space as one space; null counts as empty."""
    normal = F.regexp_replace(text_or_empty(text_col), SPACE, " ")
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(normal, 256)).alias("digest"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, digest.

    Null texts equal empty ones. Of equal texts the row with the smallest id
    stays (a null id only if no other is there); rows that repeat an id with the
    same text are all marked kept if that id stays. An empty table gives no rows.
    Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    narrow = cut_lineage(digests(docs, id_col, text_col).withColumn("key", F.xxhash64("digest")))
    rows = narrow.count()
    bits = filter_bits(rows, max_bits)
    shared = spark.sparkContext.broadcast(repeated_bits(narrow.select("key"), bits))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maybe = maybe_among(shared.value, bits, batch.column("key"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(maybe)], ["doc_id", "digest", "maybe"])

    kind = narrow.schema["doc_id"].dataType.simpleString()
    tested = cut_lineage(narrow.mapInArrow(tidy(test), f"doc_id {kind}, digest binary, maybe boolean"))
    shared.destroy()
    alone = tested.filter("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    maybe = tested.filter("maybe").select("doc_id", "digest")
    groups = maybe.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    joined = maybe.join(groups, "digest").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")
    return alone.unionByName(joined)
