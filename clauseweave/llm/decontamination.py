"""Benchmark passages in training texts, found by spaced seeds.

A spaced seed looks at the words of a span through a fixed mask and ignores the
words under zeros, so one or more substituted words inside the span do not hide
the hit. The masks' hashes of all benchmark positions are sorted and sent to the
tasks in blocks of bounded size; each text is hashed once a block, hits are
aligned on their diagonal, and the overlap around them is verified word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseweave.llm.common import BASE, mix64, text_or_empty, tidy, utf8, words
from clauseweave.session import cut_lineage

#: Masks of weight 5 to 6; the first is contiguous, for short exact passages.
MASKS = ("11111", "1101011", "110010011", "1010011001")
#: An overlap counts from this many aligned words on, with this share of them equal.
MIN_WORDS, MIN_EQUAL = 12, 0.8
#: Words of benchmark text in one block sent to the tasks (8 bytes a word and mask, and as much again for places).
BLOCK_WORDS = 500_000


@dataclass(frozen=True)
class Overlap:
    min_words: int = MIN_WORDS
    min_equal: float = MIN_EQUAL
    masks: tuple[str, ...] = MASKS


def seeds(word: np.ndarray, row: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every span that fits into its row."""
    n = len(word) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[:n] == row[len(mask) - 1 :])
    h = np.zeros(len(at), np.uint64)
    for i, bit in enumerate(mask):
        if bit == "1":
            h += word[at + i] * np.uint64(pow(BASE, 2 * i + 3, 1 << 64))
    return mix64(h), at


class Index:
    """The seeds of one block of benchmark items."""

    def __init__(self, items: int, word: np.ndarray, row: np.ndarray, rule: Overlap):
        self.word, self.row, self.rule = word, row, rule
        self.first = np.searchsorted(row, np.arange(items + 1))
        self.tables = []
        for mask in rule.masks:
            h, at = seeds(word, row, mask)
            order = np.argsort(h, kind="stable")
            self.tables.append((mask, h[order], at[order]))

    def hits(self, word: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Distinct (text row, item row, shift): a text word at place p meets the benchmark word at p - shift."""
        found = []
        for mask, table, where in self.tables:
            h, at = seeds(word, row, mask)
            lo = np.searchsorted(table, h)
            at, h, lo = (x[lo < len(table)] for x in (at, h, lo))
            same = table[lo] == h
            at, h, lo = at[same], h[same], lo[same]
            n = np.searchsorted(table, h, side="right") - lo
            text_at = np.repeat(at, n)
            item_at = where[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
            found.append(np.stack([row[text_at], self.row[item_at], text_at - item_at], axis=1))
        return np.unique(np.concatenate(found), axis=0)

    def longest(self, word: np.ndarray, first: int, last: int, item: int, shift: int) -> int:
        """Words of the longest overlap on one diagonal that the rule accepts, ends equal; 0 if none."""
        lo = max(first, int(self.first[item]) + shift)
        hi = min(last, int(self.first[item + 1]) + shift)
        equal = word[lo:hi] == self.word[lo - shift : hi - shift]
        return longest_run(equal, self.rule)


def longest_run(equal: np.ndarray, rule: Overlap) -> int:
    """The longest stretch that begins and ends with an equal word, long enough and equal enough."""
    n = len(equal)
    # An item shorter than the minimum counts as a whole.
    score = np.concatenate(([0], np.cumsum(np.where(equal, 1.0 - rule.min_equal, -rule.min_equal))))
    at = np.flatnonzero(equal)
    if not len(at):
        return 0
    # Stretch i..j is accepted if score[j + 1] >= score[i]; suffix maxima make the best j monotonic.
    reach = np.maximum.accumulate(score[at + 1][::-1])[::-1]
    best = 0
    for k, i in enumerate(at):
        if n - i <= best:
            break
        far = k + int(np.searchsorted(-reach[k:], -(score[i] - 1e-9), side="right")) - 1
        if far >= k:
            best = max(best, int(at[far]) - int(i) + 1)
    return best


def overlaps(docs: DataFrame, benchmark: DataFrame, rule: Overlap = Overlap(), id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per text and benchmark item that overlap: doc_id, item_id, words, needed.

    Texts are lower-cased in A-Z and split at white space. An item overlaps where
    at least ``min_words`` aligned words (all its words, if it has fewer) hold at
    least ``min_equal`` equal ones. Items and texts without enough words for a
    mask, null texts and empty tables give no rows; items of fewer words than the
    shortest mask cannot be found. Items with one text are all reported.
    """
    spark = docs.sparkSession
    bench = benchmark.select(F.col(item_id).alias("item_id"), text_or_empty(item_text).alias("text"))
    bench = cut_lineage(bench.withColumn("_words", F.size(F.split("text", "[\\x20\\x09-\\x0D]+")).cast("long")))
    total = bench.agg(F.sum("_words")).first()[0] or 0
    n_blocks = max(1, -(-total // block_words))
    kind = dict(docs.select(F.col(id_col).alias("doc_id")).dtypes)["doc_id"]
    item_kind = dict(bench.dtypes)["item_id"]
    schema = f"doc_id {kind}, item_id {item_kind}, words int, needed int"
    out = spark.createDataFrame([], schema)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    for block in range(n_blocks):
        part = bench if n_blocks == 1 else bench.filter(F.pmod(F.xxhash64("text", "item_id"), F.lit(n_blocks)) == block)
        rows = part.select("item_id", "text").toArrow()  # one block of bounded size
        data, offsets = utf8(rows.column("text"))
        word, row, _, _ = words(data, offsets)
        shared = spark.sparkContext.broadcast((rows.column("item_id").to_pylist(), word, row))
        found = texts.mapInArrow(_search(shared, rule), schema)
        out = found if block == 0 else out.unionByName(found)
    return out


def _search(shared, rule: Overlap):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, word, row = shared.value
        names, index = pa.array(ids), Index(len(ids), word, row, rule)
        lengths = np.diff(index.first)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                data, offsets = utf8(part.column("text"))
                word, row, _, _ = words(data, offsets)
                first = np.searchsorted(row, np.arange(part.num_rows + 1))
                best: dict[tuple[int, int], int] = {}
                for text, item, shift in index.hits(word, row).tolist():
                    got = index.longest(word, int(first[text]), int(first[text + 1]), item, shift)
                    if got >= min(rule.min_words, int(lengths[item])):
                        best[text, item] = max(best.get((text, item), 0), got)
                if best:
                    keys = list(best)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("doc_id").take(pa.array([t for t, _ in keys])),
                            names.take(pa.array([i for _, i in keys])),
                            pa.array(list(best.values()), pa.int32()),
                            pa.array([min(rule.min_words, int(lengths[i])) for _, i in keys], pa.int32()),
                        ],
                        ["doc_id", "item_id", "words", "needed"],
                    )

    return tidy(search)


def contaminated(docs: DataFrame, benchmark: DataFrame, rule: Overlap = Overlap(), **columns: str) -> DataFrame:
    """One row per input row: doc_id, contaminated, n_items, longest_overlap, item_ids.

    Texts without an overlap have false, 0, 0 and an empty list. Rows that repeat
    an id are judged together. ``columns`` as for ``overlaps``.
    """
    found = overlaps(docs, benchmark, rule, **columns)
    per = found.groupBy("doc_id").agg(F.countDistinct("item_id").alias("n_items"), F.max("words").alias("longest_overlap"), F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    ids = docs.select(F.col(columns.get("id_col", "doc_id")).alias("doc_id"))
    empty = F.array().cast(dict(per.dtypes)["item_ids"])
    return ids.join(per.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left").select(
        "doc_id",
        F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("longest_overlap", F.lit(0)).alias("longest_overlap"),
        F.coalesce("item_ids", empty).alias("item_ids"),
    )
