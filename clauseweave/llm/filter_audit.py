"""Audit of five filters: what each removes in every order, from a sparse document-term matrix.

Each task turns steps of texts into a shard of the matrix in compressed sparse
rows over words of its own. Shards send their vocabularies, cut into buckets of
words by a checksum, to one dictionary a bucket, which gives each word a number;
a word of every text comes once a shard. With these dense global numbers as
columns the matrix decides two filters: the sum of a row is its words, the count
of its nonzero entries its distinct words. The other flags come along with each
row. Texts meet once, as digests, to find those that a smaller id holds too; then
only counts of flag sets are left.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clauseweave.llm.batches import numbered_words, steps
from clauseweave.llm.common import utf8
from clauseweave.llm.storage import Workspace

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT, SYMBOLS = 100, 80, 10, b"#$%&*|"
#: Bytes of text in a shard of the matrix; a longer text is a shard of its own.
SHARD_BYTES = 4 << 20
#: Dictionaries: as many as there are shuffle partitions, within these bounds.
FEWEST_BUCKETS, MOST_BUCKETS = 16, 4096

SHARD = (
    "shard long, rows int, doc_id array<{kind}>, part array<string>, digest array<binary>, flags array<int>, "
    "row_ends binary, words binary, counts binary, vocabulary array<binary>"
)


def _flag(name: str) -> int:
    return 1 << FILTERS.index(name)


def _shard(data: np.ndarray, offsets: np.ndarray, buckets: int) -> dict[str, object]:
    """Rows of the matrix over the shard's own words, numbered bucket by bucket, digests, and the flags that need no words."""
    raw = data.tobytes()
    texts = [raw[offsets[i] : offsets[i + 1]] for i in range(len(offsets) - 1)]
    word, lengths, vocabulary = numbered_words(texts, shared=True)
    bucket = np.fromiter(map(zlib.crc32, vocabulary), np.int64, len(vocabulary)) % buckets
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
    listed = [vocabulary[i] for i in order.tolist()]
    row = np.repeat(np.arange(len(texts)), lengths)
    width = max(len(vocabulary), 1)
    entry, count = np.unique(row * width + place[word], return_counts=True)
    ends = np.searchsorted(entry, np.arange(1, len(texts) + 1) * width)

    def sums(mask):
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(mask, out=total[1:])
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.int64)

    table = np.zeros(256, bool)
    table[list(SYMBOLS)] = True
    points, upper, symbols = sums((data & 0xC0) != 0x80), sums((data >= 65) & (data <= 90)), sums(table[data])
    flags = np.where(100 * upper > MAX_UPPER_PERCENT * points, _flag("C"), 0) | np.where(symbols > 0, _flag("D"), 0)
    return {
        "digest": [hashlib.sha256(t).digest() for t in texts],
        "flags": flags.tolist(),
        "row_ends": ends.astype("<i8").tobytes(),
        "words": (entry % width).astype("<i4").tobytes(),
        "counts": count.astype("<i4").tobytes(),
        "vocabulary": [b" ".join(listed[a:b]) for a, b in itertools.pairwise(cuts)],
    }


def local_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", size: int = SHARD_BYTES) -> DataFrame:
    """Shards of the matrix, each over the words of its own vocabulary (a list of words a bucket). Null texts and parts count as empty."""
    buckets = min(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), FEWEST_BUCKETS), MOST_BUCKETS)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for lo, hi in steps(batch, offsets, size):
                made = _shard(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], buckets)
                ids = batch.column("doc_id").slice(lo, hi - lo)
                columns = {
                    "shard": pa.array([(task << 32) + number]),
                    "rows": pa.array([hi - lo], pa.int32()),
                    "doc_id": pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), ids),
                    "part": pa.array([batch.column("part").slice(lo, hi - lo).to_pylist()], pa.list_(pa.string())),
                    "digest": pa.array([made["digest"]], pa.list_(pa.binary())),
                    "flags": pa.array([made["flags"]], pa.list_(pa.int32())),
                    "row_ends": pa.array([made["row_ends"]], pa.binary()),
                    "words": pa.array([made["words"]], pa.binary()),
                    "counts": pa.array([made["counts"]], pa.binary()),
                    "vocabulary": pa.array([made["vocabulary"]], pa.list_(pa.binary())),
                }
                number += 1
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return rows.mapInArrow(cut, SHARD.format(kind=kind))


def numbered(shards: DataFrame) -> DataFrame:
    """Each shard's words of each bucket as numbers: shard, bucket, numbers, top (words of the bucket so far), fresh (those first met here).

    One task reads all shards' words of a bucket, shard after shard, and keeps the
    bucket's dictionary only.
    """
    parts = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = shards.select("shard", F.posexplode("vocabulary").alias("bucket", "words")).filter(F.octet_length("words") > 0)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, {}
        for batch in batches:
            numbers, tops, fresh = [], [], []
            for bucket, words in zip(batch.column("bucket").to_pylist(), batch.column("words").to_pylist(), strict=True):
                if bucket != now:
                    now, known = bucket, {}
                before, own = len(known), words.split(b" ")
                numbers.append(np.fromiter((known.setdefault(w, len(known)) for w in own), "<i4", len(own)).tobytes())
                tops.append(len(known))
                fresh.append(b" ".join(w for w in own if known[w] >= before))
            yield pa.RecordBatch.from_arrays(
                [batch.column("shard"), batch.column("bucket"), pa.array(numbers, pa.binary()), pa.array(tops, pa.int64()), pa.array(fresh, pa.binary())],
                ["shard", "bucket", "numbers", "top", "fresh"],
            )

    return sent.repartition(parts, "bucket").sortWithinPartitions("bucket", "shard").mapInArrow(number, "shard long, bucket int, numbers binary, top long, fresh binary")


def _offsets(lists: DataFrame) -> DataFrame:
    """Words in the buckets before each: one row a bucket, at most ``MOST_BUCKETS``."""
    sizes = lists.groupBy(F.col("bucket").alias("_bucket")).agg(F.max("top").alias("_size"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(sizes.select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")))


def dictionary(lists: DataFrame) -> DataFrame:
    """Every word of the corpus once, with its dense number from 0: word, word_id. ``lists`` are the stored ``numbered`` words."""
    found = lists.filter(F.octet_length("fresh") > 0).join(_offsets(lists), F.col("bucket") == F.col("_bucket"))
    words = F.split(F.decode("fresh", "UTF-8"), " ")
    first = F.col("_offset") + F.col("top") - F.size(words)
    return found.select(first.alias("_first"), F.posexplode(words).alias("_at", "word")).select("word", (F.col("_first") + F.col("_at")).alias("word_id"))


def global_shards(shards: DataFrame, lists: DataFrame) -> DataFrame:
    """The shards with ``word_ids``: by bucket the global number of its first word and the numbers of the shard's own words."""
    placed = lists.join(_offsets(lists), F.col("bucket") == F.col("_bucket"))
    # One entry a bucket, of the words of one shard.
    own = placed.groupBy(F.col("shard").alias("_shard")).agg(F.array_sort(F.collect_list(F.struct("bucket", F.col("_offset").alias("offset"), "numbers"))).alias("word_ids"))
    return shards.drop("vocabulary").join(own, F.col("shard") == F.col("_shard"), "left").drop("_shard")


def joined_ids(word_ids: list[dict] | None) -> np.ndarray:
    """The global number of each of a shard's own words."""
    parts = [np.frombuffer(x["numbers"], "<i4") + np.int64(x["offset"]) for x in word_ids or []]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def csr(row_ends: bytes, words: bytes, counts: bytes, word_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row pointer, global columns (ascending in a row) and values of one shard."""
    ends = np.concatenate(([0], np.frombuffer(row_ends, "<i8")))
    columns, values = word_ids[np.frombuffer(words, "<i4")], np.frombuffer(counts, "<i4")
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    order = np.lexsort((columns, row))
    return ends, columns[order], values[order]


def matrix_rows(shards: DataFrame) -> DataFrame:
    """One row per document: doc_id, part, digest, fails (bits of A to D), words, distinct_words, from the rows of the matrix."""
    kind = shards.schema["doc_id"].dataType.elementType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                column = {name: batch.column(name).slice(i, 1) for name in batch.schema.names}
                ids = joined_ids(column["word_ids"][0].as_py())
                blobs = [column[name][0].as_py() for name in ("row_ends", "words", "counts")]
                ends, columns, values = csr(*blobs, ids)
                total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
                words = total[ends[1:]] - total[ends[:-1]]
                # Entries of one row that share a global number would be one word.
                fresh = np.concatenate(([0], np.cumsum(np.append(True, columns[1:] != columns[:-1])[: len(columns)])))
                fresh = fresh[ends[1:]] - fresh[ends[:-1]]
                starts = ends[:-1][(np.diff(ends) > 0) & (ends[:-1] > 0)]
                again = np.zeros(len(ends) - 1, np.int64)
                again[np.searchsorted(ends, starts, side="right") - 1] = columns[starts] == columns[starts - 1]
                distinct = fresh + again
                flags = column["flags"].flatten().to_numpy()
                fails = flags | np.where(words < MIN_WORDS, _flag("A"), 0) | np.where(100 * distinct < MIN_DISTINCT_PERCENT * words, _flag("B"), 0)
                out = [column["doc_id"].flatten(), column["part"].flatten(), column["digest"].flatten(), pa.array(fails.astype(np.int32)), pa.array(words), pa.array(distinct)]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "part", "digest", "fails", "words", "distinct_words"])

    needed = shards.select("doc_id", "part", "digest", "flags", "row_ends", "words", "counts", "word_ids")
    return needed.mapInArrow(judge, f"doc_id {kind}, part string, digest binary, fails int, words long, distinct_words long")


def flag_counts(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows, good and toxic rows of each part and set of failed filters, E among them: part, fails, n, good, toxic.

    E fails where a smaller id has the same digest. Rows are first counted by
    digest and id, then reduced to one row for each (digest, part, labels), so no
    group of copies is gathered. An id counts as good (toxic) if any of its
    labels says so; null ids have no labels, no smaller id, and fail E never.
    """
    one = rows.groupBy("digest", "part", "fails", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("_good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("_toxic"))
    # Null ids match nothing; a second key spreads them.
    spread = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(4096))).otherwise(F.lit(0))
    marked = one.withColumn("_spread", spread).join(marks.withColumn("_none", F.lit(0).cast("long")), (F.col("doc_id") == F.col("_id")) & (F.col("_spread") == F.col("_none")), "left")
    good, toxic = F.coalesce("_good", F.lit(False)).alias("_good"), F.coalesce("_toxic", F.lit(False)).alias("_toxic")
    known = F.col("doc_id").isNotNull()
    reduced = marked.groupBy("digest", "part", "fails", good, toxic).agg(
        F.sum("n").alias("n"),
        F.min("doc_id").alias("_least"),
        F.coalesce(F.min_by(F.when(known, F.col("n")), F.col("doc_id")), F.lit(0)).alias("_at_least"),
        F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("_without"),
    )
    least = F.min("_least").over(Window.partitionBy("digest"))
    first = F.col("_without") + F.when(F.col("_least") == least, F.col("_at_least")).otherwise(0)
    both = F.array(
        F.struct(F.col("fails").alias("fails"), first.alias("n")),
        F.struct(F.col("fails").bitwiseOR(F.lit(_flag("E"))).alias("fails"), (F.col("n") - first).alias("n")),
    )
    split = reduced.withColumn("_both", both).select("part", "_good", "_toxic", F.explode("_both").alias("_one"))
    return split.groupBy("part", F.col("_one.fails").alias("fails")).agg(
        F.sum("_one.n").alias("n"),
        F.sum(F.when(F.col("_good"), F.col("_one.n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("_toxic"), F.col("_one.n")).otherwise(0)).alias("toxic"),
    )


def _bit(letter: Column) -> Column:
    return F.element_at(F.array(*[F.lit(_flag(f)) for f in FILTERS]), F.instr(F.lit(FILTERS), letter))


def _total(amount: str, condition) -> Column:
    """Sum of ``amount`` over the part's flag sets that meet a condition on their bits."""
    return F.aggregate(F.filter("_sets", lambda s: condition(s["fails"])), F.lit(0).cast("long"), lambda acc, s: acc + s[amount])


def order_table(counts: DataFrame) -> DataFrame:
    """All orders and steps of each part, from at most 32 flag sets a part."""
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("_sets"))
    # The bits are made inside generators, so that what follows reads them as columns.
    letters = F.explode(F.transform(F.split(F.lit(",".join(ORDERS)), ","), lambda o: F.struct(o.alias("filter_order"), F.transform(F.split(o, ""), _bit).alias("bits"))))
    ordered = parts.withColumn("_order", letters)
    places = F.transform(
        F.sequence(F.lit(1), F.lit(len(FILTERS))),
        lambda i: F.struct(i.alias("step"), F.element_at("_order.bits", i).alias("own"), F.aggregate(F.slice("_order.bits", F.lit(1), i - 1), F.lit(0), lambda a, b: a + b).alias("before")),
    )
    bits = ordered.withColumn("_step", F.explode(places))
    own, before = F.col("_step.own"), F.col("_step.before")

    def has(x, mask):
        return x.bitwiseAND(mask) != 0

    def here(x):
        return has(x, own) & ~has(x, before)

    # Of the filters that a row fails each comes first in as many orders as any other.
    share = F.aggregate(F.filter("_sets", lambda s: has(s["fails"], own)), F.lit(0).cast("long"), lambda acc, s: acc + s["n"] * (F.lit(len(ORDERS)) / F.bit_count(s["fails"])).cast("long"))
    return bits.select(
        "part",
        F.col("_order.filter_order").alias("filter_order"),
        F.col("_step.step").alias("step"),
        _total("n", lambda x: ~has(x, own.bitwiseOR(before))).alias("kept"),
        _total("n", here).alias("removed"),
        _total("n", lambda x: has(x, own) & has(x, before)).alias("redundant"),
        _total("n", lambda x: x == own).alias("unique_fails"),
        _total("good", here).alias("good_lost"),
        _total("toxic", here).alias("toxic_lost"),
        share.alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null texts and parts count as empty; an empty text fails A only, and E if a
    smaller id is empty too. Rows that repeat an id are rows of their own, and
    none of them has a smaller id. Null ids: see ``flag_counts``. Texts of any
    length are read whole. Without documents there are no parts and no rows;
    without labels the losses are 0. Other columns are not read.
    """
    out = Workspace(docs.sparkSession)
    with Workspace(docs.sparkSession) as space:
        # Bucketed by shard: only the numbers move to meet it.
        shards = space.bucketed(local_shards(docs, id_col, text_col, part_col), "shard")
        rows = matrix_rows(global_shards(shards, space.store(numbered(shards))))
        # At most 32 rows a part: stored, so that all else can go.
        return order_table(out.store(flag_counts(rows, labels, id_col)))
