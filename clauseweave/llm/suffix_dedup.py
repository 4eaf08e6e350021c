"""Repeated byte strings by merged Burrows-Wheeler transforms.

Every byte covered by a string of ``length`` bytes that also starts elsewhere is
removed. A string is filed under its anchor, the ``GRAM`` bytes of it with the
least hash, so equal strings have equal anchors and meet under one key; the
strings under one anchor occurrence form a context. Contexts that occur twice as
a whole are settled by counting them. What is left, contexts that share an anchor
but differ somewhere, is cut out of the texts and comes in buckets:

* a bucket's contexts are dealt to shards, and each shard's rotations are sorted
  on their own into a Burrows-Wheeler transform of several bytes a step;
* the transforms are merged by refining their interleave: rotations in the order
  of their first h bytes, stably dealt by the bytes before them, are in the order
  of their first h + r bytes. Neighbours that a step still leaves together have
  that many bytes in common, so the refinement yields the common prefixes, and
  after ``length`` bytes the classes left are the repeated intervals.

No suffix is sorted against those of another shard. An anchor with more contexts
than a bucket takes is settled by counting its strings one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseweave.llm.common import BASE, INVERSE, mix64, powers, text_or_empty, tidy, utf8
from clauseweave.llm.exact_dedup import filter_bits, maybe_among, repeated_bits
from clauseweave.llm.storage import Workspace

LENGTH, GRAM = 200, 64
#: Text bytes of a vectorised step; contexts under one anchor that buckets take; bytes of a bucket and of a shard; bits of the largest filter.
STEP, MOST_CONTEXTS, BUCKET_BYTES, SHARD_BYTES, FILTER_BITS = 1 << 19, 1000, 60_000, 16_000, 1 << 26
#: Bytes that one refinement step looks at: the first that divides the length. A bucket has fewer
#: different ones than a 16-bit radix sort takes.
STRIDES = (20, 8, 5, 4, 3, 2, 1)
EMPTY = np.zeros(0, np.int64)


# Anchors and contexts.


def _least(value: np.ndarray, width: int) -> np.ndarray:
    """For each start the place of the least value among ``width``, the leftmost of equal ones."""
    place = np.arange(len(value), dtype=np.int32)
    size = 1
    while size < width:
        shift = min(size, width - size)
        a, b = value[:-shift], value[shift:]
        right = b < a
        place = np.where(right, place[shift:], place[:-shift])
        value = np.minimum(a, b)
        size += shift
    return place


def _contexts(data: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, context hash, start and number of strings of each context.

    ``first`` and ``last`` bound the texts in ``data``; strings lie within one.
    """
    up, down = powers(BASE, len(data)), powers(INVERSE, len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    gram = min(GRAM, length)
    grams = mix64((sums[gram:] - sums[:-gram]) * down[: len(sums) - gram])
    place = _least(grams, length - gram + 1)
    edge = np.zeros(len(data) + 2, np.int32)
    ok = last - first >= length
    np.add.at(edge, first[ok], 1)
    np.add.at(edge, last[ok] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(edge)[: max(len(place), 0)] > 0)
    if not len(start):
        return EMPTY.view(np.uint64), EMPTY.view(np.uint64), EMPTY, EMPTY
    anchor = place[start]
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)))
    new |= np.isin(start, first)
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(start)))
    lo = start[at]
    whole = (sums[lo + count + length - 1] - sums[lo]) * down[lo]
    context = mix64(whole + count.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + mix64((anchor[at] - lo).astype(np.uint64)))
    return grams[anchor[at]], context, lo, count


def contexts(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """The contexts of one text of any size: (anchor hash, context hash, start, number of strings)."""
    parts = []
    for at in range(0, max(len(data) - length + 1, 0), STEP):
        piece = data[at : at + STEP + length - 1]
        a, c, lo, n = _contexts(piece, np.array([0]), np.array([len(piece)]), length)
        parts.append((a, c, lo + at, n))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (EMPTY.view(np.uint64), EMPTY.view(np.uint64), EMPTY, EMPTY)


def text_key(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def _occurrence(key: bytes, start: np.ndarray) -> np.ndarray:
    """A key for the place of a context: the same for copies of one text."""
    return mix64(np.uint64(int.from_bytes(key[:8], "little")) + mix64(start.astype(np.uint64) + np.uint64(int.from_bytes(key[8:], "little"))))


def _distinct_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, np.ndarray]]:
    """Key and bytes of each text that the task has not seen yet."""
    seen: set[bytes] = set()
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            data, offsets = utf8(batch.column("text").slice(at, 500))
            raw = data.tobytes()
            for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                key = text_key(raw[lo:hi])
                if key not in seen:
                    seen.add(key)
                    yield key, data[lo:hi]


def _steps(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[list[tuple[bytes, np.ndarray, tuple[np.ndarray, ...]]]]:
    """Texts of ``length`` or more with their contexts, many short ones in one vectorised step."""
    waiting: list[tuple[bytes, np.ndarray]] = []
    size = 0

    def done() -> list[tuple[bytes, np.ndarray, tuple[np.ndarray, ...]]]:
        ends = np.cumsum([len(d) for _, d in waiting])
        starts = np.concatenate(([0], ends[:-1]))
        a, c, lo, n = _contexts(np.concatenate([d for _, d in waiting]), starts, ends, length)
        row = np.searchsorted(starts, lo, side="right") - 1
        cut = np.searchsorted(row, np.arange(len(waiting) + 1))
        return [(key, d, (a[x:y], c[x:y], lo[x:y] - starts[i], n[x:y])) for i, ((key, d), x, y) in enumerate(zip(waiting, cut[:-1], cut[1:], strict=True))]

    for key, data in _distinct_texts(batches):
        if len(data) < length:
            continue
        if len(data) > STEP:
            yield [(key, data, contexts(data, length))]
            continue
        waiting.append((key, data))
        size += len(data)
        if size >= STEP:
            yield done()
            waiting, size = [], 0
    if waiting:
        yield done()


def _list_contexts(length: int):
    """(anchor, context, occurrence, text_key, start, strings) of every context of the task's texts."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _steps(batches, length):
            n = [len(x[2]) for _, _, x in found]
            cols = [np.concatenate([x[j] for _, _, x in found]) for j in range(4)]
            occurrence = np.concatenate([_occurrence(key, x[2]) for key, _, x in found])
            keys = pa.array([key for key, _, _ in found], pa.binary()).take(pa.array(np.repeat(np.arange(len(found)), n)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0].view(np.int64)), pa.array(cols[1].view(np.int64)), pa.array(occurrence.view(np.int64)), keys, pa.array(cols[2].astype(np.int32)), pa.array(cols[3].astype(np.int32))],
                ["anchor", "context", "occurrence", "text_key", "start", "strings"],
            )

    return listed


def _cut_out(length: int, shared, bits: int):
    """(anchor, context, occurrence, bytes) of the contexts whose occurrence is among the wanted."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _steps(batches, length):
            rows: tuple[list, list, list, list] = ([], [], [], [])
            for key, data, (anchor, context, start, strings) in found:
                occurrence = _occurrence(key, start)
                hit = maybe_among(shared.value, bits, pa.array(occurrence.view(np.int64)))
                for i in np.flatnonzero(hit).tolist():
                    rows[0].append(anchor[i].view(np.int64))
                    rows[1].append(context[i].view(np.int64))
                    rows[2].append(occurrence[i].view(np.int64))
                    rows[3].append(data[start[i] : start[i] + strings[i] + length - 1].tobytes())
            if rows[0]:
                yield pa.RecordBatch.from_arrays([*(pa.array(r, pa.int64()) for r in rows[:3]), pa.array(rows[3], pa.binary())], ["anchor", "context", "occurrence", "bytes"])

    return cut


# Transforms of shards and their merge.


class _Rotations:
    """The rotations of several strings, laid end to end; a jump stays in its string."""

    def __init__(self, sizes: np.ndarray):
        self.first = np.concatenate(([0], np.cumsum(sizes)))
        self.of = np.repeat(np.arange(len(sizes)), sizes)
        self.start, self.size = self.first[self.of], sizes[self.of]
        self.own = np.arange(self.first[-1]) - self.start

    def ahead(self, step: int, part: slice = slice(None)) -> np.ndarray:
        """The place of each rotation that begins ``step`` further on."""
        return self.start[part] + (self.own[part] + step) % self.size[part]

    def longer(self, rank: np.ndarray, known: int, wanted: int, part: slice = slice(None)) -> np.ndarray:
        """Dense ranks of the first ``wanted`` bytes from those of the first ``known``."""
        base = part.start or 0
        while known < wanted:
            step = min(known, wanted - known)
            key = rank * (int(rank.max(initial=0)) + 1) + rank[self.ahead(step, part) - base]
            rank = np.unique(key, return_inverse=True)[1]
            known += step
        return rank


def repeated_intervals(strings: list[bytes], length: int, shard_bytes: int = SHARD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """String, place and class of every rotation whose first ``length`` bytes another rotation shares.

    Rotations that cross the end of their string are sorted along, but never count.
    """
    sizes = np.array([len(s) + 1 for s in strings])
    turn = _Rotations(sizes)
    raw = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    n = len(raw)
    stride = next(r for r in STRIDES if length % r == 0)
    # Symbols of the transform are short strings of ``stride`` bytes, numbered in one order for all shards.
    packed, known = np.zeros(n, np.uint64), min(stride, 8)
    for k in range(known):
        packed = (packed << np.uint64(8)) | raw[turn.ahead(k)]
    symbol = turn.longer(np.unique(packed, return_inverse=True)[1], known, stride)
    # Shards are runs of whole strings; each is sorted on its own by its first ``length`` bytes.
    shard_of_string = turn.first[:-1] // shard_bytes
    edges = np.append(turn.first[:-1][np.concatenate(([True], np.diff(shard_of_string) > 0))], n).tolist()
    order = np.empty(n, np.int64)
    shard = np.empty(n, np.uint8 if len(edges) <= 256 else np.uint16)
    for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        order[lo:hi] = lo + np.argsort(turn.longer(symbol[lo:hi], stride, length, slice(lo, hi)), kind="stable")
        shard[lo:hi] = k
    # The transform of each sorted list: the bytes before every rotation.
    transform = symbol[turn.ahead(-stride)][order].astype(np.uint16 if symbol.max(initial=0) < 1 << 16 else np.uint32)
    # The interleave: which rotation, as a place in the shards' sorted lists, stands where.
    interleave, group, places = np.arange(n), np.zeros(n, np.int32), np.arange(n)
    for _ in range(length // stride):
        before = transform[interleave]
        move = np.argsort(before, kind="stable")
        moved, earlier = before[move], group[move]
        source = shard[interleave[move]]
        interleave = np.empty(n, np.int64)
        interleave[np.argsort(source, kind="stable")] = places
        group = np.concatenate(([0], np.cumsum((moved[1:] != moved[:-1]) | (earlier[1:] != earlier[:-1]), dtype=np.int32)))
    place = order[interleave]
    string, own = turn.of[place], turn.own[place]
    whole = own + length < sizes[string]
    string, own, group = string[whole], own[whole], group[whole]
    several = np.bincount(group, minlength=1)[group] > 1 if len(group) else np.zeros(0, bool)
    return string[several], own[several], group[several]


def covered(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The ranges that strings of ``length`` from these sorted places cover."""
    if not len(starts):
        return []
    gap = np.flatnonzero(starts[1:] > starts[:-1] + length)
    lo = starts[np.concatenate(([0], gap + 1))]
    hi = starts[np.append(gap, len(starts) - 1)] + length
    return list(zip(lo.tolist(), hi.tolist(), strict=True))


RANGES = "array<struct<lo:int,hi:int>>"


def _merge_buckets(length: int):
    """(anchor, context, ranges) of what other contexts under the anchor repeat; rows come sorted by anchor."""

    def settle(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch | None:
        string, place, _ = repeated_intervals([r[3] for r in rows], length)
        by = np.lexsort((place, string))
        string, place = string[by], place[by]
        cut = np.flatnonzero(np.diff(string)) + 1
        out = [(rows[int(s[0])][:2], covered(p, length)) for s, p in zip(np.split(string, cut), np.split(place, cut), strict=True) if len(s)]
        if not out:
            return None
        kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in out], pa.int64()), pa.array([k[1] for k, _ in out], pa.int64()), pa.array([[{"lo": a, "hi": b} for a, b in r] for _, r in out], kind)], ["anchor", "context", "ranges"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket: list[tuple[int, int, int, bytes]] = []
        group: dict[int, tuple[int, int, int, bytes]] = {}
        size, current = 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "context", "occurrence", "bytes")), strict=True):
                if row[0] != current:
                    if len(group) > 1:
                        bucket.extend(group.values())
                        size += sum(len(r[3]) for r in group.values())
                    group, current = {}, row[0]
                    if size >= BUCKET_BYTES:
                        if (out := settle(bucket)) is not None:
                            yield out
                        bucket, size = [], 0
                group[row[2]] = row  # a copy of the text in another task gives the same occurrence
        if len(group) > 1:
            bucket.extend(group.values())
        if bucket and (out := settle(bucket)) is not None:
            yield out

    return merge


def _single_strings(length: int):
    """(anchor, string, occurrence, context, place, twice) of every string of the contexts."""

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                cols: list[list[np.ndarray]] = [[], []]
                counts = []
                for value, occurrence in zip(part.column("bytes").to_pylist(), part.column("occurrence").to_pylist(), strict=True):
                    data = np.frombuffer(value, np.uint8)
                    down, up = powers(INVERSE, len(data)), powers(BASE, len(data))
                    sums = np.zeros(len(data) + 1, np.uint64)
                    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
                    m = len(data) - length + 1
                    cols[0].append(mix64((sums[length:] - sums[:m]) * down[:m]))
                    cols[1].append(mix64(np.full(m, occurrence, np.int64).view(np.uint64) + np.arange(m, dtype=np.uint64)))
                    counts.append(m)
                row = pa.array(np.repeat(np.arange(part.num_rows), counts))
                place = np.concatenate([np.arange(m, dtype=np.int32) for m in counts])
                yield pa.RecordBatch.from_arrays(
                    [part.column("anchor").take(row), pa.array(np.concatenate(cols[0]).view(np.int64)), pa.array(np.concatenate(cols[1]).view(np.int64)), part.column("context").take(row), pa.array(place), part.column("twice").take(row)],
                    ["anchor", "string", "occurrence", "context", "place", "twice"],
                )

    return single


# The whole job.


def _kept(length: int, shared, bits: int):
    """(text_key, n_bytes, kept_sha256, text): the text itself only where ranges may have to be removed."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for key, data in _distinct_texts(batches):
            raw = data.tobytes()
            maybe = bool(maybe_among(shared.value, bits, pa.array([int.from_bytes(key[:8], "little", signed=True)], pa.int64()))[0])
            rows.append((key, len(raw), None if maybe else hashlib.sha256(raw).hexdigest(), raw if maybe else None))
            size += 100 + len(raw) * maybe
            if size > 4 << 20:
                yield _kept_batch(rows)
                rows, size = [], 0
        if rows:
            yield _kept_batch(rows)

    return kept


def _kept_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int64(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["text_key", "n_bytes", "kept_sha256", "text"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text_key, n_bytes, n_removed, n_spans, kept_sha256, removed) of texts with their ranges."""
    for batch in batches:
        out = []
        for key, raw, sha, ranges in zip(*(batch.column(c).to_pylist() for c in ("text_key", "text", "kept_sha256", "ranges")), strict=True):
            if raw is None:
                out.append((key, 0, 0, sha, []))
                continue
            merged: list[list[int]] = []
            for r in sorted((r["lo"], r["hi"]) for r in ranges or []):
                if merged and r[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], r[1])
                else:
                    merged.append(list(r))
            digest, at = hashlib.sha256(), 0
            for lo, hi in merged:
                digest.update(raw[at:lo])
                at = hi
            digest.update(raw[at:])
            out.append((key, sum(hi - lo for lo, hi in merged), len(merged), digest.hexdigest(), [{"lo": lo, "hi": hi} for lo, hi in merged]))
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], kinds[0]), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(columns[1:], kinds[1:], strict=True))], ["text_key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])


def repeated_bytes(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (byte ranges).

    Texts are UTF-8 bytes, null counts as empty. A string repeats if it also
    starts elsewhere in any row, the same row included; overlapping ones count,
    and matches never cross rows. Equal texts of ``length`` bytes or more, rows
    that repeat an id among them, are removed whole. An empty table gives no
    rows; other columns are not read.
    """
    spark = docs.sparkSession
    result = Workspace(spark)
    texts = docs.select(text_or_empty(text_col).alias("text"))
    with Workspace(spark) as work:
        everything = work.store(texts.mapInArrow(tidy(_list_contexts(length)), "anchor long, context long, occurrence long, text_key binary, start int, strings int"))
        bits = filter_bits(everything.count(), FILTER_BITS)
        repeated = spark.sparkContext.broadcast(repeated_bits(everything.select(F.col("anchor").alias("key")), bits))

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(maybe_among(repeated.value, bits, batch.column("anchor"))))

        rows = work.store(everything.mapInArrow(tidy(keep), everything.schema))
        work.drop(everything)
        repeated.destroy()
        groups = work.store(
            rows.groupBy("anchor", "context").agg(F.min("occurrence").alias("occurrence"), F.max("occurrence").alias("other"), F.min("strings").alias("strings")).withColumn("twice", F.col("occurrence") != F.col("other")).drop("other")
        )
        open_ = groups.groupBy("anchor").agg(F.count(F.lit(1)).alias("contexts"), F.bool_or(~F.col("twice")).alias("open")).filter("contexts > 1 AND open").select("anchor", "contexts")
        open_ = work.store(open_)
        wanted = work.store(groups.join(open_.select("anchor"), "anchor").select("occurrence"))
        want_bits = filter_bits(wanted.count(), FILTER_BITS)
        keys = wanted.select(F.col("occurrence").alias("key"))
        wanted_filter = spark.sparkContext.broadcast(repeated_bits(keys.union(keys), want_bits))
        pieces = work.store(texts.mapInArrow(tidy(_cut_out(length, wanted_filter, want_bits)), "anchor long, context long, occurrence long, bytes binary"))
        wanted_filter.destroy()
        crowded = groups.join(open_.filter(F.col("contexts") > MOST_CONTEXTS).select("anchor"), "anchor").select("anchor", "context", "twice")
        few = pieces.join(open_.filter(F.col("contexts") <= MOST_CONTEXTS).select("anchor"), "anchor")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        few = few.repartition(parts, "anchor").sortWithinPartitions("anchor").select("anchor", "context", "occurrence", "bytes")
        merged = few.mapInArrow(tidy(_merge_buckets(length)), f"anchor long, context long, ranges {RANGES}")
        strings = pieces.join(crowded, ["anchor", "context"]).mapInArrow(tidy(_single_strings(length)), "anchor long, string long, occurrence long, context long, place int, twice boolean")
        strings = work.store(strings)
        twice = strings.groupBy("anchor", "string").agg(F.min("occurrence").alias("a"), F.max("occurrence").alias("b")).filter("a <> b").select("anchor", "string")
        # Contexts that occur twice are settled; their strings only count as partners.
        counted = strings.filter("NOT twice").join(twice, ["anchor", "string"]).groupBy("anchor", "context").agg(F.collect_set("place").alias("places"))
        counted = counted.select("anchor", "context", F.expr(f"transform(places, p -> named_struct('lo', p, 'hi', p + {length}))").alias("ranges"))
        partial = work.store(merged.unionByName(counted).groupBy("anchor", "context").agg(F.flatten(F.collect_list("ranges")).alias("ranges")))
        whole = groups.filter("twice").select("anchor", "context", F.expr(f"array(named_struct('lo', 0, 'hi', strings + {length - 1}))").alias("ranges"))
        partial = partial.join(whole.select("anchor", "context"), ["anchor", "context"], "left_anti")
        answers = whole.unionByName(partial)
        spans = rows.join(answers, ["anchor", "context"]).select("text_key", F.expr("transform(ranges, r -> named_struct('lo', start + r.lo, 'hi', start + r.hi))").alias("ranges"))
        by_text = result.store(spans.groupBy("text_key").agg(F.flatten(F.collect_list("ranges")).alias("ranges")))
    # Texts that occur in several rows go whole.
    narrow = result.store(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(tidy(_keys), f"doc_id {docs.select(F.col(id_col).alias('i')).schema['i'].dataType.simpleString()}, text_key binary, n_bytes long"))
    copied = narrow.filter(F.col("n_bytes") >= length).groupBy("text_key").agg(F.count(F.lit(1)).alias("n"), F.min("n_bytes").cast("int").alias("size")).filter("n > 1")
    all_ranges = result.store(by_text.join(copied, "text_key", "full").select("text_key", F.expr("CASE WHEN n > 1 THEN array(named_struct('lo', 0, 'hi', size)) ELSE ranges END").alias("ranges")))
    text_bits = filter_bits(all_ranges.count(), FILTER_BITS)
    heads = all_ranges.select("text_key").mapInArrow(tidy(_heads), "key long")
    touched = spark.sparkContext.broadcast(repeated_bits(heads.union(heads), text_bits))
    kept = result.store(texts.mapInArrow(tidy(_kept(length, touched, text_bits)), "text_key binary, n_bytes long, kept_sha256 string, text binary"))
    touched.destroy()
    clean = kept.filter("text IS NULL").select("text_key", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), "kept_sha256", F.expr(f"cast(array() AS {RANGES})").alias("removed"))
    cut = kept.filter("text IS NOT NULL").join(all_ranges, "text_key", "left").select("text_key", "n_bytes", "text", "kept_sha256", "ranges")
    cut = cut.mapInArrow(tidy(_remove), f"text_key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed {RANGES}").drop("n_bytes")
    per_text = clean.unionByName(cut).groupBy("text_key").agg(*[F.first(c).alias(c) for c in ("n_removed", "n_spans", "kept_sha256", "removed")])
    return narrow.join(per_text, "text_key").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_key, n_bytes) of every row."""
    for batch in batches:
        texts = [t.encode() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([text_key(t) for t in texts], pa.binary()), pa.array([len(t) for t in texts], pa.int64())], ["doc_id", "text_key", "n_bytes"])


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first eight bytes of each text key as a number."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([int.from_bytes(k[:8], "little", signed=True) for k in batch.column("text_key").to_pylist()], pa.int64())], ["key"])
