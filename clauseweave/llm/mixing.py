"""Mixing sources to target weights by Pfair scheduling, with built-in functions only.

Each source is cut into blocks. Block j (from 1) of a source of weight w is
released at slot floor((j-1)/w) and due at slot ceil(j/w); in every slot the
released block with the earliest deadline goes next, so at any slot t a source
has got more than w*t - 1 and less than w*t + 1 blocks.

Weights are whole numbers of very many parts, so that releases and deadlines are
exact and no drift adds up from slot to slot. A phase ends when a source has no
block left; the others then share the slots by their weights. The driver deals
out blocks, never rows, and hands them over in pieces of bounded size; rows meet
their block by a join.

Of more sources than one heap takes, the largest go as they are and all others
as one stream, whose slots are dealt in the same way to groups of sources and at
last to the sources of each group: their windows count slots of their group.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseweave.llm.common import gapless_index
from clauseweave.session import cut_lineage

#: Rows of a block, parts that weights are measured in, streams dealt together, buckets for numbering rows, slots handed over together.
BLOCK_ROWS, CYCLE, MAX_STREAMS, ROW_BUCKETS, PIECE = 16, 1 << 40, 256, 1024, 1 << 20
OTHER = "(other)"


@dataclass(frozen=True)
class Phase:
    """The slots between two endings of sources."""

    first_slot: int
    length: int
    cycle: int
    shares: dict[str, int]
    template: dict[str, list[int]]
    first_block: dict[str, int]


def whole_shares(weights: dict[str, float], cycle: int = CYCLE) -> dict[str, int]:
    """Shares of at least 1 next to weight times cycle, by largest remainders; they sum to the cycle unless some weigh under 1."""
    total = sum(weights.values())
    exact = {s: w / total * cycle for s, w in weights.items()}
    shares = {s: max(1, int(x)) for s, x in exact.items()}
    left = max(0, cycle - sum(shares.values()))
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[:left]:
        shares[s] += 1
    return shares


def deadline_order(shares: dict[str, int]) -> Iterator[tuple[str, int]]:
    """Without end, for each slot the source and its block (from 0) with the earliest deadline among the released."""
    cycle = sum(shares.values())
    waiting = sorted((0, -(-cycle // k), s, 0) for s, k in shares.items())
    ready: list[tuple[int, str, int]] = []
    for slot in itertools.count():
        while waiting and waiting[0][0] <= slot:
            _, due, source, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due, source, j))
        _, source, j = heapq.heappop(ready)
        yield source, j
        heapq.heappush(waiting, ((j + 1) * cycle // shares[source], -(-(j + 2) * cycle // shares[source]), source, j + 1))


def deadline_template(shares: dict[str, int]) -> dict[str, list[int]]:
    """For each source the slots of its blocks in one cycle."""
    slots: dict[str, list[int]] = {s: [] for s in shares}
    for slot, (source, _) in enumerate(itertools.islice(deadline_order(shares), sum(shares.values()))):
        slots[source].append(slot)
    return slots


def dealt(blocks: dict[str, int], weights: dict[str, float], cycle: int = CYCLE) -> Iterator[tuple[str, int, int, int, int]]:
    """For each slot source, block, phase, release and deadline; every block of every source is placed once."""
    left = {s: n for s, n in blocks.items() if n}
    for phase in itertools.count():
        if not left:
            return
        shares, first = whole_shares({s: weights[s] for s in left}, cycle), {s: blocks[s] - n for s, n in left.items()}
        size = sum(shares.values())
        for source, j in deadline_order(shares):
            yield source, first[source] + j, phase, j * size // shares[source], -(-(j + 1) * size // shares[source])
            left[source] -= 1
            if not left[source]:
                del left[source]
                break


def mixture(blocks: dict[str, int], weights: dict[str, float], cycle: int = CYCLE, most: int = MAX_STREAMS, top: bool = True) -> Iterator[tuple[str, int, int, int, int]]:
    """As ``dealt``, of any number of sources: at most ``most`` and one share a heap, the others are groups of sources."""
    names = sorted((s for s, n in blocks.items() if n), key=lambda s: (-weights[s], s))
    if len(names) <= most:
        yield from dealt({s: blocks[s] for s in names}, weights, cycle)
        return
    size = -(-len(names) // most)
    groups = [*([s] for s in names[:most]), names[most:]] if top else [names[i : i + size] for i in range(0, len(names), size)]
    inner = {g[0]: mixture({s: blocks[s] for s in g}, weights, cycle, most, False) for g in groups if len(g) > 1}
    for group, *own in dealt({g[0]: sum(blocks[s] for s in g) for g in groups}, {g[0]: sum(weights[s] for s in g) for g in groups}, cycle):
        yield next(inner[group]) if group in inner else (group, *own)


def phases(blocks: dict[str, int], weights: dict[str, float], cycle: int = CYCLE) -> list[Phase]:
    """The phases of ``dealt`` with all their slots, for small plans; at most one phase a source."""
    out, slot = [], 0
    for _, part in itertools.groupby(dealt(blocks, weights, cycle), key=lambda x: x[2]):
        template: dict[str, list[int]] = {}
        first: dict[str, int] = {}
        length = 0
        for length, (source, block, *_) in enumerate(part, 1):
            template.setdefault(source, []).append(length - 1)
            first.setdefault(source, block)
        out.append(Phase(slot, length, length, {s: len(x) for s, x in template.items()}, template, first))
        slot += length
    return out


def temperature_weights(counts: dict[str, int], exponent: float) -> dict[str, float]:
    """Weights in proportion to a power of the counts: 1 keeps the proportions, 0 makes sources equal."""
    return {s: n**exponent for s, n in counts.items() if n}


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    exponent: float = 0.5,
    block_rows: int = BLOCK_ROWS,
    cycle: int = CYCLE,
    id_col: str = "doc_id",
    source_col: str = "source",
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per input row: doc_id, source, stream, block, phase, slot, release, deadline, position, and the columns to ``keep``.

    ``weights`` maps sources to positive target weights; sources without one
    (null included) share the stream ``(other)``, whose weight is the smallest
    given. Without ``weights`` they are the counts to the power ``exponent`` of
    all sources, null being ``(other)``. Every row is placed: positions are
    gapless from 0. Rows that repeat an id get their places by source and the columns
    to ``keep`` (narrow ones, say where the row is stored), else in any order. Release
    and deadline count slots from the start of the phase, those of sources beyond
    the 256 of most weight slots of their group. An empty table gives no rows.
    One count a stream reaches the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), *keep)
    if weights is None:
        streams = rows.withColumn("stream", F.coalesce("source", F.lit(OTHER)))
    elif any(w <= 0 for w in weights.values()):
        raise ValueError("weights are positive")
    else:
        listed = F.broadcast(spark.createDataFrame([(s, s) for s in weights], "source string, stream string"))
        streams = rows.join(listed, "source", "left").select("doc_id", "source", *keep, F.coalesce("stream", F.lit(OTHER)).alias("stream"))
    numbered = cut_lineage(gapless_index(streams, ["stream"], F.col("doc_id"), [F.col(c) for c in ("source", *keep)], ROW_BUCKETS, "_row"))
    counts = {r.stream: r.n for r in numbered.groupBy("stream").agg(F.count(F.lit(1)).alias("n")).collect()}
    target = temperature_weights(counts, exponent) if weights is None else {OTHER: min(weights.values(), default=1.0), **weights}
    blocks = {s: -(-n // block_rows) for s, n in counts.items()}
    placed = numbered.withColumn("block", F.floor(F.col("_row") / block_rows).cast("long")).join(_slots(spark, mixture(blocks, target, cycle), counts, block_rows), ["stream", "block"])
    position = F.col("_start") + F.col("_row") % block_rows
    return placed.select("doc_id", "source", "stream", "block", "phase", "slot", "release", "deadline", position.alias("position"), *keep)


def _slots(spark: SparkSession, order: Iterator[tuple[str, int, int, int, int]], counts: dict[str, int], block_rows: int) -> DataFrame:
    """The dealt blocks as a table with their slot and the position of their first row."""
    kinds = {"stream": pa.string(), "block": pa.int64(), "phase": pa.int32(), "release": pa.int64(), "deadline": pa.int64(), "slot": pa.int64(), "_start": pa.int64()}
    out, slot, start = None, 0, 0
    while piece := list(itertools.islice(order, PIECE)) or out is None:
        columns = [list(c) for c in zip(*piece, strict=True)] if piece is not True else [[] for _ in range(5)]
        starts = []
        for source, block in zip(*columns[:2], strict=True):
            starts.append(start)
            start += min(block_rows, counts[source] - block * block_rows)
        columns += [list(range(slot, slot + len(starts))), starts]
        slot += len(starts)
        part = spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds)))
        out = part if out is None else out.union(cut_lineage(part))
    return out
