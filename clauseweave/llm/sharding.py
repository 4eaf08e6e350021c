"""Shards by a hierarchical weighted hash tree, with built-in functions only.

A row descends from regions to racks to shards by weighted hash draws. A shard
draws an exponential variate from the hash of the key and its name, divided by
its weight; a rack draws the least of its shards, a region the least of its racks,
which are variates of the weight under them. At each level the smallest draw
wins. Rows move only into or out of subtrees whose weights change, and a shard
added anywhere takes rows only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseweave.llm.common import gapless_index, text_or_empty

#: Rows are numbered within a shard by this many hash buckets.
SLOT_BUCKETS = 1024


@dataclass(frozen=True)
class Topology:
    """Region to rack to shard to weight; names are stable identities, weights positive."""

    regions: tuple[tuple[str, tuple[tuple[str, tuple[tuple[int, float], ...]], ...]], ...]

    def shards(self) -> list[int]:
        return [s for _, racks in self.regions for _, leaves in racks for s, _ in leaves]

    def grown(self, weight: float = 1.0) -> Topology:
        """One more shard, in a region of its own."""
        new = max(self.shards(), default=-1) + 1
        return Topology((*self.regions, (f"region-of-{new}", ((f"rack-of-{new}", ((new, weight),)),))))


def topology(shards: int, racks_per_region: int = 2, shards_per_rack: int = 5) -> Topology:
    """Regions of racks of shards, filled in order; the last ones may be partly filled."""
    size = racks_per_region * shards_per_rack
    regions = []
    for r in range(0, shards, size):
        racks = []
        for k in range(r, min(r + size, shards), shards_per_rack):
            racks.append((f"region{r // size}-rack{(k - r) // shards_per_rack}", tuple((s, 1.0) for s in range(k, min(k + shards_per_rack, shards)))))
        regions.append((f"region{r // size}", tuple(racks)))
    return Topology(tuple(regions))


def _literal(tree: Topology) -> Column:
    """The tree as one constant: regions of racks of shards, each shard with its name and weight."""
    regions = []
    for _, racks in tree.regions:
        below = []
        for _, leaves in racks:
            shards = ", ".join(f"struct('shard{s}' AS name, {float(w)!r}D AS weight, {s} AS shard)" for s, w in leaves)
            below.append(f"array({shards})")
        regions.append(f"array({', '.join(below)})")
    return F.expr(f"array({', '.join(regions)})")


def shard_of(key: Column, tree: Topology) -> Column:
    """The shard of a key: the region, rack and shard of least draw.

    A shard draws an exponential variate of its weight from 52 bits of a hash of
    its name and the key; equal draws go to the lower number. A rack's draw is
    the least of its shards', a region's the least of its racks': that is again an
    exponential variate, of the weight of all below. So a change of weight in a
    subtree moves rows into or out of that subtree only, and a new shard,
    wherever it stands, takes rows into itself only.
    """
    key = F.coalesce(key.cast("string"), F.lit("null"))

    def draw(child: Column) -> Column:
        uniform = (F.shiftrightunsigned(F.xxhash64(child["name"], key), 12).cast("double") + 0.5) / F.lit(float(1 << 52))
        return F.struct((-F.log(uniform) / child["weight"]).alias("draw"), child["shard"].alias("shard"))

    def least(racks: Column) -> Column:
        return F.array_min(F.transform(racks, lambda leaves: F.array_min(F.transform(leaves, draw))))

    return F.array_min(F.transform(_literal(tree), least))["shard"]


def assign_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", slot_buckets: int = SLOT_BUCKETS, place: tuple[str, str] | None = None) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The key alone decides the shard (law ``key``); a null key is a key like any
    other, rows with one key share a shard. Size is the text's UTF-8 bytes plus
    16; null text counts as empty. Slots are gapless from 0 in each shard; rows
    equal in key, size and checksum get their slots in any order. ``place`` names
    two columns, a run of the table and a number within it: slots then follow that
    order. An empty table gives no rows.
    """
    tree = topology(shards)
    text, key = text_or_empty(text_col), F.col(id_col)
    placed = docs.select(
        key.alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(key, tree).alias("shard"),
        shard_of(key, tree.grown()).alias("grown_shard"),
        *[F.col(c).alias(name) for c, name in zip(place or (), ("_run", "_at"), strict=False)],
    )
    if place is None:
        numbered = gapless_index(placed, ["shard"], F.col("doc_id"), [F.col("size"), F.col("text_crc32")], slot_buckets, "slot")
    else:
        numbered = gapless_index(placed, ["shard"], F.col("_at"), [], slot_buckets, "slot", run=F.col("_run"))
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
