from __future__ import annotations

import collections
import math
import zlib

import pytest
import xxhash

from clauseweave.llm.sharding import assign_shards, shard_of, topology
from pyspark.sql import functions as F


def test_contract_on_odd_rows(odd):
    found = assign_shards(odd, shards=7, slot_buckets=4).collect()
    texts = {r.doc_id: r.text or "" for r in odd.collect() if r.doc_id is not None}
    assert len(found) == odd.count()
    slots = collections.defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < 7 and r.law == "key" and r.grown_shard in (r.shard, 7)
        if r.doc_id is not None:
            raw = texts[r.doc_id].encode()
            assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    for i in texts:
        assert len({r.shard for r in found if r.doc_id == i}) == 1


def test_no_rows(nothing):
    assert assign_shards(nothing).collect() == []


def test_growth_takes_only_into_the_new_shard_and_shares_are_even(spark):
    tree = topology(40)
    ids = spark.range(40_000).select("id", shard_of(F.col("id"), tree).alias("a"), shard_of(F.col("id"), tree.grown()).alias("b"), shard_of(F.col("id"), tree.grown().grown()).alias("c"))
    rows = ids.collect()
    assert all(r.b in (r.a, 40) and r.c in (r.b, 41) for r in rows)
    counts = collections.Counter(r.a for r in rows)
    assert set(counts) == set(range(40)) and max(counts.values()) < 1.25 * 1000 and min(counts.values()) > 0.75 * 1000
    assert 700 < sum(r.b == 40 for r in rows) < 1300


def test_weight_change_moves_rows_only_into_the_grown_subtree(spark):
    tree = topology(20)
    region, (rack, other) = tree.regions[0]
    heavier = (rack[0], tuple((s, w * (3 if s == 2 else 1)) for s, w in rack[1]))
    grown = type(tree)(((region, (heavier, other)), *tree.regions[1:]))
    rows = spark.range(20_000).select(shard_of(F.col("id"), tree).alias("a"), shard_of(F.col("id"), grown).alias("b")).collect()
    moved = [(r.a, r.b) for r in rows if r.a != r.b]
    # Region 0 grew: rows enter it from outside, and move in it only towards the rack and shard that grew.
    assert moved and all(b < 10 for _, b in moved)
    assert all(b < 5 for a, b in moved if a < 10) and all(b == 2 for a, b in moved if a < 5)


def test_every_count_of_shards():
    for n in range(1, 45):
        assert sorted(topology(n).shards()) == list(range(n))


def plain_shard(key, tree):
    """The level-by-level choice, recomputed with another implementation of the hash."""

    def draw(leaf):
        shard, weight = leaf
        name = xxhash.xxh64_intdigest(f"shard{shard}".encode(), 42)
        word = xxhash.xxh64_intdigest(str(key).encode(), name) >> 12
        return -math.log((word + 0.5) / (1 << 52)) / weight, shard

    region = min(tree.regions, key=lambda r: min(draw(x) for _, leaves in r[1] for x in leaves))
    rack = min(region[1], key=lambda r: min(draw(x) for x in r[1]))
    return min(draw(x) for x in rack[1])[1]


def test_shards_recomputed(spark):
    for tree in (topology(40), topology(13).grown(2.5), topology(1)):
        rows = spark.range(-50, 1500).select("id", shard_of(F.col("id"), tree).alias("a")).collect()
        assert [r.a for r in rows] == [plain_shard(r.id, tree) for r in rows]


@pytest.mark.parametrize("first", [1, 9, 49, 99])
def test_a_grown_tree_places_like_one_of_that_count(spark, first):
    """Also at full racks and regions: every next count takes rows into its last shard only."""
    counts = range(first, first + 13)
    ids = spark.range(3000).select("id", *[shard_of(F.col("id"), topology(n)).alias(f"s{n}") for n in counts], *[shard_of(F.col("id"), topology(n).grown()).alias(f"g{n}") for n in counts])
    for r in ids.collect():
        for n in counts:
            assert r[f"g{n}"] in (r[f"s{n}"], n)
            if n + 1 in counts:
                assert r[f"g{n}"] == r[f"s{n + 1}"]
