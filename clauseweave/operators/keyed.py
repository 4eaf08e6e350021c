"""Operators on keys: first row, insert-if-absent, ordered distinct merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseweave.session import cut_lineage


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep the first row of every key in the given order.

    Spark pushes the ``row_number() = 1`` filter below the shuffle, so each task
    sends at most one row per key and a heavily repeated key stays cheap.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_row", F.row_number().over(window)).where("_row = 1").drop("_row")
    )


def first_k_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank_col: str
) -> DataFrame:
    """First k rows of every key with their 1-based rank."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(window)).where(F.col(rank_col) <= k)


def absent_rows(incoming: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``incoming`` whose key ``existing`` lacks."""
    return incoming.join(existing.select(*keys), list(keys), "left_anti")


def absent_from_store(incoming: DataFrame, store: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``absent_rows`` for a batch that is small against the store.

    An anti join cannot broadcast the batch, so it would shuffle every stored
    key. The stored keys that the batch has are found first: there the batch's
    keys are the side that Spark broadcasts when their size allows, and only the
    few hits meet the batch again. Give a stored batch: it is read twice.
    """
    hits = store.select(*keys).join(incoming.select(*keys), list(keys), "left_semi")
    return incoming.join(hits.distinct(), list(keys), "left_anti")


def merge_keep_existing(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column]
) -> DataFrame:
    """Append the first incoming row of every key that is not there yet.

    ``existing`` is the result of earlier merges, so its keys are unique already
    and its rows neither move nor sort. The batch is computed once.
    """
    fresh = absent_from_store(cut_lineage(first_per_key(incoming, keys, order)), existing, keys)
    return existing.unionByName(fresh, allowMissingColumns=True)


def merge_names(known: DataFrame, added: DataFrame) -> DataFrame:
    """Ordered distinct merge of (name, position) lists: known names first.

    Returns (name, position) with positions renumbered from 0. The lists are
    taxonomy names, one per discovered type, so the numbering window is small.
    """
    both = known.select("name", F.lit(0).alias("part"), "position").unionByName(
        added.select("name", F.lit(1).alias("part"), "position")
    )
    firsts = both.groupBy("name").agg(F.min(F.struct("part", "position")).alias("seen"))
    order = Window.orderBy("seen.part", "seen.position", "name")
    return firsts.select("name", (F.row_number().over(order) - 1).alias("position"))


def new_names(names: DataFrame, known: DataFrame) -> DataFrame:
    """The distinct non-empty names that are not known yet."""
    return absent_rows(names.select("name").where("name <> ''").distinct(), known, ["name"])


def apply_updates(base: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Overwrite columns of ``base`` with matching rows of ``updates``.

    Every row of base survives; a base row without an update keeps its values.
    """
    changed = [c for c in updates.columns if c != key]
    renamed = updates.select(
        F.col(key), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in changed]
    )
    joined = base.join(renamed, key, "left")
    out = [
        F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
        if c in changed
        else F.col(c)
        for c in base.columns
    ]
    return joined.select(*out, *[F.col(f"_new_{c}").alias(c) for c in changed if c not in base.columns])
