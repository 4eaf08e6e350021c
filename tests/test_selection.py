from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from clauseweave.functions import ids
from clauseweave.operators.keyed import apply_updates, first_per_key, merge_names
from clauseweave.operators.selection import (
    discrete_quantiles,
    exact_quantiles,
    key_cutoffs,
    numbered_by_key,
)
from clauseweave.operators.splits import stratified_split


def key(i, seed=7):
    return hashlib.md5(f"{i}|{seed}".encode()).hexdigest()


def test_cutoffs_and_numbering_with_a_hot_group(spark):
    df = spark.range(30_000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g")
    ).withColumn("key", ids.order_key(F.col("id"), 7))
    targets = spark.createDataFrame([("hot", 1), ("hot", 5000), ("hot", 10_000), ("g1", 3)], "g string, k long")
    got = {(r.g, r.k): r.cutoff for r in key_cutoffs(df, ["g"], "key", targets).collect()}
    hot = sorted(key(i) for i in range(0, 30_000, 3))
    g1 = sorted(key(i) for i in range(30_000) if i % 3 and i % 50 == 1)
    assert got == {("hot", 1): hot[0], ("hot", 5000): hot[4999], ("hot", 10_000): hot[-1], ("g1", 3): g1[2]}
    numbers = {r.id: r.position for r in numbered_by_key(df, "key").select("id", "position").collect()}
    order = sorted(range(30_000), key=key)
    assert all(numbers[i] == n for n, i in enumerate(order))


@pytest.mark.parametrize("cells", [2, 64, 4096])
def test_exact_quantiles(spark, cells):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=3000), np.full(2000, 0.5), rng.exponential(1e6, 500), [1e-300, -1e12]])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    probabilities = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = exact_quantiles(df, "v", probabilities, cells=cells)
    assert got == pytest.approx(list(np.quantile(values, probabilities)), rel=1e-12)


def test_discrete_quantiles(spark):
    values = [1, 1, 1, 2, 3, 50, 51, 9, 9]
    df = spark.createDataFrame([(v,) for v in values], "v int")
    row = discrete_quantiles(df, "v", [0.5, 0.95, 0.33], ["a", "b", "c"]).first()
    assert list(row) == pytest.approx(list(np.quantile(values, [0.5, 0.95, 0.33])))


def split_input(spark):
    rows = spark.range(4000).select(
        F.col("id").cast("string").alias("clause_id"),
        F.when(F.col("id") % 3 == 0, "Big").when(F.col("id") < 12, "Rare").otherwise(F.concat(F.lit("T"), F.col("id") % 7)).alias("primary_type"),
        F.when(F.col("id") % 5 < 3, "EDGAR_auto").otherwise("CUAD").alias("source"),
    )
    return rows


def test_split_rules(spark):
    df = split_input(spark)
    rows = stratified_split(df).collect()
    assert {r.clause_id: r.split for r in rows} == {
        r.clause_id: r.split for r in stratified_split(df.repartition(3)).collect()
    }
    assert len({r.clause_id for r in rows}) == len(rows)
    human = [r for r in rows if r.source == "CUAD"]
    assert len(human) == df.where("source = 'CUAD'").count()
    assert all(r.split == "train" for r in rows if r.source != "CUAD" or r.primary_type == "Rare")
    big = [r.split for r in human if r.primary_type == "Big"]
    held = (2 * len(big) + 5) // 10
    assert (big.count("val"), big.count("test")) == (held // 2, held - held // 2)
    train = sum(r.split == "train" for r in human)
    machine = len(rows) - len(human)
    assert machine == min(int(train * 0.4 / 0.6), df.where("source <> 'CUAD'").count())


def test_split_without_machine_rows_and_with_few(spark):
    human = split_input(spark).where("source = 'CUAD'")
    assert stratified_split(human).count() == human.count()
    few = human.unionByName(split_input(spark).where("source <> 'CUAD' AND clause_id < 40"))
    assert stratified_split(few).count() == few.count()
    only_machine = split_input(spark).where("source <> 'CUAD'")
    assert stratified_split(only_machine).count() == 0


def test_training_cap(spark):
    rows = stratified_split(split_input(spark), train_cap_per_type=25).where("split = 'train'")
    counts = {r.primary_type: r["count"] for r in rows.groupBy("primary_type").count().collect()}
    assert counts["Big"] == 25 and max(counts.values()) == 25


def test_first_per_key_reduces_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    out = first_per_key(df, ["k"], [F.col("id")])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert {tuple(r) for r in out.collect()} == {(0, 0), (1, 1)}


def test_merge_names_keeps_order(spark):
    known = spark.createDataFrame([("B", 0), ("A", 1)], "name string, position long")
    added = spark.createDataFrame([("A", 0), ("C", 1), ("C", 2), ("Aa", 3)], "name string, position long")
    rows = merge_names(known, added).orderBy("position").collect()
    assert [(r.name, r.position) for r in rows] == [("B", 0), ("A", 1), ("C", 2), ("Aa", 3)]


def test_updates_can_set_null(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(1, None, 5)], "id int, v string, w int")
    rows = {r.id: (r.v, r.w) for r in apply_updates(base, new, "id").collect()}
    assert rows == {1: (None, 5), 2: ("b", None)}


def test_split_makes_its_clauses_once(spark, tmp_path):
    """The result reads what was stored for the cutoffs, not the clauses' source again."""
    path = str(tmp_path / "clauses")
    rows = [(f"id{i}", "a" if i % 3 else "b", "CUAD" if i % 4 else "EDGAR_auto") for i in range(200)]
    spark.createDataFrame(rows, "clause_id string, primary_type string, source string").write.parquet(path)
    out = stratified_split(spark.read.parquet(path))
    assert out.count() > 0
    assert not any(path in f for f in out.inputFiles())
