"""Exact order statistics without gathering a group in one task.

A seeded hash key is uniform, so its three leading hex digits cut any group
into 4096 even buckets. Counts per bucket tell in which bucket the k-th key
lies; only the rows of that bucket are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_DIGITS = 3


def _bucket(key: str) -> Column:
    return F.substring(F.col(key), 1, BUCKET_DIGITS)


def key_cutoffs(df: DataFrame, groups: Sequence[str], key: str, targets: DataFrame) -> DataFrame:
    """The k-th smallest hash key of each group.

    ``targets`` holds (groups..., k), k >= 1 and at most the group's size, one
    row per wanted order statistic. Returns targets plus ``cutoff``.
    """
    groups = list(groups)
    slim = df.select(*groups, F.col(key).alias("_key"), _bucket(key).alias("_bucket"))
    histogram = slim.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy(*groups).orderBy("_bucket")
    cumulative = histogram.withColumn("_upto", F.sum("_n").over(running))
    hit = (
        cumulative.join(targets, groups)
        .where((F.col("_upto") >= F.col("k")) & (F.col("_upto") - F.col("_n") < F.col("k")))
        .select(*groups, "_bucket", "k", (F.col("k") - F.col("_upto") + F.col("_n")).alias("_at"))
    )
    inside = slim.join(hit.select(*groups, "_bucket").distinct(), [*groups, "_bucket"], "left_semi")
    numbered = inside.withColumn(
        "_at", F.row_number().over(Window.partitionBy(*groups, "_bucket").orderBy("_key"))
    )
    return numbered.join(hit, [*groups, "_bucket", "_at"]).select(
        *groups, "k", F.col("_key").alias("cutoff")
    )


def key_cutoff(df: DataFrame, key: str, k: int) -> str | None:
    """The k-th smallest hash key of a whole table; None when there is none."""
    slim = df.select(F.col(key).alias("_key"), _bucket(key).alias("_bucket"))
    counts = slim.groupBy("_bucket").count().orderBy("_bucket").collect()  # at most 4096 rows
    before = 0
    for row in counts:
        if before + row["count"] >= k > before:
            inside = slim.where(F.col("_bucket") == row["_bucket"])
            nth = F.row_number().over(Window.partitionBy("_bucket").orderBy("_key"))
            return inside.withColumn("_at", nth).where(F.col("_at") == k - before).first()["_key"]
        before += row["count"]
    return None


def numbered_by_key(df: DataFrame, key: str, position: str = "position") -> DataFrame:
    """Global 0-based numbering in hash-key order, sorted bucket by bucket."""
    staged = df.withColumn("_bucket", _bucket(key))
    counts = staged.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(key))
    return (
        staged.withColumn("_within", within)
        .join(offsets, "_bucket")
        .withColumn(position, F.col("_before") + F.col("_within") - 1)
        .drop("_bucket", "_within", "_before")
    )


def discrete_quantiles(
    df: DataFrame, value: str, probabilities: Sequence[float], names: Sequence[str]
) -> DataFrame:
    """Linear-interpolated quantiles of an integer-like column, as one row.

    Works on counts per distinct value, so it fits columns such as word counts
    whose distinct values are few. Lazy, one pass over the data.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    upto = F.sum("_n").over(Window.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("_n").over(Window.partitionBy())
    ranked = counts.withColumns({"_upto": upto, "_total": total})
    picks = []
    for p, name in zip(probabilities, names, strict=True):
        at = (F.col("_total") - 1) * F.lit(float(p))
        low = F.min(F.when(F.col("_upto") > F.floor(at), F.col("_v").cast("double")))
        high = F.min(F.when(F.col("_upto") > F.ceil(at), F.col("_v").cast("double")))
        share = F.max(at - F.floor(at))
        picks.append((low + (high - low) * share).alias(name))
    return ranked.agg(*picks)


def exact_quantiles(
    df: DataFrame,
    value: str,
    probabilities: Sequence[float],
    cells: int = 4096,
    known: tuple[float, float, int] | None = None,
) -> list[float]:
    """``exact_quantiles_of`` for one column."""
    return exact_quantiles_of(df, [value], probabilities, cells, None if known is None else {value: known})[value]


def exact_quantiles_of(
    df: DataFrame,
    values: Sequence[str],
    probabilities: Sequence[float],
    cells: int = 4096,
    known: dict[str, tuple[float, float, int]] | None = None,
) -> dict[str, list[float]]:
    """Linear-interpolated quantiles of double columns, exact at any size.

    Narrows the ranges around all wanted ranks of all columns together: each
    histogram pass is one scan with a small aggregate, and ends where a cell holds
    a single value. Give stored columns (see ``cut_lineage``) when computing them
    is costly, and ``known`` (min, max, count) when those are at hand.
    """
    if known is None:
        named = [f(F.col(v).cast("double")) for v in values for f in (F.min, F.max, F.count)]
        row = df.agg(*[c.alias(f"c{i}") for i, c in enumerate(named)]).first()
        known = {v: (row[3 * i], row[3 * i + 1], row[3 * i + 2]) for i, v in enumerate(values)}
    found: dict[tuple[str, int], float] = {}
    #: Open ranges: column, low, high, rows below the range, wanted ranks in it.
    ranges = []
    for v in values:
        low, high, count = known[v]
        ranks = sorted({r for p in probabilities for r in _neighbour_ranks(p, count)}) if count else []
        if ranks:
            ranges.append((v, low, high, 0, ranks))
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("v")) for v in values]))
    slim = df.select(pairs.alias("p")).select("p.name", "p.v").where("v IS NOT NULL")
    while ranges:
        closed = [r for r in ranges if r[1] == r[2]]
        found |= {(v, r): low for v, low, _, _, ranks in closed for r in ranks}
        ranges = [r for r in ranges if r[1] != r[2]]
        if not ranges:
            break
        table = df.sparkSession.createDataFrame([(i, v, low, high) for i, (v, low, high, _, _) in enumerate(ranges)], "range int, name string, low double, high double")
        inside = slim.join(F.broadcast(table), "name").where(F.col("v").between(F.col("low"), F.col("high")))
        # Too narrow for cells of their own, neighbours are told apart by value.
        width = (F.col("high") - F.col("low")) / cells
        cell = F.when(F.col("low") + width > F.col("low"), F.least(F.floor((F.col("v") - F.col("low")) / width), F.lit(cells - 1)).cast("double")).otherwise(F.col("v"))
        histogram = (
            inside.groupBy("range", cell.alias("cell"))
            .agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            .orderBy("range", "cell")
            .collect()  # at most ``cells`` rows a range
        )
        narrower = []
        below = {i: r[3] for i, r in enumerate(ranges)}
        for row in histogram:
            v, _, _, _, ranks = ranges[row["range"]]
            here = [r for r in ranks if below[row["range"]] <= r < below[row["range"]] + row.n]
            if here:
                narrower.append((v, row.lo, row.hi, below[row["range"]], here))
            below[row["range"]] += row.n
        ranges = narrower
    out: dict[str, list[float]] = {}
    for v in values:
        count = known[v][2]
        out[v] = []
        for p in probabilities:
            if not count:
                out[v].append(float("nan"))
                continue
            lo, hi = _neighbour_ranks(p, count)
            share = (count - 1) * p - lo
            out[v].append(found[v, lo] + (found[v, hi] - found[v, lo]) * share)
    return out


def _neighbour_ranks(p: float, count: int) -> tuple[int, int]:
    at = (count - 1) * p
    lo = int(at)
    return lo, min(lo + (1 if at > lo else 0), count - 1)
