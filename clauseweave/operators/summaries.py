"""Aggregates per contract, per type and per feature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseweave import settings as S
from clauseweave.functions import labels as L
from clauseweave.functions import lexical as X
from clauseweave.operators.selection import exact_quantiles_of
from clauseweave.session import cut_lineage


def length_statistics(clauses: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean and population deviation of n_words, overall or per key."""
    grouped = clauses.groupBy(*keys) if keys else clauses
    return grouped.agg(
        F.avg("n_words").alias("mean_words"), F.stddev_pop("n_words").alias("std_words")
    )


def with_length_score(clauses: DataFrame, fitted: DataFrame | None = None) -> DataFrame:
    """Add length_score from ``n_words``.

    ``fitted`` is a one-row result of length_statistics on a training corpus.
    Without it each contract is its own corpus. Statistics taken while the
    contract was one row (mean_words, std_words) are used when present; else
    they are aggregated and joined back (no window, so one huge contract stays
    spread out).
    """
    if fitted is not None:
        fit = fitted.select(F.struct("mean_words", "std_words")).scalar()
        score = X.length_score(F.col("n_words"), fit["mean_words"], fit["std_words"])
        return clauses.withColumn("length_score", score)
    if "mean_words" not in clauses.columns:
        clauses = clauses.join(length_statistics(clauses, ["contract_id"]), "contract_id")
    return (
        clauses
        .withColumn(
            "length_score", X.length_score(F.col("n_words"), F.col("mean_words"), F.col("std_words"))
        )
        .drop("mean_words", "std_words")
    )


def imbalance_by_type(clauses: DataFrame) -> DataFrame:
    """Mean imbalance and count per contract and primary type."""
    typed = clauses.withColumn("clause_type", L.primary_label(F.col("clause_types"))).where("clause_type IS NOT NULL")
    # Rows without a score go by the count: Spark would push a filter on the score down
    # to the clauses and work out every feature once more for it.
    counted = typed.groupBy("contract_id", "clause_type").agg(
        F.avg("power_imbalance_score").alias("imbalance_score"),
        F.count("power_imbalance_score").alias("clause_count"),
    )
    return counted.where("clause_count > 0")


def contract_summary(clauses: DataFrame, parties: DataFrame | None = None) -> DataFrame:
    """One row per contract: counts, mean imbalance, dominant type and party.

    Aggregates by (contract, type) first, then by contract. Equal type counts
    resolve to the alphabetically first name. ``parties`` may give party names
    per contract (contract_id, party_a, party_b).
    """
    typed = clauses.select(
        "contract_id",
        L.primary_label(F.col("clause_types")).alias("primary_type"),
        "power_imbalance_score",
        "is_anomalous",
    )
    per_type = typed.groupBy("contract_id", "primary_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("power_imbalance_score").alias("total"),
        F.count("power_imbalance_score").alias("n_scored"),
        F.count_if(F.col("is_anomalous")).alias("n_anomalous"),
    )
    rank = F.when(F.col("primary_type").isNotNull(), F.struct(-F.col("n"), "primary_type"))
    out = per_type.groupBy("contract_id").agg(
        F.sum("n").alias("total_clauses"),
        F.sum("n_anomalous").alias("anomalous_clauses"),
        F.coalesce(F.sum("total") / F.nullif(F.sum("n_scored"), F.lit(0)), F.lit(0.0)).alias(
            "overall_imbalance_index"
        ),
        F.min_by("primary_type", rank).alias("dominant_clause_type"),
    )
    index = F.col("overall_imbalance_index")
    if parties is None:
        party = X.dominant_party(index)
    else:
        names = parties.select(
            "contract_id", F.col("party_a").alias("_a"), F.col("party_b").alias("_b")
        )
        out = out.join(names, "contract_id", "left")
        party = X.dominant_party(
            index, F.coalesce("_a", F.lit("Party A")), F.coalesce("_b", F.lit("Party B"))
        )
    out = out.withColumns({"dominant_party": party, "report_band": X.report_band(index)})
    return out.drop("_a", "_b")


def feature_statistics(scored: DataFrame, features: list[str], stored: bool = False) -> DataFrame:
    """mean, sample std, min, max and quartiles of each feature.

    The features are written out once (unless the caller says they are stored
    already) because the exact quartiles take a few narrow passes over all of them.
    """
    slim = scored.select(*features)
    if not stored:
        slim = cut_lineage(slim)
    wide = slim.agg(
        *[
            f(c).alias(f"{c}__{n}")
            for c in features
            for n, f in (
                ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max), ("count", F.count),
            )
        ]
    ).first()
    known = {c: (wide[f"{c}__min"], wide[f"{c}__max"], wide[f"{c}__count"]) for c in features}
    quartiles = exact_quantiles_of(slim, features, [0.25, 0.5, 0.75], known=known)
    rows = [(c, *[wide[f"{c}__{n}"] for n in ("mean", "std", "min", "max")], *quartiles[c]) for c in features]
    return scored.sparkSession.createDataFrame(
        rows, "feature string, mean double, std double, min double, max double, p25 double, p50 double, p75 double"
    )


def analysis_rows(summary: DataFrame, metadata: Column, created_at: Column) -> DataFrame:
    """Append-only analysis results with their metadata as JSON text."""
    return summary.select(
        "contract_id",
        "overall_imbalance_index",
        "total_clauses",
        "anomalous_clauses",
        "dominant_clause_type",
        F.to_json(metadata).alias("analysis_metadata"),
        created_at.alias("created_at"),
    )


def latest_parties(results: DataFrame) -> DataFrame:
    """Party names of the newest result per contract (of equal times the last metadata text); defaults where unreadable."""
    newest = results.groupBy("contract_id").agg(
        F.max(F.struct("created_at", "analysis_metadata"))["analysis_metadata"].alias("analysis_metadata")
    )
    meta = F.from_json("analysis_metadata", "party_a string, party_b string")
    return newest.select(
        "contract_id",
        F.coalesce(meta["party_a"], F.lit("Party A")).alias("party_a"),
        F.coalesce(meta["party_b"], F.lit("Party B")).alias("party_b"),
    )


def anomalous_clauses(clauses: DataFrame) -> DataFrame:
    return clauses.where(F.col("is_anomalous"))


def unscored_clauses(clauses: DataFrame, contract_id: str | None = None) -> DataFrame:
    out = clauses.where(F.col("anomaly_score").isNull())
    return out if contract_id is None else out.where(F.col("contract_id") == contract_id)


def report_rows(clauses: DataFrame, contract_id: str, limit: int | None = None) -> DataFrame:
    """The clause table of one contract's report."""
    return report_table(clauses.where(F.col("contract_id") == contract_id), limit)


def report_table(clauses: DataFrame, limit: int | None = None) -> DataFrame:
    """The report rows of every contract by position, with the contract's number of clauses.

    A layout may take the first ``limit`` rows; by default there are all.
    """
    total = F.count(F.lit(1)).over(Window.partitionBy("contract_id"))
    order = Window.partitionBy("contract_id").orderBy("position", "clause_id")
    numbered = clauses.withColumn("total_rows", total).withColumn("row_no", F.row_number().over(order))
    return _report_columns(numbered if limit is None else numbered.where(F.col("row_no") <= limit))


def _report_columns(first: DataFrame) -> DataFrame:
    label = F.coalesce(L.primary_label(F.col("clause_types")), F.lit("Unclassified"))
    return first.select(
        "contract_id",
        F.col("row_no"),
        F.col("total_rows"),
        label.alias("clause_type"),
        F.when(F.col("anomaly_score").isNotNull(), F.format_string("%.1f", "anomaly_score"))
        .otherwise("N/A").alias("anomaly_score"),
        F.when(F.col("is_anomalous"), "YES").otherwise("NO").alias("anomaly_flag"),
        F.when(F.col("power_imbalance_score").isNotNull(), F.format_string("%+.1f", F.round("power_imbalance_score", 1)))
        .otherwise("N/A").alias("imbalance_score"),
        F.coalesce("imbalance_label", F.lit("N/A")).alias("label"),
    )


def high_imbalance_count(clauses: DataFrame) -> DataFrame:
    return clauses.groupBy("contract_id").agg(
        F.count_if(F.col("imbalance_label").contains("HIGH")).alias("high_imbalance_clauses")
    )
