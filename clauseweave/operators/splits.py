"""Label cleanup and the deterministic stratified train/val/test split.

Rows are ordered inside a type by a seeded hash of clause_id. The split is
decided by comparing that hash with a few cutoffs per type, so clause texts
never move for it.

Sizes per type with n rows: held out = n * 20% rounded half up, of which the
smaller half is validation and the rest test. Types with fewer than 10 rows,
and held-out parts of fewer than 2, stay in training.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseweave import settings as S
from clauseweave.functions import ids
from clauseweave.functions import labels as L
from clauseweave.functions import text as T
from clauseweave.operators.selection import key_cutoff, key_cutoffs
from clauseweave.session import cut_lineage, small_side


def clean_labelled(
    clauses: DataFrame,
    taxonomy: Sequence[str] = S.CLAUSE_TYPES,
    max_labels: int | None = S.MAX_LABELS_PER_CLAUSE,
    max_chars: int | None = S.MAX_CLAUSE_CHARS,
) -> DataFrame:
    """Known labels only (the first ``max_labels``), <omitted> stripped, length limits applied; None is no limit."""
    labelled = clauses.withColumn("clause_types", L.known_labels(F.col("clause_types"), taxonomy, max_labels))
    labelled = labelled.where(F.size("clause_types") > 0)
    labelled = labelled.withColumn("clause_text", T.strip_omitted(F.col("clause_text")))
    if max_chars is not None:
        labelled = labelled.where(F.length("clause_text") <= max_chars)
    return labelled.where(T.word_count(F.col("clause_text")) >= S.MIN_CLAUSE_WORDS)


def with_primary_type(clauses: DataFrame) -> DataFrame:
    return clauses.withColumn(
        "primary_type", F.coalesce(L.primary_label(F.col("clause_types")), F.lit("Unknown"))
    )


def stratified_split(
    clauses: DataFrame,
    seed: int = S.SEED,
    auto_share: float = S.AUTO_LABEL_SHARE_OF_TRAIN,
    train_cap_per_type: int | None = None,
) -> DataFrame:
    """Add ``split``; machine-labelled rows beyond their share are dropped.

    Needs clause_id (unique), primary_type and source. Validation and test come
    from human-labelled rows only.
    """
    keyed = clauses.withColumns(
        {
            "_key": ids.order_key(F.col("clause_id"), seed),
            "_auto": F.coalesce(F.col("source").startswith(S.AUTO_SOURCE_PREFIX), F.lit(False)),
        }
    )
    # The cutoffs and the result take several passes, so what made the clauses runs once.
    keyed = cut_lineage(keyed)
    slim = keyed.select("primary_type", "_key", "_auto")
    by_type = slim.groupBy("primary_type", "_auto").agg(F.count(F.lit(1)).alias("n"))
    held_out = (
        F.when(F.col("n") < S.MIN_TYPE_COUNT_FOR_EVAL, F.lit(0))
        .otherwise(F.floor((F.col("n") * 2 + 5) / 10))
        .cast("long")
    )
    sizes = (
        by_type.where(~F.col("_auto"))
        .withColumn("_held", held_out)
        .withColumn("_held", F.when(F.col("_held") < S.MIN_HELD_OUT_COUNT, 0).otherwise(F.col("_held")))
        .withColumn("_val", F.floor(F.col("_held") / 2).cast("long"))
    )
    targets = sizes.where("_held > 0").select(
        "primary_type", F.explode(F.array("_val", "_held")).alias("k")
    )
    cutoffs = key_cutoffs(slim.where(~F.col("_auto")), ["primary_type"], "_key", targets)
    per_type = small_side(
        cutoffs.groupBy("primary_type").agg(
            F.min("cutoff").alias("_val_cut"), F.max("cutoff").alias("_held_cut")
        )
    )

    # Machine-labelled rows allowed next to the human training rows.
    human_train = F.coalesce(F.sum(F.col("n") - F.col("_held")), F.lit(0))
    room = sizes.agg(F.floor(human_train * F.lit(auto_share) / F.lit(1 - auto_share)).cast("long")).first()[0]
    machine = slim.where("_auto")
    if room >= machine.count():
        keep_auto = F.lit(True)
    elif room < 1:
        keep_auto = F.lit(False)
    else:
        keep_auto = F.col("_key") <= key_cutoff(machine, "_key", room)

    split = (
        F.when(F.col("_auto"), F.when(keep_auto, F.lit("train")))
        .when(F.col("_key") <= F.col("_val_cut"), F.lit("val"))
        .when(F.col("_key") <= F.col("_held_cut"), F.lit("test"))
        .otherwise(F.lit("train"))
    )
    out = keyed.join(per_type, "primary_type", "left").withColumn("split", split)
    out = out.where("split IS NOT NULL").drop("_val_cut", "_held_cut", "_auto")
    if train_cap_per_type is not None:
        trained = slim.join(per_type, "primary_type", "left").where(split == "train")
        out = _cap_training(out, trained, train_cap_per_type)
    return out.drop("_key")


def _cap_training(split: DataFrame, trained: DataFrame, cap: int) -> DataFrame:
    """Keep the ``cap`` training rows of each type with the smallest hash."""
    slim = trained.select("primary_type", "_key")
    targets = (
        slim.groupBy("primary_type").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > cap)
        .select("primary_type", F.lit(cap).cast("long").alias("k"))
    )
    cut = key_cutoffs(slim, ["primary_type"], "_key", targets).select("primary_type", "cutoff")
    return (
        split.join(small_side(cut), "primary_type", "left")
        .where((F.col("split") != "train") | F.col("cutoff").isNull() | (F.col("_key") <= F.col("cutoff")))
        .drop("cutoff")
    )


def split_counts(split: DataFrame) -> DataFrame:
    return split.groupBy("split", "primary_type").agg(F.count(F.lit(1)).alias("n_clauses"))


def shuffled(df: DataFrame, seed: int = S.SEED, id_col: str = "clause_id") -> DataFrame:
    """Rows in seeded hash order, for a sink whose reader wants them mixed."""
    return df.orderBy(ids.order_key(F.col(id_col), seed))
