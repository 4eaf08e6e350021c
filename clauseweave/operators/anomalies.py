"""Anomaly scoring of clause embeddings: isolation forest, reconstruction, fusion.

The forest is fitted on bounded samples, all trees level by level; its draws come
from digests, so any engine can repeat them. The reconstruction signal is the
error left by a linear (principal component) bottleneck or by a trained
autoencoder (``operators.network``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseweave import settings as S
from clauseweave.functions import ids
from clauseweave.functions import vectors as V
from clauseweave.functions.lexical import clip
from clauseweave.operators.network import Network, fit_network, score_network
from clauseweave.operators.selection import (
    discrete_quantiles,
    exact_quantiles,
    key_cutoff,
    numbered_by_key,
)
from clauseweave.session import cut_lineage, scratch


def _mean_path(n: int) -> float:
    """Average depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n


def sample_for_trees(
    embeddings: DataFrame, id_col: str, vector_col: str, trees: int, rows_per_tree: int, seed: int
) -> DataFrame:
    """(tree, vector) rows: at most trees x rows_per_tree of them, seeded.

    The rows with the smallest hash form the pool. Each tree takes a run of
    consecutive pool rows, wrapping around when the pool is small.
    """
    keyed = embeddings.select(
        F.col(vector_col).alias("vector"), ids.order_key(F.col(id_col), seed).alias("_key")
    )
    slots = trees * rows_per_tree
    size = keyed.count()
    pool = keyed
    if size > slots:
        pool = keyed.where(F.col("_key") <= key_cutoff(keyed, "_key", slots))
    pool_size = min(size, slots)
    per_tree = min(rows_per_tree, pool_size)
    numbered = numbered_by_key(pool, "_key")
    last = F.lit(trees * per_tree - 1).cast("long")
    own = F.explode_outer(F.sequence(F.col("position"), last, F.lit(pool_size).cast("long")))
    return numbered.where(F.col("position") <= last).select("vector", own.alias("slot")).select(
        F.floor(F.col("slot") / per_tree).cast("int").alias("tree"), "vector"
    )


def _mean_path_of(n: Column) -> Column:
    """``_mean_path`` of a count column."""
    far = F.lit(2.0) * (F.log(n - 1) + F.lit(float(np.euler_gamma))) - F.lit(2.0) * (n - 1) / n
    return F.when(n <= 1, 0.0).when(n == 2, 1.0).otherwise(far)


def _drawn(seed: int, dim: int) -> tuple[Column, Column]:
    """The feature and the share of its range at which a node is cut, from a digest of seed, tree and node."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("tree").cast("string"), F.col("node").cast("string")))
    number = [F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9)]
    return (number[0] % dim).cast("int"), number[1] / float(1 << 32)


def _next_features(points: DataFrame, stuck: DataFrame, dim: int) -> DataFrame:
    """For nodes whose drawn feature is constant: the next one, in a circle, that is not, and its range."""
    ranges = points.join(F.broadcast(stuck.select("tree", "node", "feature")), ["tree", "node"]).select("tree", "node", "feature", F.posexplode("vector").alias("other", "x"))
    wide = ranges.groupBy("tree", "node", "feature", "other").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where("lo < hi")
    near = F.struct(F.pmod(F.col("other") - F.col("feature"), F.lit(dim)).alias("step"), F.col("other").alias("feature"), "lo", "hi")
    return wide.groupBy("tree", "node").agg(F.min(near).alias("next"))


def fit_isolation_forest(
    embeddings: DataFrame,
    id_col: str,
    vector_col: str,
    trees: int = S.FOREST_TREES,
    rows_per_tree: int = S.FOREST_SAMPLE_ROWS,
    seed: int = S.SEED,
) -> DataFrame:
    """One row per tree, nodes in heap order; each tree sees a bounded sample.

    All trees grow together, a level at a time: one aggregate finds the range of
    the feature that each node draws, one join sends its points to the children.
    A level has at most trees x rows_per_tree points, whatever the input.
    """
    depth = max(1, math.ceil(math.log2(max(rows_per_tree, 2))))
    sample = sample_for_trees(embeddings, id_col, vector_col, trees, rows_per_tree, seed)
    levels = []
    with scratch(embeddings.sparkSession):
        points = cut_lineage(sample.select("tree", F.lit(0).alias("node"), F.col("vector").cast("array<double>").alias("vector")))
        dim = points.agg(F.max(F.size("vector"))).first()[0] or 1
        for level in range(depth + 1):
            feature, share = _drawn(seed, dim)
            drawn = points.withColumns({"feature": feature, "share": share}).withColumn("x", F.element_at("vector", F.col("feature") + 1))
            nodes = cut_lineage(drawn.groupBy("tree", "node", "feature", "share").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")))
            constant = (F.col("n") > 1) & (F.col("lo") == F.col("hi")) & F.lit(level < depth)
            wide = (F.col("n") > 1) & (F.col("lo") < F.col("hi")) & F.lit(level < depth)
            any_constant, any_wide = nodes.agg(F.max(constant), F.max(wide)).first()
            if any_constant:
                found = _next_features(points, nodes.where(constant), dim)
                joined = nodes.join(F.broadcast(found), ["tree", "node"], "left")
                nodes = cut_lineage(joined.select("tree", "node", "share", "n", *[F.coalesce(f"next.{c}", c).alias(c) for c in ("feature", "lo", "hi")]))
                any_wide = True
            cut = F.col("lo") + F.col("share") * (F.col("hi") - F.col("lo"))
            grown = nodes.select(
                "tree", "node", F.when(wide, F.col("feature")).otherwise(-1).alias("feature"), F.when(wide, cut).otherwise(0.0).alias("threshold"),
                F.when(wide, 0.0).otherwise(level + _mean_path_of(F.col("n"))).alias("path"),
            )
            levels.append(grown)
            if not any_wide:
                break
            inner = grown.where("feature >= 0")
            # At most one node a point.
            right = F.element_at("vector", F.col("feature") + 1) > F.col("threshold")
            sent = points.join(F.broadcast(inner.drop("path")), ["tree", "node"])
            points = cut_lineage(sent.select("tree", (2 * F.col("node") + 1 + right.cast("int")).alias("node"), "vector"))
        known = levels[0]
        for more in levels[1:]:
            known = known.unionByName(more)
        tree = known.groupBy("tree").agg(F.map_from_entries(F.collect_list(F.struct("node", F.struct("feature", "threshold", "path")))).alias("at"))
        every = F.sequence(F.lit(0), F.lit(2 ** (depth + 1) - 2))
        # A child that no sample row reached ends a path at its own depth.
        arrays = [
            F.transform(every, lambda i: F.coalesce(F.try_element_at("at", i)["feature"], F.lit(-1))).alias("feature"),
            F.transform(every, lambda i: F.coalesce(F.try_element_at("at", i)["threshold"], F.lit(0.0))).alias("threshold"),
            F.transform(every, lambda i: F.coalesce(F.try_element_at("at", i)["path"], F.floor(F.log2(i + 1.0)).cast("double"))).alias("path"),
        ]
        return cut_lineage(tree.select("tree", *arrays), keep=True)


def forest_score(model: DataFrame, vector_col: str, rows_per_tree: int = S.FOREST_SAMPLE_ROWS) -> Column:
    """Negated anomaly score: lower means more isolated.

    The model is bounded (trees x nodes), so it is collected once and broadcast.
    """
    rows = model.orderBy("tree").collect()
    feature = np.array([r.feature for r in rows])
    threshold = np.array([r.threshold for r in rows])
    path = np.array([r.path for r in rows])
    shared = model.sparkSession.sparkContext.broadcast((feature, threshold, path))
    scale = _mean_path(rows_per_tree) or 1.0
    steps = int(math.log2(feature.shape[1] + 1)) - 1

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        feat, cut, length = shared.value
        trees = np.arange(len(feat))
        for batch in batches:
            if len(batch) == 0:
                yield pd.Series([], dtype=float)
                continue
            x = np.stack(batch.to_numpy()).astype(float)
            node = np.zeros((len(x), len(feat)), dtype=np.int64)
            for _ in range(steps):
                f = feat[trees, node]
                right = np.take_along_axis(x, np.maximum(f, 0), axis=1) > cut[trees, node]
                node = np.where(f >= 0, 2 * node + 1 + right, node)
            yield pd.Series(-np.exp2(-length[trees, node].mean(axis=1) / scale))

    return score(F.col(vector_col))


def forest_decision(
    scored: DataFrame, score_col: str = "forest_raw", contamination: float = S.FOREST_CONTAMINATION
) -> DataFrame:
    """Add if_score: the score less its contamination quantile (negative: outlier).

    Finding the quantile reads the scores several times, so store them before.
    """
    offset = exact_quantiles(scored, score_col, [contamination])[0]
    return scored.withColumn("if_score", F.col(score_col) - F.lit(offset))


def fit_reconstruction(embeddings: DataFrame, vector_col: str, components: int) -> DataFrame:
    """The linear model as one row: centre, and one array for each principal component."""
    staged = embeddings.select(array_to_vector(F.col(vector_col).cast("array<double>")).alias("_vec"))
    centre = StandardScaler(withMean=True, withStd=False, inputCol="_vec", outputCol="_centred").fit(staged)
    model = PCA(k=components, inputCol="_centred", outputCol="_pc").fit(centre.transform(staged))
    axes = [[float(x) for x in axis] for axis in model.pc.toArray().T]
    row = [([float(x) for x in centre.mean.toArray()], axes)]
    return embeddings.sparkSession.createDataFrame(row, "centre array<double>, axes array<array<double>>")


def score_reconstruction(embeddings: DataFrame, model: DataFrame, vector_col: str) -> DataFrame:
    """Add ae_score: mean squared error left by the model, principal components or a network.

    For orthonormal components the residual is |x|^2 - |P x|^2 of the centred
    vector, so the vector need not be rebuilt. The model is one row of bounded
    size, which becomes part of the expression.
    """
    if "weights" in model.columns:
        return score_network(embeddings, Network.of(model), vector_col)
    fitted = model.first()
    centred = F.zip_with(F.col(vector_col).cast("array<double>"), F.lit(fitted.centre), lambda x, c: x - c)
    explained = F.lit(0.0)
    for axis in fitted.axes:
        along = V.dot(F.lit(axis), F.col("_x"))
        explained = explained + along * along
    left_over = (V.dot(F.col("_x"), F.col("_x")) - explained) / F.size("_x")
    return embeddings.withColumn("_x", centred).withColumn("ae_score", F.greatest(F.lit(0.0), left_over)).drop("_x")


def reconstruction_error(embeddings: DataFrame, vector_col: str, components: int) -> DataFrame:
    """Add ae_score by a model fitted on the rows themselves."""
    return score_reconstruction(embeddings, fit_reconstruction(embeddings, vector_col, components), vector_col)


def score_bounds(scored: DataFrame) -> DataFrame:
    """One row with the fitted range of both raw scores (forest inverted)."""
    return scored.agg(
        F.min(-F.col("if_score")).alias("if_low"), F.max(-F.col("if_score")).alias("if_high"),
        F.min("ae_score").alias("ae_low"), F.max("ae_score").alias("ae_high"),
    )


def fuse(scored: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Normalise both scores to 0..100 by the fitted bounds and average them.

    ``bounds`` is a one-row score_bounds of the training rows; by default the
    rows themselves are the training set.
    """
    bounds = score_bounds(scored) if bounds is None else bounds
    bound = bounds.select(F.struct(*bounds.columns)).scalar()

    def scaled(value: Column, low: Column, high: Column) -> Column:
        width = F.when(high - low == 0, F.lit(1.0)).otherwise(high - low)
        return clip((value - low) / width * 100, 0.0, 100.0)

    out = scored.withColumns(
        {
            "if_normalised": scaled(-F.col("if_score"), bound["if_low"], bound["if_high"]),
            "ae_normalised": scaled(F.col("ae_score"), bound["ae_low"], bound["ae_high"]),
        }
    )
    out = out.withColumn(
        "combined_score",
        S.FOREST_WEIGHT * F.col("if_normalised") + S.RECONSTRUCTION_WEIGHT * F.col("ae_normalised"),
    )
    return out.withColumn("is_anomalous", F.col("combined_score") > S.ANOMALY_FLAG_ABOVE)


@dataclass(frozen=True)
class AnomalyModel:
    """What scoring needs of the training rows: bounded tables and two numbers.

    ``forest`` has one row a tree, ``reconstruction`` one row (components or a
    network), ``limits`` one row with the contamination offset, the range of both
    raw scores and the rows of a tree.
    """

    forest: DataFrame
    reconstruction: DataFrame
    limits: DataFrame

    def save(self, folder: str) -> None:
        for name in ("forest", "reconstruction", "limits"):
            getattr(self, name).write.mode("overwrite").parquet(f"{folder}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> AnomalyModel:
        return cls(*[spark.read.parquet(f"{folder}/{name}") for name in ("forest", "reconstruction", "limits")])


def fit_anomalies(embeddings: DataFrame, id_col: str, vector_col: str, components: int, contamination: float = S.FOREST_CONTAMINATION, hidden: Sequence[int] | None = None) -> AnomalyModel:
    """Fit both signals, the offset and the score ranges on training rows.

    With ``hidden`` (the layers down to the bottleneck) a network reconstructs,
    else ``components`` principal components.
    """
    rows_per_tree = max(1, min(S.FOREST_SAMPLE_ROWS, embeddings.count()))
    forest = fit_isolation_forest(embeddings, id_col, vector_col)
    if hidden:
        reconstruction = cut_lineage(fit_network(embeddings, vector_col, hidden).table(embeddings.sparkSession))
    else:
        reconstruction = cut_lineage(fit_reconstruction(embeddings, vector_col, components))
    with_forest = embeddings.withColumn("forest_raw", forest_score(forest, vector_col, rows_per_tree))
    scored = cut_lineage(score_reconstruction(with_forest, reconstruction, vector_col).select("forest_raw", "ae_score"))
    offset = exact_quantiles(scored, "forest_raw", [contamination])[0]
    bounds = score_bounds(scored.withColumn("if_score", F.col("forest_raw") - F.lit(offset)))
    limits = bounds.withColumn("offset", F.lit(offset)).withColumn("rows_per_tree", F.lit(rows_per_tree))
    return AnomalyModel(forest, reconstruction, cut_lineage(limits))


def score_anomalies(embeddings: DataFrame, model: AnomalyModel, vector_col: str) -> DataFrame:
    """Score any rows, one contract's too, by what was fitted before."""
    limits = model.limits.first()  # one row
    with_forest = embeddings.withColumn("forest_raw", forest_score(model.forest, vector_col, limits.rows_per_tree))
    scored = score_reconstruction(with_forest, model.reconstruction, vector_col)
    decided = scored.withColumn("if_score", F.col("forest_raw") - F.lit(limits.offset))
    return fuse(decided, model.limits.select("if_low", "if_high", "ae_low", "ae_high"))


def score_embeddings(embeddings: DataFrame, id_col: str, vector_col: str, components: int, hidden: Sequence[int] | None = None) -> DataFrame:
    """Both signals and their fusion for every row, fitted on the rows themselves."""
    return score_anomalies(embeddings, fit_anomalies(embeddings, id_col, vector_col, components, hidden=hidden), vector_col)


def proxy_labels(clauses: DataFrame, words_col: str = "n_words") -> DataFrame:
    """Add proxy_anomaly: under 15 words, or above the 95th percentile of length."""
    p95 = discrete_quantiles(clauses, words_col, [S.PROXY_LONG_QUANTILE], ["p95"]).scalar()
    flag = (F.col(words_col) < S.PROXY_SHORT_WORDS) | (F.col(words_col) > p95)
    return clauses.withColumn("proxy_anomaly", flag.cast("int"))


def precision_recall_at_k(
    labelled: DataFrame, k: int, score_col: str, label_col: str, id_col: str
) -> DataFrame:
    """Precision and recall of the k highest scores; ties fall to the lower id."""
    # Ranking and counting both read these three columns.
    labelled = cut_lineage(labelled.select(id_col, score_col, label_col))
    top = labelled.orderBy(F.desc(score_col), id_col).limit(k)
    totals = labelled.agg(
        F.count(F.lit(1)).alias("test_size"), F.coalesce(F.sum(label_col), F.lit(0)).alias("proxy_anomalies")
    )
    known = totals.select(F.struct("test_size", "proxy_anomalies")).scalar()
    positives = known["proxy_anomalies"]
    return top.agg(
        F.avg(label_col).alias("precision_at_k"),
        (F.sum(label_col) / F.greatest(positives, F.lit(1))).alias("recall_at_k"),
        F.lit(k).alias("k"),
        F.max(known["test_size"]).alias("test_size"),
        F.max(positives).alias("proxy_anomalies"),
    )
