"""Classifier evaluation and tuning as grouped aggregates.

Long per-class rows are reduced in the map stage: whatever the corpus size, the
shuffles carry at most (candidates x classes x 10) counters per task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseweave import settings as S
from clauseweave.functions.probabilities import logit
from clauseweave.operators.neighbours import matrix
from clauseweave.session import cut_lineage


def _ratio(top: Column, bottom: Column) -> Column:
    """top / bottom with 0 / 0 = 0."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def class_counts(predictions: DataFrame, taxonomy: Sequence[str]) -> DataFrame:
    """tp, fp, fn per class, including classes nobody used.

    ``predictions`` has array<string> columns ``y_true`` and ``y_pred``. Labels
    outside the taxonomy are ignored. Only labels that occur are exploded.
    """
    used = predictions.select(
        "y_true", "y_pred", F.explode_outer(F.array_union("y_true", "y_pred")).alias("class")
    ).where("class IS NOT NULL")
    truth = F.array_contains("y_true", F.col("class"))
    guess = F.array_contains("y_pred", F.col("class"))
    flags = used.select(
        "class",
        (truth & guess).cast("int").alias("tp"),
        (~truth & guess).cast("int").alias("fp"),
        (truth & ~guess).cast("int").alias("fn"),
    )
    sums = flags.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    names = predictions.sparkSession.createDataFrame(
        [(i, t) for i, t in enumerate(taxonomy)], "class_idx int, class string"
    )
    return names.join(sums, "class", "left").fillna(0, ["tp", "fp", "fn"])


def classification_report(predictions: DataFrame, taxonomy: Sequence[str]) -> DataFrame:
    """Per-class rows plus micro, macro, weighted and samples averages.

    Columns: section ('class' or 'average'), name, precision, recall, f1, support.
    """
    counts = class_counts(predictions, taxonomy)
    scored = counts.select("class", *_prf(), (F.col("tp") + F.col("fn")).alias("support"), "tp", "fp", "fn")
    per_class = scored.select(
        F.lit("class").alias("section"), F.col("class").alias("name"),
        "precision", "recall", "f1", F.col("support").cast("long").alias("support"),
    )
    support = F.sum("support")
    sums = scored.agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
        support.cast("long").alias("support"),
        *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")],
        *[_ratio(F.sum(F.col(m) * F.col("support")), support).alias(f"weighted_{m}")
          for m in ("precision", "recall", "f1")],
    ).withColumns({f"micro_{m}": c for m, c in zip(("precision", "recall", "f1"), _prf_columns())})
    rows = F.explode(
        F.array(*[
            F.struct(
                F.lit(f"{kind} avg").alias("name"),
                F.col(f"{kind}_precision").alias("precision"),
                F.col(f"{kind}_recall").alias("recall"),
                F.col(f"{kind}_f1").alias("f1"),
            )
            for kind in ("micro", "macro", "weighted")
        ])
    )
    averages = sums.select("support", rows.alias("r")).select(
        F.lit("average").alias("section"), "r.name", "r.precision", "r.recall", "r.f1", "support"
    )
    return per_class.unionByName(averages).unionByName(_sample_average(predictions, taxonomy))


def _sample_average(predictions: DataFrame, taxonomy: Sequence[str]) -> DataFrame:
    def known(c: str) -> Column:
        return F.array_distinct(F.filter(c, lambda x: x.isin(*taxonomy)))

    sizes = predictions.select(known("y_true").alias("t"), known("y_pred").alias("p")).select(
        F.size(F.array_intersect("t", "p")).alias("both"), F.size("t").alias("t"), F.size("p").alias("p")
    )
    both, t, p = F.col("both"), F.col("t"), F.col("p")
    return sizes.agg(
        F.avg(_ratio(both, p)).alias("precision"),
        F.avg(_ratio(both, t)).alias("recall"),
        F.avg(_ratio(2 * both, t + p)).alias("f1"),
        F.sum(t).cast("long").alias("support"),
    ).select(
        F.lit("average").alias("section"), F.lit("samples avg").alias("name"),
        "precision", "recall", "f1", "support",
    )


def _prf_columns() -> list[Column]:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return [_ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(2 * tp, 2 * tp + fp + fn)]


def _prf() -> list[Column]:
    return [c.alias(n) for c, n in zip(_prf_columns(), ("precision", "recall", "f1"))]


# --- Tuning ------------------------------------------------------------------

def _long(scored: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """(extra..., class_idx, p, y) from arrays ``probabilities`` and ``labels``."""
    pairs = F.arrays_zip(F.col("probabilities").alias("p"), F.col("labels").alias("y"))
    rows = scored.select(*extra, F.posexplode_outer(pairs).alias("class_idx", "z")).where("z IS NOT NULL")
    return rows.select(
        *extra, "class_idx", F.col("z.p").alias("p"), F.col("z.y").alias("y")
    )


def threshold_search(scored: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Best threshold per class by F1; ties go to the lowest threshold.

    A class without positives keeps 0.5. Probabilities are put in ten bins by
    the number of grid values they reach, so the grid costs one pass.
    """
    return _best_thresholds(_long(scored, extra), extra)


def _best_thresholds(long: DataFrame, extra: Sequence[str]) -> DataFrame:
    keys = [*extra, "class_idx"]
    reached = sum(((F.col("p") >= t).cast("int") for t in S.THRESHOLD_GRID), F.lit(0))
    bins = long.groupBy(*keys, reached.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")
    )

    def summed(column: str, least: int) -> Column:
        return F.sum(F.when(F.col("bin") >= least, F.col(column)).otherwise(0))

    grid = list(enumerate(S.THRESHOLD_GRID, start=1))
    totals = bins.groupBy(*keys).agg(
        F.sum("pos").alias("positives"),
        F.array(*[
            F.struct(F.lit(t).alias("t"), summed("pos", i).alias("tp"), summed("n", i).alias("flagged"))
            for i, t in grid
        ]).alias("grid"),
    )
    # Order by F1 descending, then threshold ascending: smallest struct wins.
    ranked = F.array_min(
        F.transform(
            "grid",
            lambda g: F.struct(
                (-_ratio(2 * g["tp"], F.col("positives") + g["flagged"])).alias("neg_f1"),
                g["t"].alias("t"),
            ),
        )
    )
    return totals.withColumn("_best", ranked).select(
        *keys,
        F.when(F.col("positives") == 0, F.lit(S.DEFAULT_CLASS_THRESHOLD))
        .otherwise(F.col("_best.t")).alias("threshold"),
        F.when(F.col("positives") == 0, F.lit(0.0)).otherwise(-F.col("_best.neg_f1")).alias("f1"),
        F.col("positives").cast("long").alias("positives"),
    )


def temperature_search(scored: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Temperature of the lowest mean cross-entropy; ties go to the lowest.

    All sixteen losses are summed side by side in one aggregate.
    """
    return _best_temperature(_long(scored, extra), extra)


def _best_temperature(long: DataFrame, extra: Sequence[str]) -> DataFrame:
    with_logit = long.select(*extra, logit(F.col("p")).alias("x"), F.col("y").cast("double").alias("y"))

    def loss(t: float) -> Column:
        z = F.col("x") / F.lit(t)
        return F.avg(F.greatest(z, F.lit(0.0)) - z * F.col("y") + F.log1p(F.exp(-F.abs(z))))

    losses = F.array_min(
        F.array(*[F.struct(loss(t).alias("nll"), F.lit(t).alias("t")) for t in S.TEMPERATURE_GRID])
    )
    grouped = with_logit.groupBy(*extra) if extra else with_logit
    return grouped.agg(losses.alias("_best")).select(
        *extra, F.col("_best.t").alias("temperature"), F.col("_best.nll").alias("nll")
    )


def weight_candidates(models: Sequence[str]) -> list[tuple[int, str, list[float]]]:
    """(order, name, weights) of single models, pairs and the triple, 0.1 steps."""
    tenths = range(11)
    grid: list[tuple[str, list[float]]] = []
    for i, name in enumerate(models):
        grid.append((name, [1.0 if j == i else 0.0 for j in range(len(models))]))
    for i in range(len(models)):
        for j in range(i + 1, len(models)):
            for a in tenths:
                weights = [0.0] * len(models)
                weights[i], weights[j] = a / 10, (10 - a) / 10
                grid.append((f"ensemble_{models[i]}_{models[j]}", weights))
    if len(models) == 3:
        for a in tenths:
            for b in range(11 - a):
                grid.append(("ensemble", [a / 10, b / 10, (10 - a - b) / 10]))
    return [(order, name, weights) for order, (name, weights) in enumerate(grid)]


def _edges() -> np.ndarray:
    """The log-odds at which some temperature puts a probability on a threshold of the grid, ascending."""
    odds = np.log(np.array(S.THRESHOLD_GRID) / (1 - np.array(S.THRESHOLD_GRID)))
    return np.unique(np.multiply.outer(np.array(S.TEMPERATURE_GRID), odds))


def blend_counts(scored: DataFrame, models: Sequence[str], labels: str, weights: Sequence[Sequence[float]]) -> DataFrame:
    """(candidate, classes, counts): what every later choice needs of a blend, from one pass over the scores.

    A temperature moves thresholds, not the order of probabilities: p passes a
    threshold at a temperature when its log-odds pass a fixed edge. So each task
    counts, for each blend and class, rows and positives between all such edges,
    and adds up the loss of each temperature; arrays of all tasks are added by
    element.
    """
    wanted = scored.select(*models, labels).where(F.col(labels).isNotNull())
    edges, blends, temperatures = _edges(), np.array(weights), np.array(S.TEMPERATURE_GRID)
    cells = len(edges) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: np.ndarray | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            p = np.stack([matrix(batch.column(m)) for m in models]).astype(float)
            y = matrix(batch.column(labels)).astype(float)
            rows, classes = y.shape
            if totals is None:
                totals = np.zeros((len(blends), len(temperatures) + 1 + 2 * classes * cells))
            place = np.broadcast_to(np.arange(classes) * cells, y.shape).ravel()
            for c, w in enumerate(blends):
                mixed = np.zeros(y.shape)
                for share, one in zip(w, p, strict=True):
                    mixed = mixed + share * one
                clipped = np.clip(mixed, S.PROBABILITY_EPSILON, 1 - S.PROBABILITY_EPSILON)
                x = np.log(clipped / (1 - clipped))
                for i, t in enumerate(temperatures):
                    z = x / t
                    totals[c, i] += (np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))).sum()
                totals[c, len(temperatures)] += y.size
                cell = place + np.searchsorted(edges, x.ravel(), side="right")
                at = len(temperatures) + 1
                totals[c, at : at + classes * cells] += np.bincount(cell, minlength=classes * cells)
                totals[c, at + classes * cells :] += np.bincount(cell, weights=y.ravel(), minlength=classes * cells)
        if totals is not None:
            n, width = totals.shape
            listed = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(totals.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n), pa.int32()), listed], ["candidate", "counts"])

    sent = wanted.mapInArrow(count, "candidate int, counts array<double>").select("candidate", array_to_vector("counts").alias("v"))
    return sent.groupBy("candidate").agg(vector_to_array(Summarizer.sum(F.col("v"))).alias("counts"))


def _judged_blend(counts: np.ndarray) -> tuple[float, float, list[float]]:
    """Temperature of least loss, macro F1 and best thresholds of one blend; ties go to the lowest."""
    edges, grid, temperatures = _edges(), np.array(S.THRESHOLD_GRID), np.array(S.TEMPERATURE_GRID)
    cells, at = len(edges) + 1, len(temperatures) + 1
    classes = (len(counts) - at) // (2 * cells)
    temperature = float(temperatures[int(np.argmin(counts[: at - 1] / max(counts[at - 1], 1)))])
    rows, positive = counts[at:].reshape(2, classes, cells)
    first = np.searchsorted(edges, temperature * np.log(grid / (1 - grid)) - 1e-12) + 1
    above = [x[:, ::-1].cumsum(axis=1)[:, ::-1][:, first] for x in (rows, positive)]
    flagged, hits = above
    positives = positive.sum(axis=1)
    f1 = np.where(positives[:, None] > 0, 2 * hits / np.maximum(positives[:, None] + flagged, 1), 0.0)
    best = f1.argmax(axis=1)
    thresholds = np.where(positives > 0, grid[best], S.DEFAULT_CLASS_THRESHOLD)
    return temperature, float(f1[np.arange(classes), best].mean()), thresholds.tolist()


def ensemble_search(scored: DataFrame, models: Sequence[str], labels: str = "labels") -> DataFrame:
    """Temperature, thresholds and macro F1 of every blend, best first wins.

    ``scored`` has one array<double> column per model and an int array of
    labels, all of one length. Returns one row per candidate with ``is_winner`` on
    the best (ties: the earliest candidate). The scores are read once.
    """
    candidates = weight_candidates(models)
    table = F.broadcast(
        scored.sparkSession.createDataFrame(candidates, "candidate int, name string, weights array<double>")
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_judged_blend(np.array(c)) for c in batch.column("counts").to_pylist()]
            columns = [batch.column("candidate"), *[pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.float64(), pa.float64(), pa.list_(pa.float64())))]]
            yield pa.RecordBatch.from_arrays(columns, ["candidate", "temperature", "f1_macro", "thresholds"])

    # One row a candidate from here on.
    counts = blend_counts(scored, models, labels, [w for _, _, w in candidates])
    judged = cut_lineage(counts.mapInArrow(judge, "candidate int, temperature double, f1_macro double, thresholds array<double>"))
    winner = judged.agg(F.max_by("candidate", F.struct("f1_macro", -F.col("candidate"))).alias("w"))
    rows = table.join(judged, "candidate").select("candidate", "name", "weights", "f1_macro", "thresholds", "temperature")
    return rows.withColumn("is_winner", F.col("candidate") == winner.scalar())


def metric_rows(report: DataFrame, component: str) -> DataFrame:
    """A report as append-only (component, metric, value) rows."""
    values = F.explode(
        F.array(*[
            F.struct(F.lit(m).alias("m"), F.col(m).cast("double").alias("v"))
            for m in ("precision", "recall", "f1", "support")
        ])
    )
    return report.select("name", values.alias("x")).select(
        F.lit(component).alias("component"),
        F.concat_ws(".", "name", "x.m").alias("metric"),
        F.col("x.v").alias("value"),
    )


def max_pool(chunk_probabilities: DataFrame, key: str, column: str = "probabilities") -> DataFrame:
    """Largest probability per class over all chunks of a clause, in one aggregate.

    One maximum a class, partly taken before the shuffle. All chunks have one length.
    """
    chunks = chunk_probabilities.where(F.size(column) > 0)
    head = chunks.select(F.size(column)).first()
    if head is None:
        return chunks.select(key, column)
    largest = [F.max(F.get(column, F.lit(i)).cast("double")).alias(f"_{i}") for i in range(head[0])]
    return chunks.groupBy(key).agg(*largest).select(key, F.array(*[f"_{i}" for i in range(head[0])]).alias(column))
