"""Autoencoder of embeddings, trained by all tasks together.

The network (rectified hidden layers down to a bottleneck and up again, linear
output) is small, the rows are many. A step broadcasts the weights, every task
passes over its rows and sends one summed gradient, the gradients are added up by
position in two stages, and the driver makes one quasi-Newton step. The result is
that of one machine over all rows, whatever the partitions, up to rounding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseweave import settings as S
from clauseweave.operators.neighbours import matrix

#: Partial sums between the tasks and the total.
PARTIAL_SUMS = 64
STEP_ROWS = 4096
#: What a rectifier lets through below zero, so that no unit is lost for good.
LEAK = 0.01
NETWORK = "sizes array<int>, centre array<double>, scale double, weights array<double>"


@dataclass(frozen=True)
class Network:
    """Layer sizes, weights in one array, and how rows are centred and scaled before."""

    sizes: tuple[int, ...]
    centre: np.ndarray
    scale: float
    weights: np.ndarray

    def table(self, spark: SparkSession) -> DataFrame:
        """As one row, to store."""
        row = (list(self.sizes), self.centre.tolist(), float(self.scale), self.weights.tolist())
        return spark.createDataFrame([row], NETWORK)

    @classmethod
    def of(cls, table: DataFrame) -> Network:
        row = table.first()
        return cls(tuple(row.sizes), np.array(row.centre), row.scale, np.array(row.weights))


def layer_sizes(dim: int, hidden: Sequence[int]) -> tuple[int, ...]:
    """Input, hidden layers to the bottleneck and back, output."""
    return (dim, *hidden, *reversed(hidden[:-1]), dim)


def unpacked(sizes: Sequence[int], weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Matrix and offset of each layer, as views of the one array."""
    out, at = [], 0
    for a, b in zip(sizes[:-1], sizes[1:], strict=True):
        out.append((weights[at : at + a * b].reshape(a, b), weights[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def first_weights(sizes: Sequence[int], seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    parts = []
    for a, b in zip(sizes[:-1], sizes[1:], strict=True):
        parts += [rng.normal(size=a * b) * np.sqrt(2.0 / a), np.full(b, 0.1)]
    return np.concatenate(parts)


def forward(sizes: Sequence[int], weights: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
    """Output of every layer; the last is linear."""
    layers = unpacked(sizes, weights)
    out = [x]
    for i, (w, b) in enumerate(layers):
        z = out[-1] @ w + b
        out.append(z if i == len(layers) - 1 else np.maximum(z, LEAK * z))
    return out


def summed_gradient(sizes: Sequence[int], weights: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray]:
    """Sum over rows of the mean squared error, and its gradient."""
    out = forward(sizes, weights, x)
    off = out[-1] - x
    layers = unpacked(sizes, weights)
    back = 2.0 * off / x.shape[1]
    parts: list[np.ndarray] = []
    for i in range(len(layers) - 1, -1, -1):
        parts[:0] = [(out[i].T @ back).ravel(), back.sum(axis=0)]
        if i:
            back = (back @ layers[i][0].T) * np.where(out[i] > 0, 1.0, LEAK)
    return float((off**2).mean(axis=1).sum()), np.concatenate(parts)


def _rows(network: Network, batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for at in range(0, batch.num_rows, STEP_ROWS):
        yield (matrix(batch.column(0).slice(at, STEP_ROWS)).astype(float) - network.centre) / network.scale


def total_gradient(vectors: DataFrame, network: Network) -> tuple[int, float, np.ndarray]:
    """Rows, summed error and summed gradient over a table of one vector column."""
    shared = vectors.sparkSession.sparkContext.broadcast(network)

    def pass_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        total = np.zeros(len(net.weights) + 2)
        for batch in batches:
            for x in _rows(net, batch):
                error, gradient = summed_gradient(net.sizes, net.weights, x)
                total[0] += len(x)
                total[1] += error
                total[2:] += gradient
        cell = TaskContext.get().partitionId() % PARTIAL_SUMS
        yield pa.RecordBatch.from_arrays([pa.array([cell]), pa.array([total.tolist()], pa.list_(pa.float64()))], ["cell", "total"])

    added = Summarizer.sum(F.col("v"))
    sent = vectors.mapInArrow(pass_over, "cell long, total array<double>").select("cell", array_to_vector("total").alias("v"))
    whole = sent.groupBy("cell").agg(added.alias("v")).agg(added.alias("v")).select(vector_to_array("v")).first()[0]
    shared.destroy()
    return int(whole[0]), whole[1], np.array(whole[2:])


def descend(evaluate: Callable[[np.ndarray], tuple[float, np.ndarray]], weights: np.ndarray, passes: int, memory: int = 12) -> np.ndarray:
    """Quasi-Newton descent with a limited memory: few passes over the data, each far ahead.

    A step that does not lessen the error is halved; that costs a pass as well.
    """
    error, gradient = evaluate(weights)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    left, length = passes - 1, min(1.0, 1.0 / max(float(np.abs(gradient).sum()), 1e-12))
    while left > 0 and np.abs(gradient).max() > 1e-9:
        direction, kept = gradient.copy(), []
        for step, change in reversed(moves):
            share = float(step @ direction) / float(step @ change)
            kept.append(share)
            direction -= share * change
        if moves:
            step, change = moves[-1]
            direction *= float(step @ change) / float(change @ change)
        for (step, change), share in zip(moves, reversed(kept), strict=True):
            direction += (share - float(change @ direction) / float(step @ change)) * step
        slope = float(gradient @ direction)
        if slope <= 0:
            moves, direction, slope = [], gradient.copy(), float(gradient @ gradient)
        scale = 1.0 if moves else length
        while left > 0:
            left -= 1
            ahead, there = evaluate(weights - scale * direction)
            if ahead <= error - 1e-4 * scale * slope:
                break
            scale /= 2
        else:
            break
        step, change = -scale * direction, there - gradient
        weights, error, gradient = weights + step, ahead, there
        if float(step @ change) > 1e-12:
            moves = [*moves, (step, change)][-memory:]
    return weights


def fit_network(
    embeddings: DataFrame,
    vector_col: str,
    hidden: Sequence[int] = S.NETWORK_HIDDEN,
    passes: int = S.NETWORK_PASSES,
    seed: int = S.SEED,
) -> Network:
    """Train on all rows with a vector; store the table before, each of the ``passes`` reads it."""
    vectors = embeddings.where(F.col(vector_col).isNotNull()).select(F.col(vector_col).cast("array<double>").alias("v"))
    if not vectors.take(1):
        raise ValueError("no vectors to train on")
    vec = array_to_vector("v")
    moments = vectors.agg(Summarizer.mean(vec).alias("m"), Summarizer.variance(vec).alias("s")).select(vector_to_array("m").alias("m"), vector_to_array("s").alias("s")).first()
    scale = float(np.sqrt(np.mean(moments.s))) or 1.0
    sizes = layer_sizes(len(moments.m), hidden)
    centre = np.array(moments.m)

    def evaluate(weights: np.ndarray) -> tuple[float, np.ndarray]:
        rows, error, gradient = total_gradient(vectors, Network(sizes, centre, scale, weights))
        return error / rows, gradient / rows

    return Network(sizes, centre, scale, descend(evaluate, first_weights(sizes, seed), passes))


def score_network(embeddings: DataFrame, network: Network, vector_col: str, score_col: str = "ae_score") -> DataFrame:
    """Add the mean squared error of each row's reconstruction, in the rows' own units; null for a null vector."""
    shared = embeddings.sparkSession.sparkContext.broadcast(network)

    @F.pandas_udf("double")
    def error(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        net = shared.value
        for series in batches:
            out = np.full(len(series), np.nan)
            there = series.notna().to_numpy()
            if there.any():
                x = (np.stack(series[there].to_numpy()).astype(float) - net.centre) / net.scale
                out[there] = ((forward(net.sizes, net.weights, x)[-1] - x) ** 2).mean(axis=1) * net.scale**2
            yield pd.Series(out)

    return embeddings.withColumn(score_col, F.when(F.col(vector_col).isNotNull(), error(F.col(vector_col))))
