"""Batched model inference. The model is the user's; Spark feeds it batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauseweave import settings as S
from clauseweave.functions import probabilities as P
from clauseweave.operators.evaluation import max_pool

BATCH_ROWS = 32


def with_model_output(
    df: DataFrame,
    make_model: Callable,
    input_col: str,
    output_col: str,
    batch_rows: int = BATCH_ROWS,
    input_length: int | None = None,
) -> DataFrame:
    """Add an array<double> computed by ``make_model()(batch of inputs)``.

    ``make_model`` runs once per Python worker, where it loads the weights.
    Array inputs need their (fixed) ``input_length``.
    """
    run = predict_batch_udf(
        make_model,
        return_type=T.ArrayType(T.DoubleType()),
        batch_size=batch_rows,
        input_tensor_shapes=None if input_length is None else [[input_length]],
    )
    return df.withColumn(output_col, run(F.col(input_col)))


def classify_tokens(
    clauses: DataFrame,
    make_model: Callable,
    tokens_col: str,
    key: str = "clause_id",
    pad: int = 0,
    prepare: Callable | None = None,
) -> DataFrame:
    """Class probabilities of tokenised clauses: windows, inference, max-pool.

    Windows of token ids are padded to full length for the model. ``prepare``
    replaces the padding by another column function, say one joining tokens.
    """
    windows = clauses.select(key, F.explode_outer(P.window_tokens(F.col(tokens_col))).alias("window"))
    if prepare is None:
        missing = F.array_repeat(F.lit(pad), F.lit(S.WINDOW_TOKENS) - F.size("window"))
        windows = windows.withColumn("window", F.concat("window", missing))
        scored = with_model_output(windows, make_model, "window", "probabilities", input_length=S.WINDOW_TOKENS)
    else:
        windows = windows.withColumn("window", prepare(F.col("window")))
        scored = with_model_output(windows, make_model, "window", "probabilities")
    return max_pool(scored, key)


def with_predictions(
    df: DataFrame,
    model_cols: Sequence[str],
    weights: Sequence[float],
    temperature: float,
    thresholds: Sequence[float] | float,
    names: Sequence[str] = S.CLAUSE_TYPES,
) -> DataFrame:
    """Blend, calibrate and decode: adds clause_types, probabilities, confidence."""
    if isinstance(thresholds, (int, float)):
        thresholds = [float(thresholds)] * len(names)
    limits = F.array(*[F.lit(float(t)) for t in thresholds])
    staged = df.withColumn(
        "_p", P.calibrate(P.blend([F.col(c) for c in model_cols], weights), temperature)
    )
    return staged.withColumns(
        {
            "clause_types": P.decode(F.col("_p"), limits, names),
            "probabilities": P.probability_map(F.col("_p"), names),
            "confidence": F.round(F.array_max("_p"), 4),
            "_max": F.array_max("_p"),
        }
    ).withColumn(
        "status",
        F.when(
            (F.col("clause_types") == F.array(F.lit(S.OTHER))) | (F.col("_max") < S.AUTO_ACCEPT_CONFIDENCE),
            "review",
        ).otherwise("accepted"),
    ).drop("_p", "_max")


def accepted(predicted: DataFrame) -> DataFrame:
    return predicted.where("status = 'accepted'").drop("status")


def for_review(predicted: DataFrame) -> DataFrame:
    return predicted.where("status = 'review'").drop("status")
