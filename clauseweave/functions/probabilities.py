"""Calibration, blending and decoding of class probability vectors.

A vector is array<double> in taxonomy order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from clauseweave import settings as S

EPS = S.PROBABILITY_EPSILON


def logit(p: Column) -> Column:
    q = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), p))
    return F.log(q / (F.lit(1.0) - q))


def tempered(p: Column, temperature: Column) -> Column:
    """One calibrated probability; temperature 1 returns it unclipped."""
    return F.when(temperature == 1.0, p).otherwise(
        F.lit(1.0) / (F.lit(1.0) + F.exp(-logit(p) / temperature))
    )


def calibrate(probabilities: Column, temperature: float) -> Column:
    if temperature == 1.0:
        return probabilities
    return F.transform(probabilities, lambda p: tempered(p, F.lit(float(temperature))))


def blend(vectors: Sequence[Column], weights: Sequence[float]) -> Column:
    """Weighted sum of model vectors; a model of weight 0 or null takes no part."""
    active = [(v, w) for v, w in zip(vectors, weights, strict=True) if w > 0]
    if not active:
        raise ValueError("at least one weight must be positive")
    out = _scaled(*active[0])
    for vector, weight in active[1:]:
        out = F.zip_with(out, _scaled(vector, weight), lambda a, b: a + b)
    return out


def _scaled(vector: Column, weight: float) -> Column:
    return F.transform(vector, lambda p: p * F.lit(float(weight)))


def decode(
    probabilities: Column,
    thresholds: Column,
    names: Sequence[str] = S.CLAUSE_TYPES,
    unknown_below: float = S.UNKNOWN_MAX_PROBABILITY,
) -> Column:
    """Names whose probability reaches their threshold, or ["Other"]."""
    name_array = F.array(*[F.lit(n) for n in names])
    hits = F.filter(
        F.zip_with(
            name_array,
            F.zip_with(probabilities, thresholds, lambda p, t: p >= t),
            lambda n, hit: F.when(hit, n),
        ),
        lambda n: n.isNotNull(),
    )
    other = F.array(F.lit(S.OTHER))
    return (
        F.when(F.array_max(probabilities) < unknown_below, other)
        .when(F.size(hits) == 0, other)
        .otherwise(hits)
    )


def probability_map(probabilities: Column, names: Sequence[str] = S.CLAUSE_TYPES) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(n) for n in names]), probabilities)


def top_probabilities(probability_by_name: Column, k: int = 5) -> Column:
    """The k most probable entries; equal values keep name order."""
    ordered = F.array_sort(
        F.transform(
            F.map_entries(probability_by_name),
            lambda e: F.struct((-e["value"]).alias("neg"), e["key"].alias("name"), e["value"].alias("p")),
        )
    )
    return F.transform(F.slice(ordered, 1, k), lambda e: F.struct(e["name"].alias("name"), e["p"].alias("p")))


def confidence(probability_by_name: Column) -> Column:
    """Largest probability in the map; 0 when the map is empty or null."""
    return F.coalesce(F.array_max(F.map_values(probability_by_name)), F.lit(0.0))


def window_tokens(tokens: Column, size: int = S.WINDOW_TOKENS, overlap: int = S.WINDOW_OVERLAP) -> Column:
    """Overlapping token windows; text that fits gives one window."""
    n = F.size(tokens)
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(
        F.sequence(F.lit(0), n - 1, F.lit(size - overlap))
    )
    return F.transform(starts, lambda s: F.slice(tokens, s + 1, F.lit(size)))
