"""Multi-label helpers: arrays in memory, pipe-joined text only at the edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from clauseweave import settings as S
from clauseweave.functions.text import strip


def join_labels(labels: Column) -> Column:
    return F.array_join(labels, "|")


def split_labels(joined: Column) -> Column:
    """Pipe-joined text to an array; blanks vanish, null gives an empty array."""
    parts = F.transform(F.split(F.coalesce(joined, F.lit("")), r"\|"), strip)
    return F.filter(parts, lambda p: p != "")


def known_labels(
    labels: Column,
    taxonomy: Sequence[str] = S.CLAUSE_TYPES,
    limit: int | None = S.MAX_LABELS_PER_CLAUSE,
) -> Column:
    """First ``limit`` labels (None: all) that are in the taxonomy, in stored order."""
    known = F.filter(labels, lambda x: x.isin(*taxonomy))
    return known if limit is None else F.slice(known, 1, limit)


def primary_label(labels: Column) -> Column:
    """First label, or null when there is none."""
    return F.get(labels, F.lit(0))


def multi_hot(labels: Column, taxonomy: Sequence[str] = S.CLAUSE_TYPES) -> Column:
    """0/1 vector of taxonomy length."""
    names = F.array(*[F.lit(t) for t in taxonomy])
    # As an array of one, so that the labels are made once and not for every name.
    trimmed = F.array(F.transform(labels, strip))
    return F.element_at(F.transform(trimmed, lambda own: F.transform(names, lambda t: F.array_contains(own, t).cast("int"))), 1)
