"""Stable identifiers: the leading hex digits of an md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def contract_id(*parts: Column | str) -> Column:
    return _digest(parts, 12)


def clause_id(*parts: Column | str) -> Column:
    return _digest(parts, 16)


def order_key(id_col: Column, seed: int) -> Column:
    """A uniform, seeded, engine-independent sort key for sampling."""
    return F.md5(F.concat(id_col.cast("string"), F.lit(f"|{seed}")))


def _digest(parts, length: int) -> Column:
    cols = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.substring(F.md5(F.concat(*cols)), 1, length)
