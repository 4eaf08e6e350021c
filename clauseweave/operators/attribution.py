"""Which features or words drive a score."""

from __future__ import annotations

from collections.abc import Callable
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseweave import settings as S
from clauseweave.session import cut_lineage

FEATURES = [
    "sentiment_score", "modal_score", "obligation_score", "assertiveness_score", "length_score",
]


def _subset_weights(feature: int, count: int) -> list[float]:
    """Shapley weight of every subset value, by bit mask."""
    out = []
    for mask in range(2**count):
        size = mask.bit_count()
        inside = mask >> feature & 1
        others = size - inside
        weight = factorial(others) * factorial(count - others - 1) / factorial(count)
        out.append(weight if inside else -weight)
    return out


def with_feature_attribution(scored: DataFrame, background: float = S.NEUTRAL_SCORE) -> DataFrame:
    """Exact Shapley values of the five features against a neutral background.

    All 32 subsets are evaluated inside the row as plain columns (bit i of the
    subset number says whether feature i has its own value or the background's),
    so the whole computation is compiled.
    """
    n = len(FEATURES)
    *tones, length = FEATURES
    weights = [S.WEIGHT_SENTIMENT, S.WEIGHT_MODAL, S.WEIGHT_OBLIGATION, S.WEIGHT_ASSERTIVENESS]

    # Sentiment works for party B, the other features for party A.
    def raw(mask: int, for_a: bool) -> Column:
        parts = []
        for i, (c, w) in enumerate(zip(tones, weights, strict=True)):
            value = c if mask >> i & 1 else f"{background}D"
            parts.append(f"{w}D * " + (value if (i > 0) == for_a else f"(1D - {value})"))
        return F.expr(" + ".join(parts))

    def imbalance(mask: int) -> Column:
        inner = mask % 2 ** (n - 1)
        own_length = length if mask >> (n - 1) else f"{background}D"
        amplifier = f"((0.8D + 0.4D * {own_length}) * 100D)"
        a, b = (
            f"greatest(0D, least(100D, _raw_{p}{inner} * {amplifier}))" for p in "ab"
        )
        return F.expr(f"{a} - {b}")

    sums = {f"_raw_{p}{m}": raw(m, p == "a") for m in range(2 ** (n - 1)) for p in "ab"}
    values = {f"_subset{m}": imbalance(m) for m in range(2**n)}
    shares = {
        f"{c}_contribution": F.expr(
            " + ".join(f"{w}D * _subset{m}" for m, w in enumerate(_subset_weights(i, n)))
        )
        for i, c in enumerate(FEATURES)
    }
    complete = F.expr(" AND ".join(f"{c} IS NOT NULL" for c in FEATURES))
    staged = scored.withColumns(sums).withColumns(values)
    staged = staged.withColumns({c: F.when(complete, v) for c, v in shares.items()})
    return staged.drop(*sums, *values)


def masked_text(words: Column, keep: Column) -> Column:
    """Words joined by spaces with dropped ones shown as [MASK]."""
    return F.array_join(
        F.zip_with(words, keep, lambda w, k: F.when(k == 1, w).otherwise(F.lit("[MASK]"))), " "
    )


def top_words(words: Column, values: Column, k: int = 20) -> Column:
    """The k words of largest absolute value, as (word, value) structs."""
    rows = F.transform(
        F.arrays_zip(words.alias("w"), values.alias("v")),
        lambda z, i: F.struct((-F.abs(z["v"])).alias("neg"), i.alias("i"), z["w"].alias("word"), z["v"].alias("value")),
    )
    return F.transform(
        F.slice(F.array_sort(rows), 1, k), lambda r: F.struct(r["word"].alias("word"), r["value"].alias("value"))
    )


def segments(words: Column, most: int) -> Column:
    """Words cut into at most ``most`` runs of equal length (the last may be shorter), in order."""
    return F.transform(words, lambda _, i: F.floor(i / F.ceil(F.size(words) / F.lit(float(most)))).cast("int"))


def sign(mask: Column, segment: Column) -> Column:
    """1 where the mask keeps the segment, -1 where it hides it: a row of a Hadamard matrix.

    Over all masks each segment is kept in one half, and any two segments are kept
    together in one quarter, so effects of segments do not mix.
    """
    return F.lit(1) - F.lit(2) * (F.bit_count(mask.bitwiseAND(segment + 1)) % 2)


def masked_copies(clauses: DataFrame, key: str, text_col: str, runs: int) -> DataFrame:
    """(key, mask, text): every clause under each of its masks.

    A clause of few segments needs the next power of two above their number of
    masks, others ``runs``. Clauses without words give no rows. Each segment is
    joined once, shown and hidden; a copy joins segments, not words.
    """
    words = clauses.select(key, F.filter(F.split(text_col, r"\s+"), lambda w: w != "").alias("_words")).where(F.size("_words") > 0)
    length = F.ceil(F.size("_words") / F.lit(float(runs - 1))).cast("int")
    cuts = F.transform(F.sequence(F.lit(0), F.size("_words") - 1, F.col("_length")), lambda at: F.slice("_words", at + 1, F.col("_length")))
    staged = words.withColumn("_length", length).select(key, cuts.alias("_cuts"))
    shown = F.transform("_cuts", lambda part: F.array_join(part, " "))
    hidden = F.transform("_cuts", lambda part: F.array_join(F.array_repeat(F.lit("[MASK]"), F.size(part)), " "))
    # The least power of two above the number of segments.
    needed = F.expr("shiftleft(1, length(bin(size(_cuts))))")
    masks = F.explode(F.sequence(F.lit(0), F.col("_needed") - 1)).alias("mask")
    copies = staged.select(key, shown.alias("_shown"), hidden.alias("_hidden"), needed.alias("_needed")).select(key, "_shown", "_hidden", masks)
    kept = F.transform("_shown", lambda part, g: F.when(sign(F.col("mask"), g) == 1, part).otherwise(F.get("_hidden", g)))
    return copies.select(key, "mask", F.array_join(kept, " ").alias("text"))


def with_word_attribution(
    clauses: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    text_col: str = "clause_text",
    runs: int = 64,
    top: int = 20,
) -> DataFrame:
    """Add ``top_words``: the words that move a model's score most when they are hidden.

    ``score`` adds ``score`` (double) to a table with a ``text`` column, say by
    ``inference.with_model_output``; it sees the masked copies of each distinct text
    once. They are made where they are scored and stored nowhere. Every
    clause is scored under the masks of a two-level Hadamard design over its words
    (over runs of words, where there are ``runs`` or more), and a word's value is
    the least-squares effect of keeping it: the mean score with it less the mean
    without. For a score that adds up over words this is each word's own share.
    Clauses without words get an empty list.
    """
    # Keyed by a digest, so that equal clauses are scored once; only texts move, not their copies.
    digest = F.sha2(text_col, 256)
    texts = clauses.select(digest.alias("_digest"), F.col(text_col).alias("_text")).groupBy("_digest").agg(F.min("_text").alias("_text"))
    scored = score(masked_copies(texts, "_digest", "_text", runs)).select("_digest", "mask", F.col("score").cast("double").alias("score"))
    # One sum a segment: sufficient statistics of the fit.
    sums = [F.sum(sign(F.col("mask"), F.lit(g)) * F.col("score")).alias(f"_{g}") for g in range(runs - 1)]
    fitted = scored.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n"), *sums)
    # Half of the masks keep a word: the difference of the two means is the signed sum over half the masks.
    effects = cut_lineage(fitted.select(F.col("_digest").alias("_key"), F.array(*[F.col(f"_{g}") * 2 / F.col("_n") for g in range(runs - 1)]).alias("_effects")))
    joined = clauses.join(effects, digest == F.col("_key"), "left")
    words = F.filter(F.split(text_col, r"\s+"), lambda w: w != "")
    staged = joined.withColumn("_words", words).withColumn("_values", F.transform(segments(F.col("_words"), runs - 1), lambda g: F.round(F.get("_effects", g), 9)))
    empty = F.array().cast("array<struct<word:string,value:double>>")
    # Rounded, so that equal effects tie whatever the order of their sums.
    return staged.withColumn("top_words", F.when(F.size("_words") > 0, top_words(F.col("_words"), F.col("_values"), top)).otherwise(empty)).drop("_key", "_effects", "_words", "_values")
