"""Lexical features of a clause and the leverage scores built from them."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseweave import settings as S
from clauseweave.functions.text import WORD

#: What is counted in a clause in lower case.
COUNTS = "on_a int, on_b int, absolute int, conditional int"


def _whole_words(terms: list[str]) -> str:
    """Any of the terms as a whole word; the first letter is tested first."""
    letters = "".join(sorted({t[0] for t in terms}))
    return rf"(?=[{letters}])(?<![{WORD}])(?:{'|'.join(terms)})(?![{WORD}])"


def _any_of(text: str, terms: list[str]) -> bool:
    return any(t in text for t in terms)


def _present(text: str, terms: list[str]) -> int:
    """How many of the terms occur in the text at all."""
    return sum(t in text for t in terms)


def _term_counts(low: Column) -> Column:
    """``COUNTS`` of texts in lower case.

    Arrow batches: Python's search for plain terms is several times as fast as the engine's.
    """
    end_of_sentence = re.compile(r"[.;]\s+")

    def one(text: str) -> tuple[int, ...]:
        on_a = on_b = 0
        if _any_of(text, S.OBLIGATION_WORDS):
            for sentence in end_of_sentence.split(text):
                if _any_of(sentence, S.OBLIGATION_WORDS):
                    a, b = _any_of(sentence, S.PARTY_A_TERMS), _any_of(sentence, S.PARTY_B_TERMS)
                    on_a, on_b = on_a + (a and not b), on_b + (b and not a)
        return on_a, on_b, _present(text, S.ABSOLUTE_TERMS), _present(text, S.CONDITIONAL_TERMS)

    names = [c.split(" ")[0] for c in COUNTS.split(", ")]

    def count(batch: pa.Array) -> pa.Array:
        found = [(0, 0, None, None) if text is None else one(text) for text in batch.to_pylist()]
        columns = zip(*found, strict=True) if found else [[]] * len(names)
        return pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in columns], names)

    return F.arrow_udf(count, COUNTS)(low)


def _share(part: Column, rest: Column) -> Column:
    return F.when(part + rest == 0, F.lit(S.NEUTRAL_SCORE)).otherwise(part / (part + rest))


def with_lexical_features(df: DataFrame, text_col: str = "clause_text") -> DataFrame:
    """Add modal_score, obligation_score and assertiveness_score.

    The intermediate columns are separate projection steps so that Spark
    evaluates the regex work and the counts once per row.
    """
    low = F.col("_low")
    step = df.withColumn("_low", F.lower(F.col(text_col))).withColumn("_counts", _term_counts(low))
    modals = F.regexp_extract_all(low, F.lit(_whole_words(S.OBLIGATION_WORDS + S.DISCRETION_WORDS)), F.lit(0))
    step = step.withColumn("_modals", modals)
    obliging = F.size(F.filter("_modals", lambda w: w.isin(*S.OBLIGATION_WORDS)))
    step = step.withColumns({"_obliging": obliging, "_n_modals": F.size("_modals")})
    n = {c.split(" ")[0]: F.col(f"_counts.{c.split(' ')[0]}") for c in COUNTS.split(", ")}
    return step.withColumns(
        {
            "modal_score": _share(F.col("_obliging"), F.col("_n_modals") - F.col("_obliging")),
            "obligation_score": _share(n["on_b"], n["on_a"]),
            "assertiveness_score": _share(n["absolute"], n["conditional"]),
        }
    ).drop("_low", "_counts", "_modals", "_obliging", "_n_modals")


def sentiment_score(probabilities: Column) -> Column:
    """Tone in [0, 1] from a map of class name to probability.

    Class names may be negative/neutral/positive in any case, or label_0/1/2.
    Unknown names count as neutral. A missing map is neutral too.
    """
    values = S.SENTIMENT_SCORES

    def tone(name: Column) -> Column:
        name = F.lower(name)
        return (
            F.when(name.isin("negative", "label_0"), F.lit(values["negative"]))
            .when(name.isin("positive", "label_2"), F.lit(values["positive"]))
            .otherwise(F.lit(values["neutral"]))
        )

    total = F.aggregate(
        F.map_entries(probabilities),
        F.lit(0.0),
        lambda acc, e: acc + tone(e["key"]) * e["value"],
    )
    return F.coalesce(clip(total, 0.0, 1.0), F.lit(S.NEUTRAL_SCORE))


def length_score(n_words: Column, mean: Column, std: Column) -> Column:
    """Logistic of the word count's z-score; a zero deviation counts as 1."""
    z = (n_words - mean) / F.when(std == 0, F.lit(1.0)).otherwise(std)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def party_leverage(
    sentiment: Column, modal: Column, obligation: Column, assertive: Column, length: Column
) -> tuple[Column, Column]:
    """Leverage of both parties on a 0..100 scale."""
    one = F.lit(1.0)
    raw_a = (
        S.WEIGHT_SENTIMENT * (one - sentiment)
        + S.WEIGHT_MODAL * modal
        + S.WEIGHT_OBLIGATION * obligation
        + S.WEIGHT_ASSERTIVENESS * assertive
    )
    raw_b = (
        S.WEIGHT_SENTIMENT * sentiment
        + S.WEIGHT_MODAL * (one - modal)
        + S.WEIGHT_OBLIGATION * (one - obligation)
        + S.WEIGHT_ASSERTIVENESS * (one - assertive)
    )
    amplifier = F.lit(0.8) + F.lit(0.4) * length
    return (
        clip(raw_a * amplifier * 100, 0.0, 100.0),
        clip(raw_b * amplifier * 100, 0.0, 100.0),
    )


def with_leverage(df: DataFrame) -> DataFrame:
    """Add both leverages, the signed imbalance and its label."""
    a, b = party_leverage(
        F.col("sentiment_score"),
        F.col("modal_score"),
        F.col("obligation_score"),
        F.col("assertiveness_score"),
        F.col("length_score"),
    )
    df = df.withColumns({"party_a_leverage": a, "party_b_leverage": b})
    df = df.withColumn(
        "power_imbalance_score",
        clip(F.col("party_a_leverage") - F.col("party_b_leverage"), -100.0, 100.0),
    )
    return df.withColumn("imbalance_label", imbalance_label(F.col("power_imbalance_score")))


def imbalance_label(score: Column) -> Column:
    """HIGH from 40, MEDIUM from 20, both inclusive; null stays null."""
    size = F.abs(score)
    return (
        F.when(score.isNull(), F.lit(None).cast("string"))
        .when((size >= S.IMBALANCE_HIGH) & (score > 0), "HIGH")
        .when(size >= S.IMBALANCE_HIGH, "HIGH (Party B)")
        .when((size >= S.IMBALANCE_MEDIUM) & (score > 0), "MEDIUM")
        .when(size >= S.IMBALANCE_MEDIUM, "MEDIUM (Party B)")
        .otherwise("BALANCED")
    )


def report_band(index: Column) -> Column:
    """Band of a whole contract; unlike the clause label the limits are exclusive."""
    return (
        F.when(index > S.IMBALANCE_HIGH, "HIGH favouring Party A")
        .when(index < -S.IMBALANCE_HIGH, "HIGH favouring Party B")
        .when(F.abs(index) > S.IMBALANCE_MEDIUM, "MODERATE")
        .otherwise("BALANCED")
    )


def dominant_party(index: Column, a: Column | str = "Party A", b: Column | str = "Party B") -> Column:
    a = F.lit(a) if isinstance(a, str) else a
    b = F.lit(b) if isinstance(b, str) else b
    return F.when(index > 0, a).when(index < 0, b).otherwise(F.lit("Balanced"))


def clip(value: Column, low: float, high: float) -> Column:
    """Clamp; least/greatest skip nulls, so null is kept explicitly."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))
