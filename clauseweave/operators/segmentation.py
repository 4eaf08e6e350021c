"""Documents to clauses. Each document is one row, so no shuffle is needed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseweave import settings as S
from clauseweave.functions import ids, text as T


def with_clause_array(
    docs: DataFrame, text_col: str = "text", min_words: int = S.MIN_CLAUSE_WORDS
) -> DataFrame:
    """Replace the text column by ``clauses``, an array of (text, n_words).

    Header pieces are used when there are at least five of them, paragraphs
    otherwise.
    """
    kept = [c for c in docs.columns if c != text_col]
    staged = docs.withColumn("_by_header", T.header_pieces(F.col(text_col)))
    pieces = F.when(
        F.size("_by_header") >= S.MIN_SEGMENTS_BY_HEADER, F.col("_by_header")
    ).otherwise(T.paragraph_pieces(F.col(text_col)))
    staged = staged.select(*kept, pieces.alias("_pieces"))
    counted = T.counted_clauses(F.col("_pieces"))
    return staged.select(*kept, F.filter(counted, lambda c: c["n_words"] >= min_words).alias("clauses"))


def explode_clauses(
    docs: DataFrame, text_col: str = "text", min_words: int = S.MIN_CLAUSE_WORDS
) -> DataFrame:
    """One row per valid clause: position (0-based), clause_text and n_words."""
    kept = [c for c in docs.columns if c != text_col]
    return _exploded(with_clause_array(docs, text_col, min_words), kept)


def _exploded(staged: DataFrame, kept: list[str]) -> DataFrame:
    # The outer form keeps Spark from adding a "not empty" filter below the
    # explode, which would run the whole segmentation a second time.
    rows = staged.select(*kept, F.posexplode_outer("clauses").alias("position", "_c"))
    return rows.where("_c IS NOT NULL").select(
        *kept, "position", F.col("_c.text").alias("clause_text"), F.col("_c.n_words").alias("n_words")
    )


def upload_clauses(docs: DataFrame, source: str = "text_input") -> DataFrame:
    """Clauses of submitted documents (contract_id, text); ids carry the position.

    A contract is one row here, so the mean and deviation of its clause lengths
    are taken inside the row and ride along as mean_words and std_words.
    """
    staged = with_clause_array(docs.select("contract_id", "text"))
    count = F.greatest(F.size("clauses"), F.lit(1))
    mean = F.aggregate("clauses", F.lit(0.0), lambda a, c: a + c["n_words"]) / count
    squares = F.aggregate(
        "clauses", F.lit(0.0), lambda a, c: a + F.pow(c["n_words"] - F.col("mean_words"), F.lit(2))
    )
    staged = staged.withColumn("mean_words", mean)
    staged = staged.withColumn("std_words", F.sqrt(squares / count))
    clauses = _exploded(staged, ["contract_id", "mean_words", "std_words"])
    return _processed(
        clauses,
        ids.clause_id(F.col("contract_id"), F.col("position"), F.col("clause_text")),
        source,
        "position", "n_words", "mean_words", "std_words",
    )


def filing_clauses(filings: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Clauses of raw filings (file_name, text), one row per file.

    ``carry`` names further columns to keep on every clause.
    Short files are dropped after cleaning. Ids leave the position out, so a
    clause repeated inside one file has one id; repeats go before the explode
    and no shuffle is needed.
    """
    cleaned = filings.select(
        ids.contract_id(F.col("file_name")).alias("contract_id"),
        *carry,
        T.clean_filing(F.col("text")).alias("text"),
    )
    # A short text becomes null, which has no clauses: a filter would be pushed below the
    # cleaning, and every text would be cleaned twice.
    long_enough = F.when(T.has_words(F.col("text"), S.MIN_FILING_WORDS), F.col("text"))
    staged = with_clause_array(cleaned.withColumn("text", long_enough)).withColumn("clauses", F.array_distinct("clauses"))
    return _processed(
        _exploded(staged, ["contract_id", *carry]),
        ids.clause_id("EDGAR", F.col("contract_id"), F.col("clause_text")),
        "EDGAR",
        "position", "n_words", *carry,
    )


def _processed(clauses: DataFrame, clause_id: Column, source: str, *extra: str) -> DataFrame:
    return clauses.select(
        "contract_id",
        clause_id.alias("clause_id"),
        "clause_text",
        F.array().cast("array<string>").alias("clause_types"),
        F.lit("").alias("party_a"),
        F.lit("").alias("party_b"),
        F.lit(source).alias("source"),
        *extra,
    )
