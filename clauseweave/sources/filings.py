"""Raw filings on disk: text files, full submissions, PDFs."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseweave import settings as S
from clauseweave.functions import ids
from clauseweave.functions import text as T
from clauseweave.operators.keyed import absent_from_store
from clauseweave.session import cut_lineage

#: Splits of a folder scan: at least so many a core, up to so many joined in a task.
SPLITS_A_CORE, SPLITS_A_TASK = 4, 16


def read_filings(spark: SparkSession, folder: str) -> DataFrame:
    """All ``*.txt`` files of a folder as (file_name, text); bad bytes replaced."""
    raw = spark.read.format("text").option("wholetext", "true").option("pathGlobFilter", "*.txt").load(folder)
    # Spark counts 4 MB for opening a file, so a scan of small ones has a task for every 32 of them.
    splits, least = raw.rdd.getNumPartitions(), SPLITS_A_CORE * spark.sparkContext.defaultParallelism
    if splits > least:
        raw = raw.coalesce(max(least, splits // SPLITS_A_TASK))
    return raw.select(
        F.col("_metadata.file_name").alias("file_name"), unix_lines(F.col("value")).alias("text")
    )


def unix_lines(text: Column) -> Column:
    """Line ends as a text-mode reader would give them."""
    return F.regexp_replace(text, r"\r\n?", "\n")


def new_filings(filings: DataFrame, contracts: DataFrame) -> DataFrame:
    """Filings whose contract is not stored yet under a filing source."""
    done = contracts.where(F.col("source").startswith(S.AUTO_SOURCE_PREFIX)).select("contract_id")
    # Read once: a batch of files is stored before its names are looked up and its texts go on.
    keyed = cut_lineage(filings.withColumn("contract_id", ids.contract_id(F.col("file_name"))))
    return absent_from_store(keyed, done, ["contract_id"]).drop("contract_id")


def submission_exhibits(submissions: DataFrame) -> DataFrame:
    """EX-10 exhibits of full submissions (accession, cik, file_date, sgml).

    One row per exhibit with its file name and text; short ones are dropped. Two
    exhibits of one type share a name; the first in the submission stays. That is
    decided inside the submission's row, so texts do not move.
    """

    def parsed(block: Column) -> Column:
        body = F.split(F.get(F.split(block, "(?i)<TEXT>", 2), F.lit(1)), "(?i)</TEXT>|</DOCUMENT>", 2)
        return F.struct(
            T.strip(F.regexp_extract(block, r"(?i)<TYPE>([^\n<]+)", 1)).alias("doc_type"),
            # A text part counts only when something closes it.
            F.when(F.size(body) == 2, T.strip(F.get(body, F.lit(0)))).alias("text"),
        )

    def wanted(part: Column) -> Column:
        return F.upper(part["doc_type"]).startswith("EX-10") & (F.length(part["text"]) >= S.MIN_EXHIBIT_CHARS)

    blocks = F.expr("slice(_blocks, 2, greatest(size(_blocks) - 1, 0))")
    parts = (
        submissions.withColumn("_blocks", F.split("sgml", "(?i)<DOCUMENT>"))
        .withColumn("_parts", F.filter(F.transform(blocks, parsed), wanted))
        .withColumn("_types", F.transform("_parts", lambda p: p["doc_type"]))
        .withColumn("_firsts", F.expr("filter(_parts, (p, i) -> array_position(_types, p.doc_type) = i + 1)"))
    )
    named = parts.select("accession", "cik", "file_date", F.explode_outer("_firsts").alias("_part")).where("_part IS NOT NULL")
    safe = F.regexp_replace("_part.doc_type", rf"[^{T.WORD}]", "_")
    digest = F.substring(F.md5(F.concat("accession", "_part.doc_type")), 1, 8)
    return named.select(
        "accession",
        F.concat(F.concat_ws("_", "file_date", "cik", safe, digest), F.lit(".txt")).alias("file_name"),
        F.col("_part.doc_type").alias("doc_type"),
        F.col("_part.text").alias("text"),
    )


def read_pdfs(
    spark: SparkSession,
    folder: str,
    extract_pages: Callable[[bytes], list[str]] | None = None,
    max_pages: int | None = None,
) -> DataFrame:
    """PDF files as (file_name, content_id, text, page_count).

    ``max_pages`` limits the pages whose text is taken; ``page_count`` is always
    the number of pages of the file.
    ``extract_pages`` turns file bytes into page texts; the default needs
    pdfplumber on the executors. Files without text are dropped.
    """
    extract = extract_pages or _pdfplumber_pages

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pages = [extract(bytes(c)) for c in pdf["content"]]
            yield pd.DataFrame(
                {
                    "file_name": pdf["file_name"],
                    "content_id": pdf["content_id"],
                    "text": ["\n".join(p for p in page[:max_pages] if p) for page in pages],
                    "page_count": [len(p) for p in pages],
                }
            )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    named = files.select(
        F.col("_metadata.file_name").alias("file_name"),
        F.substring(F.md5("content"), 1, 12).alias("content_id"),
        "content",
    )
    out = named.mapInPandas(run, "file_name string, content_id string, text string, page_count int")
    return out.withColumn("text", T.clean_extracted(F.col("text"))).where("text <> ''")


def _pdfplumber_pages(content: bytes) -> list[str]:
    try:
        import pdfplumber
    except ImportError as error:
        raise RuntimeError("install pdfplumber on the executors or pass extract_pages") from error
    with pdfplumber.open(io.BytesIO(content)) as pdf:
        return [p.extract_text(x_tolerance=2, y_tolerance=2) or "" for p in pdf.pages]
