"""Incremental ingest of a filings folder with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clauseweave.functions import ids
from clauseweave.operators.segmentation import filing_clauses
from clauseweave.session import scratch, stored
from clauseweave.sources.filings import new_filings, unix_lines
from clauseweave.sources.store import ClauseStore, uploaded_contracts


def filing_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """New ``*.txt`` files as (file_name, text, arrived_at)."""
    raw = (
        spark.readStream.format("text")
        .option("wholetext", "true")
        .option("pathGlobFilter", "*.txt")
        .option("maxFilesPerTrigger", max_files)
        .schema("value string")
        .load(folder)
    )
    return raw.select(
        F.col("_metadata.file_name").alias("file_name"),
        unix_lines(F.col("value")).alias("text"),
        F.col("_metadata.file_modification_time").alias("arrived_at"),
    )


def ingest_batch(batch: DataFrame, store: ClauseStore, source: str = "EDGAR") -> None:
    """Segment one micro-batch and insert what is new. Safe to replay.

    Files whose contract is stored already are skipped before any segmentation;
    a file without clauses gets its contract too, so no later run reads it again.
    The files are read once, and the batch's own tables go when it is done.
    """
    with scratch(batch.sparkSession):
        fresh = new_filings(batch.select("file_name", "text"), store.contracts())
        with stored(filing_clauses(fresh)) as clauses:
            store.save_clauses(clauses, [F.col("position")])
        # Contracts last: a contract row marks the file as fully ingested.
        named = fresh.select(ids.contract_id(F.col("file_name")).alias("contract_id"), F.col("file_name").alias("filename"))
        store.save_contracts(uploaded_contracts(named, source))


def start_ingest(
    stream: DataFrame, store: ClauseStore, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(lambda df, _: ingest_batch(df, store)).option(
        "checkpointLocation", checkpoint
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def unique_arrivals(clauses: DataFrame, delay: str = "1 day") -> DataFrame:
    """Drop repeated clause ids of a stream inside the watermark."""
    return clauses.withWatermark("arrived_at", delay).dropDuplicatesWithinWatermark(["clause_id"])
