"""Incremental ingest run as a stream over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from clauseweave.checks import derived as D
from clauseweave.checks.registry import query
from clauseweave.operators.segmentation import filing_clauses
from clauseweave.session import is_folder, shared_folder
from clauseweave.sources.store import ClauseStore
from clauseweave.streaming.ingest import ingest_batch, unique_arrivals


def _document_stream(spark, folder):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    reader, path = spark.readStream.schema(schema), f"{folder}/documents.parquet"
    # A table is a folder of part files or a single file; a missing one is an error.
    if not is_folder(spark, path):
        reader, path = reader.option("pathGlobFilter", "documents.parquet"), folder
    return (
        reader.parquet(path)
        .select(
            F.concat(F.lit("doc_"), "doc_id", F.lit(".txt")).alias("file_name"), "text",
            F.col("_metadata.file_modification_time").alias("arrived_at"),
        )
    )


_STREAM_SQL = f"""
long_docs AS (SELECT substr(md5('doc_'||doc_id||'.txt'), 1, 12) AS contract_id, text FROM documents
  WHERE len(regexp_extract_all(text, '\\S+')) >= 100),
{D.segment_sql('long_docs')},
rows_ AS (SELECT DISTINCT contract_id, clause_text, substr(md5('EDGAR'||contract_id||clause_text), 1, 16) AS clause_id FROM numbered)"""


@query(
    "stream_ingest",
    f"WITH {_STREAM_SQL} SELECT contract_id, clause_id, clause_text, 'EDGAR' AS source FROM rows_",
)
def stream_ingest(spark, folder):
    """Stream the documents into a store; a replayed batch must change nothing."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    store = ClauseStore(spark, f"{root}/store")

    def twice(batch, _):
        ingest_batch(batch, store)
        ingest_batch(batch, store)

    stream = _document_stream(spark, folder)
    writer = stream.writeStream.foreachBatch(twice).option("checkpointLocation", f"{root}/progress")
    writer.trigger(availableNow=True).start().awaitTermination()
    return store.clauses().select("contract_id", "clause_id", "clause_text", "source")


@query(
    "stream_unique_arrivals",
    f"WITH {_STREAM_SQL} SELECT contract_id, clause_id FROM rows_",
)
def stream_unique_arrivals(spark, folder):
    """The same clauses through the stateful duplicate filter, each sent twice."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = _document_stream(spark, folder)
    clauses = filing_clauses(stream, carry=["arrived_at"]).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    writer = (
        unique_arrivals(clauses).select("contract_id", "clause_id")
        .writeStream.format("parquet")
        .option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/progress")
    )
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("contract_id string, clause_id string").parquet(f"{root}/out")

