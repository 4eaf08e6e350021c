"""A corpus pipeline: toxicity, near duplicates, benchmark passages, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and works on all rows the stage before
it kept. ``run`` writes each stage's rows to the shared folder and reads them
again, so that a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseweave.llm.common import table
from clauseweave.llm.decontamination import contaminated
from clauseweave.llm.mixing import mix_sources
from clauseweave.llm.ngram_join import Similarity, near_duplicates
from clauseweave.llm.sharding import assign_shards
from clauseweave.llm.toxicity import scorer, train
from clauseweave.session import cut_lineage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHARDS = 40


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is not among ``ids``; a null id equals a null id."""
    return docs.join(ids.select(F.col("doc_id").alias("_id")).distinct(), F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose toxicity score is below the threshold, decided row by row."""
    model = train(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(*COLUMNS).withColumn("_text", F.col("text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    scored = rows.mapInArrow(scorer(model), f"{kinds}, score double")
    return scored.filter(F.col("score") < model.threshold_score).select(*COLUMNS)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8 or more, the smallest id stays.

    Documents without words are no copies of anything and stay.
    """
    found = near_duplicates(docs, Similarity(shingle=5, above=4, below=5))
    return without(docs.select(*COLUMNS), found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that overlap a benchmark item."""
    found = contaminated(docs, table(spark, sf_dir, "benchmark"))
    return without(docs.select(*COLUMNS), found.filter("contaminated"))


def located(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns with each row's file (``_file``) and place in it (``_at``); what is no stored table is stored first.

    Files are numbered as the partitions were that wrote them, so the two give the
    order in which the table was written.
    """
    stored = docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
    rows = docs if stored else cut_lineage(docs.select(*columns))
    where = rows.metadataColumn("_metadata")
    return rows.select(*columns, where["file_path"].alias("_file"), where["row_index"].alias("_at"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, ordered within the table by their place in the mixture of sources; copies of a row have places of their own."""
    rows, at = located(docs, *COLUMNS), ["_file", "_at"]
    places = mix_sources(rows, keep=at).select(*at, "position")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.join(places, at)
    return placed.repartitionByRange(parts, "position").sortWithinPartitions("position").select(*COLUMNS)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard of every document that is left, and its slot: within a shard the order of the table, so that of the mixture."""
    return assign_shards(located(docs, "doc_id", "text"), SHARDS, place=("_file", "_at"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", one_of_near_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: Scores, links and seeds are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        last = name == STAGES[-1][0]
        docs = stage(spark, docs, sf_dir) if last else cut_lineage(stage(spark, docs, sf_dir))
    return docs
