"""The clause store: insert-only Parquet tables under one root folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from clauseweave.functions import ids
from clauseweave.operators.keyed import absent_from_store, absent_rows, first_per_key, merge_keep_existing
from clauseweave.session import cut_lineage, stored

CONTRACTS = "contract_id string, filename string, source string, page_count int, created_at timestamp"
CLAUSES = (
    "clause_id string, contract_id string, clause_text string, clause_types array<string>, "
    "party_a string, party_b string, source string, created_at timestamp"
)
RESULTS = (
    "contract_id string, overall_imbalance_index double, total_clauses long, anomalous_clauses long, "
    "dominant_clause_type string, analysis_metadata string, created_at timestamp"
)
#: Scores of a clause; the newest version counts.
SCORES = (
    "clause_id string, version long, anomaly_score double, is_anomalous boolean, "
    "power_imbalance_score double, imbalance_label string, created_at timestamp"
)
METRICS = "component string, metric string, value double, created_at timestamp"


class ClauseStore:
    """Contracts, clauses, analysis results and metrics as append-only tables.

    A row is inserted only when its key is absent, so a repeated or retried
    batch changes nothing. There is one writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(self.path(name))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def contracts(self) -> DataFrame:
        return self.table("contracts", CONTRACTS)

    def clauses(self) -> DataFrame:
        return self.table("clauses", CLAUSES)

    def results(self) -> DataFrame:
        return self.table("results", RESULTS)

    def metrics(self) -> DataFrame:
        return self.table("metrics", METRICS)

    def save_contracts(self, contracts: DataFrame) -> int:
        """Insert (contract_id, filename, source[, page_count]) rows that are new."""
        if "page_count" not in contracts.columns:
            contracts = contracts.withColumn("page_count", F.lit(None).cast("int"))
        rows = contracts.withColumn("created_at", F.current_timestamp())
        return self._insert("contracts", CONTRACTS, rows, "contract_id", [F.col("filename")])

    def save_clauses(self, clauses: DataFrame, order: Sequence[Column] | None = None) -> int:
        """Insert clauses whose id is new; returns how many there were."""
        rows = clauses.withColumn("created_at", F.current_timestamp())
        order = order or [F.col("contract_id"), F.col("clause_text")]
        return self._insert("clauses", CLAUSES, rows, "clause_id", order)

    def append_results(self, results: DataFrame) -> None:
        results.write.mode("append").parquet(self.path("results"))

    def latest_results(self) -> DataFrame:
        """The newest result of each contract; of equal times the largest row."""
        columns = ["created_at", *[c.strip().split(" ")[0] for c in RESULTS.split(", ")][1:-1]]
        newest = self.results().groupBy("contract_id").agg(F.max(F.struct(*columns)).alias("r"))
        return newest.select("contract_id", "r.*")

    def append_scores(self, scores: DataFrame, version: int) -> None:
        """Add scores of clauses; a row of a higher version replaces a lower one when read."""
        named = [c.strip().split(" ") for c in SCORES.split(", ")]
        given = scores.withColumns({"version": F.lit(version), "created_at": F.current_timestamp()})
        columns = [(F.col(c) if c in given.columns else F.lit(None)).cast(kind).alias(c) for c, kind in named]
        given.select(*columns).write.mode("append").parquet(self.path("scores"))

    def latest_scores(self) -> DataFrame:
        """The newest scores of each clause; each task sends one row a clause."""
        columns = [c.strip().split(" ")[0] for c in SCORES.split(", ")][1:]
        newest = self.table("scores", SCORES).groupBy("clause_id").agg(F.max(F.struct(*columns)).alias("s"))
        return newest.select("clause_id", "s.*")

    def scored_clauses(self) -> DataFrame:
        """Every stored clause with its newest scores, null where it has none."""
        return self.clauses().join(self.latest_scores().drop("created_at"), "clause_id", "left")

    def append_metrics(self, metrics: DataFrame) -> None:
        metrics.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(
            self.path("metrics")
        )

    def latest_metrics(self) -> DataFrame:
        """Newest value per component and metric; of equal times the largest value."""
        return self.metrics().groupBy("component", "metric").agg(
            F.max(F.struct("created_at", "value"))["value"].alias("value")
        )

    def _insert(self, name: str, schema: str, rows: DataFrame, key: str, order: Sequence[Column]) -> int:
        columns = [c.strip().split(" ")[0] for c in schema.split(", ")]
        with stored(first_per_key(rows, [key], order).select(*columns)) as unique:
            fresh = absent_from_store(unique, self.table(name, schema), [key])
            written = Observation()
            counted = fresh.select(*columns).observe(written, F.count(F.lit(1)).alias("n"))
            counted.write.mode("append").parquet(self.path(name))
            return written.get["n"]


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The rows an insert would add: first per key, key not stored yet. The batch is computed once."""
    return absent_from_store(cut_lineage(first_per_key(incoming, [key], order)), existing, [key])


def merge_review_queue(existing: DataFrame, incoming: DataFrame, path: str | None = None) -> DataFrame:
    """Review rows keyed by clause_id; a row already queued stays as it is."""
    merged = merge_keep_existing(existing, incoming, ["clause_id"], [F.col("contract_id"), F.col("clause_text")])
    if path is not None:
        merged.write.mode("errorifexists").parquet(path)
    return merged


def merge_taxonomy_review(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return merge_keep_existing(existing, incoming, ["cluster_id"], [F.col("suggested_name")])


def accept_reviewed(review: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names a reviewer accepted (name, position), and the queue marked done."""
    accepted = F.lower("action") == "accept"
    names = review.where(accepted & F.col("suggested_name").isNotNull()).select(
        F.col("suggested_name").alias("name"), F.col("cluster_id").cast("long").alias("position")
    )
    return names, review.withColumn("action", F.when(accepted, "done").otherwise(F.col("action")))


def read_dynamic_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """(name, position) from a JSON list; empty when the file is missing."""
    try:
        raw = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "name string, position long")
    return raw.select(F.posexplode(F.from_json("value", "array<string>")).alias("position", "name")).select(
        "name", F.col("position").cast("long").alias("position")
    )


def write_dynamic_taxonomy(names: DataFrame, path: str) -> None:
    """Write the ordered names as one JSON list (taxonomy names only: a short list)."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "name")))
    names.agg(F.to_json(F.transform(ordered, lambda s: s["name"])).alias("value")).write.mode(
        "overwrite"
    ).text(path)


def missing_embeddings(clauses: DataFrame, cache: DataFrame) -> DataFrame:
    """Clauses whose text is not embedded yet, keyed by id and text digest."""
    stamped = clauses.withColumn("text_digest", F.md5("clause_text"))
    return absent_rows(stamped, cache, ["clause_id", "text_digest"])


def contract_rows(clauses: DataFrame, source: str) -> DataFrame:
    """One contract row per distinct contract_id of a clause batch."""
    return clauses.select("contract_id").distinct().select(
        "contract_id", F.col("contract_id").alias("filename"), F.lit(source).alias("source")
    )


def uploaded_contracts(uploads: DataFrame, source: str) -> DataFrame:
    """One contract row per upload (contract_id, filename[, page_count]), with or without clauses.

    A contract_id that comes twice keeps the first file name.
    """
    if "page_count" not in uploads.columns:
        uploads = uploads.withColumn("page_count", F.lit(None).cast("int"))
    named = uploads.select("contract_id", "filename", F.lit(source).alias("source"), "page_count")
    return first_per_key(named, ["contract_id"], [F.col("filename"), F.col("page_count")])


def upload_contract_id(text: Column) -> Column:
    return ids.contract_id(text)
