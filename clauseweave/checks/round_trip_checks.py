"""What was written to the shared folder is read back: splits, scores, metrics, names."""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from clauseweave import settings as S
from clauseweave.checks import derived as D
from clauseweave.checks import power_checks
from clauseweave.checks.derived import rounded
from clauseweave.checks.label_checks import _SPLIT_SQL, _prepared
from clauseweave.checks.registry import query, table
from clauseweave.operators import keyed as K
from clauseweave.operators import splits as P
from clauseweave.operators.summaries import report_rows, unscored_clauses
from clauseweave.plans.analysis import analyse_contracts
from clauseweave.session import cut_lineage, shared_folder
from clauseweave.sources import datasets
from clauseweave.sources.filings import read_filings
from clauseweave.sources.store import ClauseStore, read_dynamic_taxonomy, write_dynamic_taxonomy


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/round-trip-{uuid.uuid4().hex}"


@query(
    "split_csv_round_trip",
    f"WITH {_SPLIT_SQL} SELECT s.clause_id, s.primary_type, s.source, array_to_string(c.clause_types, '|') AS labels, s.split FROM split s JOIN cleaned c USING (clause_id)",
)
def split_csv_round_trip(spark, folder):
    """Splits through CSV: labels, quotes and line breaks survive."""
    path = _folder(spark)
    datasets.write_split_csv(P.stratified_split(_prepared(spark, folder)), path)
    parts = [datasets.read_split_csv(spark, f"{path}/{name}").withColumn("split", F.lit(name)) for name in ("train", "val", "test")]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.select("clause_id", "primary_type", "source", F.array_join("clause_types", "|").alias("labels"), "split")


_SCORED_SQL = f"""{D.CLAUSES_SQL},
stored AS (SELECT DISTINCT clause_id, contract_id FROM clauses),
versions AS (SELECT *, CASE WHEN {D.hex_sql('clause_id', 2)} < 4 THEN 2 WHEN {D.hex_sql('clause_id', 2)} < 11 THEN 1 END AS version FROM stored)"""


def _scored_store(spark, folder) -> ClauseStore:
    store = ClauseStore(spark, _folder(spark))
    rows = D.contract_clauses(spark, folder).withColumns(
        {"clause_types": F.array().cast("array<string>"), "party_a": F.lit(""), "party_b": F.lit(""), "source": F.lit("upload")}
    )
    store.save_clauses(rows, [F.col("position")])
    ids, digit = store.clauses().select("clause_id"), D.hex_digit("clause_id", 2)
    # The newer version is written first: order of arrival does not decide.
    for version, below in ((2, 4), (1, 11)):
        score = (D.hex_digit("clause_id", 3) * 6 + version).cast("double")
        scores = ids.where(digit < below).withColumns({"anomaly_score": score, "is_anomalous": score > 70})
        store.append_scores(scores, version)
    return store


@query(
    "stored_scores",
    f"""WITH {_SCORED_SQL} SELECT contract_id, clause_id, version, ({D.hex_sql('clause_id', 3)} * 6 + version)::DOUBLE AS anomaly_score,
      {D.hex_sql('clause_id', 3)} * 6 + version > 70 AS is_anomalous FROM versions WHERE version IS NOT NULL""",
)
def stored_scores(spark, folder):
    """Scores persist with their clause; the newest version is read."""
    rows = _scored_store(spark, folder).scored_clauses().where("version IS NOT NULL")
    return rounded(rows.select("contract_id", "clause_id", "version", "anomaly_score", "is_anomalous"), "anomaly_score")


@query("stored_unscored_clauses", f"WITH {_SCORED_SQL} SELECT contract_id, clause_id FROM versions WHERE version IS NULL")
def stored_unscored_clauses(spark, folder):
    """The clauses of the store that nobody has scored."""
    return unscored_clauses(_scored_store(spark, folder).scored_clauses()).select("contract_id", "clause_id")


@query(
    "latest_metrics",
    "SELECT lang AS component, 'texts.' || source AS metric, count(*)::DOUBLE AS value FROM documents GROUP BY lang, source",
)
def latest_metrics(spark, folder):
    """Metrics appended twice; the second value counts."""
    store = ClauseStore(spark, _folder(spark))
    docs = table(spark, folder, "documents")
    counted = docs.groupBy(F.col("lang").alias("component"), F.concat(F.lit("texts."), "source").alias("metric")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    store.append_metrics(counted.withColumn("value", F.col("value") + 1000))
    store.append_metrics(counted)
    return store.latest_metrics()


@query("stored_names", "SELECT name, row_number() OVER (ORDER BY name) - 1 AS position FROM (SELECT DISTINCT lang || ' ' || source AS name FROM documents)")
def stored_names(spark, folder):
    """The dynamic taxonomy through its JSON file, in order."""
    names = table(spark, folder, "documents").select(F.concat_ws(" ", "lang", "source").alias("name")).distinct()
    ordered = K.merge_names(spark.createDataFrame([], "name string, position long"), names.withColumn("position", F.lit(0).cast("long")))
    path = f"{_folder(spark)}/names"
    write_dynamic_taxonomy(ordered, path)
    return read_dynamic_taxonomy(spark, path)


@query(
    "unknown_label_names",
    f"""WITH {D.LABELLED_SQL} SELECT DISTINCT name FROM (SELECT unnest(clause_types) AS name FROM labelled)
    WHERE NOT list_contains({D.sql_list(S.CLAUSE_TYPES)}, name)""",
)
def unknown_label_names(spark, folder):
    """Labels that the taxonomy lacks."""
    used = D.labelled_clauses(spark, folder).select(F.explode_outer("clause_types").alias("name"))
    known = spark.createDataFrame([(t,) for t in S.CLAUSE_TYPES], "name string")
    return K.new_names(used, known)


def _analysis(spark, folder, version: int, store: ClauseStore, uploads):
    """Uploads through the analysis, with types and anomaly scores that follow from the id."""
    names = F.array(*[F.lit(t) for t in S.CLAUSE_TYPES])
    score = D.hex_digit("clause_id", 4) * F.lit(100.0) / 15 * F.lit(1.0 if version > 1 else 0.5)

    def classify(clauses):
        one = F.array(F.element_at(names, D.hex_digit("clause_id", 2) % 7 + 1))
        return clauses.withColumn("clause_types", F.when(D.hex_digit("clause_id", 1) < 14, one).otherwise(F.array().cast("array<string>")))

    def find_anomalies(clauses):
        return clauses.withColumns({"anomaly_score": score, "is_anomalous": score > S.ANOMALY_FLAG_ABOVE})

    return analyse_contracts(store, uploads, classify, find_anomalies, lambda c: power_checks._with_tone(spark, folder, c), version=version)


@query(
    "analyse_contracts",
    f"""WITH {power_checks._TYPED_SQL},
    counts AS (SELECT contract_id, primary_type, count(*) AS n FROM typed WHERE primary_type IS NOT NULL GROUP BY ALL),
    dominant AS (SELECT contract_id, primary_type FROM counts
      QUALIFY row_number() OVER (PARTITION BY contract_id ORDER BY n DESC, primary_type) = 1),
    totals AS (SELECT contract_id, count(*) AS total_clauses, count(*) FILTER (anomaly_score > 70) AS anomalous_clauses,
      round(avg(power_imbalance_score), 5) AS overall_imbalance_index, round(sum(anomaly_score), 4) AS anomaly_total FROM typed GROUP BY contract_id)
    SELECT c.contract_id, 'doc_'||c.doc_id||'.txt' AS filename, t.overall_imbalance_index, t.total_clauses, t.anomalous_clauses,
      d.primary_type AS dominant_clause_type, t.anomaly_total FROM contracts c LEFT JOIN totals t USING (contract_id) LEFT JOIN dominant d USING (contract_id)""",
)
def analyse_whole_contracts(spark, folder):
    """The analysis end to end, twice: contracts, clauses, newest scores and newest results are read back from the store."""
    store = ClauseStore(spark, _folder(spark))
    # The texts are derived once, not again for each of the four reads of both analyses.
    uploads = cut_lineage(D.contract_texts(spark, folder).withColumn("filename", F.concat(F.lit("doc_"), "doc_id", F.lit(".txt"))))
    _analysis(spark, folder, 1, store, uploads)
    results = _analysis(spark, folder, 2, store, uploads)
    totals = store.scored_clauses().groupBy("contract_id").agg(F.round(F.sum("anomaly_score"), 4).alias("anomaly_total"))
    columns = ["overall_imbalance_index", "total_clauses", "anomalous_clauses", "dominant_clause_type"]
    out = store.contracts().select("contract_id", "filename").join(results.select("contract_id", *columns), "contract_id", "left").join(totals, "contract_id", "left")
    return rounded(out, "overall_imbalance_index", digits=5)


@query(
    "contract_lookup",
    f"""WITH {power_checks._TYPED_SQL},
    own AS (SELECT * FROM typed WHERE contract_id = (SELECT min(contract_id) FROM typed))
    SELECT contract_id, row_number() OVER (ORDER BY position, clause_id) AS row_no, count(*) OVER () AS total_rows,
      coalesce(primary_type, 'Unclassified') AS clause_type, printf('%.1f', anomaly_score) AS anomaly_score,
      CASE WHEN anomaly_score > 70 THEN 'YES' ELSE 'NO' END AS anomaly_flag,
      printf('%+.1f', round(power_imbalance_score, 1)) AS imbalance_score, imbalance_label AS label FROM own""",
)
def contract_lookup(spark, folder):
    """The report of one contract, whichever id comes first."""
    first = D.contract_clauses(spark, folder).agg(F.min("contract_id")).first()[0]
    return report_rows(power_checks.analysed_clauses(spark, folder), first)


def _write_files(texts, path: str) -> None:
    """Every row of ``texts`` (value) with a line end as a ``.txt`` file of its own; null is empty.

    Hadoop's local file system starts a process to set the mode of each file it
    makes, and of the file's checksum, so files of a local path are made without it.
    """
    if path.split("://")[0] != "file" and not path.startswith("/"):
        # Tasks move their files into place themselves: the driver would move them one by one.
        texts.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)
        return
    folder = "/" + path.removeprefix("file:").lstrip("/")

    def write(batches):
        # Named by task and row: a task that is run again writes the same files.
        os.makedirs(folder, exist_ok=True)
        task, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            for value in batch.column("value").to_pylist():
                with open(f"{folder}/part-{task:05d}-{made:09d}.txt", "wb") as file:
                    file.write((value or b"") + b"\n")
                made += 1
        yield pa.RecordBatch.from_pydict({"made": pa.array([made], pa.int64())})

    written, = texts.select(F.col("value").cast("binary")).mapInArrow(write, "made long").agg(F.coalesce(F.sum("made"), F.lit(0))).first()
    if not written:
        os.makedirs(folder, exist_ok=True)


@query(
    "filing_files",
    """WITH t AS (SELECT md5(text || chr(10)) AS digest FROM documents) SELECT digest, count(*) AS n FROM t GROUP BY digest""",
)
def filing_files(spark, folder):
    """Every document as a file of its own, half of them with other line ends, through the folder scan."""
    path = _folder(spark)
    other = F.replace("text", F.lit("\n"), F.lit("\r\n"))
    texts = table(spark, folder, "documents").select(F.when(F.col("doc_id") % 2 == 0, other).otherwise(F.col("text")).alias("value"))
    _write_files(texts, path)
    read = read_filings(spark, path)
    return read.groupBy(F.md5("text").alias("digest")).agg(F.count(F.lit(1)).alias("n"))
