"""Plans that chain the operators: contract analysis, dataset build, growth."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseweave import settings as S
from clauseweave.functions import labels as L
from clauseweave.functions import lexical as X
from clauseweave.functions import text as T
from clauseweave.operators import clusters as C
from clauseweave.operators.segmentation import upload_clauses
from clauseweave.operators.splits import clean_labelled, stratified_split, with_primary_type
from clauseweave.operators.summaries import analysis_rows, contract_summary, with_length_score
from clauseweave.session import cut_lineage, scratch
from clauseweave.sources.store import ClauseStore, uploaded_contracts

#: A table of clauses in, the same clauses with more columns out.
Step = Callable[[DataFrame], DataFrame]


def score_imbalance(
    clauses: DataFrame, sentiment_col: str | None = None, length_fit: DataFrame | None = None
) -> DataFrame:
    """Add every lexical feature, both leverages, the imbalance and its label.

    ``sentiment_col`` names a map of class probabilities from a tone model;
    without it tone is neutral. ``length_fit``: see with_length_score.
    """
    tone = F.lit(S.NEUTRAL_SCORE) if sentiment_col is None else X.sentiment_score(F.col(sentiment_col))
    if "n_words" not in clauses.columns:
        clauses = clauses.withColumn("n_words", T.word_count(F.col("clause_text")))
    staged = X.with_lexical_features(clauses.withColumn("sentiment_score", tone))
    return X.with_leverage(with_length_score(staged, length_fit))


def analyse_contracts(
    store: ClauseStore,
    uploads: DataFrame,
    classify: Step,
    find_anomalies: Step,
    tone: Step | None = None,
    sentiment_col: str = "tone",
    version: int = 1,
    source: str = "upload",
) -> DataFrame:
    """Uploaded texts (contract_id, filename, text) through the whole analysis and into the store.

    ``classify`` adds clause_types, ``find_anomalies`` anomaly_score and
    is_anomalous, ``tone`` a map of class probabilities; each takes and returns
    a table of clauses. Contracts and clauses that are stored stay as they are;
    scores get ``version``, and each contract with clauses one more result row.
    Returns the newest result of every stored contract.
    """
    with scratch(uploads.sparkSession):
        clauses = cut_lineage(upload_clauses(uploads, source))
        typed = find_anomalies(classify(clauses if tone is None else tone(clauses)))
        scored = cut_lineage(score_imbalance(typed, None if tone is None else sentiment_col))
        store.save_clauses(scored, [F.col("position")])
        store.append_scores(scored, version)
        summary = contract_summary(scored)
        named = summary.withColumns({"party_a": F.lit("Party A"), "party_b": F.lit("Party B")})
        metadata = F.struct("party_a", "party_b", "dominant_party", "report_band")
        store.append_results(analysis_rows(named, metadata, F.current_timestamp()))
        # Contracts last: a contract row marks the upload as fully analysed.
        store.save_contracts(uploaded_contracts(uploads, source))
    return store.latest_results()


def build_splits(clauses: DataFrame, **options) -> DataFrame:
    """Stored clauses to a labelled train/val/test table."""
    return stratified_split(with_primary_type(clean_labelled(clauses)), **options)


def grow_taxonomy(
    unknown: DataFrame, types: DataFrame, known: DataFrame, vector_col: str
) -> dict[str, DataFrame]:
    """Unknown clauses through clustering, routing and taxonomy growth.

    ``unknown`` carries clause_id, clause_text and an embedding. Store it first:
    fitting the clusters reads it several times.
    """
    clustered = C.discover_clusters(unknown, vector_col)
    return route_clusters(clustered, types, known, vector_col)


def route_clusters(
    clustered: DataFrame, types: DataFrame, known: DataFrame, vector_col: str
) -> dict[str, DataFrame]:
    """Everything after cluster assignment, as one table per destination."""
    middle = C.centroids(clustered, vector_col)
    words = C.keyword_lists(C.cluster_keywords(clustered))
    routes = C.with_route(C.nearest_type(middle, types, "cluster_id", "centroid")).join(
        middle.select("cluster_id", F.col("cluster_size").alias("size")), "cluster_id"
    )
    candidates = routes.where("route = 'new_type'").join(words, "cluster_id", "left")
    expanded = C.expand_taxonomy(candidates, known)
    return {
        "routes": routes,
        "report": C.cluster_report(clustered, words),
        "relabelled": C.relabelled(clustered, routes),
        "ambiguous": C.ambiguous_review(clustered, routes, words),
        "expanded": expanded,
        "new_types": C.new_type_clauses(clustered, expanded),
    }


def label_counters(predicted: DataFrame) -> DataFrame:
    """How many clauses were accepted or sent to review."""
    return predicted.groupBy("status").agg(F.count(F.lit(1)).alias("n_clauses"))


def clause_listing(clauses: DataFrame) -> DataFrame:
    """The clause list of an analysis: labels as array, label of the imbalance."""
    return clauses.withColumn("imbalance_label", X.imbalance_label(F.col("power_imbalance_score"))).withColumn(
        "primary_type", L.primary_label(F.col("clause_types"))
    )
