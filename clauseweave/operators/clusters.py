"""Clusters of unknown clauses: discovery, keywords, routing, taxonomy growth."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import NGram, StopWordsRemover
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseweave import settings as S
from clauseweave.functions.text import WORD
from clauseweave.operators.density import NOISE, density_clusters
from clauseweave.operators.keyed import first_k_per_key
from clauseweave.operators.neighbours import unit_vector
from clauseweave.session import cut_lineage, remove_stored, scratch, small_side

BLOCK_BYTES = 64 * 1024 * 1024
#: Characters of text whose terms are shuffled at a time, up to so many slices; rows whose lengths are broadcast.
SLICE_CHARS, SLICES, LENGTH_ROWS = 32_000_000, 16, 2_000_000
#: Tokens that one vectorised step counts; a term is frequent from one row in so many on.
STEP_TOKENS, FREQUENT_ROWS = 1 << 20, 10_000


def discover_clusters(
    clauses: DataFrame,
    vector_col: str,
    min_size: int = S.MIN_CLUSTER_SIZE,
    seed: int = S.SEED,
) -> DataFrame:
    """Add ``cluster_id``: clusters by density, as many as there are; -1 is noise.

    Copies of a vector are one point of that weight. Rows without a direction
    (null or zero vectors) are noise. See ``operators.density`` for the method.
    """
    staged = clauses.withColumn("_unit", unit_vector(F.col(vector_col)))
    counts = staged.where("_unit IS NOT NULL").groupBy(F.col("_unit").alias("v")).agg(F.count(F.lit(1)).alias("weight"))
    # Stored, so that the numbers stay the same in every later pass.
    with scratch(clauses.sparkSession):
        points = cut_lineage(counts.withColumn("id", F.monotonically_increasing_id()))
        labels = density_clusters(points, min_size=min_size, seed=seed)
        found = cut_lineage(points.join(labels, "id").select(F.col("v").alias("_v"), F.col("cluster_id").alias("_label")), keep=True)
    key = F.xxhash64("_unit") == F.xxhash64("_v")
    joined = staged.join(found, key & (F.col("_unit") == F.col("_v")), "left").drop("_unit", "_v", "cluster_id")
    return joined.withColumn("cluster_id", F.coalesce("_label", F.lit(NOISE))).drop("_label")


def centroids(clauses: DataFrame, vector_col: str) -> DataFrame:
    """Mean vector and size per cluster; noise is left out."""
    vec = array_to_vector(F.col(vector_col).cast("array<double>"))
    return (
        clauses.where(F.col("cluster_id") != NOISE)
        .select("cluster_id", vec.alias("v"))
        .groupBy("cluster_id")
        .agg(Summarizer.mean(F.col("v")).alias("m"), F.count(F.lit(1)).alias("cluster_size"))
        .select("cluster_id", vector_to_array("m").alias("centroid"), "cluster_size")
    )


def terms(text: Column) -> Column:
    """Lower-case tokens of two or more word characters."""
    # ASCII letters are tested first; the class as a whole is unchanged by that.
    return F.regexp_extract_all(F.lower(text), F.lit(rf"[[a-z][{WORD}]]{{2,}}"), F.lit(0))


def term_lists(clauses: DataFrame, text_col: str, stop_words: Sequence[str]) -> DataFrame:
    """Add ``terms``: unigrams and bigrams left after stop words."""
    tokens = clauses.withColumn("_tokens", terms(F.coalesce(text_col, F.lit(""))))
    kept = StopWordsRemover(inputCol="_tokens", outputCol="_kept", stopWords=list(stop_words)).transform(tokens)
    pairs = NGram(n=2, inputCol="_kept", outputCol="_pairs").transform(kept)
    return pairs.withColumn("terms", F.concat("_kept", "_pairs")).drop("_tokens", "_kept", "_pairs")


def counted(column: str) -> Column:
    """(term, n) of every distinct term of an array, from the runs of the sorted array."""
    runs = "filter(sequence(0, size(s) - 1), i -> i = 0 OR s[i] <> s[greatest(i - 1, 0)])"
    pairs = f"transform(array({runs}), r -> transform(r, (p, i) -> named_struct('term', s[p], 'n', bigint(coalesce(get(r, i + 1), size(s)) - p))))[0]"
    return F.expr(f"CASE WHEN size({column}) > 0 THEN transform(array(array_sort({column})), s -> {pairs})[0] END")


def _counted_terms(stop_words: Sequence[str]):
    """(_row, cluster_id, term, n) of every distinct term of a row: the unigrams and bigrams left after stop words."""
    stops = pa.array(sorted({w.lower() for w in stop_words}), pa.string())

    def terms_of(batch: pa.RecordBatch, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        encoded = batch.column("_tokens").flatten().dictionary_encode()
        lengths = pc.fill_null(pc.list_value_length(batch.column("_tokens")), 0).to_numpy(zero_copy_only=False)
        words, code = encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row, size = np.repeat(np.arange(batch.num_rows), lengths), max(1, len(words))
        kept = ~pc.is_in(pc.utf8_lower(words), value_set=stops).to_numpy(zero_copy_only=False)[code]
        code, row = code[kept], row[kept]
        single, n = np.unique(row * size + code, return_counts=True)
        yield made(batch, single // size, words.take(pa.array(single % size)), n, schema)
        inside = row[1:] == row[:-1]
        pair, n = np.unique(((row[1:] * size + code[:-1]) * size + code[1:])[inside], return_counts=True)
        first, second = words.take(pa.array(pair // size % size)), words.take(pa.array(pair % size))
        yield made(batch, pair // size // size, pc.binary_join_element_wise(first, second, " "), n, schema)

    def made(batch: pa.RecordBatch, row: np.ndarray, term: pa.Array, n: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
        own = [batch.column(c).take(pa.array(row)) for c in ("_row", "cluster_id")]
        return pa.RecordBatch.from_arrays([*own, term, pa.array(n, pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch.column("_tokens")), 0).to_numpy(zero_copy_only=False)
            schema = pa.schema([("_row", pa.int64()), ("cluster_id", batch.schema.field("cluster_id").type), ("term", pa.string()), ("n", pa.int64())])
            ends, at = np.cumsum(lengths), 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP_TOKENS, side="right")))
                yield from terms_of(batch.slice(at, end - at), schema)
                at = end

    return run


def english_stop_words() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


def cluster_keywords(
    clauses: DataFrame,
    text_col: str = "clause_text",
    vocabulary_size: int | None = None,
    per_cluster: int = S.KEYWORDS_PER_CLUSTER,
    stop_words: Sequence[str] | None = None,
) -> DataFrame:
    """Terms of highest mean TF-IDF per cluster: (cluster_id, rank, term, weight).

    Every term counts unless ``vocabulary_size`` keeps the most frequent ones
    (ties by name). Terms are counted inside their row and stored once as (row,
    term, count), dealt by term to slices that follow one another, so what is
    shuffled at a time is a slice. A term's inverse frequency is a factor of its
    sum, so only the row lengths need it beside each count; nothing grows with the
    vocabulary on the driver or in one task. No row gives a term more than 1, so a
    cluster whose last keyword weighs more than an infrequent term can reach needs
    the sums of frequent terms only; for other clusters all terms are summed. Noise
    rows count for document frequencies but get no keywords.
    """
    stop_words = english_stop_words() if stop_words is None else stop_words
    with scratch(clauses.sparkSession):
        return cut_lineage(_keywords(clauses, text_col, vocabulary_size, per_cluster, stop_words), keep=True)


def _keywords(clauses: DataFrame, text_col: str, vocabulary_size: int | None, per_cluster: int, stop_words: Sequence[str]) -> DataFrame:
    sizes = cut_lineage(clauses.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), F.sum(F.length(text_col)).alias("chars")))
    rows, chars = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("chars"), F.lit(0))).first()
    slices = min(SLICES, 1 + chars // SLICE_CHARS)

    # Numbered before the terms are rows, and stored, so that the numbers stay the same in every later pass.
    tokens = clauses.select("cluster_id", terms(F.coalesce(text_col, F.lit(""))).alias("_tokens"), F.monotonically_increasing_id().alias("_row"))
    kind = tokens.schema["cluster_id"].dataType.simpleString()
    listed = tokens.mapInArrow(_counted_terms(stop_words), f"_row long, cluster_id {kind}, term string, n long")
    number = F.pmod(F.xxhash64("term"), F.lit(slices)).cast("int").alias("slice")
    counts = cut_lineage(listed.select("*", number), by=("slice",))
    if vocabulary_size is not None:
        totals = counts.groupBy("term").agg(F.sum("n").alias("total"))
        wanted = cut_lineage(totals.orderBy(F.desc("total"), "term").limit(vocabulary_size).select("term"))
        counts = counts.join(wanted, "term", "left_semi")
    parts = [counts.where(F.col("slice") == i) for i in range(slices)]

    idf = F.log(F.lit(float(rows + 1)) / (F.col("rows") + 1)) + 1.0
    squares, frequent, least = [], [], 1 + rows // FREQUENT_ROWS
    for part in parts:
        frequency = cut_lineage(part.groupBy("term").agg(F.count(F.lit(1)).alias("rows")))
        frequent.append(small_side(frequency.where(F.col("rows") >= least)))
        # Hashed: a slice's terms are dealt to all partitions, and its counts need no sorting.
        weighted = part.select("_row", "term", "n").join(frequency.hint("shuffle_hash"), "term").select("_row", (F.col("n") * idf).alias("w"))
        squares.append(cut_lineage(weighted.groupBy("_row").agg(F.sum(F.col("w") * F.col("w")).alias("q"))))
        remove_stored(frequency)
    lengths = small_side(reduce(DataFrame.unionByName, squares).groupBy("_row").agg(F.sqrt(F.sum("q")).alias("len")), LENGTH_ROWS)

    # Rounded for ranking so that equal weights tie whatever the summation order.
    order = [F.desc(F.round("weight", 12)), F.col("term")]

    def summed(part: DataFrame) -> DataFrame:
        return part.join(lengths, "_row").groupBy("cluster_id", "term").agg(F.sum(F.col("n") / F.col("len")).alias("s"), F.count(F.lit(1)).alias("hits"))

    def first(framed: DataFrame) -> DataFrame:
        named = framed.join(sizes, "cluster_id").select("cluster_id", "term", (F.col("s") * idf / F.col("size")).alias("weight"))
        return cut_lineage(first_k_per_key(named, ["cluster_id"], order, per_cluster, "rank"))

    def merged(best: list[DataFrame]) -> DataFrame:
        return first_k_per_key(reduce(DataFrame.unionByName, best), ["cluster_id"], order, per_cluster, "rank")

    known = F.col("cluster_id") != NOISE
    best = cut_lineage(merged([first(summed(part.where(known).join(common, "term")).join(common, "term")) for part, common in zip(parts, frequent, strict=True)]))
    # A term of fewer rows than the frequent ones weighs at most that many rows by the size; sums are exact to far less than 1e-9.
    last = best.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("found"), F.min("weight").alias("last"))
    settled = (F.col("found") == per_cluster) & (F.col("last") - 1e-9 > F.lit(least - 1.0) / F.col("size"))
    wide = sizes.where(known).join(last, "cluster_id", "left").where(~F.coalesce(settled, F.lit(False))).select("cluster_id")
    if least == 1 or (wide := cut_lineage(wide)).isEmpty():
        return best
    everything = []
    for part in parts:
        # At most one row a cluster for each term.
        framed = summed(part).withColumn("rows", F.sum("hits").over(Window.partitionBy("term")))
        everything.append(first(framed.join(wide, "cluster_id", "left_semi")))
    return best.join(wide, "cluster_id", "left_anti").unionByName(merged(everything))


def keyword_lists(keywords: DataFrame) -> DataFrame:
    """(cluster_id, words) with at most ten words per cluster, best first."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "term")))
    return keywords.groupBy("cluster_id").agg(F.transform(ordered, lambda s: s["term"]).alias("words"))


def cluster_report(clauses: DataFrame, words: DataFrame, samples: int = 3) -> DataFrame:
    """Size, keywords and the shortest sample texts per cluster, largest first."""
    members = clauses.where(F.col("cluster_id") != NOISE)
    sizes = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    shortest = first_k_per_key(
        members.select("cluster_id", "clause_id", "clause_text"),
        ["cluster_id"],
        [F.length("clause_text"), F.col("clause_id")],
        samples,
        "_n",
    )
    picks = shortest.groupBy("cluster_id").agg(
        *[F.max(F.when(F.col("_n") == i, F.col("clause_text"))).alias(f"sample_{i}") for i in range(1, samples + 1)]
    )
    out = sizes.join(picks, "cluster_id").join(words, "cluster_id", "left")
    return out.select(
        "cluster_id",
        "size",
        F.coalesce(F.array_join(F.slice("words", 1, 6), ", "), F.lit("")).alias("keywords"),
        F.coalesce(F.array_join("words", ", "), F.lit("")).alias("all_keywords"),
        *[F.coalesce(f"sample_{i}", F.lit("")).alias(f"sample_{i}") for i in range(1, samples + 1)],
        F.lit("").alias("suggested_name"),
        F.lit("").alias("auto_route"),
    ).orderBy(F.desc("size"), "cluster_id")


def nearest_type(vectors: DataFrame, types: DataFrame, key: str, vector_col: str) -> DataFrame:
    """Most similar type name per vector: (key, best_type, best_sim).

    ``types`` is (position, name, embedding). It goes to the tasks in blocks of
    bounded size, normally a single one; ties fall to the lower position.
    """
    count, dim = types.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    if not count:
        raise ValueError("no types to compare with")
    per_block = max(1, BLOCK_BYTES // (8 * dim))
    slim = vectors.select(key, F.col(vector_col).cast("array<double>").alias("v"))
    key_type = slim.schema[key].dataType.simpleString()
    best = None
    low = None
    while True:
        after = types if low is None else types.where((F.col("position") > low.position) | ((F.col("position") == low.position) & (F.col("name") > low.name)))
        block = after.orderBy("position", "name").limit(per_block).collect()
        if not block:
            break
        low = block[-1]
        part = _nearest_in_block(slim, block, key, key_type)
        best = part if best is None else best.unionByName(part)
    if count <= per_block:
        winners = best
    else:
        winners = best.groupBy(key).agg(
            F.min_by(F.struct("best_type", "best_sim"), F.struct(-F.col("best_sim"), "position")).alias("b")
        ).select(key, "b.best_type", "b.best_sim")
    return winners.select(key, "best_type", "best_sim")


def _nearest_in_block(slim: DataFrame, block: list, key: str, key_type: str) -> DataFrame:
    names = [r.name for r in block]
    positions = np.array([r.position for r in block])
    matrix = np.array([r.embedding for r in block], dtype=float)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    shared = slim.sparkSession.sparkContext.broadcast((names, positions, matrix))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labels, places, unit = shared.value
        for pdf in batches:
            if pdf.empty:
                continue
            x = np.stack(pdf["v"].to_numpy()).astype(float)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            sims = x @ unit.T
            at = sims.argmax(axis=1)
            yield pd.DataFrame(
                {
                    key: pdf[key],
                    "best_type": [labels[i] for i in at],
                    "best_sim": sims[np.arange(len(at)), at],
                    "position": places[at],
                }
            )

    return slim.mapInPandas(compare, f"{key} {key_type}, best_type string, best_sim double, position long")


def with_route(nearest: DataFrame) -> DataFrame:
    """Add ``route``: relabel from 0.80, review from 0.50, else new_type."""
    return nearest.withColumn(
        "route",
        F.when(F.col("best_sim") >= S.ROUTE_HIGH_SIMILARITY, "relabel")
        .when(F.col("best_sim") >= S.ROUTE_LOW_SIMILARITY, "review")
        .otherwise("new_type"),
    )


def relabelled(clauses: DataFrame, routes: DataFrame) -> DataFrame:
    """Clauses of clusters that match an existing type, labelled with it."""
    hits = routes.where("route = 'relabel'").select("cluster_id", "best_type", "best_sim")
    return clauses.join(small_side(hits), "cluster_id").withColumns(
        {
            "clause_types": F.array("best_type"),
            "confidence": F.round("best_sim", 4),
            "source": F.lit("EDGAR_cluster_relabel"),
        }
    ).drop("best_type", "best_sim")


def ambiguous_review(clauses: DataFrame, routes: DataFrame, words: DataFrame) -> DataFrame:
    """One review row per ambiguous cluster: size and its first clause by id."""
    hits = small_side(routes.where("route = 'review'").select("cluster_id", "best_type", "best_sim"))
    wanted = clauses.join(hits.select("cluster_id"), "cluster_id", "left_semi")
    per_cluster = wanted.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("size"), F.min_by("clause_text", "clause_id").alias("sample_1")
    )
    return hits.join(per_cluster, "cluster_id").join(words, "cluster_id", "left").select(
        "cluster_id",
        F.array_join(F.slice("words", 1, 6), ", ").alias("cluster_keywords"),
        F.array_join("words", ", ").alias("all_keywords"),
        F.col("best_type").alias("best_match"),
        F.round("best_sim", 4).alias("best_sim"),
        "size",
        "sample_1",
        F.lit("").alias("suggested_name"),
        F.lit("review").alias("action"),
    )


def auto_name(words: Column) -> Column:
    """Title-cased name from the first keywords, skipping stop and short words."""
    kept = F.filter(
        F.slice(words, 1, 6), lambda w: (~F.lower(w).isin(*S.NAME_STOPS)) & (F.length(w) > 2)
    )

    def title(word: Column) -> Column:
        parts = F.split(word, r"(?<=\P{L})(?=\p{L})")
        return F.array_join(F.transform(parts, F.initcap), "")

    named = F.array_join(F.transform(F.slice(kept, 1, 4), title), " ")
    return F.when(F.size(kept) > 0, named).otherwise(S.UNNAMED_TYPE)


def expand_taxonomy(
    candidates: DataFrame,
    known: DataFrame,
    auto_add_min: int = S.AUTO_ADD_MIN_SIZE,
    review_min: int = S.REVIEW_MIN_SIZE,
) -> DataFrame:
    """Name new-type clusters and decide their fate.

    ``candidates`` is (cluster_id, words, size), ``known`` has the names in use.
    Adds ``type_name`` and ``outcome`` (noise, auto_add, review). A name already
    in use, or taken by an auto-added cluster of lower id, gets " Variant".
    """
    outcome = (
        F.when(F.col("size") < review_min, "noise")
        .when(F.col("size") >= auto_add_min, "auto_add")
        .otherwise("review")
    )
    named = candidates.withColumns({"outcome": outcome, "_base": auto_name(F.col("words"))})
    in_use = known.select(F.col("name").alias("_base"), F.lit(True).alias("_known")).distinct()
    earlier = Window.partitionBy("_base").orderBy("cluster_id").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.coalesce(F.max((F.col("outcome") == "auto_add").cast("int")).over(earlier), F.lit(0)) == 1
    marked = named.withColumn("_taken", taken).join(in_use, "_base", "left")
    name = F.when(
        F.col("_known") | F.col("_taken"), F.concat("_base", F.lit(" Variant"))
    ).otherwise(F.col("_base"))
    return marked.withColumn(
        "type_name", F.when(F.col("outcome") != "noise", name)
    ).drop("_base", "_known", "_taken")


def new_type_clauses(clauses: DataFrame, expanded: DataFrame) -> DataFrame:
    """Clauses of auto-added clusters under their new name."""
    added = expanded.where("outcome = 'auto_add'").select("cluster_id", "type_name")
    return clauses.join(small_side(added), "cluster_id").withColumns(
        {
            "clause_types": F.array("type_name"),
            "confidence": F.lit(0.0),
            "source": F.lit("EDGAR_new_type"),
        }
    ).drop("type_name")
