"""Anomaly fusion, cluster routing, keywords, taxonomy growth."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from clauseweave import settings as S
from clauseweave.checks import derived as D
from clauseweave.checks.derived import rounded
from clauseweave.checks.registry import query, table
from clauseweave.functions import text as T
from clauseweave.functions import vectors as V
from clauseweave.operators import anomalies as A
from clauseweave.operators import clusters as C
from clauseweave.operators import neighbours as N
from clauseweave.operators import network as W
from clauseweave.session import cut_lineage, scratch

# --- Anomalies --------------------------------------------------------------------

_RAW_SQL = """
raw AS (SELECT vec_id, label, 0.5::DOUBLE - list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))) / 64 AS if_score,
    list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE * x::DOUBLE * x::DOUBLE)) / 64 AS ae_score FROM embeddings)"""
_FUSED_SQL = f"""{_RAW_SQL},
fit AS (SELECT min(-if_score) AS il, max(-if_score) AS ih, min(ae_score) AS al, max(ae_score) AS ah FROM raw),
normalised AS (SELECT vec_id, (-if_score - il) / (ih - il) * 100 AS if_normalised, (ae_score - al) / (ah - al) * 100 AS ae_normalised
  FROM raw, fit),
fused AS (SELECT *, 0.5 * if_normalised + 0.5 * ae_normalised AS combined_score FROM normalised)"""


def _raw(spark, folder):
    x = F.transform("embedding", lambda e: e.cast("double"))
    rows = table(spark, folder, "embeddings").withColumn("x", x)
    return rows.select(
        "vec_id",
        (F.lit(0.5) - V.total(F.transform("x", F.abs)) / 64).alias("if_score"),
        (V.total(F.transform("x", lambda e: e * e * e * e)) / 64).alias("ae_score"),
    )


@query(
    "anomaly_fusion",
    f"""WITH {_FUSED_SQL} SELECT vec_id, round(if_normalised, 6) AS if_normalised, round(ae_normalised, 6) AS ae_normalised,
      round(combined_score, 6) AS combined_score, combined_score > 70 AS is_anomalous FROM fused""",
)
def anomaly_fusion(spark, folder):
    out = A.fuse(_raw(spark, folder)).select("vec_id", "if_normalised", "ae_normalised", "combined_score", "is_anomalous")
    return rounded(out, "if_normalised", "ae_normalised", "combined_score")


_PROXY_SQL = f"""{_FUSED_SQL},
sized AS (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS n_words FROM documents),
proxied AS (SELECT doc_id, n_words, (n_words < 15 OR n_words > (SELECT quantile_cont(n_words, 0.95) FROM sized))::INT AS proxy_anomaly FROM sized)"""


def _proxied(spark, folder):
    sized = table(spark, folder, "documents").select("doc_id", T.word_count(F.col("text")).alias("n_words"))
    return A.proxy_labels(cut_lineage(sized))


@query("proxy_anomalies", f"WITH {_PROXY_SQL} SELECT doc_id, n_words, proxy_anomaly FROM proxied")
def proxy_anomalies(spark, folder):
    return _proxied(spark, folder)


@query(
    "precision_recall_at_k",
    f"""WITH {_PROXY_SQL}, top AS (SELECT proxy_anomaly FROM proxied JOIN fused ON doc_id = vec_id
      ORDER BY combined_score DESC, doc_id LIMIT 50),
    all_ AS (SELECT count(*) AS n, sum(proxy_anomaly) AS pos FROM proxied JOIN fused ON doc_id = vec_id)
    SELECT round(avg(proxy_anomaly), 6) AS precision_at_k, round(sum(proxy_anomaly)::DOUBLE / greatest(max(pos), 1), 6) AS recall_at_k,
      50 AS k, max(n) AS test_size, max(pos)::BIGINT AS proxy_anomalies FROM top, all_""",
)
def precision_recall_at_k(spark, folder):
    fused = A.fuse(_raw(spark, folder)).select(F.col("vec_id").alias("doc_id"), "combined_score")
    labelled = _proxied(spark, folder).join(fused, "doc_id")
    out = A.precision_recall_at_k(labelled, 50, "combined_score", "proxy_anomaly", "doc_id")
    return rounded(out, "precision_at_k", "recall_at_k")


def _forest_sql(trees: int, rows: int, seed: int) -> str:
    """The forest replayed level by level: draws from digests, ranges, children, then the path of every row."""
    depth = max(1, math.ceil(math.log2(max(rows, 2))))
    mean = "CASE WHEN n <= 1 THEN 0 WHEN n = 2 THEN 1 ELSE 2 * (ln(n - 1) + 0.57721566490153286) - 2 * (n - 1)::DOUBLE / n END"
    steps = [
        f"""keyed AS (SELECT vec_id, embedding::DOUBLE[] AS x, md5(vec_id||'|{seed}') AS k FROM embeddings),
placed AS (SELECT x, row_number() OVER (ORDER BY k) - 1 AS p, least(count(*) OVER (), {trees * rows}) AS pool FROM keyed),
sizes AS (SELECT *, least({rows}, pool) AS per FROM placed WHERE p < pool),
p0 AS (SELECT (p + j * pool) // per AS tree, 0 AS node, x FROM sizes, (SELECT unnest(range({trees * rows})) AS j) WHERE p + j * pool < {trees} * per),
w0 AS (SELECT vec_id, x, tree, 0 AS node FROM keyed, (SELECT unnest(range({trees})) AS tree))"""
    ]
    for i in range(depth + 1):
        split = f"n > 1 AND lo < hi AND {i} < {depth}"
        child = "2 * node + 1 + (x[f + 1] > lo + u * (hi - lo))::INT AS node"
        steps.append(
            f"""d{i} AS (SELECT tree, node, md5('{seed}|'||tree||'|'||node) AS h FROM p{i} GROUP BY tree, node),
f{i} AS (SELECT tree, node, ('0x'||h[1:8])::BIGINT % 64 AS f, ('0x'||h[9:16])::BIGINT / 4294967296.0::DOUBLE AS u FROM d{i}),
s{i} AS (SELECT tree, node, any_value(f) AS f, any_value(u) AS u, count(*) AS n, min(x[f + 1]) AS lo, max(x[f + 1]) AS hi
  FROM p{i} JOIN f{i} USING (tree, node) GROUP BY tree, node),
p{i + 1} AS (SELECT tree, {child}, x FROM p{i} JOIN s{i} USING (tree, node) WHERE {split}),
e{i} AS (SELECT vec_id, {i} + {mean} AS path FROM w{i} JOIN s{i} USING (tree, node) WHERE NOT ({split})),
w{i + 1} AS (SELECT vec_id, x, tree, {child} FROM w{i} JOIN s{i} USING (tree, node) WHERE {split})"""
        )
    ends = " UNION ALL ".join(f"SELECT * FROM e{i}" for i in range(depth + 1))
    return f"""{", ".join(steps)},
raw AS (SELECT vec_id, -pow(2, -avg(path) / {A._mean_path(rows)!r}) AS raw FROM ({ends}) GROUP BY vec_id)"""


@query(
    "isolation_forest",
    f"""WITH {_forest_sql(S.FOREST_TREES, S.FOREST_SAMPLE_ROWS, S.SEED)}
    SELECT vec_id, round(raw - (SELECT quantile_cont(raw, 0.05) FROM raw), 6) AS if_score FROM raw""",
)
def isolation_forest(spark, folder):
    rows = table(spark, folder, "embeddings")
    model = A.fit_isolation_forest(rows, "vec_id", "embedding")
    scored = cut_lineage(rows.select("vec_id", A.forest_score(model, "embedding").alias("forest_raw")))
    return A.forest_decision(scored).select("vec_id", F.round("if_score", 6).alias("if_score"))


@query("reconstruction_error")
def reconstruction_error(spark, folder):
    out = A.reconstruction_error(table(spark, folder, "embeddings"), "embedding", components=4)
    return rounded(out.select("vec_id", "ae_score"), "ae_score", digits=5)


# Training sums floating-point gradients, so no SQL repeats it; tests hold the network
# against finite differences and against principal components.
@query("network_reconstruction")
def network_reconstruction(spark, folder):
    rows = cut_lineage(table(spark, folder, "embeddings"))
    out = W.score_network(rows, W.fit_network(rows, "embedding"), "embedding")
    return rounded(out.select("vec_id", "ae_score"), "ae_score", digits=4)


# The forward pass of a network with given weights, for every row.
_LAYERS = [64, 6, 3, 6, 64]
_LAYER_SQL = ", ".join(
    f"""z{n + 1} AS (SELECT vec_id, x, list_transform(range({b}), lambda j: 0.01::DOUBLE * j +
      list_sum(list_transform(range({a}), lambda i: h[i + 1] * sin(i + {b} * j + {n})::DOUBLE / {a}))) AS z FROM h{n}),
    h{n + 1} AS (SELECT vec_id, x, {"list_transform(z, lambda e: greatest(e, 0.01::DOUBLE * e))" if n < 3 else "z"} AS h FROM z{n + 1})"""
    for n, (a, b) in enumerate(zip(_LAYERS[:-1], _LAYERS[1:], strict=True))
)


@query(
    "network_scores",
    f"""WITH h0 AS (SELECT vec_id, embedding::DOUBLE[] AS x, embedding::DOUBLE[] AS h FROM embeddings), {_LAYER_SQL}
    SELECT vec_id, round(list_sum(list_transform(range(64), lambda i: pow(h[i + 1] - x[i + 1], 2))) / 64, 6) AS ae_score FROM h4""",
)
def network_scores(spark, folder):
    parts = []
    for n, (a, b) in enumerate(zip(_LAYERS[:-1], _LAYERS[1:], strict=True)):
        i, j = np.arange(a)[:, None], np.arange(b)[None]
        parts += [(np.sin(i + b * j + n) / a).ravel(), 0.01 * np.arange(b)]
    network = W.Network(tuple(_LAYERS), np.zeros(64), 1.0, np.concatenate(parts))
    out = W.score_network(table(spark, folder, "embeddings"), W.Network.of(network.table(spark)), "embedding")
    return rounded(out.select("vec_id", "ae_score"), "ae_score")


@query("anomaly_scores")
def anomaly_scores(spark, folder):
    out = A.score_embeddings(table(spark, folder, "embeddings"), "vec_id", "embedding", components=4)
    return rounded(out.select("vec_id", "combined_score", "is_anomalous"), "combined_score", digits=3)


# --- Clusters ---------------------------------------------------------------------

_DIMS_SQL = "unnest(range(64)) AS d, unnest(embedding)::DOUBLE AS x"
_CENTROID_SQL = f"""
dims AS (SELECT vec_id, label, {_DIMS_SQL} FROM embeddings),
means AS (SELECT label AS cluster_id, d, avg(x) AS m FROM dims GROUP BY label, d),
sizes AS (SELECT label AS cluster_id, count(*) AS size FROM embeddings GROUP BY label)"""
# A type's reference vector is a weighted mean of its label's vectors. Weights
# grow with the label, so that all three routes occur.
_ROUTES_SQL = f"""{_CENTROID_SQL},
weights AS (SELECT vec_id, label, CASE WHEN label = 0 THEN coalesce(toxic, 0)::DOUBLE WHEN l.doc_id IS NOT NULL THEN 1::DOUBLE
  ELSE label / 10.0::DOUBLE END AS w FROM embeddings LEFT JOIN labels l ON l.doc_id = vec_id),
types AS (SELECT 'Type '||d.label AS name, d.label AS position, d, sum(w * x) / sum(w) AS x
  FROM dims d JOIN weights w ON w.vec_id = d.vec_id GROUP BY d.label, d),
sims AS (SELECT m.cluster_id, t.name, t.position, sum(m * x) / (sqrt(sum(m * m)) * sqrt(sum(x * x))) AS sim
  FROM means m JOIN types t USING (d) GROUP BY ALL),
routes AS (SELECT cluster_id, name AS best_type, sim AS best_sim,
    CASE WHEN sim >= 0.8 THEN 'relabel' WHEN sim >= 0.5 THEN 'review' ELSE 'new_type' END AS route FROM sims
  QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY sim DESC, position) = 1)"""


def _clustered(spark, folder):
    return table(spark, folder, "embeddings").withColumn("cluster_id", F.col("label"))


def _types(spark, folder):
    hits = table(spark, folder, "labels").select(F.col("doc_id").alias("vec_id"), "toxic")
    rows = table(spark, folder, "embeddings").join(hits, "vec_id", "left")
    weight = (
        F.when(F.col("label") == 0, F.coalesce("toxic", F.lit(0)).cast("double"))
        .when(F.col("toxic").isNotNull(), F.lit(1.0))
        .otherwise(F.col("label") / F.lit(10.0))
    )
    dims = rows.select("label", weight.alias("w"), F.posexplode("embedding").alias("d", "x"))
    means = dims.groupBy("label", "d").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"))
    vectors = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("v"))
    return vectors.select(
        F.concat(F.lit("Type "), "label").alias("name"),
        F.col("label").cast("long").alias("position"),
        F.transform("v", lambda s: s["x"]).alias("embedding"),
    )


def _routes(spark, folder):
    middle = C.centroids(_clustered(spark, folder), "embedding")
    return C.with_route(C.nearest_type(middle, _types(spark, folder), "cluster_id", "centroid"))


@query(
    "cluster_centroids",
    f"""WITH {_CENTROID_SQL} SELECT cluster_id, d AS dim, round(m, 6) AS value, size AS cluster_size
    FROM means JOIN sizes USING (cluster_id)""",
)
def cluster_centroids(spark, folder):
    out = C.centroids(_clustered(spark, folder), "embedding")
    return out.select("cluster_id", F.posexplode_outer("centroid").alias("dim", "value"), "cluster_size").withColumn(
        "value", F.round("value", 6)
    )


@query("route_clusters", f"WITH {_ROUTES_SQL} SELECT cluster_id, best_type, round(best_sim, 6) AS best_sim, route FROM routes")
def route_clusters(spark, folder):
    return rounded(_routes(spark, folder), "best_sim")


@query(
    "nearest_vectors",
    f"""WITH {_ROUTES_SQL},
    pairs AS (SELECT v.vec_id, t.name, t.position, sum(v.x * t.x) / (sqrt(sum(v.x * v.x)) * sqrt(sum(t.x * t.x))) AS sim
      FROM dims v JOIN types t USING (d) GROUP BY ALL)
    SELECT vec_id, name AS best_type, round(sim, 6) AS best_sim FROM pairs
    QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, position) = 1""",
)
def nearest_vectors(spark, folder):
    rows = table(spark, folder, "embeddings")
    return rounded(C.nearest_type(rows, _types(spark, folder), "vec_id", "embedding"), "best_sim")


@query(
    "relabelled_clauses",
    f"""WITH {_ROUTES_SQL} SELECT vec_id, best_type AS clause_type, round(best_sim, 4) AS confidence, 'EDGAR_cluster_relabel' AS source
    FROM embeddings JOIN routes ON cluster_id = label WHERE route = 'relabel'""",
)
def relabelled_clauses(spark, folder):
    out = C.relabelled(_clustered(spark, folder), _routes(spark, folder))
    return out.select("vec_id", F.element_at("clause_types", 1).alias("clause_type"), "confidence", "source")


# Clusters of documents: the source column groups them.
STOPS = S.NAME_STOPS
_KEYWORD_SQL = f"""
docs AS (SELECT doc_id, substr(source, 4)::INT AS cluster_id, text,
  [w FOR w IN regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') IF NOT list_contains({D.sql_list(STOPS)}, w)] AS tokens
  FROM documents),
terms AS (SELECT doc_id, cluster_id, unnest(tokens) AS term FROM docs
  UNION ALL SELECT doc_id, cluster_id, unnest(list_transform(range(1, len(tokens)), lambda i: tokens[i]||' '||tokens[i + 1])) FROM docs),
vocabulary AS (SELECT term FROM terms GROUP BY term),
tf AS (SELECT doc_id, cluster_id, term, count(*)::DOUBLE AS n FROM terms SEMI JOIN vocabulary USING (term) GROUP BY ALL),
idf AS (SELECT term, ln(((SELECT count(*) FROM docs) + 1)::DOUBLE / (count(*) + 1)) + 1 AS w FROM tf GROUP BY term),
weighted AS (SELECT doc_id, cluster_id, term, n * w AS v FROM tf JOIN idf USING (term)),
lengths AS (SELECT doc_id, sqrt(sum(v * v)) AS len FROM weighted GROUP BY doc_id),
members AS (SELECT cluster_id, count(*) AS size FROM docs GROUP BY cluster_id),
means AS (SELECT w.cluster_id, term, sum(v / len) / any_value(size) AS weight
  FROM weighted w JOIN lengths USING (doc_id) JOIN members m ON m.cluster_id = w.cluster_id GROUP BY w.cluster_id, term),
keywords AS (SELECT cluster_id, term, weight, row_number() OVER (PARTITION BY cluster_id ORDER BY round(weight, 12) DESC, term) AS rank
  FROM means QUALIFY rank <= 10),
word_lists AS (SELECT cluster_id, list(term ORDER BY rank) AS words FROM keywords GROUP BY cluster_id)"""


def _document_clusters(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id",
        F.substring("source", 4, 10).cast("int").alias("cluster_id"),
        F.col("doc_id").cast("string").alias("clause_id"),
        F.col("text").alias("clause_text"),
    )


def _words(spark, folder):
    return C.keyword_lists(C.cluster_keywords(_document_clusters(spark, folder), stop_words=STOPS))


@query(
    "cluster_keywords",
    f"WITH {_KEYWORD_SQL} SELECT cluster_id, rank, term, round(weight, 6) AS weight FROM keywords",
)
def cluster_keywords(spark, folder):
    return rounded(C.cluster_keywords(_document_clusters(spark, folder), stop_words=STOPS), "weight")


@query(
    "cluster_report",
    f"""WITH {_KEYWORD_SQL},
    shortest AS (SELECT cluster_id, text, row_number() OVER (PARTITION BY cluster_id ORDER BY length(text), doc_id::VARCHAR) AS n
      FROM docs QUALIFY n <= 3),
    samples AS (SELECT cluster_id, max(text) FILTER (n = 1) AS sample_1, max(text) FILTER (n = 2) AS sample_2,
      max(text) FILTER (n = 3) AS sample_3 FROM shortest GROUP BY cluster_id)
    SELECT cluster_id, size, array_to_string(words[1:6], ', ') AS keywords, array_to_string(words, ', ') AS all_keywords, coalesce(sample_1, '') AS sample_1,
      coalesce(sample_2, '') AS sample_2, coalesce(sample_3, '') AS sample_3, '' AS suggested_name, '' AS auto_route
    FROM members JOIN samples USING (cluster_id) JOIN word_lists USING (cluster_id)""",
)
def cluster_report(spark, folder):
    return C.cluster_report(_document_clusters(spark, folder), _words(spark, folder))


# Here the share of a cluster's documents that carry a label plays the similarity.
_DOC_ROUTES_SQL = f"""{_KEYWORD_SQL},
shares AS (SELECT cluster_id, count(l.doc_id)::DOUBLE / count(*) AS best_sim FROM docs d LEFT JOIN labels l USING (doc_id) GROUP BY cluster_id),
doc_routes AS (SELECT cluster_id, 'Notices' AS best_type, best_sim, CASE WHEN best_sim >= 0.8 THEN 'relabel'
  WHEN best_sim >= 0.4 THEN 'review' ELSE 'new_type' END AS route FROM shares)"""


def _document_routes(spark, folder):
    docs = _document_clusters(spark, folder)
    labels = table(spark, folder, "labels").select("doc_id", F.lit(1).alias("hit"))
    share = docs.join(labels, "doc_id", "left").groupBy("cluster_id").agg(
        (F.count("hit") / F.count(F.lit(1))).alias("best_sim")
    )
    route = F.when(F.col("best_sim") >= 0.8, "relabel").when(F.col("best_sim") >= 0.4, "review").otherwise("new_type")
    return share.select("cluster_id", F.lit("Notices").alias("best_type"), "best_sim", route.alias("route"))


@query(
    "ambiguous_review",
    f"""WITH {_DOC_ROUTES_SQL}
    SELECT r.cluster_id, array_to_string(any_value(words)[1:6], ', ') AS cluster_keywords, array_to_string(any_value(words), ', ') AS all_keywords, any_value(best_type) AS best_match,
      round(any_value(best_sim), 4) AS best_sim, count(*) AS size, arg_min(text, doc_id::VARCHAR) AS sample_1,
      '' AS suggested_name, 'review' AS action
    FROM docs d JOIN doc_routes r USING (cluster_id) JOIN word_lists USING (cluster_id) WHERE route = 'review' GROUP BY r.cluster_id""",
)
def ambiguous_review(spark, folder):
    return C.ambiguous_review(_document_clusters(spark, folder), _document_routes(spark, folder), _words(spark, folder))


_EXPANDED_SQL = f"""{_KEYWORD_SQL},
candidates AS (SELECT cluster_id, words, size FROM word_lists JOIN members USING (cluster_id)
  UNION ALL SELECT cluster_id + 100, list_reverse(words), size // 4 FROM word_lists JOIN members USING (cluster_id)
  UNION ALL SELECT cluster_id + 200, words, size FROM word_lists JOIN members USING (cluster_id)
  UNION ALL SELECT cluster_id + 300, ['notices'], size FROM word_lists JOIN members USING (cluster_id)
  UNION ALL SELECT cluster_id + 400, ['a', 'of'], size FROM word_lists JOIN members USING (cluster_id)),
kept AS (SELECT *, [w FOR w IN words[1:6] IF NOT list_contains({D.sql_list(S.NAME_STOPS)}, lower(w)) AND length(w) > 2][1:4] AS k FROM candidates),
named AS (SELECT cluster_id, size, CASE WHEN len(k) = 0 THEN 'Unknown Clause Type' ELSE array_to_string(list_transform(k, lambda w:
    array_to_string(list_transform(string_split(w, ' '), lambda x: upper(x[1])||lower(x[2:])), ' ')), ' ') END AS base,
  CASE WHEN size < 10 THEN 'noise' ELSE 'auto_add' END AS outcome FROM kept),
marked AS (SELECT *, coalesce(max((outcome = 'auto_add')::INT) OVER (PARTITION BY base ORDER BY cluster_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 OR list_contains({D.sql_list(S.CLAUSE_TYPES)}, base) AS clash FROM named)"""


def _candidates(spark, folder):
    sizes = _document_clusters(spark, folder).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    base = _words(spark, folder).join(sizes, "cluster_id")
    c, size = F.col("cluster_id"), F.col("size")
    variants = F.explode(
        F.array(
            F.struct(c.alias("id"), F.col("words").alias("w"), size.alias("n")),
            F.struct((c + 100).alias("id"), F.reverse("words").alias("w"), F.floor(size / 4).alias("n")),
            F.struct((c + 200).alias("id"), F.col("words").alias("w"), size.alias("n")),
            F.struct((c + 300).alias("id"), F.array(F.lit("notices")).alias("w"), size.alias("n")),
            F.struct((c + 400).alias("id"), F.array(F.lit("a"), F.lit("of")).alias("w"), size.alias("n")),
        )
    )
    return base.select(variants.alias("v")).select(
        F.col("v.id").alias("cluster_id"), F.col("v.w").alias("words"), F.col("v.n").alias("size")
    )


@query(
    "expand_taxonomy",
    f"""WITH {_EXPANDED_SQL} SELECT cluster_id, size, outcome,
      CASE WHEN outcome <> 'noise' THEN CASE WHEN clash THEN base||' Variant' ELSE base END END AS type_name FROM marked""",
)
def expand_taxonomy(spark, folder):
    known = spark.createDataFrame([(t,) for t in S.CLAUSE_TYPES], "name string")
    return C.expand_taxonomy(_candidates(spark, folder), known).select("cluster_id", "size", "outcome", "type_name")


@query(
    "new_type_clauses",
    f"""WITH {_EXPANDED_SQL} SELECT doc_id, CASE WHEN clash THEN base||' Variant' ELSE base END AS clause_type, 0.0::DOUBLE AS confidence,
      'EDGAR_new_type' AS source FROM docs JOIN marked USING (cluster_id) WHERE outcome = 'auto_add'""",
)
def new_type_clauses(spark, folder):
    known = spark.createDataFrame([(t,) for t in S.CLAUSE_TYPES], "name string")
    expanded = C.expand_taxonomy(_candidates(spark, folder), known)
    out = C.new_type_clauses(_document_clusters(spark, folder), expanded)
    return out.select("doc_id", F.element_at("clause_types", 1).alias("clause_type"), "confidence", "source")


@query("discover_clusters")
def discover_clusters(spark, folder):
    return C.discover_clusters(table(spark, folder, "embeddings"), "embedding").select("vec_id", "cluster_id")


# --- Neighbours and density --------------------------------------------------------

# Up to 1024 points share a leaf, so the graph is exact; beyond that a test measures its recall.
_NEIGHBOUR_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
u AS (SELECT vec_id, list_transform(x, lambda e: e / sqrt(list_sum(list_transform(x, lambda y: y * y)))) AS x FROM v),
pairs AS (SELECT a.vec_id, b.vec_id AS neighbour, round(sqrt(greatest(0, 2 - 2 * list_dot_product(a.x, b.x))), 7) AS d
  FROM u a JOIN u b ON a.vec_id <> b.vec_id)
SELECT vec_id, neighbour, round(d, 4) AS distance FROM pairs
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbour) <= 15"""


@query("nearest_neighbours", _NEIGHBOUR_SQL)
def nearest_neighbours(spark, folder):
    rows = table(spark, folder, "embeddings")
    with scratch(spark):
        points = cut_lineage(N.unit_vectors(rows, "vec_id", "embedding"))
        graph = cut_lineage(N.neighbour_graph(points), keep=True)
    near = graph.select(F.col("id").alias("vec_id"), F.explode("near").alias("n"))
    return near.select("vec_id", F.col("n.id").alias("neighbour"), F.round("n.distance", 4).alias("distance"))


# Every vector moves close to the axis of its group (its id modulo 20), all groups
# around one more axis; nine vectors stay where they are, far off: too few for a cluster.
@query(
    "planted_clusters",
    """WITH g AS (SELECT vec_id, CASE WHEN vec_id < 9 THEN -1 ELSE vec_id % 20 END AS planted FROM embeddings)
    SELECT vec_id, CASE WHEN planted < 0 THEN -1 ELSE min(vec_id) OVER (PARTITION BY planted) END AS cluster FROM g""",
)
def planted_clusters(spark, folder):
    group = F.when(F.col("vec_id") < 9, -1).otherwise(F.col("vec_id") % 20)
    moved = F.transform(
        "embedding",
        lambda x, i: x.cast("double")
        + F.when(F.col("planted") < 0, 0.0).when(i == 63, 30.0).when(i == F.col("planted"), 10.0).otherwise(0.0),
    )
    rows = table(spark, folder, "embeddings").withColumn("planted", group).withColumn("vector", moved)
    found = cut_lineage(C.discover_clusters(rows, "vector").select("vec_id", "cluster_id"))
    least = found.where(F.col("cluster_id") != C.NOISE).groupBy("cluster_id").agg(F.min("vec_id").alias("first"))
    return found.join(least, "cluster_id", "left").select("vec_id", F.coalesce("first", F.lit(C.NOISE)).alias("cluster"))
