from __future__ import annotations

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F

import compare
from clauseweave import settings as S
from clauseweave.checks import model_checks
from clauseweave.checks.registry import CHECK_SQL
from clauseweave.functions import probabilities as P
from clauseweave.operators import anomalies as A
from clauseweave.operators import clusters as C
from clauseweave.operators import inference as I
from clauseweave.plans.analysis import grow_taxonomy


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    near = rng.normal(0, 1, size=(600, 6))
    far = rng.normal(0, 1, size=(6, 6)) + 9
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.vstack([near, far]))]
    return spark.createDataFrame(rows, "id long, v array<float>")


def test_forest_finds_outliers_and_repeats(spark, points):
    model = A.fit_isolation_forest(points, "id", "v", trees=60, rows_per_tree=64).persist()
    assert model.count() == 60
    scored = A.forest_decision(points.withColumn("forest_raw", A.forest_score(model, "v", 64)))
    rows = scored.orderBy("if_score").collect()
    assert {r.id for r in rows[:6]} == set(range(600, 606))
    assert sum(r.if_score < 0 for r in rows) == pytest.approx(0.05 * len(rows), abs=2)
    again = A.fit_isolation_forest(points.repartition(5), "id", "v", trees=60, rows_per_tree=64)
    assert {r.tree: list(r.threshold) for r in again.collect()} == {r.tree: list(r.threshold) for r in model.collect()}


def test_tree_samples_have_equal_size(spark, points):
    sample = A.sample_for_trees(points, "id", "v", trees=20, rows_per_tree=64, seed=1)
    assert {r["count"] for r in sample.groupBy("tree").count().collect()} == {64}
    few = A.sample_for_trees(points.limit(10), "id", "v", trees=5, rows_per_tree=64, seed=1)
    assert {r["count"] for r in few.groupBy("tree").count().collect()} == {10}
    small = A.sample_for_trees(points, "id", "v", trees=3, rows_per_tree=50, seed=1)
    assert {r["count"] for r in small.groupBy("tree").count().collect()} == {50}


def test_reconstruction_error_like_numpy(spark, points):
    x = np.array([r.v for r in points.orderBy("id").collect()], dtype=float)
    centred = x - x.mean(axis=0)
    _, _, vt = np.linalg.svd(centred, full_matrices=False)
    kept = centred @ vt[:2].T @ vt[:2]
    want = ((centred - kept) ** 2).mean(axis=1)
    got = [r.ae_score for r in A.reconstruction_error(points, "v", 2).orderBy("id").collect()]
    assert got == pytest.approx(list(want), abs=1e-6)


def test_bounds_fitted_elsewhere_clip(spark):
    train = spark.createDataFrame([(0.0, 0.0), (-1.0, 2.0)], "if_score double, ae_score double")
    new = spark.createDataFrame([(-5.0, 9.0), (3.0, -1.0), (-0.5, 1.0)], "if_score double, ae_score double")
    rows = A.fuse(new, A.score_bounds(train)).collect()
    assert [r.combined_score for r in rows] == [100.0, 0.0, 50.0]
    assert [r.is_anomalous for r in rows] == [True, False, False]
    flat = spark.createDataFrame([(1.0, 1.0)], "if_score double, ae_score double")
    assert A.fuse(flat).first().combined_score == 0.0


def test_nearest_type_in_several_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vectors, types = rng.normal(size=(40, 5)), rng.normal(size=(23, 5))
    types[11] = types[3] * 2  # same direction: the lower position wins
    vectors[0] = types[3]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id int, v array<double>")
    known = spark.createDataFrame(
        [(f"t{i}", i, [float(x) for x in v]) for i, v in enumerate(types)], "name string, position long, embedding array<double>"
    )
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    want = (np.round(unit(vectors) @ unit(types).T, 12)).argmax(axis=1)
    for size in (C.BLOCK_BYTES, 8 * 5 * 4):
        monkeypatch.setattr(C, "BLOCK_BYTES", size)
        rows = C.nearest_type(df, known, "id", "v").orderBy("id").collect()
        assert [r.best_type for r in rows] == [f"t{i}" for i in want]


def test_growth_end_to_end(spark):
    rng = np.random.default_rng(2)
    axes = np.eye(8)
    rows = []
    for i in range(240):
        axis = i % 4
        v = axes[axis] * 5 + rng.normal(0, 0.1, 8)
        rows.append((f"k{i}", f"c{i}", f"topic{axis} widget{axis} number {i}", [float(x) for x in v]))
    unknown = spark.createDataFrame(
        rows, "clause_id string, contract_id string, clause_text string, embedding array<double>"
    )
    types = spark.createDataFrame(
        [("Notices", 0, [float(x) for x in axes[0]]), ("Payments", 1, [float(x) for x in axes[1] + axes[2]])],
        "name string, position long, embedding array<double>",
    )
    known = types.select("name")
    clustered = C.discover_clusters(unknown, "embedding").persist()
    assert clustered.groupBy("cluster_id").count().count() == 4
    from clauseweave.plans.analysis import route_clusters

    out = route_clusters(clustered, types, known, "embedding")
    assert {r.route for r in out["routes"].collect()} == {"relabel", "review", "new_type"}
    assert {r.clause_types[0] for r in out["relabelled"].collect()} == {"Notices"}
    assert out["ambiguous"].count() == 2
    names = {r.type_name for r in out["expanded"].collect()}
    assert len(names) == 1 and "Topic3" in names.pop()
    assert out["new_types"].count() == 60
    assert [r.size for r in out["report"].collect()] == [60] * 4
    assert set(grow_taxonomy(unknown, types, known, "embedding")) == set(out)


def test_variant_names(spark):
    rows = [(1, ["notices"], 20), (2, ["alpha", "beta"], 20), (3, ["alpha", "beta"], 5), (4, ["alpha", "beta"], 30), (5, ["of", "x"], 10)]
    candidates = spark.createDataFrame(rows, "cluster_id int, words array<string>, size long")
    known = spark.createDataFrame([("Notices",)], "name string")
    out = {r.cluster_id: (r.outcome, r.type_name) for r in C.expand_taxonomy(candidates, known).collect()}
    assert out == {
        1: ("auto_add", "Notices Variant"), 2: ("auto_add", "Alpha Beta"), 3: ("noise", None),
        4: ("auto_add", "Alpha Beta Variant"), 5: ("auto_add", "Unknown Clause Type"),
    }


def test_auto_name_titles_like_python(spark):
    words = ["term_of use", "x2y party", "don", "été long", "a", "THE", "Seventh"]
    df = spark.createDataFrame([(words,)], "w array<string>")
    kept = [w for w in words[:6] if w.lower() not in ("the", "a") and len(w) > 2]
    assert df.select(C.auto_name(F.col("w"))).first()[0] == " ".join(w.title() for w in kept[:4])


def test_windows_cover_everything(spark):
    for n in (0, 1, 253, 254, 255, 380, 381, 1000):
        tokens = spark.createDataFrame([([*range(n)],)], "t array<int>")
        got = [list(w) for w in tokens.select(P.window_tokens(F.col("t"))).first()[0]]
        want, start = [list(range(n))[:254]], 0
        while n > 254 and start + 126 < n:
            start += 126
            want.append(list(range(start, min(start + 254, n))))
        assert got == want


def test_batched_model_sees_every_row(spark):
    df = spark.range(100).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("x"))

    def make():
        return lambda batch: np.asarray(batch) * 2.0

    rows = I.with_model_output(df, make, "x", "y", batch_rows=7, input_length=2).collect()
    assert all(list(r.y) == [2.0 * r.id, 2.0] for r in rows)


def test_decode_edges(spark):
    names = ["A", "B"]
    df = spark.createDataFrame([([0.29, 0.1],), ([0.5, 0.5],), ([0.4, 0.45],), ([0.3, 0.2],)], "p array<double>")
    limits = F.array(F.lit(0.5), F.lit(0.5))
    got = [r[0] for r in df.select(P.decode(F.col("p"), limits, names)).collect()]
    assert got == [["Other"], ["A", "B"], ["Other"], ["Other"]]
    low = F.array(F.lit(0.3), F.lit(0.3))
    assert [r[0] for r in df.select(P.decode(F.col("p"), low, names)).collect()][3] == ["A"]


def test_token_windows_through_a_model(spark):
    rows = [("a", list(range(1, 401))), ("b", [5, 9]), ("c", [])]
    df = spark.createDataFrame(rows, "clause_id string, t array<int>")

    def make():
        return lambda batch: np.stack([batch.max(axis=1), (np.asarray(batch) > 0).sum(axis=1)], axis=1) / 1.0

    got = {r.clause_id: list(r.probabilities) for r in I.classify_tokens(df, make, "t").collect()}
    assert got == {"a": [400.0, 254.0], "b": [9.0, 2.0], "c": [0.0, 0.0]}


def test_anomaly_model_scores_new_rows(spark, points, tmp_path):
    model = A.fit_anomalies(points, "id", "v", components=2)
    model.save(str(tmp_path / "m"))
    loaded = A.AnomalyModel.load(spark, str(tmp_path / "m"))
    together = {r.id: (r.if_score, r.ae_score, r.combined_score) for r in A.score_anomalies(points, loaded, "v").collect()}
    own = {r.id: (r.if_score, r.ae_score, r.combined_score) for r in A.score_embeddings(points, "id", "v", 2).collect()}
    assert np.allclose([together[k] for k in sorted(own)], [own[k] for k in sorted(own)])
    # A new contract of three clauses is judged by the training rows, not by itself.
    few = points.orderBy("id").limit(3)
    alone = {r.id: (r.if_score, r.ae_score, r.combined_score) for r in A.score_anomalies(few, loaded, "v").collect()}
    assert np.allclose(list(alone.values()), [together[k] for k in alone])
    share = sum(v[0] < 0 for v in together.values()) / len(together)
    assert share == pytest.approx(S.FOREST_CONTAMINATION, abs=1.5 / len(together) + 1e-9)


def test_types_that_share_a_position_at_a_block_border(spark, monkeypatch):
    rng = np.random.default_rng(3)
    types = rng.normal(size=(12, 4))
    known = spark.createDataFrame([(f"t{i:02}", i // 4, [float(x) for x in v]) for i, v in enumerate(types)], "name string, position long, embedding array<double>")
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(types)], "id int, v array<double>")
    monkeypatch.setattr(C, "BLOCK_BYTES", 8 * 4 * 3)
    rows = C.nearest_type(df, known, "id", "v").orderBy("id").collect()
    assert [r.best_type for r in rows] == [f"t{i:02}" for i in range(12)]


def test_blend_counts_are_those_of_every_blend(spark):
    """Temperature, thresholds and F1 of each blend by going through all of them one by one."""
    from clauseweave.operators import evaluation as E

    rng = np.random.default_rng(11)
    n, classes = 90, 5
    y = (rng.random((n, classes)) < 0.3).astype(int)
    y[:, 4] = 0  # a class without positives
    models = {m: np.clip(rng.random((n, classes)) * 0.6 + y * rng.uniform(0, 0.5), 0, 1) for m in ("a", "b", "c")}
    models["a"][0, :3] = [0.0, 1.0, 0.5]
    rows = [(*[[float(x) for x in models[m][i]] for m in models], [int(k) for k in y[i]]) for i in range(n)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>, c array<double>, labels array<int>").repartition(3)
    got = {r.candidate: r for r in E.ensemble_search(df, list(models)).collect()}
    best = (-1.0, 0)
    for order, name, weights in E.weight_candidates(list(models)):
        p = sum(w * models[m] for w, m in zip(weights, models, strict=True))
        q = np.clip(p, S.PROBABILITY_EPSILON, 1 - S.PROBABILITY_EPSILON)
        x = np.log(q / (1 - q))
        loss = [(np.maximum(x / t, 0) - x / t * y + np.log1p(np.exp(-np.abs(x / t)))).mean() for t in S.TEMPERATURE_GRID]
        t = S.TEMPERATURE_GRID[int(np.argmin(loss))]
        hot = p if t == 1.0 else 1 / (1 + np.exp(-x / t))
        f1, thresholds = [], []
        for c in range(classes):
            scores = []
            for cut in S.THRESHOLD_GRID:
                flagged = hot[:, c] >= cut
                below = y[:, c].sum() + flagged.sum()
                scores.append(2 * (flagged & (y[:, c] == 1)).sum() / below if below else 0.0)
            f1.append(max(scores) if y[:, c].any() else 0.0)
            thresholds.append(S.THRESHOLD_GRID[int(np.argmax(scores))] if y[:, c].any() else S.DEFAULT_CLASS_THRESHOLD)
        r = got[order]
        assert (r.name, list(r.weights), r.temperature) == (name, weights, t)
        assert r.f1_macro == pytest.approx(np.mean(f1))
        assert list(r.thresholds) == thresholds
        if np.mean(f1) > best[0] + 1e-12:
            best = (np.mean(f1), order)
    assert [o for o, r in got.items() if r.is_winner] == [best[1]]
    assert len(got) == 102


def test_ensemble_plan_does_not_fan_out(spark):
    from clauseweave.operators import evaluation as E

    df = spark.createDataFrame([([0.2, 0.9], [0.1, 0.8], [0, 1])], "a array<double>, b array<double>, labels array<int>")
    counts = E.blend_counts(df, ["a", "b"], "labels", [[1.0, 0.0], [0.5, 0.5]])
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
    assert counts.count() == 2


def test_windows_of_texts_without_words(spark, tmp_path):
    texts = ["the a the", "", " \n ", "de " * 300, "que"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = compare.spark_rows(model_checks.window_max_pool(spark, str(tmp_path)))
    assert compare.difference(got, compare.duck_rows(duck, CHECK_SQL["window_max_pool"])) is None
    assert sum("nan" in row for row in got[1]) == 2
