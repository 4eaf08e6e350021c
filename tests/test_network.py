from __future__ import annotations

import numpy as np
import pytest

from clauseweave.operators import anomalies as A
from clauseweave.operators import network as W
from clauseweave.session import cut_lineage


def vectors(spark, x, parts=4):
    return cut_lineage(spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id long, v array<double>").repartition(parts))


def test_gradient_against_differences():
    rng = np.random.default_rng(1)
    sizes = W.layer_sizes(5, [4, 2])
    assert sizes == (5, 4, 2, 4, 5)
    weights = W.first_weights(sizes, 3) + rng.normal(size=W.first_weights(sizes, 3).shape) * 0.1
    x = rng.normal(size=(7, 5))
    _, gradient = W.summed_gradient(sizes, weights, x)
    for i in range(len(weights)):
        step = np.zeros_like(weights)
        step[i] = 1e-6
        above, below = (W.summed_gradient(sizes, weights + s, x)[0] for s in (step, -step))
        assert gradient[i] == pytest.approx((above - below) / 2e-6, abs=1e-5)


def test_gradient_of_all_tasks_is_that_of_one_pass(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 6)) * 3 + 1
    sizes = W.layer_sizes(6, [4, 2])
    net = W.Network(sizes, x.mean(axis=0), 2.0, W.first_weights(sizes, 1))
    want_error, want = W.summed_gradient(sizes, net.weights, (x - net.centre) / 2.0)
    for parts in (1, 7):
        rows, error, gradient = W.total_gradient(vectors(spark, x, parts).select("v"), net)
        assert rows == 500
        assert error == pytest.approx(want_error)
        assert gradient == pytest.approx(want, abs=1e-8)


def test_curved_rows_better_than_components(spark):
    """Rows on a closed curve in eight dimensions: one bottleneck unit pair cannot be linear."""
    rng = np.random.default_rng(5)
    t = rng.uniform(-2, 2, 800)
    x = np.column_stack([t, t**2, np.sin(2 * t), np.cos(2 * t), np.abs(t), t**3 / 4, np.tanh(3 * t), t * np.abs(t)]) + rng.normal(size=(800, 8)) * 0.01
    df = vectors(spark, x)
    network = W.fit_network(df, "v", hidden=[24, 2], passes=80)
    curved = W.score_network(df, network, "v").agg({"ae_score": "avg"}).first()[0]
    linear = A.reconstruction_error(df, "v", 2).agg({"ae_score": "avg"}).first()[0]
    assert curved < 0.7 * linear


def test_stored_network_scores_alike(spark, tmp_path):
    x = np.random.default_rng(6).normal(size=(60, 4))
    df = vectors(spark, x)
    network = W.fit_network(df, "v", hidden=[3, 2], passes=4)
    network.table(spark).write.parquet(str(tmp_path / "net"))
    again = W.Network.of(spark.read.parquet(str(tmp_path / "net")))
    rows = spark.createDataFrame([(0, [1.0, 2.0, 3.0, 4.0]), (1, None)], "id long, v array<double>")
    first, second = (W.score_network(rows, n, "v").orderBy("id").collect() for n in (network, again))
    assert first[0].ae_score == second[0].ae_score > 0
    assert first[1].ae_score is None
    with pytest.raises(ValueError):
        W.fit_network(rows.where("v IS NULL"), "v")


def test_anomaly_model_with_a_network(spark, tmp_path):
    rng = np.random.default_rng(7)
    df = vectors(spark, rng.normal(size=(200, 5)))
    model = A.fit_anomalies(df, "id", "v", 2, hidden=[4, 2])
    model.save(str(tmp_path / "m"))
    loaded = A.AnomalyModel.load(spark, str(tmp_path / "m"))
    new = vectors(spark, np.vstack([rng.normal(size=(20, 5)), [[40.0, -40.0, 40.0, -40.0, 40.0]]]))
    first, second = ({r.id: r for r in A.score_anomalies(new, m, "v").collect()} for m in (model, loaded))
    assert {i: r.combined_score for i, r in first.items()} == {i: r.combined_score for i, r in second.items()}
    direct = {r.id: r.ae_score for r in W.score_network(new, W.Network.of(loaded.reconstruction), "v").collect()}
    assert {i: r.ae_score for i, r in first.items()} == direct
    assert first[20].ae_score == max(direct.values()) and first[20].is_anomalous


def test_forest_cuts_the_next_feature_where_the_drawn_one_is_constant(spark):
    """Only one of forty features varies: every tree must find it."""
    x = np.zeros((80, 40))
    x[:, 17] = np.arange(80)
    model = A.fit_isolation_forest(vectors(spark, x), "id", "v", trees=6, rows_per_tree=32).collect()
    for tree in model:
        assert tree.feature[0] == 17
        assert {f for f in tree.feature if f >= 0} == {17}
    same = A.fit_isolation_forest(vectors(spark, np.ones((20, 3))), "id", "v", trees=2, rows_per_tree=8).collect()
    assert all(set(t.feature) == {-1} for t in same)
