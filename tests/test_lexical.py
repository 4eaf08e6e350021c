from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from clauseweave import settings as S
from clauseweave.functions import lexical as X
from clauseweave.operators.attribution import FEATURES, with_feature_attribution, with_word_attribution
from clauseweave.operators.summaries import contract_summary, length_statistics, with_length_score
from clauseweave.plans.analysis import score_imbalance

PARTS = [
    "The Company shall", "Licensee must pay", "either party may", "in no event", "subject to", "you will", "we",
    "our", "might", "maybe", "shallow", "SHALL", "Buyer", "required.", "; ", ". ", "unless", "provided that",
    "entitled", "the seller", "nothing", "été", "shall_x", "may-be", "will\n", "under no circumstances",
]


def clauses() -> list[str]:
    rng = random.Random(5)
    return ["", "."] + [" ".join(rng.choice(PARTS) for _ in range(rng.randint(1, 25))) for _ in range(600)]


def share(a: int, b: int) -> float:
    return a / (a + b) if a + b else 0.5


def expected(text: str) -> tuple[float, float, float]:
    low = text.lower()
    tokens = re.findall(r"\w+", low)
    modal = share(sum(w in S.OBLIGATION_WORDS for w in tokens), sum(w in S.DISCRETION_WORDS for w in tokens))

    def has(s, terms):
        return any(t in s for t in terms)

    duties = [s for s in re.split(r"[.;]\s+", low) if has(s, S.OBLIGATION_WORDS)]
    a = sum(has(s, S.PARTY_A_TERMS) and not has(s, S.PARTY_B_TERMS) for s in duties)
    b = sum(has(s, S.PARTY_B_TERMS) and not has(s, S.PARTY_A_TERMS) for s in duties)
    firm = share(sum(t in low for t in S.ABSOLUTE_TERMS), sum(t in low for t in S.CONDITIONAL_TERMS))
    return modal, share(b, a), firm


def test_features_like_python(spark):
    values = clauses()
    df = spark.createDataFrame(list(enumerate(values)), "i int, clause_text string")
    rows = sorted(X.with_lexical_features(df).collect(), key=lambda r: r.i)
    for row, text in zip(rows, values, strict=True):
        got = (row.modal_score, row.obligation_score, row.assertiveness_score)
        assert got == pytest.approx(expected(text)), text


def test_labels_at_the_limits(spark):
    values = [40.0, 39.99, 20.0, 19.99, 0.0, -20.0, -40.0, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = df.select(X.imbalance_label(F.col("v")).alias("l"), X.report_band(F.col("v")).alias("b")).collect()
    assert [r.l for r in rows] == [
        "HIGH", "MEDIUM", "MEDIUM", "BALANCED", "BALANCED", "MEDIUM (Party B)", "HIGH (Party B)", None,
    ]
    assert [r.b for r in rows[:5]] == ["MODERATE", "MODERATE", "BALANCED", "BALANCED", "BALANCED"]


def test_sentiment(spark):
    maps = [{"negative": 0.5, "positive": 0.5}, {"LABEL_2": 1.0}, {"odd": 1.0}, None, {}]
    df = spark.createDataFrame([(m,) for m in maps], "m map<string,double>")
    got = [r[0] for r in df.select(X.sentiment_score(F.col("m"))).collect()]
    assert got == [0.5, 1.0, 0.5, 0.5, 0.0]


def test_length_paths_agree(spark):
    rows = [(f"c{i % 3}", f"k{i}", i * i % 17 + 1) for i in range(60)] + [("solo", "z", 5)]
    df = spark.createDataFrame(rows, "contract_id string, clause_id string, n_words int")
    joined = with_length_score(df)
    stats = length_statistics(df, ["contract_id"])
    carried = with_length_score(df.join(stats, "contract_id"))
    pick = lambda d: {r.clause_id: r.length_score for r in d.collect()}
    a, b = pick(joined), pick(carried)
    assert a == pytest.approx(b)
    assert a["z"] == 0.5


def test_attribution_adds_up(spark):
    df = spark.createDataFrame(
        [(0.1, 0.9, 1.0, 0.7, 0.8), (0.5, 0.5, 0.5, 0.5, 0.5), (0.0, 1.0, 1.0, 1.0, 1.0)],
        ", ".join(f"{f} double" for f in FEATURES),
    )
    a, b = X.party_leverage(*[F.col(f) for f in FEATURES])
    rows = with_feature_attribution(df).withColumn("out", a - b).collect()
    for r in rows:
        total = sum(r[f"{f}_contribution"] for f in FEATURES)
        assert total == pytest.approx(r.out, abs=1e-9)  # neutral background scores 0


def test_scores_stay_in_range(spark):
    df = spark.createDataFrame(
        [("c", str(i), t) for i, t in enumerate(clauses())], "contract_id string, clause_id string, clause_text string"
    )
    out = score_imbalance(df)
    bad = out.where(
        "party_a_leverage NOT BETWEEN 0 AND 100 OR party_b_leverage NOT BETWEEN 0 AND 100 "
        "OR power_imbalance_score NOT BETWEEN -100 AND 100 OR imbalance_label IS NULL"
    )
    assert bad.count() == 0


def test_summary_ties_and_gaps(spark):
    rows = [
        ("c", ["B"], 10.0, True), ("c", ["A"], -4.0, False), ("c", [], None, None),
        ("d", [], None, None),
    ]
    df = spark.createDataFrame(
        rows, "contract_id string, clause_types array<string>, power_imbalance_score double, is_anomalous boolean"
    )
    got = {r.contract_id: r for r in contract_summary(df).collect()}
    assert (got["c"].dominant_clause_type, got["c"].overall_imbalance_index, got["c"].anomalous_clauses) == ("A", 3.0, 1)
    assert (got["d"].dominant_clause_type, got["d"].overall_imbalance_index, got["d"].dominant_party) == (None, 0.0, "Balanced")


def test_word_attribution_of_any_clause(spark):
    texts = ["pay", "", None, "  ", "shall pay the fee now", "the the the pay", " ".join(f"w{i} pay" for i in range(90))]
    rows = spark.createDataFrame([(f"c{i}", t, 7) for i, t in enumerate(texts)], "clause_id string, clause_text string, score int")

    def score(table):
        seen = table.count()
        assert seen == table.select("text").distinct().count()
        words = F.split("text", " ")
        return table.withColumn("score", F.size(F.filter(words, lambda w: w == "pay")) * 2.0 - F.size(F.filter(words, lambda w: w == "the")))

    found = {r.clause_id: r for r in with_word_attribution(rows, score).collect()}
    assert len(found) == len(texts) and all(r.score == 7 for r in found.values())
    for i in (1, 2, 3):
        assert found[f"c{i}"].top_words == []
    assert [tuple(w) for w in found["c0"].top_words] == [("pay", 2.0)]
    assert [tuple(w) for w in found["c4"].top_words] == [("pay", 2.0), ("the", -1.0), ("shall", 0.0), ("fee", 0.0), ("now", 0.0)]
    assert [tuple(w) for w in found["c5"].top_words] == [("pay", 2.0), ("the", -1.0), ("the", -1.0), ("the", -1.0)]
    # 180 words in 60 runs of three: a run of two "pay" has twice the value of a run of one.
    long = found["c6"].top_words
    assert len(long) == 20 and {w.value for w in long} == {4.0}


def test_scores_of_types_are_made_once(spark):
    from clauseweave.checks import power_checks

    df = power_checks.imbalance_by_type(spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
