"""Lexical features, imbalance, contract summaries, reports, attribution."""

from __future__ import annotations

from itertools import combinations
from math import factorial

from pyspark.sql import functions as F

from clauseweave import settings as S
from clauseweave.checks import derived as D
from clauseweave.checks.derived import rounded
from clauseweave.checks.registry import query, table
from clauseweave.functions import ids
from clauseweave.functions import lexical as X
from clauseweave.functions import text as T
from clauseweave.operators import summaries as M
from clauseweave.operators.attribution import FEATURES, masked_text, top_words, with_feature_attribution, with_word_attribution
from clauseweave.operators.inference import with_model_output
from clauseweave.plans.analysis import clause_listing, score_imbalance

SCORES = ["sentiment_score", "modal_score", "obligation_score", "assertiveness_score", "length_score"]
RESULTS = ["party_a_leverage", "party_b_leverage", "power_imbalance_score"]


def _contains_any(text: str, terms) -> str:
    return "(" + " OR ".join(f"contains({text}, {D.quoted(t)})" for t in terms) + ")"


def _how_many(text: str, terms) -> str:
    return "(" + " + ".join(f"contains({text}, {D.quoted(t)})::INT" for t in terms) + ")"


def _share_sql(part: str, rest: str) -> str:
    return f"(CASE WHEN {part} + {rest} = 0 THEN 0.5::DOUBLE ELSE {part}::DOUBLE / ({part} + {rest}) END)"


LEXICAL_SQL = f"""
lowered AS (SELECT *, lower(clause_text) AS low FROM tone_clauses),
counted AS (
  SELECT *,
    [w FOR w IN regexp_extract_all(low, '[\\p{{L}}\\p{{N}}_]+') IF list_contains({D.sql_list(S.OBLIGATION_WORDS)}, w)] AS ob,
    [w FOR w IN regexp_extract_all(low, '[\\p{{L}}\\p{{N}}_]+') IF list_contains({D.sql_list(S.DISCRETION_WORDS)}, w)] AS di,
    [s FOR s IN regexp_split_to_array(low, '[.;]\\s+') IF {_contains_any('s', S.OBLIGATION_WORDS)}] AS duties,
    {_how_many('low', S.ABSOLUTE_TERMS)} AS n_abs, {_how_many('low', S.CONDITIONAL_TERMS)} AS n_cond
  FROM lowered),
sided AS (
  SELECT *,
    len([s FOR s IN duties IF {_contains_any('s', S.PARTY_A_TERMS)} AND NOT {_contains_any('s', S.PARTY_B_TERMS)}]) AS on_a,
    len([s FOR s IN duties IF {_contains_any('s', S.PARTY_B_TERMS)} AND NOT {_contains_any('s', S.PARTY_A_TERMS)}]) AS on_b
  FROM counted),
lexical AS (
  SELECT contract_id, clause_id, position, n_words, clause_text, sentiment_score,
    {_share_sql('len(ob)', 'len(di)')} AS modal_score,
    {_share_sql('on_b', 'on_a')} AS obligation_score,
    {_share_sql('n_abs', 'n_cond')} AS assertiveness_score
  FROM sided)"""

LEVERAGE_SQL = """
leverage AS (
  SELECT *,
    greatest(0, least(100, (0.3::DOUBLE * (1 - sentiment_score) + 0.25::DOUBLE * modal_score + 0.25::DOUBLE * obligation_score
      + 0.2::DOUBLE * assertiveness_score) * (0.8::DOUBLE + 0.4::DOUBLE * length_score) * 100)) AS party_a_leverage,
    greatest(0, least(100, (0.3::DOUBLE * sentiment_score + 0.25::DOUBLE * (1 - modal_score) + 0.25::DOUBLE * (1 - obligation_score)
      + 0.2::DOUBLE * (1 - assertiveness_score)) * (0.8::DOUBLE + 0.4::DOUBLE * length_score) * 100)) AS party_b_leverage
  FROM sized),
scored AS (
  SELECT *, party_a_leverage - party_b_leverage AS power_imbalance_score,
    CASE WHEN abs(party_a_leverage - party_b_leverage) >= 40
           THEN CASE WHEN party_a_leverage > party_b_leverage THEN 'HIGH' ELSE 'HIGH (Party B)' END
         WHEN abs(party_a_leverage - party_b_leverage) >= 20
           THEN CASE WHEN party_a_leverage > party_b_leverage THEN 'MEDIUM' ELSE 'MEDIUM (Party B)' END
         ELSE 'BALANCED' END AS imbalance_label
  FROM leverage)"""

# Tone: a document labelled toxic reads negative, one of high quality positive.
_TONE_SQL = """
tones AS (
  SELECT substr(md5('doc_'||doc_id||'.txt'), 1, 12) AS contract_id,
    CASE WHEN toxic = 1 THEN 0.25::DOUBLE * 0.5 + 0.05::DOUBLE * 1.0
         WHEN quality = 1 THEN 0.3::DOUBLE * 0.5 + 0.6::DOUBLE * 1.0
         ELSE 0.8::DOUBLE * 0.5 + 0.1::DOUBLE END AS sentiment_score
  FROM labels),
tone_clauses AS (
  SELECT c.*, coalesce(sentiment_score, 0.5::DOUBLE) AS sentiment_score
  FROM clauses c LEFT JOIN tones USING (contract_id))"""

_SIZED_SQL = """
stats AS (SELECT contract_id, avg(n_words) AS m, stddev_pop(n_words) AS s FROM lexical GROUP BY contract_id),
sized AS (
  SELECT l.*, 1 / (1 + exp(-((n_words - m) / CASE WHEN s = 0 THEN 1 ELSE s END))) AS length_score
  FROM lexical l JOIN stats USING (contract_id))"""

SCORED_SQL = f"{D.CLAUSES_SQL}, {_TONE_SQL}, {LEXICAL_SQL}, {_SIZED_SQL}, {LEVERAGE_SQL}"


def _with_tone(spark, folder, clauses):
    """Attach class probabilities of a tone model, here from the labels table."""
    def probabilities(neg, neu, pos):
        return F.create_map(
            F.lit("LABEL_0"), F.lit(neg), F.lit("neutral"), F.lit(neu), F.lit("Positive"), F.lit(pos)
        )

    tones = table(spark, folder, "labels").select(
        ids.contract_id("doc_", F.col("doc_id"), ".txt").alias("contract_id"),
        F.when(F.col("toxic") == 1, probabilities(0.7, 0.25, 0.05))
        .when(F.col("quality") == 1, probabilities(0.1, 0.3, 0.6))
        .otherwise(probabilities(0.1, 0.8, 0.1))
        .alias("tone"),
    )
    return clauses.join(tones, "contract_id", "left")


def scored_clauses(spark, folder):
    return score_imbalance(_with_tone(spark, folder, D.contract_clauses(spark, folder)), "tone")


@query(
    "lexical_features",
    f"""WITH {D.CLAUSES_SQL}, tone_clauses AS (SELECT *, 0.5 AS sentiment_score FROM clauses), {LEXICAL_SQL}
    SELECT clause_id, round(modal_score, 6) AS modal_score, round(obligation_score, 6) AS obligation_score,
      round(assertiveness_score, 6) AS assertiveness_score FROM lexical""",
)
def lexical_features(spark, folder):
    out = X.with_lexical_features(D.contract_clauses(spark, folder))
    return rounded(
        out.select("clause_id", "modal_score", "obligation_score", "assertiveness_score"),
        "modal_score", "obligation_score", "assertiveness_score",
    )


@query(
    "sentiment_scores",
    f"""WITH {D.CLAUSES_SQL}, {_TONE_SQL}
    SELECT clause_id, round(sentiment_score, 6) AS sentiment_score FROM tone_clauses""",
)
def sentiment_scores(spark, folder):
    clauses = _with_tone(spark, folder, D.contract_clauses(spark, folder))
    return clauses.select("clause_id", F.round(X.sentiment_score(F.col("tone")), 6).alias("sentiment_score"))


@query(
    "corpus_length_scores",
    f"""WITH {D.CLAUSES_SQL}, fit AS (SELECT avg(n_words) AS m, stddev_pop(n_words) AS s FROM clauses)
    SELECT clause_id, n_words, round(1 / (1 + exp(-((n_words - m) / s))), 6) AS length_score FROM clauses, fit""",
)
def corpus_length_scores(spark, folder):
    clauses = D.contract_clauses(spark, folder).withColumn("n_words", T.word_count(F.col("clause_text")))
    out = M.with_length_score(clauses, M.length_statistics(clauses))
    return rounded(out.select("clause_id", "n_words", "length_score"), "length_score")


@query(
    "power_imbalance",
    f"""WITH {SCORED_SQL}
    SELECT clause_id, contract_id, {', '.join(f'round({c}, 6) AS {c}' for c in SCORES + RESULTS)}, imbalance_label
    FROM scored""",
)
def power_imbalance(spark, folder):
    out = scored_clauses(spark, folder)
    return rounded(
        out.select("clause_id", "contract_id", *SCORES, *RESULTS, "imbalance_label"), *SCORES, *RESULTS
    )


_TYPED_SQL = f"""{SCORED_SQL},
names AS (SELECT {D.sql_list(S.CLAUSE_TYPES)} AS t),
typed AS (
  SELECT s.*, CASE WHEN {D.hex_sql('clause_id', 1)} < 14 THEN t[{D.hex_sql('clause_id', 2)} % 7 + 1] END AS primary_type,
    {D.hex_sql('clause_id', 4)} * 100::DOUBLE / 15 AS anomaly_score
  FROM scored s, names)"""


def analysed_clauses(spark, folder):
    """Scored clauses with a type and an anomaly score that follow from the id."""
    names = F.array(*[F.lit(t) for t in S.CLAUSE_TYPES])
    one = F.array(F.element_at(names, D.hex_digit("clause_id", 2) % 7 + 1))
    types = F.when(D.hex_digit("clause_id", 1) < 14, one).otherwise(F.array().cast("array<string>"))
    score = D.hex_digit("clause_id", 4) * F.lit(100.0) / 15
    return scored_clauses(spark, folder).withColumns(
        {"clause_types": types, "anomaly_score": score, "is_anomalous": score > S.ANOMALY_FLAG_ABOVE}
    )


@query(
    "contract_summary",
    f"""WITH {_TYPED_SQL},
    counts AS (SELECT contract_id, primary_type, count(*) AS n FROM typed WHERE primary_type IS NOT NULL GROUP BY ALL),
    dominant AS (SELECT contract_id, primary_type FROM counts
      QUALIFY row_number() OVER (PARTITION BY contract_id ORDER BY n DESC, primary_type) = 1),
    totals AS (SELECT contract_id, count(*) AS total_clauses, count(*) FILTER (anomaly_score > 70) AS anomalous_clauses,
      round(avg(power_imbalance_score), 6) AS overall_imbalance_index FROM typed GROUP BY contract_id)
    SELECT t.*, d.primary_type AS dominant_clause_type,
      CASE WHEN overall_imbalance_index > 0 THEN 'Party A' WHEN overall_imbalance_index < 0 THEN 'Party B' ELSE 'Balanced' END AS dominant_party,
      CASE WHEN overall_imbalance_index > 40 THEN 'HIGH favouring Party A' WHEN overall_imbalance_index < -40 THEN 'HIGH favouring Party B'
        WHEN abs(overall_imbalance_index) > 20 THEN 'MODERATE' ELSE 'BALANCED' END AS report_band
    FROM totals t LEFT JOIN dominant d USING (contract_id)""",
)
def contract_summary(spark, folder):
    clauses = rounded(analysed_clauses(spark, folder), "power_imbalance_score", digits=9)
    return rounded(M.contract_summary(clauses), "overall_imbalance_index")


@query(
    "imbalance_by_type",
    f"""WITH {_TYPED_SQL}
    SELECT contract_id, primary_type AS clause_type, round(avg(power_imbalance_score), 6) AS imbalance_score,
      count(*) AS clause_count FROM typed WHERE primary_type IS NOT NULL GROUP BY ALL""",
)
def imbalance_by_type(spark, folder):
    return rounded(M.imbalance_by_type(analysed_clauses(spark, folder)), "imbalance_score")


@query(
    "report_table",
    f"""WITH {_TYPED_SQL},
    all_rows AS (SELECT *, row_number() OVER (PARTITION BY contract_id ORDER BY position, clause_id) AS row_no,
      count(*) OVER (PARTITION BY contract_id) AS total_rows FROM typed)
    SELECT contract_id, row_no, total_rows, coalesce(primary_type, 'Unclassified') AS clause_type,
      printf('%.1f', anomaly_score) AS anomaly_score,
      CASE WHEN anomaly_score > 70 THEN 'YES' ELSE 'NO' END AS anomaly_flag,
      printf('%+.1f', round(power_imbalance_score, 1)) AS imbalance_score, imbalance_label AS label
    FROM all_rows""",
)
def report_table(spark, folder):
    return M.report_table(analysed_clauses(spark, folder))


@query(
    "high_imbalance_counts",
    f"""WITH {_TYPED_SQL} SELECT contract_id, count(*) FILTER (contains(imbalance_label, 'HIGH')) AS high_imbalance_clauses
    FROM typed GROUP BY contract_id""",
)
def high_imbalance_counts(spark, folder):
    return M.high_imbalance_count(analysed_clauses(spark, folder))


@query(
    "anomalous_clauses",
    f"WITH {_TYPED_SQL} SELECT contract_id, clause_id, round(anomaly_score, 6) AS anomaly_score FROM typed WHERE anomaly_score > 70",
)
def anomalous_clauses(spark, folder):
    out = M.anomalous_clauses(analysed_clauses(spark, folder))
    return rounded(out.select("contract_id", "clause_id", "anomaly_score"), "anomaly_score")


@query(
    "unscored_clauses",
    f"""WITH {_TYPED_SQL} SELECT contract_id, clause_id FROM typed WHERE {D.hex_sql('clause_id', 5)} < 6""",
)
def unscored_clauses(spark, folder):
    pending = F.when(D.hex_digit("clause_id", 5) >= 6, F.col("anomaly_score"))
    clauses = analysed_clauses(spark, folder).withColumn("anomaly_score", pending)
    return M.unscored_clauses(clauses).select("contract_id", "clause_id")


@query(
    "clause_listing",
    f"""WITH {_TYPED_SQL} SELECT contract_id, position, clause_id, primary_type, round(power_imbalance_score, 6) AS imbalance,
      imbalance_label FROM typed""",
)
def listing(spark, folder):
    return clause_listing(analysed_clauses(spark, folder)).select(
        "contract_id", "position", "clause_id", "primary_type",
        F.round("power_imbalance_score", 6).alias("imbalance"), "imbalance_label",
    )


# Party names of a contract: the newest analysis of the document's label row.
@query(
    "named_dominant_party",
    f"""WITH {SCORED_SQL},
    names AS (SELECT substr(md5('doc_'||doc_id||'.txt'), 1, 12) AS contract_id, 'Holder '||doc_id AS party_a,
      CASE WHEN quality = 1 THEN 'Other '||doc_id ELSE 'Party B' END AS party_b FROM labels),
    totals AS (SELECT contract_id, count(*) AS total_clauses, round(avg(power_imbalance_score), 6) AS i FROM scored GROUP BY contract_id)
    SELECT t.contract_id, total_clauses, CASE WHEN i > 0 THEN coalesce(party_a, 'Party A') WHEN i < 0 THEN coalesce(party_b, 'Party B')
      ELSE 'Balanced' END AS dominant_party FROM totals t LEFT JOIN names n USING (contract_id)""",
)
def named_dominant_party(spark, folder):
    results = table(spark, folder, "labels").select(
        ids.contract_id("doc_", F.col("doc_id"), ".txt").alias("contract_id"),
        F.to_json(
            F.struct(
                F.concat(F.lit("Holder "), "doc_id").alias("party_a"),
                F.when(F.col("quality") == 1, F.concat(F.lit("Other "), "doc_id")).alias("party_b"),
            )
        ).alias("analysis_metadata"),
        F.col("doc_id").alias("created_at"),
    )
    clauses = rounded(scored_clauses(spark, folder), "power_imbalance_score", digits=9).withColumns(
        {"clause_types": F.array().cast("array<string>"), "is_anomalous": F.lit(False)}
    )
    out = M.contract_summary(clauses, M.latest_parties(results))
    return out.select("contract_id", "total_clauses", "dominant_party")


@query(
    "feature_statistics",
    f"""WITH {SCORED_SQL},
    long AS (UNPIVOT (SELECT {', '.join(SCORES)}, power_imbalance_score FROM scored)
      ON {', '.join(SCORES)}, power_imbalance_score INTO NAME feature VALUE v)
    SELECT feature, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min,
      round(max(v), 6) AS max, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50,
      round(quantile_cont(v, 0.75), 6) AS p75 FROM long GROUP BY feature""",
)
def feature_statistics(spark, folder):
    stats = M.feature_statistics(scored_clauses(spark, folder), [*SCORES, "power_imbalance_score"])
    return rounded(stats, "mean", "std", "min", "max", "p25", "p50", "p75")


def _coalition_sql(members: tuple[str, ...]) -> str:
    v = {f: (f if f in members else "0.5::DOUBLE") for f in FEATURES}
    s, m, o, a, ln = (v[f] for f in FEATURES)
    amp = f"(0.8::DOUBLE + 0.4::DOUBLE * {ln}) * 100"
    one = f"(0.3::DOUBLE * (1 - {s}) + 0.25::DOUBLE * {m} + 0.25::DOUBLE * {o} + 0.2::DOUBLE * {a})"
    two = f"(0.3::DOUBLE * {s} + 0.25::DOUBLE * (1 - {m}) + 0.25::DOUBLE * (1 - {o}) + 0.2::DOUBLE * (1 - {a}))"
    return f"(greatest(0, least(100, {one} * {amp})) - greatest(0, least(100, {two} * {amp})))"


def _attribution_sql(feature: str) -> str:
    others = [f for f in FEATURES if f != feature]
    parts = []
    for size in range(len(others) + 1):
        weight = factorial(size) * factorial(len(others) - size) / factorial(len(FEATURES))
        for group in combinations(others, size):
            gain = f"{_coalition_sql((*group, feature))} - {_coalition_sql(group)}"
            parts.append(f"{weight}::DOUBLE * ({gain})")
    return f"round({' + '.join(parts)}, 6) AS {feature}_contribution"


@query(
    "feature_attribution",
    f"WITH {SCORED_SQL} SELECT clause_id, {', '.join(_attribution_sql(f) for f in FEATURES)} FROM scored",
)
def feature_attribution(spark, folder):
    shares = [f"{f}_contribution" for f in FEATURES]
    out = with_feature_attribution(scored_clauses(spark, folder))
    return rounded(out.select("clause_id", *shares), *shares)


@query(
    "masked_words",
    """WITH w AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS words FROM documents)
    SELECT doc_id, array_to_string(list_transform(words, lambda x: CASE WHEN length(x) % 3 = 0 THEN '[MASK]' ELSE x END), ' ')
      AS masked FROM w""",
)
def masked_words(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", T.words(F.col("text")).alias("words"))
    keep = F.transform("words", lambda w: (F.length(w) % 3 != 0).cast("int"))
    return docs.select("doc_id", masked_text(F.col("words"), keep).alias("masked"))


@query(
    "top_attributed_words",
    """WITH w AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS words FROM documents),
    v AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM w),
    r AS (SELECT doc_id, word, i, (CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END) * length(word)::DOUBLE / 10 AS value FROM v)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY abs(value) DESC, i) AS rank, word, value FROM r
    QUALIFY rank <= 20""",
)
def top_attributed_words(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", T.words(F.col("text")).alias("words"))
    values = F.transform(
        "words", lambda w, i: F.when(i % 2 == 0, 1).otherwise(-1) * F.length(w).cast("double") / 10
    )
    tops = docs.select("doc_id", F.posexplode_outer(top_words(F.col("words"), values)).alias("p", "t")).where("p IS NOT NULL")
    return tops.select("doc_id", (F.col("p") + 1).alias("rank"), "t.word", "t.value")


def _toy_model():
    """A model that adds up over words: by their lengths, nothing for a mask."""
    import numpy as np

    def predict(texts):
        return np.array([[sum(0.0 if w == "[MASK]" else (len(w) * 7 % 11 - 5) / 10 for w in t.split())] for t in texts])

    return predict


@query(
    "word_attribution",
    """WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\x0B\f\r]+') AS words FROM documents),
    sized AS (SELECT doc_id, words, ceil(len(words) / 63.0::DOUBLE)::BIGINT AS run FROM w WHERE len(words) > 0),
    v AS (SELECT doc_id, run, unnest(words) AS word, unnest(range(len(words))) AS i FROM sized),
    g AS (SELECT doc_id, i // run AS segment, sum(CASE WHEN word = '[MASK]' THEN 0 ELSE (length(word) * 7 % 11 - 5) / 10.0::DOUBLE END) AS value
      FROM v GROUP BY ALL),
    r AS (SELECT doc_id, i, word, round(value, 6) AS value FROM v JOIN g USING (doc_id) WHERE i // run = segment)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY abs(value) DESC, i) AS rank, word, value FROM r QUALIFY rank <= 20""",
)
def word_attribution(spark, folder):
    """Every document through a model that adds up over words, whose attributions SQL can state."""
    docs = table(spark, folder, "documents").select("doc_id", "text")

    def score(texts):
        out = with_model_output(texts, _toy_model, "text", "_output")
        return out.withColumn("score", F.round(F.element_at("_output", 1), 6))

    found = with_word_attribution(docs, score, "text")
    tops = found.select("doc_id", F.posexplode_outer("top_words").alias("p", "t")).where("p IS NOT NULL")
    return tops.select("doc_id", (F.col("p") + 1).alias("rank"), "t.word", F.round("t.value", 6).alias("value"))


@query(
    "analysis_metadata",
    """WITH latest AS (
      SELECT user_id, arg_max(props, ts) AS props FROM events GROUP BY user_id)
    SELECT 'user_'||user_id AS contract_id,
      CASE WHEN json_extract(props, '$.k')::INT % 2 = 0 THEN 'Holder '||json_extract(props, '$.k') ELSE 'Party A' END AS party_a,
      CASE WHEN json_extract(props, '$.k')::INT % 2 = 0 THEN 'Party B' ELSE 'Party B' END AS party_b
    FROM latest""",
)
def analysis_metadata(spark, folder):
    events = table(spark, folder, "events")
    k = F.from_json("props", "k int")["k"]
    name = F.when(k % 2 == 0, F.concat(F.lit("Holder "), k))
    rows = M.analysis_rows(
        events.select(
            F.concat(F.lit("user_"), "user_id").alias("contract_id"),
            F.lit(0.0).alias("overall_imbalance_index"),
            F.lit(1).alias("total_clauses"),
            F.lit(0).alias("anomalous_clauses"),
            F.col("event_type").alias("dominant_clause_type"),
            name.alias("party_a"),
            F.col("ts"),
        ),
        F.struct("party_a"),
        F.col("ts"),
    )
    return M.latest_parties(rows)
