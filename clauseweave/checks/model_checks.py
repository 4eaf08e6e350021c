"""Probabilities: blending, calibration, decoding, tuning, evaluation, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseweave import settings as S
from clauseweave.checks import derived as D
from clauseweave.checks.derived import CLASSES, MODELS, rounded
from clauseweave.checks.registry import query, table
from clauseweave.functions import probabilities as P
from clauseweave.functions import text as T
from clauseweave.operators import evaluation as E
from clauseweave.operators import inference as I
from clauseweave.plans.analysis import label_counters

WEIGHTS = [0.6, 0.4, 0.0]
TEMPERATURE = 0.7
THRESHOLDS = [0.5, 0.4, 0.6, 0.5, 0.3, 0.7, 0.5, 0.8, 0.9, 0.5]

_LOGIT = "ln(greatest(1e-7, least(1 - 1e-7, {p})) / (1 - greatest(1e-7, least(1 - 1e-7, {p}))))"


def _tempered(p: str, t: str) -> str:
    return f"(1 / (1 + exp(-{_LOGIT.format(p=p)} / {t})))"


_PREDICTED_SQL = f"""{D.PREDICTIONS_SQL},
mixed AS (SELECT *, list_transform(range(1, 11), lambda i: 0.6::DOUBLE * model_a[i] + 0.4::DOUBLE * model_b[i]) AS m FROM predictions),
calibrated AS (SELECT *, list_transform(m, lambda x: {_tempered('x', f'{TEMPERATURE}::DOUBLE')}) AS p FROM mixed),
decoded AS (
  SELECT *, CASE WHEN list_max(p) < 0.3 OR len(hits) = 0 THEN ['Other'] ELSE hits END AS clause_types
  FROM (SELECT *, list_filter(list_transform(range(1, 11), lambda i:
      CASE WHEN p[i] >= {D.sql_list(THRESHOLDS)}[i] THEN {D.sql_list(CLASSES)}[i] END), lambda x: x IS NOT NULL) AS hits FROM calibrated)),
gated AS (
  SELECT *, list_max(p) AS top, CASE WHEN clause_types = ['Other'] OR list_max(p) < 0.8 THEN 'review' ELSE 'accepted' END AS status FROM decoded)"""


def _predicted(spark, folder):
    return I.with_predictions(D.predictions(spark, folder), list(MODELS), WEIGHTS, TEMPERATURE, THRESHOLDS, CLASSES)


@query(
    "predictions",
    f"""WITH {_PREDICTED_SQL}
    SELECT vec_id, array_to_string(clause_types, '|') AS clause_type, round(top, 4) AS confidence, status,
      round(list_sum(p), 6) AS total FROM gated""",
)
def predictions(spark, folder):
    out = _predicted(spark, folder)
    total = F.aggregate(F.map_values("probabilities"), F.lit(0.0), lambda a, x: a + x)
    return out.select(
        "vec_id", F.array_join("clause_types", "|").alias("clause_type"), "confidence", "status",
        F.round(total, 6).alias("total"),
    )


@query("label_counters", f"WITH {_PREDICTED_SQL} SELECT status, count(*) AS n_clauses FROM gated GROUP BY status")
def counters(spark, folder):
    return label_counters(_predicted(spark, folder))


@query(
    "accepted_clauses",
    f"WITH {_PREDICTED_SQL} SELECT vec_id, array_to_string(clause_types, '|') AS clause_type FROM gated WHERE status = 'accepted'",
)
def accepted_clauses(spark, folder):
    return I.accepted(_predicted(spark, folder)).select("vec_id", F.array_join("clause_types", "|").alias("clause_type"))


@query(
    "review_clauses",
    f"WITH {_PREDICTED_SQL} SELECT vec_id, round(top, 4) AS confidence FROM gated WHERE status = 'review'",
)
def review_clauses(spark, folder):
    return I.for_review(_predicted(spark, folder)).select("vec_id", "confidence")


@query(
    "top_probabilities",
    f"""WITH {_PREDICTED_SQL},
    long AS (SELECT vec_id, unnest({D.sql_list(CLASSES)}) AS name, unnest(p) AS p FROM gated)
    SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, name) AS rank, name, round(p, 6) AS p
    FROM long QUALIFY rank <= 5""",
)
def top_probabilities(spark, folder):
    tops = P.top_probabilities(F.col("probabilities"))
    out = _predicted(spark, folder).select("vec_id", F.posexplode_outer(tops).alias("at", "t"))
    return out.select("vec_id", (F.col("at") + 1).alias("rank"), "t.name", F.round("t.p", 6).alias("p"))


# --- Tuning -----------------------------------------------------------------------

_LONG_SQL = f"""{D.PREDICTIONS_SQL},
long AS (SELECT vec_id, unnest(range(10)) AS class_idx, unnest(model_a) AS p, unnest(list_transform(range(10), lambda i: (i = label)::INT)) AS y
  FROM predictions)"""


def _scored(spark, folder):
    return D.predictions(spark, folder).withColumn("probabilities", F.col("model_a"))


def _threshold_sql(source: str, keys: str) -> str:
    return f"""
grid AS (SELECT unnest({D.sql_list(S.THRESHOLD_GRID)})::DOUBLE AS t),
f1s AS (SELECT {keys}, t, sum(y) AS positives,
    CASE WHEN sum(y) + count(*) FILTER (p >= t) = 0 THEN 0::DOUBLE
      ELSE 2.0::DOUBLE * sum(y) FILTER (p >= t) / (sum(y) + count(*) FILTER (p >= t)) END AS f1
  FROM {source}, grid GROUP BY {keys}, t),
best AS (SELECT {keys}, CASE WHEN positives = 0 THEN 0.5::DOUBLE ELSE t END AS threshold,
    CASE WHEN positives = 0 THEN 0::DOUBLE ELSE coalesce(f1, 0) END AS f1, positives::BIGINT AS positives FROM f1s
  QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY coalesce(f1, 0) DESC, t) = 1)"""


@query(
    "threshold_search",
    f"WITH {_LONG_SQL}, {_threshold_sql('long', 'class_idx')} SELECT class_idx, threshold, round(f1, 6) AS f1, positives FROM best",
)
def threshold_search(spark, folder):
    return rounded(E.threshold_search(_scored(spark, folder)), "f1")


def _temperature_sql(source: str, keys: str) -> str:
    lead = f"{keys}, " if keys else ""
    over = f"PARTITION BY {keys} " if keys else ""
    return f"""
temps AS (SELECT unnest({D.sql_list(S.TEMPERATURE_GRID)})::DOUBLE AS t),
losses AS (SELECT {lead}t, avg(greatest(x / t, 0) - x / t * y + ln(1 + exp(-abs(x / t)))) AS nll
  FROM (SELECT {lead}y, {_LOGIT.format(p='p')} AS x FROM {source}), temps GROUP BY {lead}t),
coolest AS (SELECT {lead}t AS temperature, nll FROM losses
  QUALIFY row_number() OVER ({over}ORDER BY nll, t) = 1)"""


@query(
    "temperature_search",
    f"WITH {_LONG_SQL}, {_temperature_sql('long', '')} SELECT temperature, round(nll, 6) AS nll FROM coolest",
)
def temperature_search(spark, folder):
    return rounded(E.temperature_search(_scored(spark, folder)), "nll")


_GRID = E.weight_candidates(list(MODELS))
_ENSEMBLE_SQL = f"""{D.PREDICTIONS_SQL},
candidates AS (SELECT unnest({D.sql_list([c for c, _, _ in _GRID])}) AS candidate, unnest({D.sql_list([n for _, n, _ in _GRID])}) AS name,
  unnest({D.sql_list([w[0] for *_, w in _GRID])})::DOUBLE AS w0, unnest({D.sql_list([w[1] for *_, w in _GRID])})::DOUBLE AS w1,
  unnest({D.sql_list([w[2] for *_, w in _GRID])})::DOUBLE AS w2),
per_class AS (SELECT unnest(range(10)) AS class_idx, unnest(model_a) AS a, unnest(model_b) AS b, unnest(model_c) AS c,
  unnest(list_transform(range(10), lambda i: (i = label)::INT)) AS y FROM predictions),
fanned AS (SELECT candidate, class_idx, w0 * a + w1 * b + w2 * c AS p, y FROM per_class, candidates),
{_temperature_sql('fanned', 'candidate')},
warmed AS (SELECT f.candidate, class_idx, y, CASE WHEN temperature = 1 THEN p ELSE {_tempered('p', 'temperature')} END AS p
  FROM fanned f JOIN coolest USING (candidate)),
{_threshold_sql('warmed', 'candidate, class_idx')},
macro AS (SELECT candidate, avg(f1) AS f1_macro, list(threshold ORDER BY class_idx) AS thresholds FROM best GROUP BY candidate)"""


@query(
    "ensemble_search",
    f"""WITH {_ENSEMBLE_SQL}
    SELECT candidate, name, temperature, round(f1_macro, 6) AS f1_macro, array_to_string(thresholds, ',') AS thresholds,
      candidate = (SELECT candidate FROM macro ORDER BY f1_macro DESC, candidate LIMIT 1) AS is_winner
    FROM candidates JOIN macro USING (candidate) JOIN coolest USING (candidate)""",
)
def ensemble_search(spark, folder):
    out = E.ensemble_search(D.predictions(spark, folder), list(MODELS))
    return rounded(out, "f1_macro").select(
        "candidate", "name", "temperature", "f1_macro",
        F.array_join(F.col("thresholds").cast("array<string>"), ",").alias("thresholds"), "is_winner",
    )


# --- Evaluation -------------------------------------------------------------------

_NAMES12 = S.CLAUSE_TYPES[:12]
_REPORT_SQL = f"""{_PREDICTED_SQL},
names AS (SELECT unnest({D.sql_list(_NAMES12)}) AS class),
pairs AS (SELECT y_true AS yt, clause_types AS yp FROM gated),
counts AS (
  SELECT class, count(*) FILTER (yt = class AND list_contains(yp, class)) AS tp,
    count(*) FILTER (yt <> class AND list_contains(yp, class)) AS fp,
    count(*) FILTER (yt = class AND NOT list_contains(yp, class)) AS fn
  FROM names, pairs GROUP BY class),
prf AS (SELECT class, tp, fp, fn, CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END AS precision,
    CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END AS recall,
    CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp::DOUBLE / (2 * tp + fp + fn) END AS f1, tp + fn AS support FROM counts),
samples AS (SELECT avg(CASE WHEN n = 0 THEN 0 ELSE hit::DOUBLE / n END) AS precision, avg(hit::DOUBLE) AS recall,
    avg(2 * hit::DOUBLE / (1 + n)) AS f1, count(*) AS support
  FROM (SELECT list_contains(yp, yt)::INT AS hit, len([x FOR x IN yp IF list_contains({D.sql_list(_NAMES12)}, x)]) AS n FROM pairs)),
report AS (
  SELECT 'class' AS section, class AS name, precision, recall, f1, support FROM prf
  UNION ALL SELECT 'average', 'micro avg', sum(tp)::DOUBLE / sum(tp + fp), sum(tp)::DOUBLE / sum(tp + fn),
    2 * sum(tp)::DOUBLE / sum(2 * tp + fp + fn), sum(support) FROM prf
  UNION ALL SELECT 'average', 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM prf
  UNION ALL SELECT 'average', 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1 * support) / sum(support), sum(support) FROM prf
  UNION ALL SELECT 'average', 'samples avg', precision, recall, f1, support FROM samples)"""


def _report(spark, folder):
    return E.classification_report(
        _predicted(spark, folder).select("y_true", F.col("clause_types").alias("y_pred")), _NAMES12
    )


@query(
    "classification_report",
    f"""WITH {_REPORT_SQL} SELECT section, name, round(precision, 6) AS precision, round(recall, 6) AS recall,
      round(f1, 6) AS f1, support::BIGINT AS support FROM report""",
)
def classification_report(spark, folder):
    return rounded(_report(spark, folder), "precision", "recall", "f1")


@query(
    "metric_rows",
    f"""WITH {_REPORT_SQL}, wide AS (SELECT name, precision, recall, f1, support::DOUBLE AS support FROM report),
    long AS (UNPIVOT wide ON precision, recall, f1, support INTO NAME metric VALUE value)
    SELECT 'classifier' AS component, name||'.'||metric AS metric, round(value, 6) AS value FROM long""",
)
def metric_rows(spark, folder):
    return rounded(E.metric_rows(_report(spark, folder), "classifier"), "value")


# --- Long clauses -----------------------------------------------------------------

_WINDOWS_SQL = """
tokens AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM documents),
starts AS (SELECT doc_id, w, CASE WHEN len(w) <= 254 THEN [0] ELSE range(0, len(w), 126) END AS s FROM tokens),
windows AS (SELECT doc_id, unnest(range(len(s))) AS window_no, unnest(list_transform(s, lambda x: w[x + 1:x + 254])) AS part FROM starts)"""


def _windows(spark, folder):
    tokens = table(spark, folder, "documents").select("doc_id", T.words(F.col("text")).alias("w"))
    return tokens.select("doc_id", F.posexplode_outer(P.window_tokens(F.col("w"))).alias("window_no", "part"))


@query(
    "token_windows",
    f"WITH {_WINDOWS_SQL} SELECT doc_id, window_no, len(part) AS n_tokens, part[1] AS first_token, part[-1] AS last_token FROM windows",
)
def token_windows(spark, folder):
    return _windows(spark, folder).select(
        "doc_id", "window_no", F.size("part").alias("n_tokens"),
        F.get("part", F.lit(0)).alias("first_token"), F.try_element_at("part", F.lit(-1)).alias("last_token"),
    )


_CUES = ["the", "de", "und", "que"]


@query(
    "window_max_pool",
    f"""WITH {_WINDOWS_SQL},
    shares AS (SELECT doc_id, {', '.join(f"len([x FOR x IN part IF x = '{c}'])::DOUBLE / len(part) AS p{i}" for i, c in enumerate(_CUES))} FROM windows)
    SELECT doc_id, {', '.join(f'round(max(p{i}), 6) AS p{i}' for i in range(len(_CUES)))} FROM shares GROUP BY doc_id""",
)
def window_max_pool(spark, folder):
    def share(cue):
        # The window of a text without words is empty: no number, as in the SQL, and no division by zero.
        part = F.size(F.filter("part", lambda x: x == cue)) / F.size("part")
        return F.when(F.size("part") == 0, F.lit(float("nan"))).otherwise(part)

    shares = F.array(*[share(c) for c in _CUES])
    pooled = E.max_pool(_windows(spark, folder).select("doc_id", shares.alias("probabilities")), "doc_id")
    return pooled.select("doc_id", *[F.round(F.get("probabilities", F.lit(i)), 6).alias(f"p{i}") for i in range(len(_CUES))])


@query(
    "windowed_classification",
    f"""WITH {_WINDOWS_SQL},
    shares AS (SELECT doc_id, {', '.join(f"len([x FOR x IN part IF x = '{c}'])::DOUBLE / len(part) AS p{i}" for i, c in enumerate(_CUES))} FROM windows)
    SELECT doc_id, {', '.join(f'round(max(p{i}), 6) AS p{i}' for i in range(len(_CUES)))} FROM shares GROUP BY doc_id""",
)
def windowed_classification(spark, folder):
    """The same shares computed by a batched Python model on every window."""

    def make_model():
        import numpy as np

        cues = list(_CUES)

        def predict(batch):
            tokens = [str(t).split(" ") for t in batch]
            return np.array([[t.count(c) / len(t) for c in cues] for t in tokens], dtype=float)

        return predict

    docs = table(spark, folder, "documents").select("doc_id", T.words(F.col("text")).alias("w"))
    pooled = I.classify_tokens(docs, make_model, "w", "doc_id", prepare=lambda part: F.array_join(part, " "))
    return pooled.select("doc_id", *[F.round(F.get("probabilities", F.lit(i)), 6).alias(f"p{i}") for i in range(len(_CUES))])
