"""Annotated datasets, labels, the store, review queues and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseweave import settings as S
from clauseweave.checks import derived as D
from clauseweave.checks.registry import query, table
from clauseweave.functions import ids
from clauseweave.functions import labels as L
from clauseweave.functions.text import word_count
from clauseweave.operators import keyed as K
from clauseweave.operators import splits as P
from clauseweave.operators.segmentation import upload_clauses
from clauseweave.sources import datasets, filings, store

TAXONOMY_SQL = D.sql_list(S.CLAUSE_TYPES)
LABEL_NAMES = [*S.PROVISION_LABELS, "Counterparts"]


# --- Annotated datasets ---------------------------------------------------------

_QA_SQL = f"""
names AS (SELECT {TAXONOMY_SQL} AS t),
qa AS (
  SELECT CASE WHEN lang = 'de' THEN '' ELSE ' '||source||' ' END AS title,
    CASE doc_id % 4 WHEN 0 THEN source||'__'||replace(t[doc_id % 100 + 1], ' ', '_')
      WHEN 1 THEN source||'__Some Question__'||(doc_id % 7)
      WHEN 2 THEN source ELSE source||'__'||upper(t[doc_id % 100 + 1])||'_'||(doc_id % 3) END AS id,
    CASE doc_id % 5 WHEN 0 THEN 'Highlight the parts related to "'||t[doc_id % 37 + 1]||'".'
      WHEN 1 THEN '' WHEN 2 THEN 'Nothing known' ELSE t[doc_id % 41 + 1] END AS question,
    string_split(text, chr(10)) AS answers
  FROM documents, names),
typed AS (
  SELECT *, coalesce(nullif(trim(title), ''), nullif(trim(string_split(id, '__')[1]), ''), 'unknown') AS contract_name,
    lower(trim(replace(string_split(id, '__')[-1], '_', ' '))) AS candidate, lower(trim(question)) AS q
  FROM qa),
matched AS (
  SELECT typed.*, coalesce(
    CASE WHEN contains(id, '__') THEN [x FOR x IN t IF contains(candidate, lower(x)) OR contains(lower(x), candidate)][1] END,
    [x FOR x IN t IF contains(q, lower(x)) OR contains(lower(x), q)][1]) AS clause_type
  FROM typed, names)"""


def _qa_rows(spark, folder):
    names = F.array(*[F.lit(t) for t in S.CLAUSE_TYPES])
    n = F.col("doc_id")
    kind, form = n % 4, n % 5

    def name(size):
        return F.element_at(names, (n % size + 1).cast("int"))

    row_id = (
        F.when(kind == 0, F.concat("source", F.lit("__"), F.replace(name(100), F.lit(" "), F.lit("_"))))
        .when(kind == 1, F.concat("source", F.lit("__Some Question__"), n % 7))
        .when(kind == 2, F.col("source"))
        .otherwise(F.concat("source", F.lit("__"), F.upper(name(100)), F.lit("_"), n % 3))
    )
    question = (
        F.when(form == 0, F.concat(F.lit('Highlight the parts related to "'), name(37), F.lit('".')))
        .when(form == 1, "")
        .when(form == 2, "Nothing known")
        .otherwise(name(41))
    )
    return table(spark, folder, "documents").select(
        F.when(F.col("lang") == "de", "").otherwise(F.concat(F.lit(" "), "source", F.lit(" "))).alias("title"),
        row_id.alias("id"),
        question.alias("question"),
        F.struct(F.split("text", "\n").alias("text")).alias("answers"),
    )


@query(
    "qa_clauses",
    f"""WITH {_QA_SQL},
    answers AS (SELECT contract_name, clause_type, trim(unnest(answers), {D.SPACES}) AS clause_text FROM matched
      WHERE clause_type IS NOT NULL),
    grouped AS (SELECT substr(md5(contract_name), 1, 12) AS contract_id, clause_text,
        list_sort(list(DISTINCT clause_type)) AS clause_types FROM answers
      WHERE len(regexp_extract_all(clause_text, '\\S+')) >= 10 GROUP BY contract_name, clause_text)
    SELECT contract_id, substr(md5(contract_id||clause_text), 1, 16) AS clause_id, clause_text,
      array_to_string(clause_types, '|') AS clause_type FROM grouped""",
)
def qa_clauses(spark, folder):
    return datasets.qa_clauses(_qa_rows(spark, folder)).select(
        "contract_id", "clause_id", "clause_text", L.join_labels(F.col("clause_types")).alias("clause_type")
    )


@query(
    "question_types",
    f"WITH {_QA_SQL} SELECT id, question, clause_type, count(*) AS n FROM matched GROUP BY ALL",
)
def question_types(spark, folder):
    typed = datasets.with_question_type(_qa_rows(spark, folder))
    return typed.groupBy("id", "question", "clause_type").agg(F.count(F.lit(1)).alias("n"))


_MAPPED = [(k, v) for k, v in S.PROVISION_LABELS.items() if v is not None]


@query(
    "provision_clauses",
    f"""WITH mapping AS (SELECT unnest({D.sql_list([k for k, _ in _MAPPED])}) AS label_name,
        unnest({D.sql_list([v for _, v in _MAPPED])}) AS clause_type),
    rows_ AS (SELECT doc_id, trim(unnest(string_split(text, chr(10))), {D.SPACES}) AS clause_text,
        {D.sql_list(LABEL_NAMES)}[doc_id % {len(LABEL_NAMES)} + 1] AS label_name, doc_id % {len(LABEL_NAMES)} AS label FROM documents)
    SELECT substr(md5('LEDGAR_'||label), 1, 12) AS contract_id, substr(md5('LEDGAR'||clause_text), 1, 16) AS clause_id,
      clause_text, clause_type FROM rows_ JOIN mapping USING (label_name)
    WHERE len(regexp_extract_all(clause_text, '\\S+')) >= 10
    QUALIFY row_number() OVER (PARTITION BY clause_text ORDER BY doc_id) = 1""",
)
def provision_clauses(spark, folder):
    rows = table(spark, folder, "documents").select(
        "doc_id", F.explode_outer(F.split("text", "\n")).alias("text"), (F.col("doc_id") % len(LABEL_NAMES)).alias("label")
    )
    names = spark.createDataFrame(list(enumerate(LABEL_NAMES)), "label long, label_name string")
    out = datasets.provision_clauses(rows, names, [F.col("doc_id")])
    return out.select("contract_id", "clause_id", "clause_text", F.element_at("clause_types", 1).alias("clause_type"))


_KEYWORDS = [k for k, _ in S.DEAL_POINT_KEYWORDS]


@query(
    "deal_point_clauses",
    f"""WITH rows_ AS (
      SELECT conv_id, turn, trim(text, {D.SPACES}) AS clause_text, CASE WHEN conv_id % 3 = 0 THEN '' ELSE role END AS category,
        lower(trim(CASE WHEN conv_id % 5 = 0 THEN ' What is said?' ELSE ' Is there a '||upper({D.sql_list(_KEYWORDS)}[conv_id % {len(_KEYWORDS)} + 1])
          ||' or '||{D.sql_list(_KEYWORDS)}[turn % {len(_KEYWORDS)} + 1]||'? ' END)) AS question FROM conversations),
    typed AS (SELECT *, CASE {' '.join(f"WHEN contains(question, {D.quoted(k)}) THEN {D.quoted(v)}" for k, v in S.DEAL_POINT_KEYWORDS)} END AS clause_type
      FROM rows_ WHERE len(regexp_extract_all(clause_text, '\\S+')) >= 10)
    SELECT substr(md5('MAUD_'||coalesce(nullif(category, ''), 'MAUD')||'_'||question), 1, 12) AS contract_id,
      substr(md5('MAUD'||clause_text), 1, 16) AS clause_id, clause_text, clause_type
    FROM typed WHERE clause_type IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY clause_text ORDER BY conv_id, turn) = 1""",
)
def deal_point_clauses(spark, folder):
    words = F.array(*[F.lit(k) for k in _KEYWORDS])

    def keyword(column):
        return F.element_at(words, (F.col(column) % len(_KEYWORDS) + 1).cast("int"))

    question = F.when(F.col("conv_id") % 5 == 0, " What is said?").otherwise(
        F.concat(F.lit(" Is there a "), F.upper(keyword("conv_id")), F.lit(" or "), keyword("turn"), F.lit("? "))
    )
    rows = table(spark, folder, "conversations").select(
        "conv_id", "turn", "text", question.alias("question"),
        F.when(F.col("conv_id") % 3 == 0, "").otherwise(F.col("role")).alias("category"),
    )
    out = datasets.deal_point_clauses(rows, [F.col("conv_id"), F.col("turn")])
    return out.select("contract_id", "clause_id", "clause_text", F.element_at("clause_types", 1).alias("clause_type"))


# --- Labels ---------------------------------------------------------------------

@query(
    "multi_hot_labels",
    f"""WITH {D.LABELLED_SQL}
    SELECT clause_id, array_to_string(clause_types, '|') AS clause_type,
      array_to_string([list_contains(clause_types, x)::INT FOR x IN t], '') AS multi_hot FROM labelled, names""",
)
def multi_hot_labels(spark, folder):
    joined = L.join_labels(F.col("clause_types"))
    back = L.split_labels(F.col("clause_type"))
    return (
        D.labelled_clauses(spark, folder)
        .select("clause_id", joined.alias("clause_type"))
        .withColumn("multi_hot", F.array_join(L.multi_hot(back).cast("array<string>"), ""))
    )


@query(
    "clean_labelled_clauses",
    f"""WITH {D.CLEANED_SQL}
    SELECT clause_id, clause_text, array_to_string(clause_types, '|') AS clause_type, primary_type, source FROM cleaned""",
)
def clean_labelled_clauses(spark, folder):
    out = P.with_primary_type(P.clean_labelled(D.labelled_clauses(spark, folder)))
    return out.select(
        "clause_id", "clause_text", L.join_labels(F.col("clause_types")).alias("clause_type"), "primary_type", "source"
    )


@query(
    "type_counts",
    f"WITH {D.CLEANED_SQL} SELECT primary_type, count(*) AS n_clauses FROM cleaned GROUP BY primary_type",
)
def type_counts(spark, folder):
    out = P.with_primary_type(P.clean_labelled(D.labelled_clauses(spark, folder)))
    return out.groupBy("primary_type").agg(F.count(F.lit(1)).alias("n_clauses"))


# --- Splits ---------------------------------------------------------------------

_SPLIT_SQL = f"""{D.CLEANED_SQL},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY primary_type ORDER BY md5(clause_id||'|42')) AS rn,
    count(*) OVER (PARTITION BY primary_type) AS n FROM cleaned WHERE NOT starts_with(source, 'EDGAR')),
held AS (SELECT *, CASE WHEN n < 10 OR (2 * n + 5) // 10 < 2 THEN 0 ELSE (2 * n + 5) // 10 END AS h FROM ranked),
human AS (
  SELECT clause_id, primary_type, source,
    CASE WHEN rn <= h // 2 THEN 'val' WHEN rn <= h THEN 'test' ELSE 'train' END AS split FROM held),
machine AS (
  SELECT clause_id, primary_type, source, 'train' AS split FROM cleaned WHERE starts_with(source, 'EDGAR')
  QUALIFY row_number() OVER (ORDER BY md5(clause_id||'|42'))
    <= (SELECT floor(count(*) * 0.4::DOUBLE / (1 - 0.4::DOUBLE)) FROM human WHERE split = 'train')),
split AS (SELECT * FROM human UNION ALL SELECT * FROM machine)"""


def _prepared(spark, folder):
    return P.with_primary_type(P.clean_labelled(D.labelled_clauses(spark, folder)))


@query("stratified_split", f"WITH {_SPLIT_SQL} SELECT clause_id, primary_type, source, split FROM split")
def stratified_split(spark, folder):
    return P.stratified_split(_prepared(spark, folder)).select("clause_id", "primary_type", "source", "split")


@query("split_counts", f"WITH {_SPLIT_SQL} SELECT split, primary_type, count(*) AS n_clauses FROM split GROUP BY ALL")
def split_counts(spark, folder):
    return P.split_counts(P.stratified_split(_prepared(spark, folder)))


@query(
    "undersampled_training",
    f"""WITH {_SPLIT_SQL},
    capped AS (SELECT *, row_number() OVER (PARTITION BY split, primary_type ORDER BY md5(clause_id||'|42')) AS r FROM split)
    SELECT clause_id, primary_type, split FROM capped WHERE split <> 'train' OR r <= 15""",
)
def undersampled_training(spark, folder):
    out = P.stratified_split(_prepared(spark, folder), train_cap_per_type=15)
    return out.select("clause_id", "primary_type", "split")


# --- Store and queues -----------------------------------------------------------

_LINE_IDS_SQL = """
stored AS (SELECT substr(md5('LEDGAR'||unnest(string_split(text, chr(10)))), 1, 16) AS clause_id FROM benchmark),
incoming AS (
  SELECT doc_id, line_no, line, substr(md5('LEDGAR'||line), 1, 16) AS clause_id FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents))"""


@query(
    "insert_new_clauses",
    f"""WITH {_LINE_IDS_SQL}
    SELECT clause_id, doc_id, line_no, line AS clause_text FROM incoming
    WHERE clause_id NOT IN (SELECT clause_id FROM stored)
    QUALIFY row_number() OVER (PARTITION BY clause_id ORDER BY doc_id, line_no) = 1""",
)
def insert_new_clauses(spark, folder):
    def with_id(rows):
        return rows.withColumn("clause_id", ids.clause_id("LEDGAR", F.col("clause_text")))

    stored = with_id(table(spark, folder, "benchmark").select(F.explode_outer(F.split("text", "\n")).alias("clause_text")))
    incoming = with_id(
        table(spark, folder, "documents").select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "clause_text"))
    )
    return store.insert_if_absent(stored, incoming, "clause_id", [F.col("doc_id"), F.col("line_no")])


@query(
    "skip_processed_filings",
    """WITH done AS (SELECT substr(md5('page_'||doc_id||'.txt'), 1, 12) AS contract_id FROM labels WHERE quality = 1)
    SELECT 'page_'||page_id||'.txt' AS file_name, length(html) AS n_chars FROM pages
    WHERE substr(md5('page_'||page_id||'.txt'), 1, 12) NOT IN (SELECT contract_id FROM done)""",
)
def skip_processed_filings(spark, folder):
    contracts = table(spark, folder, "labels").select(
        ids.contract_id("page_", F.col("doc_id"), ".txt").alias("contract_id"),
        F.when(F.col("quality") == 1, "EDGAR_auto").otherwise("upload").alias("source"),
    )
    pages = table(spark, folder, "pages").select(
        F.concat(F.lit("page_"), "page_id", F.lit(".txt")).alias("file_name"), F.length("html").alias("n_chars")
    )
    return filings.new_filings(pages, contracts)


@query(
    "new_contracts",
    f"""WITH {D.CONTRACTS_SQL},
    stored AS (SELECT substr(md5('doc_'||doc_id||'.txt'), 1, 12) AS contract_id FROM labels)
    SELECT DISTINCT contract_id, contract_id AS filename, 'upload' AS source FROM contracts
    WHERE contract_id NOT IN (SELECT contract_id FROM stored)""",
)
def new_contracts(spark, folder):
    stored = table(spark, folder, "labels").select(ids.contract_id("doc_", F.col("doc_id"), ".txt").alias("contract_id"))
    rows = store.contract_rows(D.contract_texts(spark, folder), "upload")
    return store.insert_if_absent(stored, rows, "contract_id", [F.col("filename")])


@query(
    "uploaded_text_clauses",
    f"""WITH docs AS (SELECT DISTINCT substr(md5(text), 1, 12) AS contract_id, text FROM ({D._swap_sql().join(['SELECT ', ' AS text FROM documents'])})),
    {D.segment_sql('docs')}
    SELECT contract_id, substr(md5(contract_id||position||clause_text), 1, 16) AS clause_id, 'text_input' AS source FROM numbered""",
)
def uploaded_text_clauses(spark, folder):
    texts = D.contract_texts(spark, folder).select(store.upload_contract_id(F.col("text")).alias("contract_id"), "text")
    # Equal texts have equal ids, and so have their clauses: one contract however often
    # it is submitted. Texts are read once and stay where they are read; only ids move.
    return upload_clauses(texts).select("contract_id", "clause_id", "source").distinct()


@query(
    "review_queue_merge",
    """WITH existing AS (SELECT 'c'||conv_id AS clause_id, text AS clause_text, turn FROM conversations
        QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1),
    incoming AS (SELECT 'c'||doc_id AS clause_id, text AS clause_text FROM documents)
    SELECT clause_id, clause_text, 'queued' AS contract_id FROM existing
    UNION ALL SELECT clause_id, clause_text, 'new' FROM incoming WHERE clause_id NOT IN (SELECT clause_id FROM existing)""",
)
def review_queue_merge(spark, folder):
    turns = table(spark, folder, "conversations")
    first = K.first_per_key(turns, ["conv_id"], [F.col("turn")])
    existing = first.select(
        F.concat(F.lit("c"), "conv_id").alias("clause_id"), F.col("text").alias("clause_text"), F.lit("queued").alias("contract_id")
    )
    incoming = table(spark, folder, "documents").select(
        F.concat(F.lit("c"), "doc_id").alias("clause_id"), F.col("text").alias("clause_text"), F.lit("new").alias("contract_id")
    )
    return store.merge_review_queue(existing, incoming)


@query(
    "taxonomy_review_merge",
    """WITH existing AS (SELECT label AS cluster_id, 'Known '||label AS suggested_name, count(*) AS size, 'Accept' AS action
        FROM embeddings GROUP BY label),
    incoming AS (SELECT n_nationkey AS cluster_id, n_name AS suggested_name, count(c_custkey) AS size, 'review' AS action
        FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL),
    merged AS (SELECT * FROM existing UNION ALL SELECT * FROM incoming WHERE cluster_id NOT IN (SELECT cluster_id FROM existing))
    SELECT cluster_id, suggested_name, size, CASE WHEN lower(action) = 'accept' THEN 'done' ELSE action END AS action FROM merged""",
)
def taxonomy_review_merge(spark, folder):
    existing = table(spark, folder, "embeddings").groupBy(F.col("label").alias("cluster_id")).agg(
        F.count(F.lit(1)).alias("size")
    ).select("cluster_id", F.concat(F.lit("Known "), "cluster_id").alias("suggested_name"), "size", F.lit("Accept").alias("action"))
    nation, customer = table(spark, folder, "nation"), table(spark, folder, "customer")
    incoming = (
        nation.join(customer, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .groupBy(F.col("n_nationkey").alias("cluster_id"), F.col("n_name").alias("suggested_name"))
        .agg(F.count("c_custkey").alias("size"))
        .withColumn("action", F.lit("review"))
    )
    _, marked = store.accept_reviewed(store.merge_taxonomy_review(existing, incoming))
    return marked


@query(
    "accepted_names_merge",
    f"""WITH known AS (SELECT unnest({D.sql_list(S.CLAUSE_TYPES[:3])}) AS name, unnest(range(3)) AS position),
    added AS (SELECT event_type AS name, min(event_id) AS position FROM events GROUP BY event_type
      UNION ALL SELECT 'Exclusivity', max(event_id) FROM events),
    both_ AS (SELECT name, 0 AS part, position FROM known UNION ALL SELECT name, 1, position FROM added),
    firsts AS (SELECT name, min((part, position)) AS seen FROM both_ GROUP BY name)
    SELECT name, row_number() OVER (ORDER BY seen, name) - 1 AS position FROM firsts""",
)
def accepted_names_merge(spark, folder):
    known = spark.createDataFrame(list(enumerate(S.CLAUSE_TYPES[:3])), "position long, name string")
    events = table(spark, folder, "events")
    added = events.groupBy(F.col("event_type").alias("name")).agg(F.min("event_id").alias("position"))
    repeated = events.agg(F.lit("Exclusivity").alias("name"), F.max("event_id").alias("position"))
    return K.merge_names(known, added.unionByName(repeated))


@query(
    "score_update",
    f"""WITH {D.CLAUSES_SQL},
    fresh AS (SELECT contract_id, sum(n_words)::DOUBLE AS anomaly_score FROM clauses GROUP BY contract_id HAVING count(*) >= 5)
    SELECT c.contract_id, c.doc_id, coalesce(f.anomaly_score, -1.0::DOUBLE) AS anomaly_score FROM contracts c LEFT JOIN fresh f USING (contract_id)""",
)
def score_update(spark, folder):
    base = D.contract_texts(spark, folder).select("contract_id", "doc_id", F.lit(-1.0).alias("anomaly_score"))
    fresh = (
        D.contract_clauses(spark, folder)
        .groupBy("contract_id")
        .agg(F.sum(word_count(F.col("clause_text"))).cast("double").alias("anomaly_score"), F.count(F.lit(1)).alias("n"))
        .where("n >= 5")
        .drop("n")
    )
    return K.apply_updates(base, fresh, "contract_id")


@query(
    "missing_embeddings",
    """WITH cache AS (SELECT vec_id::VARCHAR AS clause_id, md5(text) AS text_digest FROM embeddings JOIN documents ON doc_id = vec_id WHERE label <> 3)
    SELECT doc_id::VARCHAR AS clause_id, md5(text) AS text_digest FROM documents d
    WHERE NOT EXISTS (SELECT 1 FROM cache c WHERE c.clause_id = d.doc_id::VARCHAR AND c.text_digest = md5(d.text))""",
)
def missing_embeddings(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("clause_id"), F.col("text").alias("clause_text"))
    vectors = table(spark, folder, "embeddings").where("label <> 3").select(F.col("vec_id").cast("string").alias("clause_id"))
    cache = docs.join(vectors, "clause_id").select("clause_id", F.md5("clause_text").alias("text_digest"))
    return store.missing_embeddings(docs, cache).select("clause_id", "text_digest")
