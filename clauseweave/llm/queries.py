"""One query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseweave.llm.common import table
from clauseweave.llm.conversation_trie import prefix_trie
from clauseweave.llm.decontamination import contaminated
from clauseweave.llm.exact_dedup import exact_duplicates
from clauseweave.llm.filter_audit import filter_audit
from clauseweave.llm.html_extraction import fit as fit_labeller
from clauseweave.llm.html_extraction import main_text
from clauseweave.llm.line_quality import COUNTS, quality
from clauseweave.llm.line_quality import train as train_field
from clauseweave.llm.mixing import mix_sources
from clauseweave.llm.ngram_join import near_duplicates
from clauseweave.llm.pii import KINDS, fit, personal_data, span_text
from clauseweave.llm.registry import query
from clauseweave.llm.sharding import assign_shards
from clauseweave.llm.suffix_dedup import repeated_bytes
from clauseweave.llm.toxicity import toxicity, train
from clauseweave.llm.warc import archived_pages, read_warc, write_pages
from clauseweave.session import shared_folder


@query("op2_decontamination")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op3_mixing")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents"))


@query("op5_sharding")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return assign_shards(table(spark, folder, "documents"))


OP7_SQL = """
WITH d AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256
    FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
    doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


@query("op7_exact_dedup", OP7_SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    found = exact_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op8_toxicity")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity(docs, train(docs, table(spark, folder, "labels")))


@query("op10_ngram_join")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


OP6_SQL = """
WITH p AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), q AS (
    SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS newest FROM p
)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = newest THEN NULL ELSE newest END AS refers_to
FROM q
"""


@query("op6_warc", OP6_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_pages(table(spark, folder, "pages"), path)
    return archived_pages(read_warc(spark, path)).drop("target_uri")


@query("op1_pii")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = personal_data(docs, fit(docs))
    return found.select(
        "doc_id",
        *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


@query("op9_html_extraction")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return main_text(pages, fit_labeller(pages))


@query("op4_suffix_dedup")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_bytes(table(spark, folder, "documents")).drop("removed")


OP11_SQL = """
WITH w AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
    FROM documents
), f AS (
    SELECT doc_id, part, len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b,
        100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c,
        regexp_matches(t, '[#$%&*|]') AS d,
        coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e
    FROM w
), m AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
r AS (
    SELECT part, [a, b, c, d, e] AS fails, a::INT + b::INT + c::INT + d::INT + e::INT AS n_fails,
        coalesce(m.good, false) AS good, coalesce(m.toxic, false) AS toxic
    FROM f LEFT JOIN m USING (doc_id)
), sets AS (
    SELECT part, fails, n_fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
    FROM r GROUP BY part, fails, n_fails
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
    SELECT p.x || q.x || r.x || s.x || t.x AS filter_order
    FROM letters p, letters q, letters r, letters s, letters t
    WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
), steps AS (
    SELECT filter_order, step, instr('ABCDE', filter_order[step]) AS own,
        list_transform(string_split(filter_order[1:step - 1], ''), lambda c: instr('ABCDE', c)) AS earlier
    FROM orders, (SELECT unnest(range(1, 6)) AS step)
), j AS (
    SELECT part, filter_order, step, n, good, toxic, n_fails, fails[own] AS fail,
        step > 1 AND list_bool_or(list_transform(earlier, lambda k: fails[k])) AS gone
    FROM sets, steps
)
SELECT part, filter_order, step::INT AS step,
    coalesce(sum(n) FILTER (NOT fail AND NOT gone), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (fail AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fail AND gone), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (fail AND n_fails = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (fail AND NOT gone), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (fail AND NOT gone), 0)::BIGINT AS toxic_lost,
    coalesce(sum(n * (120 // greatest(n_fails, 1))) FILTER (fail), 0)::BIGINT AS shapley
FROM j GROUP BY part, filter_order, step
"""


@query("op11_filter_audit", OP11_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


#: The checksum of a decimal number's text goes bit by bit: DuckDB has no function for it.
OP12_SQL = """
WITH turns AS (
    SELECT conv_id, turn, sha256(concat(length(r), ':', r, t)) AS digest,
        len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS words
    FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL)
), own AS (
    SELECT conv_id, list({'d': digest, 'w': words} ORDER BY turn NULLS FIRST, digest) AS turns FROM turns GROUP BY conv_id
), headed AS (
    SELECT *, xor(list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
        lambda a, b: list_reduce(
            list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
            lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)
        ), 4294967295::BIGINT) % 4 AS h
    FROM own
), built AS (
    SELECT c.conv_id, list_concat(coalesce(g.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns
    FROM headed c LEFT JOIN own g ON g.conv_id = c.conv_id - c.conv_id % 20
), prefixes AS (
    SELECT conv_id, len(turns) AS total, d, array_to_string(list_transform(turns[1:d], lambda x: x.d), '') AS path, turns[d].w AS words
    FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM built)
), nodes AS (
    SELECT path, d, min(conv_id) AS conv_id, count(*) AS n, coalesce(any_value(words), 0) AS words,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (total = d), '')) AS ends
    FROM prefixes GROUP BY path, d
), children AS (SELECT path[1:64 * (d - 1)] AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
full_nodes AS (SELECT nodes.*, coalesce(children.n, 0) AS n_children FROM nodes LEFT JOIN children USING (path)),
below AS (
    SELECT path[1:64 * k] AS path, sum((n_children = 0)::INT) AS leaves, sum((n - 1) * words) AS saved
    FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM full_nodes) GROUP BY 1
)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n AS n_convs, f.n_children,
    b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, f.ends AS ends_sha256
FROM full_nodes f JOIN below b USING (path) LEFT JOIN nodes p ON f.d > 0 AND p.path = f.path[1:64 * (f.d - 1)]
"""


@query("op12_conversation_trie", OP12_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(table(spark, folder, "conversations"))


@query("op13_line_quality")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality(docs, train_field(docs, table(spark, folder, "labels"))).select("doc_id", *COUNTS, "base_failed", "kept", "content_share")
