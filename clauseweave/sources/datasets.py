"""Annotated datasets to processed clauses.

Three inputs share one output schema: contract_id, clause_id, clause_text,
clause_types, party_a, party_b, source. Readers take the splits that exist;
the transforms take DataFrames so that any storage can feed them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseweave import settings as S
from clauseweave.functions import ids
from clauseweave.functions import text as T
from clauseweave.functions.labels import join_labels, split_labels
from clauseweave.operators.keyed import first_per_key
from clauseweave.session import small_side, stored


def read_splits(
    spark: SparkSession, folder: str, names: Sequence[str], fmt: str = "parquet", schema=None
) -> DataFrame:
    """Union of the splits present under ``folder``; row order follows ``names``.

    Adds ``split_no`` so that "first row" has a meaning across splits.
    """
    parts = []
    for number, name in enumerate(names):
        reader = spark.read.format(fmt)
        if schema is not None:
            reader = reader.schema(schema)
        try:
            parts.append(reader.load(f"{folder}/{name}").withColumn("split_no", F.lit(number)))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    if not parts:
        raise FileNotFoundError(f"none of {list(names)} under {folder}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _first_matching(text: Column, taxonomy: Sequence[str]) -> Column:
    """First taxonomy name that contains the text or is contained in it."""
    names = F.array(*[F.struct(F.lit(t).alias("name"), F.lit(t.lower()).alias("low")) for t in taxonomy])
    hits = F.filter(names, lambda t: text.contains(t["low"]) | t["low"].contains(text))
    return F.get(hits, F.lit(0))["name"]


def with_question_type(
    rows: DataFrame, output: str = "clause_type", taxonomy: Sequence[str] = S.CLAUSE_TYPES
) -> DataFrame:
    """Add the clause type of QA rows: from the id's last part, else the question.

    An empty question is contained in every name and so gets the first one.
    The compared texts are a step of their own, made once per row.
    """
    raw_id = F.coalesce("id", F.lit(""))
    last = F.element_at(F.split(raw_id, "__"), -1)
    staged = rows.withColumns(
        {
            "_candidate": F.when(
                raw_id.contains("__"), F.lower(T.strip(F.replace(last, F.lit("_"), F.lit(" "))))
            ),
            "_asked": F.lower(T.strip(F.coalesce("question", F.lit("")))),
        }
    )
    from_id = _first_matching(F.col("_candidate"), taxonomy)
    from_question = _first_matching(F.col("_asked"), taxonomy)
    return staged.withColumn(output, F.coalesce(from_id, from_question)).drop("_candidate", "_asked")


def contract_name(title: Column, id_col: Column) -> Column:
    """Title, else the id's first part, else 'unknown'."""
    blank = F.lit("")
    from_title = T.strip(F.coalesce(title, blank))
    from_id = T.strip(F.get(F.split(F.coalesce(id_col, blank), "__"), F.lit(0)))
    return F.when(from_title != "", from_title).when(from_id != "", from_id).otherwise("unknown")


def qa_clauses(rows: DataFrame, taxonomy: Sequence[str] = S.CLAUSE_TYPES) -> DataFrame:
    """QA rows (title, id, question, answers.text) to clauses with sorted labels.

    Equal answers of one contract merge into one clause. The grouped rows carry
    the text, so its labels are collected as a set (bounded by the taxonomy)
    and partly merged before the shuffle.
    """
    # Type the row before its answers are exploded: once per question. Answers
    # without a type are emptied here, not filtered, because a filter on the
    # type would be pushed down and evaluate it twice.
    typed = with_question_type(
        rows.select(
            contract_name(F.col("title"), F.col("id")).alias("contract_name"),
            "id", "question", F.col("answers.text").alias("texts"),
        ),
        "clause_type",
        taxonomy,
    )
    wanted = typed.withColumn("texts", F.when(F.col("clause_type").isNotNull(), F.col("texts")))
    answers = wanted.select("contract_name", "clause_type", F.explode_outer("texts").alias("answer"))
    cleaned = answers.where("answer IS NOT NULL").withColumn("clause_text", T.strip(F.col("answer"))).where(
        T.word_count(F.col("clause_text")) >= S.MIN_CLAUSE_WORDS
    )
    grouped = cleaned.groupBy("contract_name", "clause_text").agg(
        F.array_sort(F.collect_set("clause_type")).alias("clause_types")
    )
    named = grouped.withColumn("contract_id", ids.contract_id(F.col("contract_name")))
    return named.select(
        "contract_id",
        ids.clause_id(F.col("contract_id"), F.col("clause_text")).alias("clause_id"),
        "clause_text",
        "clause_types",
        T.party_a(F.col("clause_text")).alias("party_a"),
        T.party_b(F.col("clause_text")).alias("party_b"),
        F.lit("CUAD").alias("source"),
    )


def provision_clauses(rows: DataFrame, label_names: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Provision rows (text, label int) mapped to the taxonomy.

    ``label_names`` decodes the integers (label, label_name). Rows that are too
    short or whose label has no counterpart are dropped; the first row of every
    text in the given order stays.
    """
    spark = rows.sparkSession
    mapped = [(k, v) for k, v in S.PROVISION_LABELS.items() if v is not None]
    mapping = F.broadcast(spark.createDataFrame(mapped, "label_name string, clause_type string"))
    decoded = label_names.join(mapping, "label_name").select("label", "clause_type")
    cleaned = rows.withColumn("clause_text", T.strip(F.coalesce("text", F.lit("")))).where(
        T.word_count(F.col("clause_text")) >= S.MIN_CLAUSE_WORDS
    )
    typed = cleaned.join(small_side(decoded), "label")
    out = typed.withColumn("clause_id", ids.clause_id("LEDGAR", F.col("clause_text")))
    first = first_per_key(out, ["clause_id"], order)
    return _single_label(first, ids.contract_id("LEDGAR_", F.col("label")), "LEDGAR")


def deal_point_type(question: Column) -> Column:
    """Type of the first keyword contained in the (lower-case) question."""
    chain = F.when(question.contains(S.DEAL_POINT_KEYWORDS[0][0]), S.DEAL_POINT_KEYWORDS[0][1])
    for keyword, name in S.DEAL_POINT_KEYWORDS[1:]:
        chain = chain.when(question.contains(keyword), name)
    return chain


def deal_point_clauses(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Deal-point rows (text, question, category) mapped by question keywords."""
    cleaned = rows.withColumns(
        {
            "clause_text": T.strip(F.coalesce("text", F.lit(""))),
            "question": F.lower(T.strip(F.coalesce("question", F.lit("")))),
            "category": T.strip(F.when(F.col("category") != "", F.col("category")).otherwise("MAUD")),
        }
    ).where(T.word_count(F.col("clause_text")) >= S.MIN_CLAUSE_WORDS)
    typed = cleaned.withColumn("clause_type", deal_point_type(F.col("question"))).where(
        "clause_type IS NOT NULL"
    )
    out = typed.withColumn("clause_id", ids.clause_id("MAUD", F.col("clause_text")))
    first = first_per_key(out, ["clause_id"], order)
    group = ids.contract_id("MAUD_", F.col("category"), "_", F.col("question"))
    return _single_label(first, group, "MAUD")


def _single_label(rows: DataFrame, contract: Column, source: str) -> DataFrame:
    return rows.select(
        contract.alias("contract_id"),
        "clause_id",
        "clause_text",
        F.array("clause_type").alias("clause_types"),
        F.lit("").alias("party_a"),
        F.lit("").alias("party_b"),
        F.lit(source).alias("source"),
    )


def read_split_csv(spark: SparkSession, path: str) -> DataFrame:
    """A stored split: text columns, nulls as empty, labels as an array."""
    columns = "clause_id string, contract_id string, clause_text string, clause_type string, party_a string, party_b string, source string, primary_type string"
    rows = spark.read.csv(
        path, header=True, schema=columns, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False
    ).fillna("")
    return rows.withColumn("clause_types", split_labels(F.col("clause_type")))


def write_split_csv(split: DataFrame, folder: str) -> None:
    """One CSV folder per split name; labels are pipe-joined only here.

    The rows are computed once. Parquet (``split.write.partitionBy("split")``) is
    the better sink for large splits: a CSV file with line breaks is one task.
    """
    flat = split.select(
        "clause_id", "contract_id", "clause_text", join_labels(F.col("clause_types")).alias("clause_type"),
        "party_a", "party_b", "source", "primary_type", "split",
    )
    with stored(flat) as rows:
        for name in ("train", "val", "test"):
            rows.where(F.col("split") == name).drop("split").write.mode("overwrite").csv(
                f"{folder}/{name}", header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False,
                ignoreTrailingWhiteSpace=False,
            )
