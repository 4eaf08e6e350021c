"""Contract-like inputs that Spark derives from the given tables.

The given prose has no legal vocabulary, so frequent words are swapped for
legal ones and line starts become headers. Every row and the whole text are
kept. Each derivation stands here twice: as a DataFrame and as DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseweave import settings as S
from clauseweave.checks.registry import table
from clauseweave.functions import ids
from clauseweave.operators.segmentation import upload_clauses

SWAPS = [
    (" the ", " shall "),
    (" of ", " may "),
    (" and ", " the Licensor "),
    (" to ", " the licensee "),
    (" for ", " unless "),
    (" by ", " provided that "),
    (" de ", " must "),
    (" la ", ' the "Buyer" '),
    (" que ", " should "),
    (" un ", " our Company "),
    (" und ", " will "),
    (" der ", " the customer "),
    (" die ", " if "),
    ("\nTh", "\n1. Th"),
    ("\nE", "\nARTICLE 3 E"),
    ("\nS", "\n\nS"),
    ("\nA", "\n1.2 \tA"),
    ("\nD", "\nGOVERNING LAW \nD"),
    ("\nO", "\n  CLAUSE 7 O"),
]
HEX = "0123456789abcdef"


def quoted(text: str) -> str:
    """A DuckDB string literal; line breaks and tabs as chr()."""
    out = "'" + text.replace("'", "''") + "'"
    return out.replace("\n", "'||chr(10)||'").replace("\t", "'||chr(9)||'")


def sql_list(values) -> str:
    return "[" + ", ".join(quoted(v) if isinstance(v, str) else repr(v) for v in values) + "]"


# --- Contract texts ------------------------------------------------------------

def contract_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, contract_id, text, source_tag) for every document."""
    text = F.col("text")
    for old, new in SWAPS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return table(spark, folder, "documents").select(
        "doc_id",
        ids.contract_id("doc_", F.col("doc_id"), ".txt").alias("contract_id"),
        text.alias("text"),
    )


def _swap_sql() -> str:
    out = "text"
    for old, new in SWAPS:
        out = f"replace({out}, {quoted(old)}, {quoted(new)})"
    return out


SPACES = "' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"

CONTRACTS_SQL = f"""
contracts AS (
  SELECT doc_id, substr(md5('doc_'||doc_id||'.txt'), 1, 12) AS contract_id,
         {_swap_sql()} AS text
  FROM documents)"""


def segment_sql(source: str, prefix: str = "") -> str:
    """CTEs from (contract_id, text) rows of ``source`` to ordered clauses."""
    return f"""
{prefix}lines AS (
  SELECT contract_id, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS line_no
  FROM {source}),
{prefix}marked AS (
  SELECT *, sum(CASE WHEN regexp_matches(trim(line, {SPACES}),
      '^(?:ARTICLE|SECTION|CLAUSE)\\s+\\d+|^\\d+\\.\\d*\\s+[A-Z]|^\\d+\\.\\s+[A-Z]|^[A-Z][A-Z\\s]{{4,}}$')
      THEN 1 ELSE 0 END) OVER (PARTITION BY contract_id ORDER BY line_no) AS grp
  FROM {prefix}lines),
{prefix}by_header AS (
  SELECT contract_id, grp AS piece_no, string_agg(line, chr(10) ORDER BY line_no) AS piece
  FROM {prefix}marked GROUP BY contract_id, grp),
{prefix}header_counts AS (
  SELECT contract_id, count(*) AS n FROM {prefix}by_header GROUP BY contract_id),
{prefix}by_paragraph AS (
  SELECT contract_id, unnest(regexp_split_to_array(text, '\\n\\n+')) AS piece,
         unnest(range(len(regexp_split_to_array(text, '\\n\\n+')))) AS piece_no
  FROM {source}),
{prefix}pieces AS (
  SELECT h.contract_id, piece_no, piece FROM {prefix}by_header h
  JOIN {prefix}header_counts c ON c.contract_id = h.contract_id WHERE n >= 5
  UNION ALL
  SELECT p.contract_id, piece_no, piece FROM {prefix}by_paragraph p
  JOIN {prefix}header_counts c ON c.contract_id = p.contract_id WHERE n < 5),
{prefix}tidy AS (
  SELECT contract_id, piece_no,
         trim(regexp_replace(piece, '[ \\t]{{2,}}', ' ', 'g'), {SPACES}) AS clause_text
  FROM {prefix}pieces),
{prefix}numbered AS (
  SELECT contract_id, clause_text, len(regexp_extract_all(clause_text, '\\S+')) AS n_words,
         row_number() OVER (PARTITION BY contract_id ORDER BY piece_no) - 1 AS position
  FROM {prefix}tidy WHERE len(regexp_extract_all(clause_text, '\\S+')) >= 10)"""


CLAUSES_SQL = f"""{CONTRACTS_SQL}, {segment_sql('contracts')},
clauses AS (
  SELECT contract_id, position, clause_text, n_words,
         substr(md5(contract_id||position||clause_text), 1, 16) AS clause_id
  FROM numbered)"""


def contract_clauses(spark: SparkSession, folder: str) -> DataFrame:
    return upload_clauses(contract_texts(spark, folder))


# --- Labels that follow from the clause id --------------------------------------

def hex_digit(column: str, at: int) -> Column:
    return F.instr(F.lit(HEX), F.substring(column, at, 1)) - 1


def hex_sql(column: str, at: int) -> str:
    return f"(instr('{HEX}', substr({column}, {at}, 1)) - 1)"


def labelled_clauses(spark: SparkSession, folder: str) -> DataFrame:
    """Clauses with one to four labels (some unknown), a source and <omitted> tags."""
    names = F.array(*[F.lit(t) for t in S.CLAUSE_TYPES])
    h = [hex_digit("clause_id", i) for i in range(1, 8)]
    first = F.element_at(names, (h[0] * 16 + h[1]) % 12 + 1)
    second = F.when(h[2] < 8, F.element_at(names, (h[2] * 16 + h[3]) % 100 + 1))
    third = F.when(h[3] < 4, F.element_at(names, (h[3] * 16 + h[4]) % 100 + 1))
    unknown = F.when(h[4] < 3, F.lit("Miscellaneous"))
    only_unknown = F.when(h[6] == 0, F.array(F.lit("Miscellaneous")))
    labels = F.array_compact(F.array(unknown, first, second, third, F.when(h[3] < 4, first)))
    source = F.when(h[5] < 9, "EDGAR_auto").when(h[5] < 12, "CUAD").otherwise("LEDGAR")
    tagged = F.when(h[6] < 5, F.replace("clause_text", F.lit(" shall "), F.lit(" <Omitted> shall "))).otherwise(
        F.col("clause_text")
    )
    return contract_clauses(spark, folder).withColumns(
        {"clause_types": F.coalesce(only_unknown, labels), "source": source, "clause_text": tagged}
    )


_H = [hex_sql("clause_id", i) for i in range(1, 8)]
LABELLED_SQL = f"""{CLAUSES_SQL},
names AS (SELECT {sql_list(S.CLAUSE_TYPES)} AS t),
labelled AS (
  SELECT contract_id, clause_id, position,
    CASE WHEN {_H[6]} < 5 THEN replace(clause_text, ' shall ', ' <Omitted> shall ') ELSE clause_text END AS clause_text,
    CASE WHEN {_H[6]} = 0 THEN ['Miscellaneous'] ELSE
      list_filter([CASE WHEN {_H[4]} < 3 THEN 'Miscellaneous' END,
                   t[({_H[0]} * 16 + {_H[1]}) % 12 + 1],
                   CASE WHEN {_H[2]} < 8 THEN t[({_H[2]} * 16 + {_H[3]}) % 100 + 1] END,
                   CASE WHEN {_H[3]} < 4 THEN t[({_H[3]} * 16 + {_H[4]}) % 100 + 1] END,
                   CASE WHEN {_H[3]} < 4 THEN t[({_H[0]} * 16 + {_H[1]}) % 12 + 1] END],
                  lambda x: x IS NOT NULL) END AS clause_types,
    CASE WHEN {_H[5]} < 9 THEN 'EDGAR_auto' WHEN {_H[5]} < 12 THEN 'CUAD' ELSE 'LEDGAR' END AS source
  FROM clauses, names)"""

CLEANED_SQL = f"""{LABELLED_SQL},
known AS (
  SELECT contract_id, clause_id, position, source,
    CASE WHEN regexp_matches(clause_text, '(?i)<omitted>')
      THEN trim(regexp_replace(regexp_replace(clause_text, '<omitted>', ' ', 'gi'), '\\s{{2,}}', ' ', 'g'), {SPACES})
      ELSE clause_text END AS clause_text,
    [x FOR x IN clause_types IF list_contains(t, x)][1:3] AS clause_types
  FROM labelled, names),
cleaned AS (
  SELECT *, clause_types[1] AS primary_type FROM known
  WHERE len(clause_types) > 0 AND len(regexp_extract_all(clause_text, '\\S+')) >= 10
    AND length(clause_text) <= 15000)"""

# --- Predictions from the embeddings ---------------------------------------------

CLASSES = S.CLAUSE_TYPES[:10]
#: Of each model: the step at which it deals dimensions to classes, and its lean to the true class.
MODELS = {"model_a": (1, 1.5), "model_b": (3, 1.0), "model_c": (7, 0.5)}


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Three probability vectors over ten classes, and the true class, per row.

    A model adds up the dimensions d with (step * d) mod 10 = i for class i, so
    all of them count, and leans to the true class by its own bump.
    """
    rows = table(spark, folder, "embeddings")

    def model(step: int, bump: float) -> Column:
        x = F.transform(F.col("embedding"), lambda e: e.cast("double"))

        def score(i: Column) -> Column:
            own = F.filter(x, lambda _, d: (d * step) % 10 == i)
            return F.aggregate(own, F.lit(0.0), lambda s, e: s + e)

        return F.transform(
            F.sequence(F.lit(0), F.lit(9)),
            lambda i: F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(4.0) * score(i) + F.when(i == F.col("label"), bump).otherwise(-bump)))),
        )

    labels = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (i == F.col("label")).cast("int"))
    names = F.array(*[F.lit(c) for c in CLASSES])
    return rows.select(
        "vec_id",
        "label",
        F.array(F.element_at(names, F.col("label") + 1)).alias("y_true"),
        labels.alias("labels"),
        *[model(*args).alias(name) for name, args in MODELS.items()],
    )


def _model_sql(step: int, bump: float) -> str:
    own = f"[embedding[d + 1]::DOUBLE FOR d IN range(64) IF d * {step} % 10 = i]"
    return (
        f"list_transform(range(10), lambda i: 1.0::DOUBLE / (1.0::DOUBLE + exp(-(4.0::DOUBLE * list_sum({own}) "
        f"+ CASE WHEN i = label THEN {bump}::DOUBLE ELSE -{bump}::DOUBLE END))))"
    )


PREDICTIONS_SQL = f"""
predictions AS (
  SELECT vec_id, label, {sql_list(CLASSES)}[label + 1] AS y_true,
    {', '.join(f'{_model_sql(*args)} AS {name}' for name, args in MODELS.items())}
  FROM embeddings)"""


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round result columns so that summation order does not show."""
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})
