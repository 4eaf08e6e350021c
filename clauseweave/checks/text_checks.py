"""Cleaning, segmentation, filings and submissions."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseweave.checks import derived as D
from clauseweave.checks.registry import query, table
from clauseweave.functions import text as T
from clauseweave.operators.segmentation import filing_clauses
from clauseweave.sources.filings import submission_exhibits

_DIRTY_SQL = (
    "replace(replace(text, '. ', '.'||chr(7)||'  '), chr(10), ' '||chr(10)||chr(10)||chr(10)||chr(10))"
)


@query(
    "clean_extracted_text",
    f"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace({_DIRTY_SQL},
      '[^\\x09\\x0A\\x0D\\x20-\\x7E\\x{{A0}}-\\x{{FFFF}}]', ' ', 'g'), '[ \\t]{{2,}}', ' ', 'g'),
      '\\n{{3,}}', chr(10)||chr(10), 'g'), {D.SPACES}) AS clean_text FROM documents""",
)
def clean_extracted_text(spark, folder):
    dirty = F.replace(
        F.replace("text", F.lit(". "), F.lit(".\x07  ")), F.lit("\n"), F.lit(" \n\n\n\n")
    )
    return table(spark, folder, "documents").select("doc_id", T.clean_extracted(dirty).alias("clean_text"))


def _filing_sql(text: str) -> str:
    """Nine patterns one after the other, then whitespace."""
    patterns = [
        ("<[^>]+>", "g"),
        (r"&[\p{L}\p{N}_]+;", "g"),
        ("={3,}", "g"),
        ("-{3,}", "g"),
        (r"Page \d+ of \d+", "gi"),
        (r"EXHIBIT \d+[\.\d]*", "gi"),
        ("<DOCUMENT>.*?</DOCUMENT>", "gis"),
        ("<TEXT>|</TEXT>", "gi"),
        (r"\[EDGAR[^\]]*\]", "gi"),
    ]
    for pattern, flags in patterns:
        text = f"regexp_replace({text}, '{pattern}', ' ', '{flags}')"
    text = f"regexp_replace({text}, '[ \\t]{{2,}}', ' ', 'g')"
    return f"trim(regexp_replace({text}, '\\n{{3,}}', chr(10)||chr(10), 'g'), {D.SPACES})"


_MARKED_SQL = (
    "replace(replace(html, '</h1>', '</h1>'||chr(10)||'Page 3 of 12 EXHIBIT 10.1 [EDGAR filed] ====='),"
    " '</p>', '</p>'||chr(10)||chr(10)||chr(10)||'---- ')"
)


def _filings(spark, folder):
    html = F.replace(
        F.replace("html", F.lit("</h1>"), F.lit("</h1>\nPage 3 of 12 EXHIBIT 10.1 [EDGAR filed] =====")),
        F.lit("</p>"),
        F.lit("</p>\n\n\n---- "),
    )
    return table(spark, folder, "pages").select(
        F.concat(F.lit("page_"), "page_id", F.lit(".txt")).alias("file_name"), html.alias("text")
    )


@query(
    "clean_filing_text",
    f"SELECT 'page_'||page_id||'.txt' AS file_name, {_filing_sql(_MARKED_SQL)} AS clean_text FROM pages",
)
def clean_filing_text(spark, folder):
    return _filings(spark, folder).select("file_name", T.clean_filing(F.col("text")).alias("clean_text"))


_FILINGS_SQL = f"""
filings AS (
  SELECT substr(md5('page_'||page_id||'.txt'), 1, 12) AS contract_id, {_filing_sql(_MARKED_SQL)} AS text
  FROM pages),
long_filings AS (SELECT * FROM filings WHERE len(regexp_extract_all(text, '\\S+')) >= 100),
{D.segment_sql('long_filings')},
filing_rows AS (
  SELECT *, substr(md5('EDGAR'||contract_id||clause_text), 1, 16) AS clause_id FROM numbered)"""


@query(
    "filing_clauses",
    f"""WITH {_FILINGS_SQL}
    SELECT contract_id, clause_id, clause_text, 'EDGAR' AS source FROM filing_rows
    QUALIFY row_number() OVER (PARTITION BY clause_id ORDER BY position) = 1""",
)
def filing_clause_rows(spark, folder):
    return filing_clauses(_filings(spark, folder)).select(
        "contract_id", "clause_id", "clause_text", "source"
    )


@query(
    "segment_contracts",
    f"WITH {D.CLAUSES_SQL} SELECT contract_id, clause_id, position, clause_text FROM clauses",
)
def segment_contracts(spark, folder):
    return D.contract_clauses(spark, folder).select("contract_id", "clause_id", "position", "clause_text")


@query(
    "header_lines",
    f"""WITH {D.CONTRACTS_SQL}, {D.segment_sql('contracts')}
    SELECT contract_id, count(*) AS n_lines, max(grp)::INT AS n_headers FROM marked GROUP BY contract_id""",
)
def header_lines(spark, folder):
    lines = D.contract_texts(spark, folder).select("contract_id", F.split("text", "\n").alias("lines"))
    return lines.select(
        "contract_id",
        F.size("lines").alias("n_lines"),
        F.size(F.filter("lines", T.is_header)).alias("n_headers"),
    )


@query(
    "party_mentions",
    f"""WITH {D.CLAUSES_SQL}
    SELECT clause_id,
      coalesce(nullif(regexp_extract(clause_text, '"(Company|Licensor|Seller|Vendor|Provider|Employer|Franchisor)"', 1), ''),
        regexp_extract(clause_text, '(Company|Licensor|Seller|Vendor|Provider)', 1)) AS party_a,
      coalesce(nullif(regexp_extract(clause_text, '"(Counterparty|Licensee|Buyer|Customer|Employee|Franchisee)"', 1), ''),
        regexp_extract(clause_text, '(Counterparty|Licensee|Buyer|Customer)', 1)) AS party_b
    FROM clauses""",
)
def party_mentions(spark, folder):
    text = F.col("clause_text")
    return D.contract_clauses(spark, folder).select(
        "clause_id", T.party_a(text).alias("party_a"), T.party_b(text).alias("party_b")
    )


@query(
    "submission_exhibits",
    """WITH submissions AS (
      SELECT '0001-24-'||page_id AS accession, page_id::VARCHAR AS cik, '2024-01-0'||(page_id % 9 + 1) AS file_date,
        '<SEC-HEADER>x'||chr(10)||'<DOCUMENT>'||chr(10)||'<TYPE>EX-10.'||(page_id % 3)||chr(10)||'<TEXT>'||html
        ||'</TEXT></DOCUMENT><document><type> ex-10.1 '||chr(10)||'<text>'||url||' '||html||'</document>'
        ||'<DOCUMENT><TYPE>8-K'||chr(10)||'<TEXT>'||html||'</TEXT><DOCUMENT><TYPE>EX-10.9'||chr(10)||'<TEXT>'||url||'</TEXT>' AS sgml
      FROM pages),
    blocks AS (
      SELECT accession, cik, file_date, unnest(regexp_split_to_array(sgml, '(?i)<DOCUMENT>')[2:]) AS block,
        unnest(range(len(regexp_split_to_array(sgml, '(?i)<DOCUMENT>')) - 1)) AS block_no
      FROM submissions),
    parts AS (
      SELECT *, trim(regexp_extract(block, '(?i)<TYPE>([^\\n<]+)', 1)) AS doc_type,
        trim(regexp_extract(block, '(?is)<TEXT>(.*?)(?:</TEXT>|</DOCUMENT>)', 1), ' '||chr(10)||chr(9)) AS text
      FROM blocks)
    SELECT accession, doc_type, text,
      file_date||'_'||cik||'_'||regexp_replace(doc_type, '[^\\p{L}\\p{N}_]', '_', 'g')||'_'
        ||substr(md5(accession||doc_type), 1, 8)||'.txt' AS file_name
    FROM parts WHERE starts_with(upper(doc_type), 'EX-10') AND length(text) >= 200
    QUALIFY row_number() OVER (PARTITION BY accession, doc_type ORDER BY block_no) = 1""",
)
def exhibits(spark, folder):
    pages = table(spark, folder, "pages")
    nl = F.lit("\n")
    sgml = F.concat(
        F.lit("<SEC-HEADER>x\n<DOCUMENT>\n<TYPE>EX-10."), F.col("page_id") % 3, nl, F.lit("<TEXT>"), "html",
        F.lit("</TEXT></DOCUMENT><document><type> ex-10.1 \n<text>"), "url", F.lit(" "), "html",
        F.lit("</document><DOCUMENT><TYPE>8-K\n<TEXT>"), "html",
        F.lit("</TEXT><DOCUMENT><TYPE>EX-10.9\n<TEXT>"), "url", F.lit("</TEXT>"),
    )
    submissions = pages.select(
        F.concat(F.lit("0001-24-"), "page_id").alias("accession"),
        F.col("page_id").cast("string").alias("cik"),
        F.concat(F.lit("2024-01-0"), F.col("page_id") % 9 + 1).alias("file_date"),
        sgml.alias("sgml"),
    )
    return submission_exhibits(submissions).select("accession", "doc_type", "text", "file_name")
