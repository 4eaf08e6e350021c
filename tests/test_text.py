"""Text functions against plain Python on generated and hand-written strings."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from clauseweave import settings as S
from clauseweave.functions import text as T
from clauseweave.operators.segmentation import filing_clauses, upload_clauses

PIECES = [
    "shall", "the Company", "1. Definitions", "1.2 Liability", "ARTICLE 3", "SECTION", "CLAUSE 9 x",
    "GOVERNING LAW", "ABCD", "ABCDE", "A B C", "a", "é", "Ω", "𝒳", "<b>", "</p>", "<", ">", "&amp;", "& x;",
    "===", "==", "----", "Page 1 of 2", "page 3 of 40", "EXHIBIT 10.1", "Exhibit 9", "[EDGAR x]", "[edgar",
    "]", "<DOCUMENT>", "</DOCUMENT>", "<TEXT>", "\n", "\n\n", "\n\n\n", " ", "  ", "\t", "\r", "\xa0", "　",
    "\x1c", "\x85", " ", "\x07", "​", "٣. A", "12", ".", ";", '"Buyer"', "<omitted>", "<OMITTED>",
]


def texts(seed: int, count: int) -> list[str]:
    rng = random.Random(seed)
    out = ["", " ", "\n", "\n1. Aa", "1. Aa\n", "ABCDE\n", " ABCDE \nxx", "ABCD  \nxx"]
    for _ in range(count):
        n = rng.randint(1, 60)
        out.append("".join(rng.choice(PIECES) + rng.choice(["", " ", "\n"]) for _ in range(n)))
    return out


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, text string").repartition(8)
    rows = df.select("i", make(F.col("text")).alias("out")).collect()
    return [r.out for r in sorted(rows, key=lambda r: r.i)]


HEADERS = [
    r"(?:ARTICLE|SECTION|CLAUSE)\s+\d+", r"\d+\.\d*\s+[A-Z]", r"\d+\.\s+[A-Z]", r"[A-Z][A-Z\s]{4,}$",
]


def plain_header(line: str) -> bool:
    line = line.strip()
    return bool(line) and any(re.match(p, line) for p in HEADERS)


def plain_segments(text: str) -> list[str]:
    groups: list[list[str]] = []
    for number, line in enumerate(text.split("\n")):
        if number == 0 or plain_header(line):
            groups.append([])
        groups[-1].append(line)
    pieces = ["\n".join(g) for g in groups]
    if len(pieces) < 5:
        pieces = re.split("\n\n+", text)
    tidy = [re.sub("[ \t]{2,}", " ", p).strip() for p in pieces]
    return [p for p in tidy if len(p.split()) >= 10]


def plain_filing(text: str) -> str:
    steps = [
        ("<[^>]+>", 0), (r"&\w+;", 0), ("={3,}", 0), ("-{3,}", 0), (r"Page \d+ of \d+", re.I),
        (r"EXHIBIT \d+[\.\d]*", re.I), ("<DOCUMENT>.*?</DOCUMENT>", re.I | re.S), ("<TEXT>|</TEXT>", re.I),
        (r"\[EDGAR[^\]]*\]", re.I),
    ]
    for pattern, flags in steps:
        text = re.sub(pattern, " ", text, flags=flags)
    return re.sub("\n{3,}", "\n\n", re.sub("[ \t]{2,}", " ", text)).strip()


def plain_extracted(text: str) -> str:
    text = "".join(
        c if c in "\t\n\r" or " " <= c <= "~" or "\xa0" <= c <= "￿" else " " for c in text
    )
    return re.sub("\n{3,}", "\n\n", re.sub("[ \t]{2,}", " ", text)).strip()


def plain_omitted(text: str) -> str:
    if "<omitted>" not in text.lower():
        return text
    return re.sub(r"\s{2,}", " ", re.sub("<omitted>", " ", text, flags=re.I)).strip()


@pytest.mark.parametrize(
    ("make", "plain"),
    [
        (T.strip, str.strip),
        (T.word_count, lambda t: len(t.split())),
        (T.words, str.split),
        (T.clean_filing, plain_filing),
        (T.clean_extracted, plain_extracted),
        (T.strip_omitted, plain_omitted),
        (T.clean_clause, lambda t: re.sub("[ \t]{2,}", " ", t).strip()),
    ],
    ids=["strip", "word_count", "words", "filing", "extracted", "omitted", "clause"],
)
def test_like_python(spark, make, plain):
    values = texts(1, 1500)
    assert column(spark, values, make) == [plain(v) for v in values]


def test_header_lines(spark):
    lines = [line for v in texts(2, 800) for line in v.split("\n")]
    assert column(spark, lines, T.is_header) == [plain_header(v) for v in lines]


def test_segments_and_ids(spark):
    values = texts(3, 800)
    df = spark.createDataFrame([(f"c{i}", v) for i, v in enumerate(values)], "contract_id string, text string")
    rows = upload_clauses(df).collect()
    want = set()
    for i, v in enumerate(values):
        for n, clause in enumerate(plain_segments(v)):
            want.add((f"c{i}", n, clause, hashlib.md5(f"c{i}{n}{clause}".encode()).hexdigest()[:16]))
    assert {(r.contract_id, r.position, r.clause_text, r.clause_id) for r in rows} == want
    assert len(rows) == len(want) > 100


def test_filing_clauses(spark):
    body = "\n".join(f"{i}. Alpha " + " ".join(f"word{i % 3}" for _ in range(15)) for i in (1, 2, 1, 3, 4, 5, 1))
    files = [("a.txt", "<p>" + body + "</p>"), ("short.txt", "too short")]
    df = spark.createDataFrame(files, "file_name string, text string")
    rows = filing_clauses(df).orderBy("position").collect()
    contract = hashlib.md5(b"a.txt").hexdigest()[:12]
    assert {r.contract_id for r in rows} == {contract}
    assert len(rows) == len({r.clause_id for r in rows}) == 5
    first = rows[0]
    assert first.clause_id == hashlib.md5(f"EDGAR{contract}{first.clause_text}".encode()).hexdigest()[:16]


def test_parties(spark):
    values = ['the "Buyer" and Licensee', "Licensee then Buyer", 'Company "Vendor"', "the Employer", '"Employer"', ""]
    assert column(spark, values, T.party_a) == ["", "", "Vendor", "", "Employer", ""]
    assert column(spark, values, T.party_b) == ["Buyer", "Licensee", "", "", "", ""]


def test_taxonomy_is_whole():
    assert len(S.CLAUSE_TYPES) == len(set(S.CLAUSE_TYPES)) == 100
    assert len(S.PROVISION_LABELS) == 60
    assert sum(v is None for v in S.PROVISION_LABELS.values()) == 7
    assert {v for v in S.PROVISION_LABELS.values() if v} <= set(S.CLAUSE_TYPES)
    assert len(S.DEAL_POINT_KEYWORDS) == 19
    assert {v for _, v in S.DEAL_POINT_KEYWORDS} <= set(S.CLAUSE_TYPES)


def test_uploads_are_read_once(spark):
    from clauseweave.checks import label_checks

    df = label_checks.uploaded_text_clauses(spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1


def test_word_count_over_every_space(spark):
    rows = [(f"a{chr(c)}b", len(f"a{chr(c)}b".split())) for c in [*range(1, 0x250), *range(0x1600, 0x1700), *range(0x2000, 0x2070), 0x3000, 0x200B]]
    got = spark.createDataFrame(rows, "t string, n int").where(T.word_count(F.col("t")) != F.col("n"))
    assert got.count() == 0


def test_multi_hot_makes_its_labels_once(spark):
    from clauseweave.functions import labels as L

    labels = F.array(F.when(F.rand(3) < 0.5, F.lit("a")).otherwise(F.lit("b")))
    rows = spark.range(200).select(L.multi_hot(labels, ["a", "b"]).alias("v")).collect()
    assert {sum(r.v) for r in rows} == {1}


def test_filings_are_cleaned_once(spark):
    df = spark.createDataFrame([("a.txt", "x")], "file_name string, text string")
    plan = filing_clauses(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("EXHIBIT") == 1


def test_has_words_counts_like_word_count(spark):
    values = texts(11, 400) + [f"{T.SPACE_CHARS}a{T.SPACE_CHARS}" * k for k in range(1, 7)] + ["a " * 5, " a" * 4, "a" * 500]
    counts = column(spark, values, T.word_count)
    for least in (1, 4, 5, 6):
        assert column(spark, values, lambda t, n=least: T.has_words(t, n)) == [c >= least for c in counts]


def test_a_clause_sent_twice_is_cut_once(spark, monkeypatch):
    from clauseweave.checks import stream_checks

    seen = []

    def recorded(filings, **options):
        seen.append(filings._jdf.queryExecution().analyzed().toString())
        return filing_clauses(filings, **options)

    monkeypatch.setattr(stream_checks, "filing_clauses", recorded)
    assert stream_checks.stream_unique_arrivals(spark, "/root/testdata/sf0.001").count()
    assert len(seen) == 1 and "Generate explode" not in seen[0]


def test_pieces_are_cleaned_and_counted_as_one_by_one(spark):
    """Both at once in Arrow batches; blanks of any kind, empty pieces, empty and null arrays."""
    rng = random.Random(8)
    parts = ["word", "é", "😀", " ", "  ", "\t", "\n", "\u00a0", "\u3000", "\x1c", "\u200b", "x y"]
    rows = [["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 4))] for _ in range(200)] + [None]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, pieces array<string>")
    one = F.transform("pieces", lambda p: F.struct(T.clean_clause(p).alias("text"), T.word_count(T.clean_clause(p)).alias("n_words")))
    assert df.where(~T.counted_clauses(F.col("pieces")).eqNullSafe(one)).count() == 0
