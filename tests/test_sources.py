from __future__ import annotations

import hashlib
from collections import Counter
from pathlib import Path

import pytest

from pyspark.sql import functions as F

from clauseweave.checks import round_trip_checks
from clauseweave.operators.segmentation import filing_clauses
from clauseweave.session import shared_folder
from clauseweave.sources import datasets, filings, store
from clauseweave.sources.store import ClauseStore
from clauseweave.streaming.ingest import filing_stream, start_ingest

LONG = " ".join(["word"] * 12)


def write_filings(folder, names):
    for name in names:
        lines = "\n".join(f"{i}. Heading {name} " + " ".join(f"w{i}" for _ in range(25)) for i in range(1, 7))
        (folder / name).write_text(f"<html>{lines}</html>")


def test_filing_folder(spark, tmp_path):
    write_filings(tmp_path, ["a.txt", "b.txt"])
    (tmp_path / "skip.dat").write_text("no")
    (tmp_path / "c.txt").write_bytes(b"one\r\ntwo\rthree \xff end")
    rows = {r.file_name: r.text for r in filings.read_filings(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.txt", "b.txt", "c.txt"}
    assert rows["c.txt"].startswith("one\ntwo\nthree")
    done = spark.createDataFrame(
        [(hashlib.md5(b"a.txt").hexdigest()[:12], "EDGAR_auto"), (hashlib.md5(b"b.txt").hexdigest()[:12], "upload")],
        "contract_id string, source string",
    )
    left = filings.new_filings(filings.read_filings(spark, str(tmp_path)), done)
    assert {r.file_name for r in left.collect()} == {"b.txt", "c.txt"}


def test_store_inserts_once(spark, tmp_path):
    write_filings(tmp_path, ["a.txt", "b.txt"])
    clauses = filing_clauses(filings.read_filings(spark, str(tmp_path)))
    kept = ClauseStore(spark, str(tmp_path / "store"))
    n = clauses.count()
    assert kept.save_clauses(clauses.unionByName(clauses)) == n
    assert kept.save_clauses(clauses) == 0
    assert kept.clauses().count() == n
    contracts = store.contract_rows(clauses, "EDGAR")
    assert kept.save_contracts(contracts) == 2
    assert kept.save_contracts(contracts) == 0
    metrics = spark.createDataFrame([("classifier", "f1", 0.5)], "component string, metric string, value double")
    kept.append_metrics(metrics)
    kept.append_metrics(metrics.withColumn("value", F.lit(0.75)))
    assert kept.latest_metrics().first()["value"] == 0.75


def test_stream_picks_up_new_files_only(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    kept = ClauseStore(spark, str(tmp_path / "store"))
    for batch in (["a.txt", "b.txt"], ["c.txt"]):
        write_filings(inbox, batch)
        start_ingest(
            filing_stream(spark, str(inbox)), kept, str(tmp_path / "progress"), available_now=True
        ).awaitTermination()
    assert kept.contracts().count() == 3
    whole = filing_clauses(filings.read_filings(spark, str(inbox)))
    assert {r.clause_id for r in kept.clauses().collect()} == {r.clause_id for r in whole.collect()}


def test_pdf_reader_with_own_extractor(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"page one|page\x07  two|" + b"|".join([b"x"] * 200))
    (tmp_path / "empty.pdf").write_bytes(b"")
    out = filings.read_pdfs(spark, str(tmp_path), lambda content: content.decode().split("|")).collect()
    assert len(out) == 1
    assert out[0].text.startswith("page one\npage two") and out[0].page_count == 202
    assert out[0].text.count("\n") == 201
    few = filings.read_pdfs(spark, str(tmp_path), lambda content: content.decode().split("|"), max_pages=3).collect()
    assert few[0].text == "page one\npage two\nx" and few[0].page_count == 202
    assert out[0].content_id == hashlib.md5((tmp_path / "a.pdf").read_bytes()).hexdigest()[:12]


def test_split_csv_round_trip(spark, tmp_path):
    rows = [
        ("1", "c", 'He said "no",\nthen left  ', ["A", "B"], "", "", "CUAD", "A", "train"),
        ("2", "c", " plain\ttext", ["B"], "x", "", "MAUD", "B", "val"),
    ]
    df = spark.createDataFrame(
        rows,
        "clause_id string, contract_id string, clause_text string, clause_types array<string>, party_a string, "
        "party_b string, source string, primary_type string, split string",
    )
    datasets.write_split_csv(df, str(tmp_path))
    back = datasets.read_split_csv(spark, str(tmp_path / "train")).first()
    assert (back.clause_text, back.clause_types, back.party_a) == (rows[0][2], ["A", "B"], "")
    assert datasets.read_split_csv(spark, str(tmp_path / "val")).first().clause_text == " plain\ttext"
    assert datasets.read_split_csv(spark, str(tmp_path / "test")).count() == 0


def test_dataset_splits_are_optional(spark, tmp_path):
    spark.createDataFrame([(LONG, 1)], "text string, label int").write.parquet(str(tmp_path / "train"))
    spark.createDataFrame([(LONG, 0)], "text string, label int").write.parquet(str(tmp_path / "test"))
    rows = datasets.read_splits(spark, str(tmp_path), ["train", "validation", "test"])
    names = spark.createDataFrame([(0, "Amendments"), (1, "Notices")], "label int, label_name string")
    out = datasets.provision_clauses(rows, names, [F.col("split_no")]).collect()
    assert [r.clause_types for r in out] == [["Notices"]]
    assert out[0].contract_id == hashlib.md5(b"LEDGAR_1").hexdigest()[:12]


def test_question_types(spark):
    rows = [
        ("X__Governing Law", "whatever", "Governing Law"),
        ("X__Governing_Law_0", "", "Governing Law"),
        ("X__0", 'parts related to "Insurance"', "Insurance"),
        ("plain", "", "Competitive Restriction Exception"),
        ("X__zzz", "nothing known", None),
        ("X__LICENSE", "", "License Grant"),
        (None, None, "Competitive Restriction Exception"),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "id string, question string")
    got = [r.clause_type for r in datasets.with_question_type(df).collect()]
    assert got == [r[2] for r in rows]


def test_dynamic_taxonomy_round_trip(spark, tmp_path):
    path = str(tmp_path / "names")
    assert store.read_dynamic_taxonomy(spark, path).count() == 0
    names = spark.createDataFrame([('Quote " it', 1), ("First", 0)], "name string, position long")
    store.write_dynamic_taxonomy(names, path)
    rows = store.read_dynamic_taxonomy(spark, path).orderBy("position").collect()
    assert [r.name for r in rows] == ["First", 'Quote " it']


def test_review_acceptance(spark):
    review = spark.createDataFrame(
        [(1, "New", "ACCEPT"), (2, "Other", "review"), (3, None, "accept")],
        "cluster_id int, suggested_name string, action string",
    )
    names, marked = store.accept_reviewed(review)
    assert [r.name for r in names.collect()] == ["New"]
    assert [r.action for r in marked.orderBy("cluster_id").collect()] == ["done", "review", "done"]


def test_small_batch_leaves_the_store_in_place(spark, tmp_path):
    from clauseweave.operators.keyed import absent_from_store, absent_rows, merge_keep_existing

    spark.range(200_000).selectExpr("cast(id AS string) AS clause_id", "repeat('x', 200) AS clause_text").write.parquet(str(tmp_path / "store"))
    spark.range(199_990, 200_010).selectExpr("cast(id AS string) AS clause_id", "'new' AS clause_text").write.parquet(str(tmp_path / "batch"))
    kept, batch = spark.read.parquet(str(tmp_path / "store")), spark.read.parquet(str(tmp_path / "batch"))
    fresh = absent_from_store(batch, kept, ["clause_id"])
    assert sorted(r.clause_id for r in fresh.collect()) == sorted(r.clause_id for r in absent_rows(batch, kept, ["clause_id"]).collect())
    plan = kept.select("clause_id").join(batch.select("clause_id"), ["clause_id"], "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    merged = merge_keep_existing(kept, batch, ["clause_id"], [batch.clause_text])
    assert merged.count() == 200_010 and merged.where("clause_text = 'new'").count() == 10


def test_uploads_without_clauses_are_stored(spark):
    rows = spark.createDataFrame([("a", "x.pdf", 3), ("b", "y.pdf", None), ("a", "z.pdf", 1)], "contract_id string, filename string, page_count int")
    got = {r.contract_id: (r.filename, r.source, r.page_count) for r in store.uploaded_contracts(rows, "upload").collect()}
    assert got == {"a": ("x.pdf", "upload", 3), "b": ("y.pdf", "upload", None)}


def test_stored_table_goes(spark):
    from clauseweave.session import is_folder, stored

    with stored(spark.range(5)) as df:
        assert df.count() == 5
        path = df.inputFiles()[0].rsplit("/", 1)[0]
        assert is_folder(spark, path)
    with pytest.raises(Exception, match="does not exist"):
        is_folder(spark, path)


def test_a_file_without_clauses_is_not_read_again(spark, tmp_path):
    from clauseweave.streaming.ingest import ingest_batch

    kept = store.ClauseStore(spark, str(tmp_path / "store"))
    batch = spark.createDataFrame([("short.txt", "nothing here"), ("empty.txt", "")], "file_name string, text string")
    ingest_batch(batch, kept)
    assert {r.filename for r in kept.contracts().collect()} == {"short.txt", "empty.txt"}
    assert kept.clauses().count() == 0
    assert filings.new_filings(batch, kept.contracts()).count() == 0
    ingest_batch(batch, kept)
    assert kept.contracts().count() == 2


def test_documents_as_files(spark, tmp_path):
    """Each document is one file; none has a checksum beside it, for which a process would be started."""
    texts = ["a\nb", "a\nb", "", None, "c\n\nd", "\u00fc \u20ac", "last\n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    before = set(Path(shared_folder(spark)).glob("round-trip-*"))
    found = {r.digest: r.n for r in round_trip_checks.filing_files(spark, str(tmp_path)).collect()}
    own = [f.name for folder in set(Path(shared_folder(spark)).glob("round-trip-*")) - before for f in folder.iterdir()]
    read = [((t or "") + "\n").replace("\r\n", "\n") for t in texts]
    assert found == Counter(hashlib.md5(t.encode()).hexdigest() for t in read)
    assert sum(name.endswith(".txt") for name in own) == len(texts) and not [name for name in own if name.endswith(".crc")]
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert round_trip_checks.filing_files(spark, f"{tmp_path}/none").collect() == []
