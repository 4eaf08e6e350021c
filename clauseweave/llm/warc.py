"""WARC archives as a Spark data source.

Reading plans one partition for each group of archive files of about
``split_bytes``; a record's header is parsed first, predicates on header fields
are pushed down and tested on it, and the block of a record that fails them (or
any block, with ``payload=false``) is skipped by its length without being read.
Writing streams records into files of bounded size: tasks write under a staging
folder and the commit moves the files of successful tasks into place, so a lost
or repeated task leaves no records behind.

Archives are uncompressed, since a compressed block cannot be skipped unread.
Paths are anything that Arrow's file systems open.
"""

from __future__ import annotations

import base64
import io
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage

from clauseweave.llm.exact_dedup import filter_bits, maybe_among, repeated_bits
from clauseweave.session import cut_lineage

SCHEMA = "record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, payload_length long, http_content_type string, payload binary"
HEADERS = {"warc-type": "record_type", "warc-record-id": "record_id", "warc-target-uri": "target_uri", "warc-date": "date", "warc-refers-to": "refers_to", "warc-payload-digest": "payload_digest"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of a file before the next one begins, of a read partition, and of a batch of records handed to Spark.
FILE_BYTES, SPLIT_BYTES, BATCH_BYTES = 64 << 20, 32 << 20, 4 << 20
ARROW = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary()}.get(t, pa.string())) for n, t in (x.strip().split(" ") for x in SCHEMA.split(","))])


def _one_line(value: str) -> str:
    """Header values cannot break lines."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in value or "\n" in value else value


def encode_record(record: dict) -> bytes:
    """One record: WARC header, HTTP header, payload (none in a revisit)."""
    payload = record.get("payload") or b""
    revisit = record["record_type"] == "revisit"
    length = record.get("payload_length")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: {_one_line(record.get('http_content_type') or 'application/octet-stream')}\r\nContent-Length: {len(payload) if length is None else length}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {record['record_type']}", f"WARC-Record-ID: {_one_line(record['record_id'])}", f"WARC-Date: {record.get('date') or '1970-01-01T00:00:00Z'}"]
    if record.get("target_uri") is not None:
        lines.append(f"WARC-Target-URI: {_one_line(record['target_uri'])}")
    if record.get("payload_digest"):
        lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(record["payload_digest"])).decode())
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_one_line(record['refers_to'])}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _header(stream: io.BufferedIOBase) -> dict[str, str] | None:
    """The next record's header fields in lower case, or None at the end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    fields: dict[str, str] = {}
    name = None
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        if line[:1] in b" \t" and name:
            fields[name] += " " + line.decode("utf-8", "replace").strip()
        else:
            key, _, value = line.decode("utf-8", "replace").partition(":")
            name = key.strip().lower()
            fields[name] = value.strip()
    return fields


def _digest(value: str | None) -> str | None:
    """The lower-case hex of a digest in base 32 or hex."""
    if not value:
        return None
    body = value.rpartition(":")[2]
    return body.lower() if len(body) == 40 else base64.b32decode(body).hex()


def _split_http(block: bytes) -> tuple[dict[str, str], bytes]:
    head, found, body = block.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"HTTP/"):
        return {}, block
    pairs = (line.decode("latin-1").partition(":") for line in head.split(b"\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}, body


def read_records(stream: io.BufferedIOBase, tests: list, payload: bool) -> Iterator[dict]:
    """The records whose header passes; blocks of the others are skipped unread."""
    while (fields := _header(stream)) is not None:
        length = int(fields.get("content-length", 0))
        record = {HEADERS[k]: v for k, v in fields.items() if k in HEADERS}
        record["payload_digest"] = _digest(record.get("payload_digest"))
        if not all(test(record) for test in tests):
            stream.seek(length, io.SEEK_CUR)
            continue
        if payload or record.get("record_type") == "revisit":
            http, body = _split_http(stream.read(length))
            record["http_content_type"] = http.get("content-type")
            record["payload_length"] = int(http["content-length"]) if http.get("content-length", "").isdigit() else len(body)
            record["payload"] = body if payload and record.get("record_type") != "revisit" else None
        else:
            stream.seek(length, io.SEEK_CUR)
        yield record


def header_test(filter_):
    """A test of a header field for a pushed predicate, or None if it needs the payload or is of another kind."""
    if not hasattr(filter_, "attribute") or len(filter_.attribute) != 1 or filter_.attribute[0] not in HEADERS.values():
        return None
    field = filter_.attribute[0]
    if isinstance(filter_, EqualTo):
        return lambda r: r.get(field) == filter_.value
    if isinstance(filter_, In):
        allowed = set(filter_.value)
        return lambda r: r.get(field) in allowed
    if isinstance(filter_, StringStartsWith):
        return lambda r: (r.get(field) or "").startswith(filter_.value)
    if isinstance(filter_, IsNotNull):
        return lambda r: r.get(field) is not None
    if isinstance(filter_, IsNull):
        return lambda r: r.get(field) is None
    return None


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.tests: list = []

    def pushFilters(self, filters: list) -> Iterable:
        for filter_ in filters:
            test = header_test(filter_)
            if test is None:
                yield filter_
            else:
                self.tests.append(test)

    def partitions(self) -> list[Files]:
        system, path = fs.FileSystem.from_uri(self.path)
        infos = system.get_file_info(fs.FileSelector(path)) if system.get_file_info(path).type == fs.FileType.Directory else [system.get_file_info(path)]
        groups: list[Files] = []
        size = self.split
        for info in sorted((i for i in infos if i.type == fs.FileType.File and i.path.endswith(".warc")), key=lambda i: i.path):
            if size + info.size > self.split:
                groups.append(Files([]))
                size = 0
            groups[-1].paths.append(info.path)
            size += info.size
        return groups or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.path)
        rows, size = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as file, io.BufferedReader(file, 1 << 18) as stream:
                for record in read_records(stream, self.tests, self.payload):
                    rows.append(record)
                    size += 200 + len(record.get("payload") or b"")
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.limit = int(options.get("file_bytes", FILE_BYTES))
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, path = fs.FileSystem.from_uri(self.path)
        system.create_dir(f"{path}/{self.staging}", recursive=True)
        names: list[str] = []
        out, size = None, 0
        try:
            for batch in iterator:
                for record in batch.to_pylist():
                    if out is None or size >= self.limit:
                        if out is not None:
                            out.close()
                        names.append(f"part-{uuid.uuid4().hex}.warc")
                        out, size = system.open_output_stream(f"{path}/{self.staging}/{names[-1]}"), 0
                    data = encode_record(record)
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages: list) -> None:
        system, path = fs.FileSystem.from_uri(self.path)
        system.create_dir(path, recursive=True)
        if self.overwrite:
            for info in system.get_file_info(fs.FileSelector(path)):
                if info.type == fs.FileType.File and info.path.endswith(".warc"):
                    system.delete_file(info.path)
        for message in messages:
            for name in message.names if message else []:
                system.move(f"{path}/{self.staging}/{name}", f"{path}/{name}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        system, path = fs.FileSystem.from_uri(self.path)
        if system.get_file_info(f"{path}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/{self.staging}")


class WarcSource(DataSource):
    """``spark.read.format("warc").option("payload", ...).load(path)`` and ``df.write.format("warc").save(path)``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with predicates pushed down."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 1000) -> DataFrame:
    """WARC records of pages: of equal payloads of ``least_bytes`` or more the page with the largest id is the response, the others revisit it.

    Null html is an empty payload, a null url gives no target; rows that repeat
    the largest id are all responses; a null id is the smallest. Other columns
    are not read.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("target_uri"), payload.alias("payload")).withColumn("payload_length", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    big = cut_lineage(rows.filter(F.col("payload_length") >= least_bytes).select("page_id", "payload_digest"))
    groups = big.groupBy("payload_digest").agg(F.max("page_id").alias("newest"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    # Only payloads that may occur twice meet their group; the others are written where they are read.
    bits = filter_bits(big.count())
    filled = pages.sparkSession.sparkContext.broadcast(repeated_bits(big.select(F.xxhash64("payload_digest").alias("key")), bits))

    def test(key: pd.Series) -> pd.Series:
        return pd.Series(maybe_among(filled.value, bits, pa.array(key)))

    again = (F.col("payload_length") >= least_bytes) & F.pandas_udf(test, "boolean")(F.xxhash64("payload_digest"))
    tested = rows.withColumn("again", again)
    alone = tested.filter("NOT again").drop("again").withColumn("newest", F.col("page_id"))
    several = tested.filter("again").drop("again").join(groups, "payload_digest", "left").withColumn("newest", F.coalesce("newest", "page_id"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    revisit = ~F.col("page_id").eqNullSafe(F.col("newest"))
    return alone.unionByName(several).select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        urn(F.col("page_id")).alias("record_id"),
        "target_uri",
        F.lit(None).cast("string").alias("date"),
        F.when(revisit, urn(F.col("newest"))).alias("refers_to"),
        "payload_digest",
        "payload_length",
        F.lit("text/html; charset=utf-8").alias("http_content_type"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_pages(pages: DataFrame, path: str, **columns) -> None:
    """Write a record for each page row; an empty table writes no archive."""
    register(pages.sparkSession)
    page_records(pages, **columns).write.format("warc").mode("append").save(path)


def archived_pages(archive: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri of records written by ``write_pages``.

    Length and digest of a response are those of the payload that was read, of a
    revisit those its record states.
    """
    number = lambda c: F.regexp_extract(c, "<urn:page:(-?[0-9]+)>", 1).try_cast("long")
    read = F.col("payload").isNotNull()
    return archive.select(
        number("record_id").alias("page_id"),
        F.when(read, F.octet_length("payload")).otherwise(F.col("payload_length")).cast("long").alias("payload_bytes"),
        F.when(read, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
        "target_uri",
    )
