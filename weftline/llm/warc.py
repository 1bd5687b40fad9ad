"""WARC archives as a PySpark Python data source (operator 8).

``spark.dataSource.register(WarcDataSource)`` adds the format ``warc``.

Writing: each task streams its rows into files of at most ``max_bytes`` in the
folder, named by the job and the task's attempt.  Only the files that the
driver commits are listed in the job's manifest, so a task that is run again
after a lost executor leaves no double records, and later writes add to the folder.
Option ``compression`` = "gzip" makes each record a member of its own.

Reading: the files of all manifests of the folder, and all ``*.warc`` and ``*.warc.gz`` of
others in it, are packed into partitions of about ``split_bytes``.  Filters on
``warc_type``, ``record_id``, ``target_uri``, ``refers_to``, ``payload_digest`` and
``content_length`` are pushed down (with spark.sql.python.filterPushdown.enabled):
a record's header block is parsed first, and the block of a record that no
filter wants is skipped by its Content-Length without reading it.  With option
``payload`` = "false" no block is read at all.

Paths are anything that pyarrow's file systems open by URI.

Defined results: a null payload is written as an empty one, a null header field
is left out and read as null, line ends in header values become spaces; repeated
rows are a record each; rows of one page number in a group of equal payloads are
all responses if it is the largest; an empty folder gives no rows; a file that ends
inside a record is an error, also where its block is skipped; other columns of the
pages aren't written.
"""

from __future__ import annotations

import gzip
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any, BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from .common import materialise, shared_dir

SCHEMA = "warc_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_length long, content_length long, payload binary"
MANIFEST = "_manifest"
#: Names of files that this writer makes.
OWN = re.compile(r"part-[0-9a-f]{12}-\d+-\d+-\d+\.warc(\.gz)?")
BATCH_BYTES = 8 << 20
#: Up to so many payloads with copies (about 60 bytes each) go to every task; more are joined by a shuffle.
BROADCAST_COPIES = 100_000
# fixed values of the format: header fields of the columns
HEADERS = {
    "warc_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "payload_length": "X-Payload-Length",
    "content_length": "Content-Length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NUMBERS = {"payload_length", "content_length"}


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def record(row: dict[str, Any], date: str) -> bytes:
    """One WARC record; a revisit has no block."""
    payload = (row.get("payload") or b"") if row["warc_type"] != "revisit" else b""
    values = {k: row.get(k) for k in HEADERS} | {"content_length": len(payload)}
    lines = ["WARC/1.1", *(f"{HEADERS[k]}: {' '.join(str(v).splitlines())}" for k, v in values.items() if v is not None), f"WARC-Date: {date}"]
    lines.append(f"WARC-Profile: {REVISIT_PROFILE}" if row["warc_type"] == "revisit" else "Content-Type: text/html")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def headers(stream: BinaryIO) -> dict[str, str] | None:
    """Header fields (names in lower case) of the record that starts here; None at the end of the file."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record starts with {line[:40]!r}")
    found: dict[str, str] = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n"):
        if not line:
            raise ValueError("the file ends inside a header")
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def fields(found: dict[str, str]) -> dict[str, Any]:
    values = {k: found.get(name.lower()) for k, name in HEADERS.items()}
    return values | {k: int(values[k]) for k in NUMBERS if values[k] is not None}


def wants(filters: list[Filter], values: dict[str, Any]) -> bool:
    return all(_holds(f, values.get(f.attribute[0])) for f in filters)


def _holds(f: Filter, v: Any) -> bool:
    if v is None:
        return False
    match f:
        case EqualTo():
            return v == f.value
        case In():
            return v in f.value
        case StringStartsWith():
            return v.startswith(f.value)
        case GreaterThan():
            return v > f.value
        case GreaterThanOrEqual():
            return v >= f.value
        case LessThan():
            return v < f.value
        case LessThanOrEqual():
            return v <= f.value
    return True  # IsNotNull


@dataclass
class Files(InputPartition):
    paths: list[str]

    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.split_bytes = int(options.get("split_bytes", 32 << 20))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        usable = (EqualTo, In, StringStartsWith, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, IsNotNull)
        for f in filters:
            if isinstance(f, usable) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, root = _place(self.path)
        found = sorted(system.get_file_info(fs.FileSelector(root)), key=lambda info: info.path)
        lists = [info.path for info in found if info.base_name.startswith(MANIFEST)]
        names = {n for path in lists for n in json.loads(system.open_input_stream(path).read())}
        missing = names - {info.base_name for info in found}
        if missing:
            raise ValueError(f"archives of a manifest are missing: {sorted(missing)[:3]}")
        # a file named as ours counts once a manifest lists it, one of others as it is
        found = [info for info in found if info.base_name in names or (info.base_name.endswith((".warc", ".warc.gz")) and not OWN.fullmatch(info.base_name))]
        out: list[Files] = []
        room = 0
        for info in found:
            if room < info.size or not out:
                out.append(Files([]))
                room = self.split_bytes
            out[-1].paths.append(info.path)
            room -= info.size
        return out

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are no files
            return
        system, _ = _place(self.path)
        rows: list[dict[str, Any]] = []
        for path in partition.paths:
            if path.endswith(".gz"):
                with system.open_input_stream(path, compression="gzip") as stream:
                    yield from self._records(_Buffered(stream, None), rows)
            else:
                with system.open_input_file(path) as stream:
                    yield from self._records(_Buffered(stream, stream.size()), rows)
        if rows:
            yield _batch(rows)

    def _records(self, stream: _Buffered, rows: list[dict[str, Any]]) -> Iterator[pa.RecordBatch]:
        held = 0
        while (found := headers(stream)) is not None:
            values = fields(found)
            size = values["content_length"] or 0
            if self.payload and wants(self.filters, values):
                payload = stream.read(size)
                if len(payload) < size:
                    raise ValueError("the file ends inside a block")
                rows.append(values | {"payload": payload})
                held += size
            else:
                stream.skip(size)
                if wants(self.filters, values):
                    rows.append(values | {"payload": None})
            if held > BATCH_BYTES or len(rows) >= 10_000:
                yield _batch(rows)
                rows.clear()
                held = 0


class _Buffered:
    """Lines, blocks and skips over a file of ``length`` bytes that can seek, or a stream that can't (None)."""

    def __init__(self, file: pa.NativeFile, length: int | None, size: int = 1 << 18):
        self.file, self.length, self.size, self.data, self.at = file, length, size, b"", 0

    def _more(self) -> bool:
        new = self.file.read(self.size)
        self.data, self.at = self.data[self.at :] + new, 0
        return bool(new)

    def readline(self) -> bytes:
        while (end := self.data.find(b"\n", self.at)) < 0:
            if not self._more():
                end = len(self.data) - 1
                break
        line, self.at = self.data[self.at : end + 1], end + 1
        return line

    def read(self, size: int) -> bytes:
        have = self.data[self.at : self.at + size]
        self.at += len(have)
        return have + self.file.read(size - len(have)) if len(have) < size else have

    def skip(self, size: int) -> None:
        have = min(size, len(self.data) - self.at)
        self.at += have
        left = size - have
        if self.length is not None and left:
            if self.file.tell() + left > self.length:
                raise ValueError("the file ends inside a block")
            self.file.seek(self.file.tell() + left)
        while self.length is None and left:
            new = self.file.read(min(left, self.size))
            if not new:
                raise ValueError("the file ends inside a block")
            left -= len(new)


def _batch(rows: list[dict[str, Any]]) -> pa.RecordBatch:
    types = [pa.int64() if c in NUMBERS else pa.binary() if c == "payload" else pa.string() for c in (*HEADERS, "payload")]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip((*HEADERS, "payload"), types, strict=True)], [*HEADERS, "payload"])


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.max_bytes = int(options.get("max_bytes", 64 << 20))
        self.date = options.get("date", "1970-01-01T00:00:00Z")
        self.gzip = options.get("compression", "none").lower() == "gzip"
        self.job = uuid.uuid4().hex[:12]
        system, root = _place(self.path)
        system.create_dir(root, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _place(self.path)
        task = TaskContext.get()
        stem = f"part-{self.job}-{task.partitionId() if task else 0}-{task.taskAttemptId() if task else 0}"
        names: list[str] = []
        out, size = None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None or size > self.max_bytes:
                        if out is not None:
                            out.close()
                        names.append(f"{stem}-{len(names)}.warc{'.gz' if self.gzip else ''}")
                        out, size = system.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                    data = record(row, self.date)
                    data = gzip.compress(data, mtime=0) if self.gzip else data
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _place(self.path)
        with system.open_output_stream(f"{root}/{MANIFEST}-{self.job}.json") as stream:
            stream.write(json.dumps([n for m in messages if m for n in m.paths]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Files of an aborted job stay unlisted."""


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 1000, compression: str = "none") -> None:
    """One record a row.  Of equal payloads of ``least_bytes`` or more the largest id's is a response, the others revisit it."""
    pages.sparkSession.dataSource.register(WarcDataSource)
    payload = F.coalesce(F.col(f"`{html_col}`"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumns({"payload_length": F.length("payload").cast("long"), "sha": F.sha1("payload")})
    large = F.col("payload_length") >= least_bytes
    copies = rows.where(large).groupBy(F.col("sha").alias("of")).agg(F.max("id").alias("last"), F.count("*").alias("n")).where("n > 1")
    copies = materialise(copies)  # a row for each payload that occurs twice or more
    if copies.count() <= BROADCAST_COPIES:
        copies = F.broadcast(copies)
    joined = rows.join(copies, large & (F.col("sha") == F.col("of")), "left")
    again = F.col("last").isNotNull() & (F.col("id").isNull() | (F.col("id") < F.col("last")))
    joined.select(
        F.when(again, "revisit").otherwise("response").alias("warc_type"),
        F.concat(F.lit("<urn:page:"), F.col("id").cast("string"), F.lit(">")).alias("record_id"),
        "target_uri",
        F.when(again, F.concat(F.lit("<urn:page:"), F.col("last").cast("string"), F.lit(">"))).alias("refers_to"),
        F.concat(F.lit("sha1:"), "sha").alias("payload_digest"),
        "payload_length",
        F.lit(None).cast("long").alias("content_length"),
        F.when(~again, F.col("payload")).alias("payload"),
    ).write.format("warc").option("compression", compression).mode("append").save(path)


def read_archives(spark: SparkSession, path: str, *, payload: bool = True) -> DataFrame:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def round_trip(pages: DataFrame) -> DataFrame:
    """The query's columns, from archives written to the shared folder and read back.

    Lengths and digests of responses are those of the payloads that were read;
    revisits are read by their headers alone.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    number = lambda c: F.regexp_extract(c, r"urn:page:(-?\d+)", 1).try_cast("long")
    responses = read_archives(spark, path).where("warc_type = 'response'").select("record_id", F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "warc_type", "refers_to")
    revisits = read_archives(spark, path, payload=False).where("warc_type = 'revisit'").select("record_id", F.col("payload_length").alias("payload_bytes"), F.expr("substring(payload_digest, 6)").alias("payload_digest"), "warc_type", "refers_to")
    return responses.unionByName(revisits).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), number("refers_to").alias("refers_to")
    )
