"""WARC archives as a PySpark data source, written and read by tasks.

Writing: each task writes one file of records under a temporary name; the commit on the driver renames the files of
the attempts that count, so lost executors leave nothing behind that a reader would see. Reading: one partition for
each file, the largest first. Record type and header predicates are pushed down: a record's header block is parsed
first, and the payload of a record that is not wanted, or not asked for, is skipped by its length without decoding.

Spark keeps the pushed predicates with what ``load`` returns: a query that reads an archive twice, each time with other
predicates, calls ``load`` twice.

Files end in .warc or .warc.gz (which are read from their start, as they can't be sought in). Paths are URIs that
pyarrow's file systems know (file, hdfs, s3, gs), on storage that all executors reach.

Columns: record_id, record_type, target_uri, refers_to, payload_digest, payload_bytes (of the full payload, also for
revisits), http_headers (of records that hold an HTTP message; the payload is what follows them), payload (binary: any
bytes). Nulls: a null payload is written as an empty one; a null URI or reference has no header and reads back as null.
Rows are records: repeated rows are repeated records, ties of equal payloads and ids included. An empty table gives no
file and no rows. A payload of any length is written and read whole, one at a time.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any, BinaryIO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from riskloom.llm.columns import let
from riskloom.session import materialise

SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, http_headers string, payload binary"
#: Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
#: Lengths of full payloads, which a revisit does not carry.
LENGTH = "X-Payload-Length"


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("warc")`` and ``df.write.format("warc")`` known."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


class WarcSource(DataSource):
    """Options: path; payloads (true, or false to leave all payloads unread)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> DataSourceReader:
        return WarcReader(self.options["path"], schema.fieldNames(), self.options.get("payloads", "true") == "true")

    def writer(self, schema: Any, overwrite: bool) -> DataSourceWriter:
        return WarcWriter(self.options["path"], schema.fieldNames())


@dataclass
class WarcFile(InputPartition):
    path: str
    size: int


class WarcReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], payloads: bool) -> None:
        self.path, self.columns, self.payloads = path, columns, payloads
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality of header columns is handled here; all else goes back to Spark."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in HEADERS:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        files = [f for f in found if f.is_file and f.base_name.endswith((".warc", ".warc.gz")) and f.base_name[0] not in "._"]
        return [WarcFile(f.path, f.size) for f in sorted(files, key=lambda f: (-f.size, f.path))]

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        from pyarrow import fs

        if partition is None:  # Spark asks for one partition where there is no file
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        packed = partition.path.endswith(".gz")
        with store.open_input_stream(partition.path, compression="gzip") if packed else store.open_input_file(partition.path) as raw:
            yield from records(_Buffered(raw), self.wanted, self.columns, self.payloads)


class WarcWriter(DataSourceWriter):
    def __init__(self, path: str, columns: list[str]) -> None:
        self.path, self.columns = path, columns

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)
        first = next(rows, None)
        if first is None:
            return Written("")
        name = f"{uuid.uuid4().hex}.warc"
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/_{name}", buffer_size=1 << 20) as out:
            out.write(record(first.asDict()))
            for row in rows:
                out.write(record(row.asDict()))
        return Written(name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        for k, name in enumerate(sorted(m.name for m in messages if m is not None and m.name)):
            store.move(f"{root}/_{name}", f"{root}/part-{k:05d}-{name}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None and m.name:
                store.delete_file(f"{root}/_{m.name}")


@dataclass
class Written(WriterCommitMessage):
    name: str


def record(row: dict[str, Any]) -> bytes:
    """One record; a revisit carries no payload."""
    revisit = row["record_type"] == "revisit"
    payload = b"" if revisit else row["payload"] or b""
    lines = [VERSION, *(f"{header}: {_line(row[c])}" for c, header in HEADERS.items() if row.get(c) is not None)]
    lines += [f"WARC-Date: {DATE}", f"{LENGTH}: {row['payload_bytes']}", "Content-Type: text/html; charset=utf-8"]
    if revisit:
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}")
    return "\r\n".join([*lines, f"Content-Length: {len(payload)}", "", ""]).encode() + payload + b"\r\n\r\n"


def records(source: _Buffered, wanted: dict[str, set], columns: list[str], payloads: bool = True) -> Iterator[tuple]:
    """Rows of the records whose headers have the wanted values."""
    while (version := source.line()) is not None:
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where one should begin: {version[:40]!r}")
        head: dict[str, str] = {}
        while line := source.line():
            name, _, value = line.decode(errors="replace").partition(":")
            head[name.strip().lower()] = _unline(value.strip())
        size = int(head["content-length"])
        row: dict[str, Any] = {c: head.get(h.lower()) for c, h in HEADERS.items()}
        if any(row[c] not in values for c, values in wanted.items()):
            source.skip(size + 4)
            continue
        if head.get("content-type", "").startswith("application/http"):
            http = source.until(b"\r\n\r\n", size)
            row["http_headers"], size = http.decode("latin-1").removesuffix("\r\n\r\n"), size - len(http)
        row["payload_bytes"] = int(head.get(LENGTH.lower(), size))
        if payloads and "payload" in columns:
            row["payload"] = source.take(size)
            source.skip(4)
        else:
            source.skip(size + 4)
        yield tuple(row.get(c) for c in columns)


class _Buffered:
    """Lines and blocks of a file that can be skipped over by seeking."""

    BLOCK = 1 << 18

    def __init__(self, raw: BinaryIO) -> None:
        self.raw, self.have, self.at = raw, b"", 0

    def line(self) -> bytes | None:
        """Up to the next line end, without it; None at the end of the file."""
        while (end := self.have.find(b"\r\n", self.at)) < 0:
            if not (more := self.raw.read(self.BLOCK)):
                return None
            self.have, self.at = self.have[self.at :] + more, 0
        out, self.at = self.have[self.at : end], end + 2
        return out

    def until(self, mark: bytes, most: int) -> bytes:
        """Up to a mark and with it, or ``most`` bytes if they hold none."""
        while (end := self.have.find(mark, self.at, self.at + most)) < 0 and len(self.have) - self.at < most:
            if not (more := self.raw.read(min(self.BLOCK, most))):
                break
            self.have, self.at = self.have[self.at :] + more, 0
        return self.take(most if end < 0 else end + len(mark) - self.at)

    def take(self, n: int) -> bytes:
        while len(self.have) - self.at < n and (more := self.raw.read(n - (len(self.have) - self.at))):
            self.have, self.at = self.have[self.at :] + more, 0
        out, self.at = self.have[self.at : self.at + n], self.at + n
        return out

    def skip(self, n: int) -> None:
        ahead = len(self.have) - self.at
        if n <= ahead:
            self.at += n
            return
        self.have, self.at, left = b"", 0, n - ahead
        if getattr(self.raw, "seekable", lambda: True)():
            self.raw.seek(left, 1)
        else:  # a compressed stream
            while left and (gone := len(self.raw.read(min(left, self.BLOCK)))):
                left -= gone


def _line(value: str) -> str:
    """A header value on one line, without white space at its ends: such characters and % as percent codes."""
    return "".join(f"%{ord(c):02X}" if c in "%\r\n\t " else c for c in value)


def _unline(value: str) -> str:
    return re.sub("%(0D|0A|09|20|25)", lambda m: chr(int(m[1], 16)), value)


def payload_digest(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column, five bits a character, by table look-up."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")

    def bits(sha1: Column) -> Column:
        return F.concat(*[F.lpad(F.conv(F.substring(sha1, 1 + 10 * k, 10), 16, 2), 40, "0") for k in range(4)])

    def text(ones: Column) -> Column:
        places = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substring(ones, i * 5 + 1, F.lit(5)), 2, 10).cast("int"))
        return F.array_join(F.transform(places, lambda p: F.substring(letters, p + 1, F.lit(1))), "")

    return let(F.sha1(payload), lambda sha1: let(bits(sha1), text))


def archive(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write ``pages(page_id, url, html)`` as records; of equal payloads, the largest id's is whole, the others revisit it.

    Payloads under ``least_bytes`` are all written whole. Only ids and digests are shuffled to find the equal ones;
    the few ids that revisit another are stored, so that Spark knows their size when it joins them to the pages.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    sha1 = F.unhex(F.sha1("payload"))
    ids = materialise(rows.where(F.col("payload_bytes") >= least_bytes).select("page_id", sha1.alias("sha1")), "warc-digests")
    whole = ids.groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = materialise(ids.join(whole, "sha1").where("page_id < refers_to").select("page_id", "sha1", "refers_to").distinct(), "warc-revisits")
    # Of an id with several payloads, only those that the larger page has are revisits.
    out = rows.withColumn("sha1", sha1).join(revisits, ["page_id", "sha1"], "left").select(
        F.concat(F.lit("<urn:page:"), "page_id", F.lit(">")).alias("record_id"),
        F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.concat(F.lit("<urn:page:"), "refers_to", F.lit(">")).alias("refers_to"),
        F.concat(F.lit("sha1:"), payload_digest(F.col("payload"))).alias("payload_digest"),
        "payload_bytes", "payload",
    )
    register(pages.sparkSession)
    out.write.format("warc").mode("append").save(path)


def page_number(column: str) -> Column:
    return F.regexp_extract(column, r"^<urn:page:(-?\d+)>$", 1).cast("long")
