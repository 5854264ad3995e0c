"""WARC archives: a native writer and a Python data source that reads them.

Writing: each row becomes a record by column expressions, and Spark's text writer lays records end to end with the
empty line that ends a WARC record as its separator, so any store Spark can write to will do, with its commit protocol.
Of rows with equal payloads of at least ``min_bytes`` bytes the one with the largest id is the response and the others are
revisits that refer to it, without payload. Decisions come from digests; payloads aren't shuffled unless those exceed
what may be broadcast.

Reading, format ``warc``: one partition a file (the writer bounds a file's records); predicates on record types and
headers are pushed down; a record's headers are parsed first, and a payload that isn't asked for, or whose record
doesn't qualify, is skipped by a seek.

Defined results: a null payload is empty; payloads of any length are written and read whole; repeated rows that tie, with
id and payload of a response, are responses too; among equal payloads a null id counts as smallest, and if all ids are null
each row is a response; a null url has no WARC-Target-URI and line breaks in one become spaces; an empty table gives an empty
archive; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith

from paperloom.plans.workspace import save, ship

RECORDS_PER_FILE = 20_000
BROADCAST_ROWS, HEAVY = 500_000, 2048
END = "\r\n\r\n"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:page:"
#: Column of the reader: header it comes from.
HEADERS = {
    "warc_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to", "content_type": "content-type",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", content_length long, payload_length long, headers map<string,string>, payload binary, file string, offset long"


def sha1_base32(body: Column) -> Column:
    """Base32 SHA-1 of a binary column: hex digits five at a time to base 32, whose digits are then renamed."""
    hexed = F.sha1(body)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_of(payload: Column, kind: Column, id_col: Column, refers: Column, url: Column, date: str) -> Column:
    """One WARC record without its closing empty line."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit = kind == "revisit"
    body = F.when(revisit, F.lit("")).otherwise(payload)
    optional = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    urn = lambda c: F.concat(F.lit(f"<{ID}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", kind), line("WARC-Record-ID", urn(id_col)), F.lit(f"WARC-Date: {date}\r\n"),
        optional("WARC-Target-URI", F.regexp_replace(url, r"[\r\n]+", " ")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1_base32(payload.cast("binary")))),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn(refers)), F.lit(f"WARC-Profile: {PROFILE}\r\n"))).otherwise(F.lit("")),
        line("X-Payload-Length", F.octet_length(payload).cast("string")), F.lit("Content-Type: application/http;msgtype=response\r\n"),
        line("Content-Length", (F.octet_length(body) + len(HTTP_HEAD)).cast("string")), F.lit("\r\n" + HTTP_HEAD), body,
    )


def write_archive(df: DataFrame, path: str, payload: str = "html", id_col: str = "page_id", url: str = "url", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", compression: str = "none") -> None:
    """Write ``df`` as WARC files under ``path``; ``compression`` may be gzip, at the price of seeks when reading."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("body"))
    rows = rows.withColumn("key", F.unhex(F.sha2("body", 256)))
    counted = rows.where(F.octet_length("body") >= min_bytes).groupBy("key").agg(F.max("id").alias("best"), F.count("*").alias("n"))
    shared = save(counted.where("n > 1 and best is not null"), "shared")
    if shared.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(shared.select("key", "best")), "key", "left")
    else:  # frequent digests, fewer than HEAVY of them, are settled where their rows lie; only rows of the others are shuffled
        often = shared.agg(F.sum("n")).first()[0] // HEAVY
        heavy = F.broadcast(shared.where(F.col("n") > often).select("key", "best"))
        joined = rows.join(heavy, "key").unionByName(rows.join(heavy, "key", "left_anti").join(shared.where(F.col("n") <= often).select("key", "best"), "key", "left"))
    own = F.col("best").isNull() | F.coalesce(F.col("id") == F.col("best"), F.lit(False))
    kind = F.when(own, F.lit("response")).otherwise(F.lit("revisit"))
    record = record_of(F.col("body"), kind, F.col("id"), F.col("best"), F.col("url"), date)
    joined.select(record.alias("value")).write.option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _filesystem(path: str):
    from pyarrow import fs

    path = re.sub("^s3[an]://", "s3://", path)  # Hadoop's names for what Arrow calls s3
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace(":/", ":///", 1))


class WarcReader(DataSourceReader):
    """Options: path; payload (false: leave payloads where they are); verify (true: compare payloads with digests)."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true") == "true"
        self.verify = options.get("verify", "false") == "true"
        self.wanted: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            header = HEADERS.get(f.attribute[0]) if len(f.attribute) == 1 else None
            if header and isinstance(f, EqualTo) and isinstance(f.value, str):
                self.wanted.append((header, "in", frozenset([f.value])))
            elif header and isinstance(f, In):
                self.wanted.append((header, "in", frozenset(f.value)))
            elif header and isinstance(f, StringStartsWith):
                self.wanted.append((header, "starts", f.value))
            elif header and isinstance(f, IsNotNull):
                self.wanted.append((header, "given", None))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = _filesystem(self.path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.File:
            return [_File(self.path)]
        names = sorted(x.base_name for x in store.get_file_info(fs.FileSelector(root)) if x.type == fs.FileType.File and x.size and not x.base_name.startswith(("_", ".")))
        return [_File(f"{self.path.rstrip('/')}/{n}") for n in names]

    def qualifies(self, headers: dict) -> bool:
        for header, how, what in self.wanted:
            value = headers.get(header)
            if value is None or (how == "in" and value not in what) or (how == "starts" and not value.startswith(what)):
                return False
        return True

    def read(self, partition: _File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark passes where there are no files
            return
        store, path = _filesystem(partition.path)
        raw = io.BufferedReader(store.open_input_file(path), 1 << 20)
        stream = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw
        rows, held = [], 0
        for row in self.records(stream, partition.path):
            rows.append(row)
            held += len(row[10] or b"")
            if len(rows) >= 1000 or held > 16 << 20:
                yield self.batch(rows)
                rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def records(self, stream, name: str) -> Iterator[tuple]:
        while True:
            at, line = stream.tell(), stream.readline()
            if not line:
                return
            if not line.startswith(b"WARC/"):
                raise ValueError(f"{name}: no WARC record at byte {at}")
            headers: dict[str, str] = {}
            last = ""
            while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
                if line[:1] in b" \t" and last:  # a folded header
                    headers[last] += " " + line.decode("utf-8", "replace").strip()
                    continue
                key, _, value = line.decode("utf-8", "replace").partition(":")
                last = key.strip().lower()
                headers[last] = value.strip()
            size = int(headers.get("content-length", 0))
            full = headers.get("warc-type") != "revisit"
            if not self.qualifies(headers) or not (self.payload or (self.verify and full)):
                stream.seek(size, io.SEEK_CUR)
                body = None
            else:
                block = stream.read(size)
                body = block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block
                if self.verify and full and (said := headers.get("warc-payload-digest", "")).startswith("sha1:"):
                    import base64

                    if said[5:] != base64.b32encode(hashlib.sha1(body).digest()).decode() or int(headers.get("x-payload-length", len(body))) != len(body):
                        raise ValueError(f"{name}: the record at byte {at} doesn't match its digest")
            if stream.read(4) != b"\r\n\r\n":
                raise ValueError(f"{name}: the record at byte {at} doesn't end where it says")
            if self.qualifies(headers):
                length = int(headers["x-payload-length"]) if "x-payload-length" in headers else len(body) if body is not None else None
                yield (*[headers.get(h) for h in HEADERS.values()], size, length, list(headers.items()), body if self.payload else None, name, at)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string()] * len(HEADERS) + [pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.string(), pa.int64()]
        names = [*HEADERS, "content_length", "payload_length", "headers", "payload", "file", "offset"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def read_archive(spark: SparkSession, path: str, payload: bool = True, verify: bool = False) -> DataFrame:
    """The records under ``path``: a file or a folder of .warc or .gz files, on any store that Arrow's file systems reach.

    Spark keeps the predicates that were pushed down with the table it made here, also for later queries of it; so call this
    anew for each set of predicates.
    """
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").options(path=path, payload=str(payload).lower(), verify=str(verify).lower()).load()


def page_id(record_id: Column) -> Column:
    return F.regexp_extract(record_id, f"<{ID}(-?[0-9]+)>", 1).try_cast("long")


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """The records with revisits given the payload of the response that they refer to."""
    full = read_archive(spark, path).where("warc_type = 'response'").select(F.col("record_id").alias("__pl_id"), F.col("payload").alias("__pl_payload")).dropDuplicates(["__pl_id"])
    found = read_archive(spark, path).join(full, F.col("refers_to") == F.col("__pl_id"), "left")
    return found.withColumn("payload", F.coalesce("__pl_payload", "payload")).drop("__pl_id", "__pl_payload")
