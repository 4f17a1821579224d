"""Deterministic sharded WARC writer and reader.

Records are range-sorted by (id, digest). A range sort of narrow rows (id, digest, bytes) and running sums
of the bytes in that order give the shards: a shard ends where the running sum passes a multiple of its
size. So shards are even whatever the ids look like, and the same rows give the same shards whatever the
cluster or the input's partitions. Payload rows find their shard by binary search in the borders, one for
each shard. A task streams its shards in order, rolls to the next file once a file's compressed size is
reached, and writes every header and digest anew. Equal rows give equal bytes: record ids derive from the
row, dates from a parameter, gzip members carry no time.

A task writes under temporary names of its own attempt and reports what it wrote, a row for each file in
the shared folder. A second job moves the reported files to their final names, in tasks, any of which may
run again; then the manifest is written, a folder of JSON lines that Spark marks as complete. What lost or
repeated attempts left behind goes with the folder of temporary names. A folder without a complete
manifest is not an archive.

Which of the records with equal payloads is the response is settled on (id, digest) rows alone; the
outcome travels into the writer's shuffle as mark rows that sort before their page, so payloads are
shuffled once.

Edge cases: null payloads are empty; a null id is written as such, sorts first and revisits like any
other; ids may lie anywhere among the longs; rows that repeat the largest id of a payload are all
responses; rows equal in id and payload lie in one shard; an empty table gives a manifest without files; a
payload of any length is one record; clashing extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.order import prefix_sum
from .common import cut, released, shared_dir, table

#: Raw bytes of a shard: a 200th of all within these bounds.
SHARD_BYTES = (4_000_000, 1_000_000_000)
ROLL_BYTES = 64_000_000
#: Tasks that read an archive; with more files than that, some read several.
MOST_READERS = 10_000
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "manifest"
TEMPORARY = "_temporary"

_MANIFEST_SCHEMA = "name string, temporary string, records long, bytes long, first_id long, last_id long"
_RECORD_SCHEMA = "id long, uri string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(record_id: int | None) -> str:
    return f"<urn:record:{'null' if record_id is None else record_id}>"


def _from_urn(text: str) -> int | None:
    inner = text.removesuffix(">").rpartition(":")[2]
    return None if inner == "null" else int(inner)


def _record(headers: dict[str, str], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    headers["Content-Length"] = str(len(block))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def page_record(record_id: int | None, uri: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """A response, or a revisit of the record ``refers_to``."""
    digest, revisit = digest32(payload), refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n"
    block = http if revisit else http + payload
    headers = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": _urn(record_id), "WARC-Date": date}
    if uri is not None:
        headers["WARC-Target-URI"] = "".join(c if c > " " else f"%{ord(c):02X}" for c in uri)
    headers |= {"WARC-Payload-Digest": f"sha1:{digest}", "WARC-Block-Digest": f"sha1:{digest32(block)}", "WARC-Payload-Length": str(len(payload))}
    if revisit:
        headers |= {"WARC-Refers-To": _urn(refers_to), "WARC-Profile": REVISIT_PROFILE}
    return _record(headers | {"Content-Type": "application/http; msgtype=response"}, block)


def _info_record(name: str, date: str) -> bytes:
    fields = f"software: seqloom\r\nformat: WARC File Format 1.1\r\nfilename: {name}\r\n".encode()
    return _record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:file:{name}>", "WARC-Date": date, "Content-Type": "application/warc-fields"}, fields)


def parse(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a gzipped archive, one member in memory at a time."""
    z, parts = zlib.decompressobj(31), []
    for chunk in chunks:
        while chunk:
            parts.append(z.decompress(chunk))
            chunk = z.unused_data
            if z.eof:
                head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
                lines = head.decode().split("\r\n")
                if lines[0] != "WARC/1.1":
                    raise ValueError(f"not a WARC record: {lines[0]!r}")
                headers = dict(x.split(": ", 1) for x in lines[1:])
                yield headers, rest[: int(headers["Content-Length"])]
                z, parts = zlib.decompressobj(31), []
    if parts and any(parts):
        raise ValueError("the archive breaks off inside a record")


class _Roller:
    """The files of one task attempt."""

    def __init__(self, folder: str, attempt: str, roll: int, date: str):
        self.fs, self.path = _file_system(folder)
        self.attempt, self.roll, self.date, self.done, self.out, self.shard = attempt, roll, date, [], None, None

    def put(self, shard: int, record_id: int | None, data: bytes) -> None:
        if self.out is None or shard != self.shard or self.size >= self.roll:
            self.close()
            self.number = self.number + 1 if shard == self.shard else 0
            self.shard, self.records, self.first = shard, 0, record_id
            self.name = f"part-{shard:06d}-{self.number:04d}.warc.gz"
            self.temporary = f"{TEMPORARY}/{self.attempt}-{self.name}"
            self.out = self.fs.open_output_stream(f"{self.path}/{self.temporary}", compression=None)
            self.size = self.out.write(info := _info_record(self.name, self.date)) or len(info)
        self.out.write(data)
        self.size += len(data)
        self.records += 1
        self.last = record_id

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.name, self.temporary, self.records, self.size, self.first, self.last))
            self.out = None


def revisits(narrow: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(id, digest, refers_to) of the records that repeat the payload of a larger id."""
    shared = narrow.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.max("id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    # most rows of a hot payload sit under one key: a plain join, which Spark splits when skewed
    return narrow.where(F.col("bytes") >= least_bytes).join(shared, "digest").where("id is null or id < refers_to").select("id", "digest", "refers_to").distinct()


def _borders(narrow: DataFrame, shard_bytes: int | None) -> list[tuple[int | None, str]]:
    """(id, digest) at which the shards after the first begin: at most a border for each shard's size."""
    total = narrow.agg(F.sum(F.col("bytes") + 512)).first()[0]
    if total is None:
        return []
    size = shard_bytes or int(min(max(total / 200, SHARD_BYTES[0]), SHARD_BYTES[1]))
    if total <= size:
        return []
    classes = narrow.groupBy("id", "digest").agg(F.sum(F.col("bytes") + 512).alias("bytes"))
    summed, _ = prefix_sum(classes, ["id", "digest"], "bytes")
    of = F.expr(f"before div {size}L")
    firsts = summed.groupBy(of.alias("shard")).agg(F.min(F.struct("id", "digest")).alias("first"))
    return [(r["first"]["id"], r["first"]["digest"]) for r in firsts.where("shard > 0").orderBy("shard").collect()]


def _shard(borders: list[tuple[int | None, str]]):
    """How many of the borders are not beyond a row's (id, hex)."""
    if not borders:
        return F.lit(0)
    listed = F.from_json(F.lit(json.dumps([{"id": i, "digest": d} for i, d in borders])), "array<struct<id:bigint,digest:string>>")
    own = F.struct(F.col("id"), F.col("hex").alias("digest"))

    def halve(span, _):
        mid = F.floor((span.low + span.high) / 2).cast("int")
        right = (span.low < span.high) & (F.get(listed, mid) <= own)
        return F.struct(F.when(right, mid + 1).otherwise(span.low).alias("low"), F.when(right | (span.low >= span.high), span.high).otherwise(mid).alias("high"))

    span = F.struct(F.lit(0).alias("low"), F.lit(len(borders)).alias("high"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(borders).bit_length())), span, halve, lambda x: x.low)


def write(df: DataFrame, folder: str, id_col: str, uri_col: str, payload_col: str, least_bytes: int = 0, roll_bytes: int = ROLL_BYTES, shard_bytes: int | None = None, date: str = DATE) -> DataFrame:
    """Write the archive into ``folder`` (a place all executors share) and return its manifest."""
    pages = df.select(F.col(id_col).cast("long").alias("id"), F.col(uri_col).alias("uri"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    narrow = cut(pages.select("id", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("bytes")))
    borders = _borders(narrow, shard_bytes)
    none = lambda kind: F.lit(None).cast(kind)
    marks = revisits(narrow, least_bytes).select("id", F.col("digest").alias("hex"), F.lit(0).alias("is_page"), none("string").alias("uri"), none("binary").alias("payload"), "refers_to")
    rows = pages.select("id", F.sha1("payload").alias("hex"), F.lit(1).alias("is_page"), "uri", "payload", none("long").alias("refers_to")).unionByName(marks)
    dealt = rows.withColumn("shard", _shard(borders)).withColumn("hex", F.unhex("hex"))
    dealt = dealt.repartitionByRange(len(borders) + 1, "shard").sortWithinPartitions("shard", "id", "hex", "is_page", "uri").select("shard", "id", "hex", "is_page", "uri", "payload", "refers_to")
    fs, path = _file_system(folder)
    fs.create_dir(f"{path}/{TEMPORARY}", recursive=True)

    def run(batches):
        task = TaskContext.get()
        files = _Roller(folder, f"{task.stageId()}.{task.taskAttemptId()}", roll_bytes, date)
        marked, target = None, None
        for b in batches:
            payloads = b.column(5)
            for i, (shard, record_id, digest, is_page, uri, refers) in enumerate(zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 3, 4, 6)))):
                if is_page:
                    payload = payloads[i].as_py()  # one at a time
                    files.put(shard, record_id, page_record(record_id, uri, payload, target if marked == (record_id, digest) else None, date))
                else:
                    marked, target = (record_id, digest), refers
        files.close()
        columns = list(zip(*files.done)) or [()] * 6
        kinds = [pa.string(), pa.string(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in _MANIFEST_SCHEMA.split(", ")])

    reported = cut(dealt.mapInArrow(released(run), _MANIFEST_SCHEMA))
    return commit(folder, reported)


def commit(folder: str, reported: DataFrame) -> DataFrame:
    """Give the reported files their final names, write the manifest, remove what is left over."""

    def moved(batches):
        fs, path = _file_system(folder)
        for b in batches:
            for name, temporary in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    fs.move(f"{path}/{temporary}", f"{path}/{name}")
                except OSError:  # an attempt before this one has moved it
                    if not fs.get_file_info(f"{path}/{name}").is_file:
                        raise
            yield b.select([0, *range(2, b.num_columns)])

    kept = ", ".join(x for x in _MANIFEST_SCHEMA.split(", ") if not x.startswith("temporary "))
    reported.mapInArrow(moved, kept).write.mode("overwrite").json(f"{folder}/{MANIFEST}")
    fs, path = _file_system(folder)
    fs.delete_dir(f"{path}/{TEMPORARY}")
    return manifest(reported.sparkSession, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(name, records, bytes, first_id, last_id) of a committed archive, a row for each file."""
    fs, path = _file_system(folder)
    if not fs.get_file_info(f"{path}/{MANIFEST}/_SUCCESS").is_file:
        raise FileNotFoundError(f"{folder} has no complete manifest")
    kept = ", ".join(x for x in _MANIFEST_SCHEMA.split(", ") if not x.startswith("temporary "))
    return spark.read.schema(kept).json(f"{folder}/{MANIFEST}")


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of a committed archive; every payload of a response is checked against its digest.

    (id, uri, record_type, payload, payload_bytes, payload_digest, refers_to); the length and digest
    of a revisit are those of the full payload.
    """
    names = manifest(spark, folder).select("name")
    files = names.repartitionByRange(min(max(1, names.count()), MOST_READERS), "name")

    def run(batches):
        own, base = _file_system(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows, held = [], 0
                with own.open_input_stream(f"{base}/{name}", compression=None) as f:
                    for headers, block in parse(iter(lambda: f.read(1 << 20), b"")):
                        if (row := _row(headers, block, payloads)) is not None:
                            rows.append(row)
                            held += len(row[3] or b"") + 200
                            if held > 8_000_000:
                                yield _batch(rows)
                                rows, held = [], 0
                yield _batch(rows)

    return files.mapInArrow(run, _RECORD_SCHEMA)


def _row(headers: dict[str, str], block: bytes, payloads: bool):
    kind = headers["WARC-Type"]
    if kind == "warcinfo":
        return None
    digest, refers = headers["WARC-Payload-Digest"].removeprefix("sha1:"), None
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        size = len(payload)
        if digest32(payload) != digest:
            raise ValueError(f"payload of {headers['WARC-Record-ID']} doesn't have its digest")
    else:
        payload, size, refers = None, int(headers["WARC-Payload-Length"]), _from_urn(headers["WARC-Refers-To"])
    return _from_urn(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), kind, payload if payloads else None, size, digest, refers


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
    columns = list(zip(*rows)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in _RECORD_SCHEMA.split(", ")])


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "pages"), folder, "page_id", "url", "html")
    return read(spark, folder, payloads=False).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 of a SHA-1: 160 bits are 32 digits of five; five hex digits are four of them.
OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY sha1(html)) AS last, count(*) OVER (PARTITION BY sha1(html)) AS n FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS INT), 5))::BIGINT >> CAST(5 * (3 - i % 4) AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < last THEN last END AS refers_to
FROM h
"""
