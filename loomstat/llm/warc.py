"""Web archives: writing WARC files and assembling captures from their records.

A capture is written as three records (request, response or revisit, metadata) that name the
response in ``WARC-Concurrent-To``.  Reading takes the records apart again, resolves the
concurrent-to identifiers in either direction and over one record in between, and gathers all
records of a capture into one nested row with a single shuffle.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import posixpath
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import WholeFile, open_folder, stored

VERSION = "WARC/1.1"
DATE = "2026-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6f2b7a52-6b1e-5d0a-9f5e-0b8f4c1d7a10")
PIECE = 1 << 20

RECORD = ("record_id string, type string, concurrent_to string, uri string, date string, payload_bytes long,"
          " payload_digest string, refers_to string, fields map<string,string>, payload binary")


def sha1_base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(kind: str, *key: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, kind + ':' + ':'.join(map(str, key)))}>"


def _header_value(text: str) -> str:
    """A value on one line: control characters are written as %XX."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in text).strip()


def record(kind: str, identifier: str, block: bytes, headers: dict[str, str | None]) -> bytes:
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {identifier}", f"WARC-Date: {DATE}"]
    lines += [f"{k}: {_header_value(v)}" for k, v in headers.items() if v is not None]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    """One gzip member, without a time stamp."""
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def capture_records(page, url: str | None, payload: bytes, refers_to) -> list[bytes]:
    """The three records of a page; ``refers_to``: (page, digest) of the response that a revisit stands for, or None."""
    digest = sha1_base32(hashlib.sha1(payload).digest())
    main = record_id("response", page, digest)
    path = "/" + (url or "").split("://", 1)[-1].partition("/")[2]
    host = (url or "").split("://", 1)[-1].partition("/")[0]
    asked = f"GET {_header_value(path).replace(' ', '%20')} HTTP/1.1\r\nHost: {_header_value(host)}\r\n\r\n".encode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    common = {"WARC-Target-URI": url, "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response"}
    if refers_to is None:
        answer = record("response", main, head + payload, common)
    else:
        answer = record("revisit", main, head, common | {"WARC-Profile": REVISIT_PROFILE,
                                                         "WARC-Refers-To": record_id("response", refers_to, digest)})
    request = record("request", record_id("request", page, digest), asked,
                     {"WARC-Target-URI": url, "WARC-Concurrent-To": main, "Content-Type": "application/http; msgtype=request"})
    about = f"page-id: {'' if page is None else page}\r\n".encode()
    metadata = record("metadata", record_id("metadata", page, digest), about,
                      {"WARC-Target-URI": url, "WARC-Concurrent-To": main, "Content-Type": "application/warc-fields"})
    return [request, answer, metadata]


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
                   least_revisit: int = 0) -> list[dict]:
    """Three records for every row, one ``.warc.gz`` per task; returns the files.

    The payload is the body in UTF-8, empty for null.  Of equal payloads of at least
    ``least_revisit`` bytes the row with the largest id becomes the response and the others
    revisit it.  A row with a null id is always a response, and so are all rows with the
    largest id.  Equality is that of SHA-1 digests and lengths.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(body_col).cast("string"), F.lit("")).alias("body"))
    rows = rows.withColumn("sha", F.sha1(F.col("body").cast("binary")))
    id_type = rows.schema["id"].dataType.simpleString()
    same = rows.where(F.octet_length("body") >= least_revisit).groupBy("sha").agg(
        F.max("id").alias("keeper"), F.count(F.lit(1)).alias("n"))
    same = stored(same.where("n > 1 and keeper is not null").select(F.col("sha").alias("same_sha"), "keeper"), "repeated-payloads")
    if not same.isEmpty():
        rows = rows.join(same, F.col("sha") == F.col("same_sha"), "left")
    else:
        rows = rows.withColumn("keeper", F.lit(None).cast(id_type))
    rows = rows.select("id", "url", "body", F.when(F.col("id") != F.col("keeper"), F.col("keeper")).alias("refers_to"))

    def write(batches):
        number, count = TaskContext.get().partitionId(), 0
        name = f"part-{number:06d}.warc.gz"
        with WholeFile(folder, name) as out:
            out.write(_member(record("warcinfo", record_id("warcinfo", name), b"software: loomstat\r\n",
                                     {"Content-Type": "application/warc-fields"})))
            for batch in batches:
                for page, url, body, refers_to in zip(*(batch[c].to_pylist() for c in ("id", "url", "body", "refers_to")), strict=True):
                    for part in capture_records(page, url, body.encode(), refers_to):
                        out.write(_member(part))
                    count += 1
        yield pa.RecordBatch.from_pydict({"name": [name], "captures": [count]})

    done = rows.mapInArrow(write, "name string, captures long").collect()
    files = [{"name": r.name, "captures": r.captures} for r in sorted(done, key=lambda r: r.name) if r.captures]
    with WholeFile(folder, "archives.json") as out:
        out.write(json.dumps(files).encode())
    return files


def _lines(stream) -> list[bytes] | None:
    """Header lines up to the empty one; None at the end of the file."""
    first = stream.readline()
    while first in (b"\r\n", b"\n"):
        first = stream.readline()
    if not first:
        return None
    lines = [first.rstrip(b"\r\n")]
    while (line := stream.readline().rstrip(b"\r\n")):
        lines.append(line)
    return lines


def _fields(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


class _Block(io.RawIOBase):
    """The next ``size`` bytes of a stream."""

    def __init__(self, stream, size: int):
        self.stream, self.left = stream, size

    def read(self, size: int = -1) -> bytes:
        size = self.left if size < 0 else min(size, self.left)
        data = self.stream.read(size)
        if len(data) < size:
            raise EOFError("a record ends before its Content-Length")
        self.left -= size
        return data

    def readline(self, limit: int = -1) -> bytes:
        line = self.stream.readline(self.left)
        self.left -= len(line)
        return line


def parse(stream, payloads: bool) -> dict:
    """Yields the records of an archive, plain or gzip; payloads are hashed piece by piece."""
    head = stream.peek(2)[:2]
    stream = io.BufferedReader(gzip.GzipFile(fileobj=stream), PIECE) if head == b"\x1f\x8b" else stream
    while (lines := _lines(stream)) is not None:
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        h = _fields(lines[1:])
        block = _Block(stream, int(h.get("content-length", 0)))
        kind, is_http = h.get("warc-type", ""), h.get("content-type", "").startswith("application/http")
        http = _fields((_lines(block) or [b""])[1:]) if is_http and block.left else {}
        out = {"record_id": h.get("warc-record-id"), "type": kind, "concurrent_to": h.get("warc-concurrent-to"),
               "uri": h.get("warc-target-uri"), "date": h.get("warc-date"), "refers_to": h.get("warc-refers-to"),
               "payload_bytes": None, "payload_digest": None, "fields": None, "payload": None}
        if kind == "revisit":
            size = http.get("content-length", "")
            out["payload_bytes"] = int(size) if size.isdigit() else None
            out["payload_digest"] = (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None
        elif "warc-fields" in h.get("content-type", ""):
            out["fields"] = _fields(block.read().splitlines())
        else:
            sha, n, kept = hashlib.sha1(), block.left, []
            while block.left:
                data = block.read(PIECE)
                sha.update(data)
                if payloads:
                    kept.append(data)
            digest = sha1_base32(sha.digest())
            stated = (h.get("warc-payload-digest") or "").removeprefix("sha1:")
            if kind == "response" and stated and stated != digest:
                raise ValueError(f"{out['record_id']}: payload digest {digest}, stated {stated}")
            out |= {"payload_bytes": n, "payload_digest": digest, "payload": b"".join(kept) if payloads else None}
        block.read()
        yield out


def read_records(spark: SparkSession, folder: str, files: list[str], payloads: bool = True) -> DataFrame:
    """The records of the named archives; without ``payloads`` their bytes are only counted and hashed."""
    n = len(files)
    schema = pa.schema([(k, pa.int64() if k == "payload_bytes" else pa.map_(pa.string(), pa.string()) if k == "fields"
                         else pa.binary() if k == "payload" else pa.string())
                        for k in (f.split()[0] for f in RECORD.split(", "))])

    def read(batches):
        for batch in batches:
            for i in batch["id"].to_pylist():
                fs, root = open_folder(folder)
                rows, size = [], 0
                with fs.open_input_file(posixpath.join(root, files[i])) as f:
                    for r in parse(io.BufferedReader(f, PIECE), payloads):
                        r["fields"] = list(r["fields"].items()) if r["fields"] is not None else None
                        rows.append(r)
                        size += len(r["payload"] or b"") + 500
                        if size > 4 * PIECE:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.range(0, n, 1, max(n, 1)).mapInArrow(read, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: (response, request, metadata); each a record or null.

    A request or metadata record belongs to the response that it names, that names it, or that
    the record it names belongs to.  A record that leads to no response makes a capture of its
    own with those it shares a target with.  Several records of one kind in a capture (repeated
    rows) give several rows, the n-th of each kind together.
    """
    main = F.col("type").isin("response", "revisit")
    # Read once, and known in size to the joins below.
    records = stored(records.where(main | F.col("type").isin("request", "metadata")), "records")
    part = F.struct(*records.columns)
    answers = records.where(main)
    others = records.where(~main).select("record_id", "concurrent_to", "type", part.alias("r"))
    named = answers.select(F.col("record_id").alias("member"), F.col("record_id").alias("hub"))
    naming = answers.where("concurrent_to is not null").select(F.col("concurrent_to").alias("member"), F.col("record_id").alias("hub"))
    hubs = named.union(naming).groupBy("member").agg(F.min("hub").alias("hub"))
    others = others.join(hubs.toDF("concurrent_to", "to_hub"), "concurrent_to", "left")
    others = others.join(hubs.toDF("record_id", "own_hub"), "record_id", "left")
    others = others.withColumn("hub", F.coalesce("to_hub", "own_hub"))
    between = others.where("hub is not null").groupBy("record_id").agg(F.min("hub").alias("far_hub"))
    lost = others.where("hub is null").join(between.withColumnRenamed("record_id", "concurrent_to"), "concurrent_to", "left")
    lost = lost.select("type", "r", F.coalesce("far_hub", "concurrent_to", "record_id").alias("key"))
    every = answers.select(F.lit("response").alias("type"), part.alias("r"), F.col("record_id").alias("key"))
    every = every.unionByName(others.where("hub is not null").select("type", "r", F.col("hub").alias("key"))).unionByName(lost)
    kinds = ("response", "request", "metadata")
    own = [F.collect_list(F.when(F.col("type") == k, F.col("r"))).alias(k) for k in kinds]
    gathered = every.groupBy("key").agg(*own)
    zipped = gathered.select(F.explode(F.arrays_zip(*kinds)).alias("c"))
    return zipped.select(*(F.col(f"c.{k}").alias(k) for k in kinds))


def query(spark, folder: str) -> DataFrame:
    """``op2``: every page as a capture, written below the shared folder and read back."""
    from ..session import scratch_path
    from .shared import table

    target = scratch_path(spark, "archives")
    pages = table(spark, folder, "pages")
    files = write_archives(pages, target)
    captures = assemble(read_records(spark, target, [f["name"] for f in files], payloads=False))
    page = F.nullif(F.col("metadata.fields")["page-id"], F.lit("")).cast(pages.schema["page_id"].dataType)
    flat = stored(captures.select(
        page.alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"), F.col("response.record_id").alias("record_id"),
        F.col("response.refers_to").alias("refers_record")), "captures")
    targets = flat.where("record_type = 'response'").groupBy("record_id").agg(F.min("page_id").alias("refers_to"))
    revisits = flat.where("record_type = 'revisit'").drop("record_id").join(
        targets.withColumnRenamed("record_id", "refers_record"), "refers_record", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses = flat.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast(pages.schema["page_id"].dataType))
    return responses.select(*columns).union(revisits.select(*columns))


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keeper FROM p)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(h, CAST(5 * i // 4 + 1 AS INTEGER), 2) AS INTEGER) >> CAST(3 - (5 * i) % 4 AS INTEGER)) & 31 AS INTEGER), 1)), '')
    AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM k"""
