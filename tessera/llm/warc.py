"""WARC archives with revisit records: payload digests resolve duplicates, archives are written and read back.

Only headers (id, payload digest, payload length, URL) are shuffled: they are grouped by digest, the
largest id of a group is the response and the others revisit it. The group sizes come from a partial
aggregation, so a payload that many pages share costs a row for each task, and what is joined back is
a join Spark can split. Revisit records are made from their headers alone. Payloads go from the scan
into the archive of the task that reads them: a bit map of the revisits' keys tells which rows are no
revisits, and only rows that it can't tell apart are joined. Archives are written one for each task
under a name of its own attempt, a warcinfo record first; the manifest, a table, lists the finished
ones, and only those are read, so a lost task leaves at most an unlisted file.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, discard, id_marks, marked, new_path, slices, small_batches

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 1
MANIFEST = "path string, records long"
RECORDS = "record_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def record_urn(number: int | None) -> str:
    """A URN made from a signed 64-bit id (a version 8 UUID; null ids use another node), so that it can be read back."""
    if number is None:
        return "urn:uuid:" + str(uuid.UUID(int=8 << 76 | 2 << 62 | 1 << 48 | 1 << 60))
    bits = number & (1 << 64) - 1
    return "urn:uuid:" + str(uuid.UUID(int=bits >> 60 << 80 | 8 << 76 | 2 << 62 | bits & (1 << 60) - 1))


def record_number(urn: str) -> int | None:
    value = uuid.UUID(urn.strip("<>").removeprefix("urn:uuid:")).int
    if value >> 60 & 3 == 1:
        return None
    bits = (value >> 80 & 15) << 60 | value & (1 << 60) - 1
    return bits - (1 << 64) if bits >> 63 else bits


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    """A value with control characters as one line of percent escapes that can be read back."""
    return "".join(f"%{ord(c):02X}" if c < " " or c in "%\x7f" else c for c in value)


def _plain(value: str) -> str:
    parts = value.split("%")
    return parts[0] + "".join(chr(int(p[:2], 16)) + p[2:] for p in parts[1:])


def _uri(name: str, url: str | None) -> list[str]:
    """Header lines for a URL; one that a header can't hold as it is is escaped and marked so."""
    if url is None:
        return []
    odd = any(c < " " or c == "\x7f" for c in url) or url != url.strip()
    return [f"{name}: {_line(url)}", f"X-{name[5:]}-Escaped: yes"] if odd else [f"{name}: {url}"]


def info(name: str, date: str) -> bytes:
    """The record that begins an archive."""
    block = b"software: tessera\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <{uuid.uuid5(uuid.NAMESPACE_URL, name).urn}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record(number: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool, date: str, refers_url: str | None = None) -> bytes:
    """One record; a revisit keeps the HTTP header and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_urn(number)}>", f"WARC-Date: {date}", *_uri("WARC-Target-URI", url)]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{record_urn(refers_to)}>", *_uri("WARC-Refers-To-Target-URI", refers_url), f"WARC-Refers-To-Date: {date}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def records(stream) -> Iterator[dict]:
    """Parse a stream of gzip members, one record each; faults raise ValueError."""
    inflate, data = zlib.decompressobj(31), b""
    plain: list[bytes] = []
    while True:
        if not data:
            data = stream.read(1 << 20)
            if not data:
                break
        plain.append(inflate.decompress(data))
        data = inflate.unused_data
        if inflate.eof:
            parsed = _parse(b"".join(plain))
            if parsed:
                yield parsed
            inflate, plain = zlib.decompressobj(31), []
    if any(plain):
        raise ValueError("the archive ends within a record")


def _parse(whole: bytes) -> dict | None:
    """A response or revisit as a row; None for a warcinfo record."""
    head, _, rest = whole.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("malformed record")
    if "sha1:" + base32_sha1(block) != fields["WARC-Block-Digest"]:
        raise ValueError("block digest mismatch")
    if fields["WARC-Type"] == "warcinfo":
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or "sha1:" + base32_sha1(payload) != fields["WARC-Payload-Digest"]):
        raise ValueError("payload digest mismatch")
    url = fields.get("WARC-Target-URI")
    return {
        "record_id": record_number(fields["WARC-Record-ID"]),
        "url": _plain(url) if "X-Target-URI-Escaped" in fields else url,
        "record_type": kind,
        "refers_to": record_number(fields["WARC-Refers-To"]) if kind == "revisit" else None,
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "payload_bytes": size,
        "payload": payload if kind == "response" else None,
    }


def resolve(pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> tuple[DataFrame, list[DataFrame]]:
    """The records to write (id, url, payload, sha1, bytes, original, original_url, revisit), and tables to delete when they are written.

    Null payloads are empty ones. Payloads under ``least_bytes`` are all responses. Rows that repeat
    the largest id itself are responses too; null ids rank below all others. A revisit's payload is null.
    """
    body = F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url}`").cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1(F.col("payload").cast("binary"))).withColumn("bytes", F.length(F.col("payload").cast("binary")).cast("long"))
    headers = rows.select("id", "url", "sha1", "bytes").where(F.col("bytes") >= least_bytes)
    groups = headers.groupBy("sha1").agg(F.max("id").alias("original"), F.max_by("url", F.struct("id", "url")).alias("original_url"), F.count(F.lit(1)).alias("n")).where("n > 1 AND original IS NOT NULL").drop("n")
    revisits = cut(headers.join(groups, "sha1").where(~F.col("id").eqNullSafe(F.col("original"))), "warc-revisits")
    key = F.xxhash64("id", "sha1", F.col("id").isNull())
    marks = id_marks(revisits.select(key.alias("id")))
    keyed = rows.withColumn("key", key)
    plain = marked(keyed, "key", marks, False)
    # rows that the map takes for revisits: most are, and their payloads are not wanted
    same = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["sha1"] == b["sha1"])
    known = revisits.select("id", "sha1").distinct()
    maybe = marked(keyed.select("id", "sha1", "key"), "key", marks, True).distinct()
    mistaken = cut(maybe.join(known, same(maybe, known), "left_anti").select("key"), "warc-mistaken")
    responses = plain
    if mistaken.take(1):
        some = marked(keyed, "key", id_marks(mistaken.select(F.col("key").alias("id"))), True)
        responses = plain.unionByName(some.join(known, same(some, known), "left_anti").join(mistaken, "key", "left_semi"))
    nothing = lambda kind: F.lit(None).cast(kind)
    out = responses.select("id", "url", "payload", "sha1", "bytes", nothing("long").alias("original"), nothing("string").alias("original_url"), F.lit(False).alias("revisit"))
    return out.unionByName(revisits.select("id", "url", nothing("string").alias("payload"), "sha1", "bytes", "original", "original_url", F.lit(True).alias("revisit"))), [revisits, mistaken]


def write(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, date: str | None = None) -> DataFrame:
    """Write ``pages`` as gzipped WARC files under ``path`` (any file system pyarrow opens); returns the manifest table.

    One record for each row, a gzip member each, after a warcinfo record. Ids are 64-bit integers or
    null. Records are dated now, or ``date``.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    with small_batches(pages.sparkSession):
        resolved, spare = resolve(pages, id_col, url, payload, least_bytes)
        out = _archives(resolved, path, date)
    discard(*spare)
    return out


def _archives(resolved: DataFrame, path: str, date: str) -> DataFrame:
    def member(data: bytes) -> bytes:
        pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        return pack.compress(data) + pack.flush()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        written, out = 0, None
        for whole in batches:
            for batch in slices(whole):
                if out is None:
                    out = store.open_output_stream(f"{folder}/{name}")
                    out.write(member(info(name, date)))
                for r in batch.to_pylist():
                    digest = base64.b32encode(bytes.fromhex(r["sha1"])).decode()
                    out.write(member(record(r["id"], r["url"], (r["payload"] or "").encode(), digest, r["bytes"], r["original"], r["revisit"], date, r["original_url"])))
                    written += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([written], pa.int64())], names=["path", "records"])

    return cut(resolved.mapInArrow(run, MANIFEST), "warc-manifest")


def read(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Records of the archives that the manifest lists, with digests checked; a revisit has a null payload."""
    schema = pa.schema(
        [("record_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch.column("path").to_pylist():
                held, size = [], 0
                with store.open_input_stream(f"{folder}/{name}") as stream:
                    for r in records(stream):
                        held.append(r)
                        size += len(r["payload"] or b"")
                        if len(held) >= 1000 or size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return manifest.repartition(spark.sparkContext.defaultParallelism * 2).mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write archives into the shared folder and read them back."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    return read(spark, path, write(pages, path, id_col, url, payload, least_bytes))
