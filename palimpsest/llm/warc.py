"""WARC archives: one gzip member per record, written and read back sequentially.

``write_archives`` turns rows (key, url, payload) into rolling ``.warc.gz``
files in a folder all executors share; ``read_archives`` streams them with
incremental inflation, Content-Length framing and digest checks.

Defined cases: a null payload is the empty payload, a null url an empty
target; an empty table gives no archives and no records; rows repeated with
one key each make a record of their own.  A payload under ``min_revisit``
bytes is never deduplicated; of equal longer payloads the largest key holds
the payload (all rows with that key do) and the others are revisit records.
A null key counts as smaller than any other.  Memory holds one record at a
time plus ``READ_BYTES`` of input, whatever the archive's length.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ddl, forget, scratch, table, tuned, written

MIN_REVISIT = 1000
ROLL_BYTES = 64 << 20
READ_BYTES = 1 << 18
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "key:long payload_bytes:long payload_digest:string record_type:string refers_to:long url:string payload:binary"


def _named(key: int | None) -> str:
    return "<urn:x-row:" + ("" if key is None else str(key)) + ">"


def _key(name: str) -> int | None:
    digits = name.removeprefix("<urn:x-row:").removesuffix(">")
    return int(digits) if digits else None


def record(key, url, payload: bytes, refers_to=None, revisit=False) -> bytes:
    """One WARC/1.1 record as a gzip member.

    The block is an HTTP response; a revisit's has the headers alone, whose
    Content-Length is that of the full payload.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_named(key)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {' '.join((url or '').split())}"]
    lines += [f"WARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_named(refers_to)}"]
    lines += [f"Content-Length: {len(block)}", "", ""]
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + pack.flush()


def members(stream, size: int = READ_BYTES) -> Iterator[bytes]:
    """The inflated gzip members of a stream, one after another, read piece by piece."""
    inflate, out, data = zlib.decompressobj(31), [], stream.read(size)
    while data:
        out.append(inflate.decompress(data))
        if inflate.eof:
            yield b"".join(out)
            data = inflate.unused_data or stream.read(size)
            inflate, out = zlib.decompressobj(31), []
        else:
            data = stream.read(size)
    if any(out):
        raise ValueError("the archive ends inside a gzip member")


def parsed(member: bytes) -> tuple:
    """A row of RECORD; raises ValueError where framing or a digest is wrong."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    length = int(fields["Content-Length"])
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise ValueError("Content-Length does not frame the record")
    if "sha1:" + hashlib.sha1(block).hexdigest() != fields["WARC-Block-Digest"]:
        raise ValueError("block digest mismatch")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("payload digest mismatch")
    refers = _key(fields["WARC-Refers-To"]) if revisit else None
    return _key(fields["WARC-Record-ID"]), size, digest, "revisit" if revisit else "response", refers, fields["WARC-Target-URI"], None if revisit else payload


def write_archives(rows: DataFrame, key: str, url: str, payload: str, folder: str | None = None, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write every row's record; the result lists the archives as (path, records).

    Only (digest, key) pairs are shuffled, folded per task first; the list of
    revisits is a written table that Spark broadcasts when it is small and
    merges on the key otherwise.  An archive is finished under a name of its
    attempt and then moved, so a repeated task never leaves half a file, and
    the list of committed names is itself a written table.
    """
    tuned(rows.sparkSession)
    spark = rows.sparkSession
    folder = folder or scratch(spark, "warc")
    base = rows.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.encode(F.coalesce(F.col(payload), F.lit("")), "utf-8").alias("payload"))
    keyed = base.where(F.octet_length("payload") >= min_revisit).select(F.sha1("payload").alias("digest"), "key")
    groups = keyed.groupBy("digest").agg(F.max("key").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    revisits = written(keyed.join(groups.select("digest", "refers_to"), "digest").where("key < refers_to or key is null and refers_to is not null").select(F.col("key").alias("k"), "digest", "refers_to").distinct(), "revisits")
    joined = base.join(revisits.select("k", "digest", "refers_to"), base["key"].eqNullSafe(F.col("k")) & (F.sha1("payload") == F.col("digest")), "left").select("key", "url", "payload", "refers_to")
    schema = "path:string records:long"

    def write(batches):
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, run, made, out, now = TaskContext.get().partitionId(), uuid.uuid4().hex, [], None, ""
        n = 0

        def end():
            out.close()
            store.move(now, done := f"{root}/{part:06d}-{len(made):05d}-{run}.warc.gz")
            made.append((done, n))

        for batch in batches:
            cols = batch.to_pydict()
            for k, u, p, r in zip(cols["key"], cols["url"], cols["payload"], cols["refers_to"], strict=True):
                if out is None:
                    now, n = f"{root}/.{uuid.uuid4().hex}", 0
                    out = store.open_output_stream(now, compression=None)
                out.write(record(k, u, p, r, revisit=r is not None))
                n += 1
                if out.tell() >= ROLL_BYTES:
                    end()
                    out = None
        if out is not None:
            end()
        yield table(schema, made)

    listed = written(joined.mapInArrow(write, ddl(schema)), "archives")
    listed._palimpsest_root = folder
    forget(revisits)
    return listed


def read_archives(listed: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the archives that ``write_archives`` listed, checked; columns as in RECORD."""
    folder = listed._palimpsest_root

    def read(batches):
        store, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(path, compression=None) as stream:
                    rows, held = [], 0
                    for member in members(stream):
                        row = parsed(member)
                        rows.append(row if payloads else (*row[:-1], None))
                        held += len(member)
                        if held > 1 << 23 or len(rows) == 1000:
                            yield table(RECORD, rows)
                            rows, held = [], 0
                    yield table(RECORD, rows)

    n = max(1, listed.count())
    return listed.select("path").repartition(min(n, 100_000), "path").mapInArrow(read, ddl(RECORD))


def op10(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    read = read_archives(write_archives(pages, "page_id", "url", "html"), payloads=False)
    return read.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, cast(payload_bytes AS bigint) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM g
"""
