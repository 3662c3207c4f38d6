"""WARC archives: one gzip member per record, written and read by tasks.

``write_warc`` writes a file per partition (through a temporary name, so a retried task replaces its own file).
``read_warc`` is splittable: a task gets a byte range of a file, looks for gzip magic from its start, accepts a
candidate only if the member inflates to a complete WARC header, and owns every record that starts inside its
range, reading on past the end to finish the last one. Only the record at hand is in memory.

Defined results: a null payload is the empty payload; a null url is a record without ``WARC-Target-URI``; a null
page id is written as an empty id and read back as null, sorts after all others and so never is the response of a
group that has an id; rows that repeat page id and payload of a response are responses too; an empty table gives
no files and no rows. Columns besides the three named ones are not read, whatever they are called.

Limit of the method: a gzip member that is itself the payload of an uncompressed deflate block could pass as a
record if a range starts inside that block; UTF-8 payloads cannot hold gzip magic.
"""

from __future__ import annotations

import re
import zlib

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflow.llm.common import checked_broadcast, col, put_file, shared_folder, task_fs, written

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 4 << 20
#: Payloads below this many bytes are always stored.
MIN_REVISIT_BYTES = 100
READ_SCHEMA = ("file string, offset long, record_type string, page_id long, target_uri string, refers_to long, "
               "payload_bytes long, payload_digest string, payload binary")


def classify(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
             min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, body, digest, refers_to): which rows repeat the payload of a smaller page id."""
    rows = pages.select(col(id_col).cast("long").alias("page_id"), col(url_col).cast("string").alias("url"),
                        F.coalesce(col(payload_col).cast("string"), F.lit("")).cast("binary").alias("body"))
    rows = rows.withColumn("digest", F.sha2("body", 256))
    # Only digests that occur twice are kept; map-side counts make a payload in a third of the rows one row a task.
    first = (rows.where(F.length("body") >= min_bytes).groupBy("digest")
             .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1 and first_id is not null")
             .select("digest", "first_id"))
    first = checked_broadcast(written(first, "warc-first"))
    later = F.col("first_id").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first_id")))
    return (rows.join(first, "digest", "left")
            .select("page_id", "url", "body", "digest", F.when(later, F.col("first_id")).alias("refers_to")))


def record_bytes(page_id, url, body: bytes, digest: str, refers_to, date: str) -> bytes:
    """One gzip member with one record; a revisit carries the digest and length, not the payload."""
    def urn(x):
        return f"<urn:page:{'' if x is None else int(x)}>"

    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {urn(page_id)}",
            f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {urn(refers_to)}",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = http + (body if refers_to is None else b"")
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(body)}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def write_warc(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", **cols) -> DataFrame:
    """Write ``pages`` to ``folder``; returns (file, records, bytes), already computed."""
    import pyarrow as pa

    def write(batches):
        n = [0]

        def chunks():
            for b in batches:
                for row in zip(*(c.to_pylist() for c in b.columns)):
                    n[0] += 1
                    yield record_bytes(*row, date)

        rows = chunks()
        first = next(rows, None)
        if first is None:
            return
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        size = put_file(folder, name, (c for part in ([first], rows) for c in part))
        yield pa.RecordBatch.from_pydict({"file": [name], "records": [n[0]], "bytes": [size]})

    return written(classify(pages, **cols).mapInArrow(write, "file string, records long, bytes long"), "warc-files")


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def read_member(f, at: int, known: bytes, step: int = 1 << 16):
    """(record bytes, compressed length) of the member at ``at``, or None if it is not a WARC record.

    ``known`` are the bytes already read from there. A member whose header is a WARC header but that is cut off
    or fails its checksum raises: silent loss is worse."""
    z, out, fed, good = zlib.decompressobj(31), [], 0, False
    pos, piece = at, known
    while True:
        if not piece:
            f.seek(pos)
            piece = f.read(step)
            if not piece:
                if good:
                    raise ValueError(f"WARC record at {at} is cut off")
                return None
        pos += len(piece)
        fed += len(piece)
        try:
            out.append(z.decompress(piece))
        except zlib.error as e:
            if good:
                raise ValueError(f"WARC record at {at} is damaged: {e}") from e
            return None
        if not good:
            head = b"".join(out)
            if len(head) >= 6 and not head.startswith(b"WARC/"):
                return None
            good = head.startswith(b"WARC/") and b"\r\n\r\n" in head
            if not good and (z.eof or len(head) > (1 << 20)):
                return None
        if z.eof:
            return b"".join(out), fed - len(z.unused_data)
        piece = b""


def scan_range(f, size: int, start: int, end: int):
    """(offset, record bytes) of the records that start in [start, end)."""
    end = min(end, size)
    f.seek(start)
    buf = f.read(min(end + len(MAGIC) - 1, size) - start)
    pos = start
    while pos < end:
        at = buf.find(MAGIC, pos - start)
        if at < 0 or start + at >= end:
            return
        pos = start + at
        got = read_member(f, pos, buf[at:at + (1 << 16)])
        if got is None:
            pos += 1
            continue
        yield pos, got[0]
        pos += got[1]


def to_row(file: str, offset: int, record: bytes) -> tuple:
    import hashlib
    head, _, rest = record.partition(b"\r\n\r\n")
    h = parse_head(head)
    block = rest[:int(h.get("content-length", len(rest)))]

    def page(v):
        m = re.fullmatch(r"<urn:page:(-?\d+)>", v or "")
        return int(m.group(1)) if m else None

    kind = h.get("warc-type", "")
    digest = (h.get("warc-payload-digest") or "").partition(":")[2]
    payload, length = None, int(h.get("x-payload-length", 0))
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        length, seen = len(payload), hashlib.sha256(payload).hexdigest()
        if digest and seen != digest:
            raise ValueError(f"payload of the record at {file}:{offset} does not match its digest")
        digest = seen
    return (file, offset, kind, page(h.get("warc-record-id")), h.get("warc-target-uri"), page(h.get("warc-refers-to")),
            length, digest, payload)


def read_warc(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES, payload: bool = True) -> DataFrame:
    """Records of all ``*.warc.gz`` files under ``folder``, one byte range a task step (see READ_SCHEMA).

    ``payload=False`` leaves the payload column null (its length and digest are still taken from the bytes)."""
    import pyarrow as pa
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()),
                        ("page_id", pa.int64()), ("target_uri", pa.string()), ("refers_to", pa.int64()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def read(batches):
        for b in batches:
            for file, size, start in zip(*(c.to_pylist() for c in b.columns)):
                fs, path = task_fs(file)
                rows, held = [], 0
                with fs.open_input_file(path) as f:
                    for offset, record in scan_range(f, size, start, start + split_bytes):
                        row = to_row(file, offset, record)
                        rows.append(row if payload else row[:-1] + (None,))
                        held += len(record) if payload else 200
                        if held > (4 << 20):
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    # Listing only: the content column is pruned, so Spark opens no archive here.
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
             .where("length > 0").select("path", "length"))
    ranges = files.select("path", "length", F.explode(F.expr(f"sequence(0L, length - 1, {split_bytes}L)")).alias("start"))
    n = files.agg(F.sum(F.ceil(F.col("length") / split_bytes))).first()[0] or 1
    return ranges.repartition(int(n), "path", "start").mapInArrow(read, READ_SCHEMA)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page, read the archives back, and give the digest columns of what was read."""
    folder = shared_folder(spark, "warc")
    made = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    if made.isEmpty():
        return made.select(*(F.lit(None).cast(t).alias(c) for c, t in (
            ("page_id", "long"), ("payload_bytes", "long"), ("payload_digest", "string"), ("record_type", "string"),
            ("refers_to", "long")))).where("false")
    return read_warc(spark, folder, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(encode(coalesce(html, ''))) AS payload_digest
           FROM pages),
     f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM f
"""
