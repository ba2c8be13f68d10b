"""WARC archives as a chunked record table.

Writing: payloads with equal bytes are found by SHA-1 and length; the record of the smallest page id
is a response, the others are revisits that refer to it. Each task writes one archive, a gzip member
for each record, under a temporary name that is renamed when whole, so a task that runs again
replaces its file and never leaves half of one.

Reading: archives are streamed. A record's payload leaves the reader as rows (record, chunk number,
bytes) of at most CHUNK bytes that carry the digest and the length so far, so no record has to fit
in memory; the last chunk's digest is the record's.

Archives of other writers are read, too: plain or compressed, WARC/1.0 or 1.1, records of every type
(HTTP heads are parsed where the content is HTTP and the block holds one), folded header lines, and
records without a digest or a page id, which are null then.

Defined results: a null payload counts as empty; rows with the smallest id of their payload are all
responses, should that id be repeated; a null page id or url is left out of the record's headers and
read back as null; a null id is never referred to by revisits unless no other id has the payload;
very long payloads travel in chunks; an empty table gives no archive and no rows; other columns of
pages, of whatever name, are not archived.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import checkpoint, few, remove, shared_dir

CHUNK = 256 * 1024
HEAD = 1 << 20  # a longer HTTP head counts as payload
MIN_BYTES = 0
#: Records that are worth a task that reads archives.
TASK_RECORDS = 2_000
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "record_id string, page_id long, url string, record_type string, refers_to long, declared string, chunk_no long, data binary, last boolean, bytes_so_far long, sha1_so_far string"


def open_shared(uri: str, mode: str):
    """A file in shared storage: a path, file:// or any store that pyarrow knows."""
    if "://" in uri and not uri.startswith("file://"):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        return store.open_input_stream(path) if "r" in mode else store.open_output_stream(path)
    path = uri.removeprefix("file://").removeprefix("file:")
    if "w" in mode:
        os.makedirs(os.path.dirname(path), exist_ok=True)
    return open(path, mode)


def rename_shared(a: str, b: str) -> None:
    if "://" in a and not a.startswith("file://"):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(a)
        store.move(path, fs.FileSystem.from_uri(b)[1])
    else:
        strip = lambda u: u.removeprefix("file://").removeprefix("file:")
        os.replace(strip(a), strip(b))


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_urn(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}')}>"


def clean(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def typed(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """pages (page_id, url, html) with payload digest and record type."""
    p = pages.select(F.col("page_id").cast("long"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("n", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1("payload"))
    narrow = checkpoint(p.select("page_id", "sha1", "n"))
    first = narrow.where(F.col("n") >= min_bytes).groupBy("sha1", "n").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    # one row for each id and payload that is not the first of its kind; payloads then move by page id, which is even
    later = narrow.join(first, ["sha1", "n"]).where(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("lid"), F.col("sha1").alias("lsha1"), F.col("first").alias("refers_to"), F.lit(True).alias("later")).dropDuplicates(["lid", "lsha1"])
    out = p.join(later, F.col("page_id").eqNullSafe(F.col("lid")) & (F.col("sha1") == F.col("lsha1")), "left")
    return out.select("page_id", "url", "sha1", "payload", F.when(F.col("later"), "revisit").otherwise("response").alias("record_type"), "refers_to")


def write(pages: DataFrame, out_dir: str, min_bytes: int = MIN_BYTES, chunk: int = CHUNK) -> DataFrame:
    """Write archives below out_dir; returns (path, records), checkpointed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, name, records, out = TaskContext.get(), None, 0, None
        try:
            for b in batches:
                for page_id, url, sha1, payload, kind, refers in zip(*(c for c in b.columns), strict=True):
                    if out is None:
                        name = f"{out_dir}/part-{part.partitionId():06d}.warc.gz"
                        temp = f"{name}.{part.taskAttemptId()}.tmp"
                        out = open_shared(temp, "wb")
                    records += 1
                    put(out, page_id.as_py(), url.as_py(), base32(bytes.fromhex(sha1.as_py())), memoryview(payload.as_buffer()), kind.as_py(), refers.as_py(), chunk)
        except BaseException:
            if out is not None:
                out.close()
            raise
        if out is not None:
            out.close()
            rename_shared(temp, name)
            yield pa.record_batch({"path": pa.array([name]), "records": pa.array([records], pa.int64())})

    done = typed(pages, min_bytes).mapInArrow(run, "path string, records long")
    return checkpoint(done.repartition(max(1, pages.sparkSession.sparkContext.defaultParallelism)))  # a file for each core, not for each archive


def put(out, page_id: int | None, url: str | None, digest: str, payload: memoryview, kind: str, refers: int | None, chunk: int) -> None:
    """One record as one gzip member, compressed piece by piece."""
    http = HTTP % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_urn(page_id, digest)}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {clean(url)}"] if url and clean(url) else []
    head += [f"X-Page-Id: {page_id}"] if page_id is not None else []
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_urn(refers, digest)}", *([f"X-Refers-To-Page-Id: {refers}"] if refers is not None else [])]
    body = len(payload) if kind == "response" else 0
    head += [f"Content-Length: {len(http) + body}"]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    out.write(z.compress(("\r\n".join(head) + "\r\n\r\n").encode() + http))
    for at in range(0, body, chunk):
        out.write(z.compress(payload[at:at + chunk]))
    out.write(z.compress(b"\r\n\r\n") + z.flush())


class Stream:
    """Bytes of a plain file or one of gzip members, a bounded piece at a time."""

    def __init__(self, f, size: int) -> None:
        self.f, self.size, self.have, self.raw = f, size, b"", f.read(size)
        self.z = zlib.decompressobj(31) if self.raw[:2] == b"\x1f\x8b" else None

    def more(self) -> bool:
        while True:
            if not self.raw:
                self.raw = self.f.read(self.size)
                if not self.raw:
                    return False
            if self.z is None:
                got, self.raw = self.raw, b""
            else:
                got = self.z.decompress(self.raw, self.size)
                self.raw = self.z.unconsumed_tail
                if self.z.eof:
                    self.raw, self.z = self.z.unused_data, zlib.decompressobj(31)
            if got:
                self.have += got
                return True

    def until(self, mark: bytes, most: int | None = None) -> bytes | None:
        """What stands before mark; None, and nothing read, where it doesn't end within the next `most` bytes or before the end of the file."""
        seen = 0
        while (k := self.have.find(mark, max(0, seen - len(mark)), most)) < 0:
            seen = len(self.have)
            if most is not None and seen >= most:
                return None
            if not self.more():
                if most is None and self.have.strip():
                    raise ValueError("archive ends inside a record's header")
                return None
        out, self.have = self.have[:k], self.have[k + len(mark):]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in pieces of at most `size`."""
        while n:
            if not self.have and not self.more():
                raise ValueError("archive ends inside a record's block")
            piece = self.have[:min(n, self.size)]
            self.have = self.have[len(piece):]
            n -= len(piece)
            yield piece


def records(f, chunk: int = CHUNK) -> Iterator[dict]:
    """Rows of RECORDS from an open archive."""
    s = Stream(f, chunk)
    while (head := s.until(b"\r\n\r\n")) is not None:
        lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace").lstrip("\r\n")).split("\r\n")  # a folded line goes on
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record where one should start")
        h = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines[1:] if ":" in line)}
        left = int(h["content-length"])
        if h.get("content-type", "").lower().startswith("application/http") and (http := s.until(b"\r\n\r\n", min(left, HEAD))) is not None:
            left -= len(http) + 4
        number = lambda k: int(h[k]) if k in h else None
        declared = h.get("warc-payload-digest")
        row = {"record_id": h.get("warc-record-id"), "page_id": number("x-page-id"), "url": h.get("warc-target-uri"), "record_type": h.get("warc-type"), "refers_to": number("x-refers-to-page-id"), "declared": declared and declared.split(":", 1)[-1]}
        sha, n, done = hashlib.sha1(), 0, 0
        for piece in s.take(left) if left else [b""]:
            sha.update(piece)
            done += len(piece)
            yield row | {"chunk_no": n, "data": piece, "last": done == left, "bytes_so_far": done, "sha1_so_far": base32(sha.copy().digest())}
            n += 1
        if b"".join(s.take(4)) != b"\r\n\r\n":
            raise ValueError("a record's length doesn't match its end")


def read(spark: SparkSession, archives: DataFrame, with_data: bool = True, chunk: int = CHUNK, tasks: int | None = None) -> DataFrame:
    """The chunk rows (RECORDS) of archives (path), read by so many tasks (by default as many as shuffles have); without data, the bytes are digested and dropped."""
    schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("declared", pa.string()), ("chunk_no", pa.int64()), ("data", pa.binary()), ("last", pa.bool_()), ("bytes_so_far", pa.int64()), ("sha1_so_far", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, held = [], 0
                with contextlib.closing(open_shared(path, "rb")) as f:
                    for r in records(f, chunk):
                        held += len(r["data"]) if with_data else 0
                        rows.append(r if with_data else r | {"data": None})
                        if held > 4 * chunk or len(rows) >= 2048:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    n = max(1, spark.sparkContext.defaultParallelism)
    return archives.select("path").repartition(max(n, tasks or int(spark.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(run, RECORDS)


def report(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """The columns of op7: pages are archived below the shared folder and read back."""
    spark = pages.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    archives = write(pages, at, min_bytes)
    n_archives, n = archives.agg(F.count(F.lit(1)), F.coalesce(F.sum("records"), F.lit(0))).first()
    ends = checkpoint(read(spark, archives, with_data=False, tasks=min(n_archives, -(-n // TASK_RECORDS))).where("last").drop("data"))
    remove(spark, at)  # read and checked; the digests are checkpointed
    whole = ends.where("record_type = 'response'").groupBy(F.col("page_id").alias("rid"), F.col("declared").alias("rdigest")).agg(F.max("bytes_so_far").alias("rbytes"), F.max("sha1_so_far").alias("rsha1"))
    back = ends.where("record_type = 'revisit'").join(whole, F.col("refers_to").eqNullSafe(F.col("rid")) & (F.col("declared") == F.col("rdigest")), "left")
    cols = lambda n, d: ["page_id", F.col(n).alias("payload_bytes"), F.col(d).alias("payload_digest"), "record_type", "refers_to", (F.col(d) == F.col("declared")).alias("verified")]
    return ends.where("record_type = 'response'").select(*cols("bytes_so_far", "sha1_so_far")).unionByName(few(back, n).select(*cols("rbytes", "rsha1")))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h), d AS (SELECT page_id, first, p.h, sha1(p.h) || '0' AS x FROM p JOIN f ON p.h = f.h)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(x, 1 + 5 * i // 4, 2) AS INTEGER) >> CAST(3 - 5 * i % 4 AS INTEGER)) & 31 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to, true AS verified
FROM d
"""
