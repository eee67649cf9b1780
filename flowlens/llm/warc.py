"""Operator 7, WARC archives with a two-level capture index.

`write_warc` writes a record for each page, gzip member by member, into archives in the shared folder. Of captures
with equal payloads of at least SAME_BYTES bytes, the one with the largest page_id is stored; the others become
revisit records that name it. `write_index` sorts the captures by reversed-host URL key and page_id over range
partitions; each partition writes its lines as compressed blocks of BLOCK_LINES and, beside them, a sparse directory
with the first key and the byte range of each block. `lookup` finds captures: the partition by its first key (there
are at most INDEX_PARTS), the block by binary search in the directory, the record by a range read of the archive.

Defined results: a null html is an empty payload; a null url has an empty key and no target header; control
characters in a url are percent-encoded in headers and keys. Rows with equal page_id are captures of their own; if
they share the largest page_id of equal payloads, all of them are stored. A null page_id never is the largest.
Other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm._files import Ranges, Renamed, attempt
from flowlens.llm._shared import new_path, read_table, sized, small_batches, written

SAME_BYTES, ARCHIVE_BYTES, BLOCK_LINES, PART_LINES, INDEX_PARTS = 1000, 128 << 20, 1024, 100_000, 4096
#: Repeated payloads that are broadcast to the pages (about 60 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: The date of records, a parameter of the crawl.
DATE = "2024-01-01T00:00:00Z"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def url_key(url: Column) -> Column:
    """`com,example,blog)/path?query`: what sorts the pages of a domain next to each other."""
    host = F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)
    return F.regexp_replace(F.coalesce(F.when(url.contains("://"), key).otherwise(url), F.lit("")), r"[\x00-\x20\x7f]", "%20")


def captures(pages: DataFrame) -> DataFrame:
    """page_id, url, html, key, sha1 and keeper (the page whose record holds this payload; null: this one)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.sha1(F.col("html").cast("binary"))).withColumn("key", url_key(F.col("url")))
    long = rows.where(F.octet_length("html") >= SAME_BYTES)
    same = written(long.groupBy("sha1").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n"), "same")
    rows = rows.join(sized(same, same.count(), BROADCAST_ROWS), "sha1", "left")
    return rows.withColumn("keeper", F.when((F.octet_length("html") >= SAME_BYTES) & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")))


def record(page_id, url: str | None, sha1: str, html: bytes, keeper) -> bytes:
    """One gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html)
    body = http + html if keeper is None else http
    lines = ["WARC/1.1", f"WARC-Type: {'response' if keeper is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode())
    if keeper is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{keeper}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}", "", ""]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + body + b"\r\n\r\n") + pack.flush()


def parsed(member: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(headers, HTTP head, payload) of one gzip member."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    body = rest[: int(headers["Content-Length"])]
    if first != "WARC/1.1" or rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("damaged record")
    http, _, payload = body.partition(b"\r\n\r\n")
    return headers, http, payload


def write_warc(rows: DataFrame, folder: str) -> DataFrame:
    """rows: a frame of `captures`. Returns key, page_id, archive, at, length of each record."""
    small_batches(rows.sparkSession)
    names = ["key", "page_id", "archive", "at", "length"]

    def write(batches):
        from pyspark import TaskContext

        part, number, archive = TaskContext.get().partitionId(), 0, None
        lines: list[tuple] = []

        def close():
            path = archive.done()
            out = [list(x) for x in zip(*lines, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array([path] * len(lines), pa.string()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], names)

        for batch in batches:
            for page_id, url, sha1, html, keeper, key in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "sha1", "html", "keeper", "key")], strict=True):
                archive = archive or Renamed(folder, attempt(f"part-{part:06d}-{number:04d}") + ".warc.gz")
                member = record(page_id, url, sha1, html.encode(), keeper)
                lines.append((key, page_id, archive.write(member), len(member)))
                if archive.size >= ARCHIVE_BYTES:
                    yield close()
                    archive, number = None, number + 1
                    lines.clear()
        if archive is not None:
            yield close()

    return written(rows.mapInArrow(write, "key string, page_id long, archive string, at long, length long"), "records")


def _order(key: str, page_id) -> tuple:
    """How Spark sorts keys (by UTF-8 bytes) and ids (null first)."""
    return key.encode(), page_id is not None, page_id or 0


def write_index(records: DataFrame, folder: str) -> list[tuple]:
    """Writes blocks and directories; returns ((key, page_id) of the first line, name) of each partition, in order."""
    parts = min(INDEX_PARTS, max(1, -(-records.count() // PART_LINES)))
    dealt = records.repartitionByRange(parts, "key", "page_id").sortWithinPartitions("key", "page_id", "archive", "at")

    def write(batches):
        from pyspark import TaskContext

        name = attempt(f"index-{TaskContext.get().partitionId():06d}")
        blocks, held, sparse, first = None, [], [], None

        def flush():
            data = zlib.compress("\n".join(x[2] for x in held).encode(), 6)
            sparse.append(f"{held[0][0]} {held[0][1]} {blocks.write(data)} {len(data)}")
            held.clear()

        for batch in batches:
            for key, page_id, archive, at, length in zip(*[batch.column(c).to_pylist() for c in ("key", "page_id", "archive", "at", "length")], strict=True):
                first = first or (key, page_id)
                blocks = blocks or Renamed(folder, f"{name}.blocks")
                held.append((key, page_id, f"{key} {page_id} {at} {length} {archive}"))
                if len(held) >= BLOCK_LINES:
                    flush()
        if blocks is not None:
            if held:
                flush()
            directory = Renamed(folder, f"{name}.directory")
            directory.write("\n".join(sparse).encode())
            directory.done()
            yield pa.RecordBatch.from_arrays([pa.array([first[0]]), pa.array([first[1]], pa.int64()), pa.array([blocks.done()])], ["key", "page_id", "path"])

    found = written(dealt.mapInArrow(write, "key string, page_id long, path string"), "index").collect()  # INDEX_PARTS rows at most
    return sorted(((_order(r.key, r.page_id), r.path) for r in found))


def _id(text: str):
    return None if text == "None" else int(text)


def lookup(wanted: DataFrame, folder: str, index: list[tuple]) -> DataFrame:
    """wanted: key, page_id, each pair once. Every capture found: page_id, record_type, payload_bytes,
    payload_digest, refers_to; the digest of a stored payload is taken anew and held against its header."""
    small_batches(wanted.sparkSession)
    # in the index's order, so that a block is read once by each task
    dealt = wanted.repartitionByRange(max(len(index), wanted.sparkSession.sparkContext.defaultParallelism), "key", "page_id").sortWithinPartitions("key", "page_id")
    starts = [first for first, _ in index]

    class Part:
        """A partition of the index: its directory, and the last block read."""

        def __init__(self, files: Ranges, path: str):
            self.files, self.path, self.block = files, path, None
            size = files.fs.get_file_info(name := path.removesuffix(".blocks") + ".directory").size
            rows = [x.split(" ") for x in files.read(name, 0, size).decode().split("\n")]
            self.first = [_order(x[0], _id(x[1])) for x in rows]
            self.ranges = [(int(x[2]), int(x[3])) for x in rows]

        def find(self, key: tuple):
            at = max(0, bisect.bisect_left(self.first, key) - 1)
            while at < len(self.first) and (self.first[at] <= key or at == 0):
                if self.block is None or self.block[0] != at:
                    lines = [x.split(" ", 4) for x in zlib.decompress(self.files.read(self.path, *self.ranges[at])).decode().split("\n")]
                    self.block = at, [_order(x[0], _id(x[1])) for x in lines], lines
                _, keys, lines = self.block
                for i in range(bisect.bisect_left(keys, key), bisect.bisect_right(keys, key)):
                    yield lines[i]
                at += 1

    def read(batches):
        files, parts = Ranges(folder), {}
        for batch in batches:
            rows = []
            for key, page_id in zip(batch.column("key").to_pylist(), batch.column("page_id").to_pylist(), strict=True):
                want = _order(key, page_id)
                at = max(0, bisect.bisect_left(starts, want) - 1)
                while at < len(index) and (starts[at] <= want or at == 0):
                    if at not in parts:
                        if len(parts) > 1:
                            parts.clear()
                        parts[at] = Part(files, index[at][1])
                    for _, _, offset, length, archive in parts[at].find(want):
                        headers, _, payload = parsed(files.read(archive, int(offset), int(length)))
                        digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        if headers["WARC-Type"] == "response":
                            if hashlib.sha1(payload).hexdigest() != digest:
                                raise ValueError(f"{archive} at {offset}: the payload isn't what was stored")
                            rows.append((page_id, "response", len(payload), digest, None))
                        else:
                            rows.append((page_id, "revisit", None, digest, int(headers["WARC-Refers-To"][len("<urn:page:") : -1])))
                    at += 1
            out = [list(x) for x in zip(*rows, strict=True)] or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["page_id", "record_type", "payload_bytes", "payload_digest", "refers_to"])
        files.close()

    found = written(dealt.mapInArrow(read, "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long"), "found")
    # a revisit's length is that of the stored payload it names
    stored = found.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("digest"), F.col("payload_bytes").alias("bytes")).dropDuplicates(["refers_to", "digest"])
    revisits = found.where("record_type = 'revisit'").withColumnRenamed("payload_digest", "digest")
    lost = F.raise_error(F.concat(F.lit("no stored payload for the revisit of page "), F.col("page_id").cast("string"))).cast("long")
    again = revisits.join(stored, ["refers_to", "digest"], "left")
    again = again.select("page_id", "record_type", F.coalesce("bytes", lost).alias("payload_bytes"), F.col("digest").alias("payload_digest"), "refers_to")
    return found.where("record_type = 'response'").unionByName(again)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    pages, folder = read_table(spark, sf_dir, "pages").select("page_id", "url", "html"), new_path(spark, "warc")
    index = write_index(write_warc(captures(pages), folder), folder)
    wanted = pages.select(url_key(F.col("url")).alias("key"), F.col("page_id").cast("long").alias("page_id")).distinct()
    return lookup(wanted, folder, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), k AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM p
)
SELECT page_id, cast(payload_bytes AS bigint) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM k
"""
