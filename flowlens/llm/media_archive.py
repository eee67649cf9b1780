"""Operator 10, media columns: a Spark data source over folders of archives of media members.

`write_archives` stores each text as a PNG image (64 RGB pixels, 192 samples of 8 bits, a row) in tar archives, with
a file of member offsets beside each, and then a list of the archives of the tasks that counted: what a lost task or a
second try left is not read. `MediaArchive` is the data source `media_archive`: it plans partitions of
RANGE_BYTES of the archives' bytes; a member belongs to the range in which its header begins, found by binary search
in the offsets. Members are read one by one by offset; a failed read or a damaged member is tried again by itself
with a new handle, and if it stays so, becomes a row with an error and no media, while its neighbours come whole.
Payloads leave the source in Arrow batches of BATCH_BYTES.

A text's payload is its UTF-8 with spaces up to a positive multiple of 192 bytes. A null text is an empty one. The
stored image depends on the text alone, so equal texts have equal values. Repeated rows are stored twice; a null
doc_id is kept. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from flowlens.llm._files import Ranges, Renamed, attempt, located
from flowlens.llm._shared import new_path, read_table, small_batches, written

ROW, ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES, TRIES = 192, 128 << 20, 16 << 20, 4 << 20, 3
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def to_png(text: bytes) -> bytes:
    """The payload of text as samples of an image; a text chunk holds the count of bytes before padding."""
    rows = max(1, -(-len(text) // ROW))
    lines = np.zeros((rows, ROW + 1), np.uint8)  # each line begins with its filter, 0
    lines[:, 1:] = np.frombuffer(text.ljust(rows * ROW), np.uint8).reshape(rows, ROW)
    head = struct.pack(">IIBBBBB", ROW // 3, rows, 8, 2, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"bytes\0%d" % len(text)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def _chunks(image: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, body) of every chunk, each checked by its sum."""
    if image[:8] != _SIGNATURE:
        raise ValueError("not a PNG image")
    at = 8
    while at < len(image):
        size, kind = struct.unpack_from(">I4s", image, at)
        body = image[at + 8 : at + 8 + size]
        if len(body) != size or zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", image, at + 8 + size)[0]:
            raise ValueError(f"damaged chunk at {at}")
        yield kind, body
        at += 12 + size


def from_png(image: bytes) -> tuple[bytes, int]:
    """(payload, bytes before padding)."""
    rows, n, data = 0, 0, b""
    for kind, body in _chunks(image):
        if kind == b"IHDR":
            width, rows, *rest = struct.unpack(">IIBBBBB", body)
            if (width, rest) != (ROW // 3, [8, 2, 0, 0, 0]):
                raise ValueError("another kind of image")
        elif kind == b"tEXt":
            n = int(body.partition(b"\0")[2])
        elif kind == b"IDAT":
            data += body
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(rows, ROW + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:].tobytes(), n


def features_of(payload: bytes) -> str:
    """Rows, mean, deviation and a 64-bit average hash of the samples."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    cells = np.array([part.reshape(-1, 8, ROW // 8).mean(axis=(0, 2)) if len(part) else np.full(8, 32.0) for part in np.array_split(samples, 8)])
    bits = "".join("01"[int(x)] for x in (cells > cells.mean()).ravel())
    return f"rows={len(samples)};mean={samples.mean():.3f};std={samples.std():.3f};ahash={int(bits, 2):016x}"


def _tar_header(name: bytes, size: int) -> bytes:
    head = bytearray(512)
    for at, value in ((0, name), (100, b"0000644\0"), (108, b"0000000\0"), (116, b"0000000\0"), (124, b"%011o\0" % size), (136, b"00000000000\0"), (148, b"        "), (156, b"0"), (257, b"ustar\0"), (263, b"00")):
        head[at : at + len(value)] = value
    head[148:156] = b"%06o\0 " % sum(head)
    return bytes(head)


def _tar_member(head: bytes) -> tuple[str, int]:
    """(name, size) of a header, whose sum is checked."""
    if head[257:262] != b"ustar" or int(head[148:154], 8) != sum(head) - sum(head[148:156]) + 8 * 32:
        raise ValueError("damaged header")
    return head[:100].rstrip(b"\0").decode(), int(head[124:135], 8)


def write_archives(docs: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Stores the texts under folder; returns the written archives (path, members, bytes)."""
    small_batches(docs.sparkSession)

    def store(batches):
        from pyspark import TaskContext

        part, number, archive, offsets, name = TaskContext.get().partitionId(), 0, None, [], ""

        def close():
            archive.write(bytes(1024))
            # the offsets first: an archive that can be seen has them
            index = Renamed(folder, f"{name}.offsets")
            index.write(np.array(offsets, "<i8").tobytes())
            index.done()
            return pa.RecordBatch.from_arrays([pa.array([archive.done()]), pa.array([len(offsets)], pa.int64()), pa.array([archive.size], pa.int64())], ["path", "members", "bytes"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if archive is None:
                    name = attempt(f"part-{part:06d}-{number:04d}")
                    archive, offsets = Renamed(folder, f"{name}.tar"), []
                image = to_png((text.as_py() or "").encode())
                offsets.append(archive.write(_tar_header(f"{doc_id}.png".encode(), len(image)) + image + bytes(-len(image) % 512)))
                if archive.size >= archive_bytes:
                    yield close()
                    archive, number = None, number + 1
        if archive is not None:
            yield close()

    archives = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(store, "path string, members long, bytes long"), "archives")
    listed = Renamed(folder, attempt("_archives"))
    for row in archives.select("path").toLocalIterator():  # a name for each archive_bytes
        listed.write(row.path.encode() + b"\n")
    listed.done()
    return archives


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__(None)
        self.path, self.start, self.end = path, start, end


class MediaArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.bytes = options["path"], int(options.get("rangeBytes", RANGE_BYTES))
        self.tries = int(options.get("tries", TRIES))

    def partitions(self) -> list[_Range]:
        fs, path = located(self.folder)
        found = fs.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True))
        archives = sorted((x.path, x.size) for x in found if x.path.endswith(".tar") and "/_" not in x.path[len(path) :])
        lists = [x.path for x in found if x.path[len(path) :].startswith("/_archives-")]
        if lists:  # a folder without lists is read as it is
            known = {line for x in lists for line in fs.open_input_file(x).read().decode().split("\n")}
            archives = [x for x in archives if x[0] in known]
        return [_Range(p, at, min(at + self.bytes, size)) for p, size in archives for at in range(0, size, self.bytes)]

    def read(self, partition: _Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's call when no partition is planned
            return
        files = Ranges(self.folder, self.tries)
        index = partition.path.removesuffix(".tar") + ".offsets"
        size = files.fs.get_file_info(index).size
        offsets = np.frombuffer(files.read(index, 0, size), "<i8")
        rows, held = [], 0
        for at in offsets[np.searchsorted(offsets, partition.start) : np.searchsorted(offsets, partition.end)].tolist():
            rows.append(self.member(files, partition.path, at))
            held += len(rows[-1][3] or b"")
            if held >= BATCH_BYTES:
                yield self.batch(rows)
                rows, held = [], 0
        if rows:
            yield self.batch(rows)
        files.close()

    def member(self, files: Ranges, path: str, at: int) -> tuple:
        """A row; damage found on one reading may be gone on the next, so the whole member is tried again."""
        name, problem = None, ""
        for _ in range(self.tries):
            try:
                name, size = _tar_member(files.read(path, at, 512))
                media = files.read(path, at + 512, size)
                for _ in _chunks(media):  # sums only; the samples are decoded once, by who wants them
                    pass
                return path, at, name, media, None
            except (OSError, ValueError, zlib.error) as e:
                problem = f"{path} at {at}: {e}"
                files.close()
        return path, at, name, None, problem

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["archive", "offset", "name", "media", "error"])


class MediaArchive(DataSource):
    """Options: path (a folder), rangeBytes, tries."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "archive string, offset long, name string, media binary, error string"

    def reader(self, schema) -> MediaArchiveReader:
        return MediaArchiveReader(dict(self.options))


def read_archives(spark, folder: str, **options) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(path=folder, **options).load()


def described(media: DataFrame) -> DataFrame:
    """doc_id and the digests and features of each member; a member with an error fails the query."""

    @F.arrow_udf("struct<n_bytes:bigint,payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,media_bytes:bigint,media_sha256:string,feature:string>")
    def describe(images: pa.Array) -> pa.Array:
        rows = []
        for x in images:
            image = x.as_py()
            payload, n = from_png(image)
            rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest(), features_of(payload)))
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    sure = F.when(F.col("error").isNull(), F.col("media")).otherwise(F.raise_error(F.col("error")).cast("binary"))
    doc_id = F.expr("try_cast(substring_index(name, '.', 1) as bigint)")
    return media.select(doc_id.alias("doc_id"), describe(sure).alias("d")).select("doc_id", "d.*")


def op10_media_archive(spark, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "media")
    write_archives(read_table(spark, sf_dir, "documents"), folder)
    return described(read_archives(spark, folder))
