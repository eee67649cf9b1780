"""A data source of packets as capture agents send them: messages of a 4-byte length (little-endian) and a list of packets.

A folder holds a file for each agent's stream, which may grow. In batch a file is cut into ranges of whole messages; as a
stream each micro-batch takes the whole messages that are new, and the offset tells how far each file is read, so that a
query goes on from its checkpoint. A message whose packets can't be read is one row with `error`, and the next ones are
read. A length over MAX_MESSAGE says nothing about where the next message begins: it is an error row and the end of its
file. A message that isn't whole yet waits for the rest (in batch it is an error row).

    spark.dataSource.register(FramesSource)
    spark.read.format("packet_frames").load(folder)
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from flowlens import schema

#: Fixed value: bytes of a message at most.
MAX_MESSAGE = 10 << 20
#: Bytes of a partition, unless one message is longer.
RANGE_BYTES = 32 << 20
#: A packet's number is that of its file and its place in it.
_FILE_BITS = 40

SCHEMA = schema.PACKETS + ", source string, error string"
_KINDS = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int16(), pa.binary(), pa.binary(), pa.int32(), pa.int16(), pa.int64(), pa.string(), pa.string()]
_NAMES = [x.strip().split(" ")[0] for x in SCHEMA.split(", ")]


def message(packets) -> bytes:
    """The message of packets: (timestamp_ns, src_ip, dst_ip, src_port, dst_port, protocol, payload, src_mac, snaplen, tcp_flags, tcp_seq)."""
    listed = lambda data: struct.pack("<Q", len(data)) + bytes(data)
    body = struct.pack("<Q", len(packets))
    for at, src, dst, sport, dport, protocol, payload, mac, snaplen, flags, seq in packets:
        body += struct.pack("<Q", at) + listed(src) + listed(dst) + struct.pack("<HHB", sport, dport, protocol) + listed(payload) + bytes(mac) + struct.pack("<HBI", snaplen, flags, seq)
    return struct.pack("<I", len(body)) + body


def packets_in(body: bytes) -> list[tuple]:
    """(place in the body, and the fields of `message`) of each packet; ValueError if the body isn't a whole list."""
    at = 0

    def number(form: str) -> tuple:
        nonlocal at
        at += struct.calcsize(form)
        return struct.unpack_from(form, body, at - struct.calcsize(form))

    def listed() -> bytes:
        nonlocal at
        (size,) = number("<Q")
        if size > len(body) - at:
            raise ValueError("a list is longer than its message")
        at += size
        return body[at - size : at]

    try:
        out = []
        for _ in range(number("<Q")[0]):
            begin = at
            out.append((begin, *number("<Q"), listed(), listed(), *number("<HHB"), listed(), *number("<6s"), *number("<HBI")))
    except struct.error as e:
        raise ValueError("a message ends within a packet") from e
    if at != len(body):
        raise ValueError("bytes after the last packet")
    return out


def _located(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def _files(folder: str) -> list[tuple[str, int]]:
    """Names and sizes of the folder's files, in order; names of hidden ones are left out."""
    fs, path = _located(folder)
    found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    return sorted((x.base_name, x.size) for x in found if x.is_file and x.base_name[:1] not in "._")


def _whole(fs: pafs.FileSystem, path: str, at: int, size: int) -> tuple[list[int], bool]:
    """Where whole messages begin from `at` on, and the end of the last; whether a length forbids to go on."""
    places = [at]
    with fs.open_input_file(path) as file:
        while at + 4 <= size:
            file.seek(at)
            (length,) = struct.unpack("<I", file.read(4))
            if length > MAX_MESSAGE:
                return places, True
            if at + 4 + length > size:
                break
            at += 4 + length
            places.append(at)
    return places, False


class _Range(InputPartition):
    """Messages of a file from start to end; problem: what is told of the place `end`."""

    def __init__(self, number: int, name: str, start: int, end: int, problem: str | None = None):
        super().__init__(None)
        self.number, self.name, self.start, self.end, self.problem = number, name, start, end, problem


def _ranges(number: int, name: str, places: list[int], problem: str | None) -> list[_Range]:
    out, start = [], places[0]
    for before, after in zip(places, places[1:]):
        if after - start > RANGE_BYTES and before > start:
            out.append(_Range(number, name, start, before))
            start = before
    if places[-1] > start or problem:
        out.append(_Range(number, name, start, places[-1], problem))
    return out


def _read(folder: str, part: _Range) -> Iterator[pa.RecordBatch]:
    fs, path = _located(folder)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)

    lost = lambda at, error: ((part.number << _FILE_BITS) + at, *[None] * (len(_NAMES) - 3), part.name, error)
    at = part.start
    with fs.open_input_file(f"{path}/{part.name}") as file:
        while at < part.end:
            file.seek(at)
            (length,) = struct.unpack("<I", file.read(4))
            try:
                rows = [((part.number << _FILE_BITS) + at + 4 + begin, *fields, part.name, None) for begin, *fields in packets_in(file.read(length))]
            except ValueError as e:
                rows = [lost(at, f"message at {at}: {e}")]
            if rows:
                yield batch(rows)
            at += 4 + length
    if part.problem:
        yield batch([lost(part.end, f"message at {part.end}: {part.problem}")])


_TOO_LONG, _CUT = "longer than a message may be", "the file ends within it"


class FramesReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[_Range]:
        fs, path = _located(self.folder)
        out = []
        for number, (name, size) in enumerate(_files(self.folder)):
            places, ended = _whole(fs, f"{path}/{name}", 0, size)
            out += _ranges(number, name, places, _TOO_LONG if ended else _CUT if places[-1] < size else None)
        return out

    def read(self, partition: _Range | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:
            yield from _read(self.folder, partition)


class FramesStreamReader(DataSourceStreamReader):
    """Offsets: {"files": [[name, bytes read, whether it has ended], ...]}, new files last, so that a file keeps its number."""

    def __init__(self, folder: str):
        self.folder = folder
        self.known: dict[str, tuple[int, bool]] = {}

    def initialOffset(self) -> dict:
        return {"files": []}

    def latestOffset(self, *_) -> dict:
        fs, path = _located(self.folder)
        for name, size in _files(self.folder):
            at, ended = self.known.get(name, (0, False))
            if not ended and size > at:
                places, ended = _whole(fs, f"{path}/{name}", at, size)
                at = places[-1]
            self.known[name] = at, ended
        return {"files": [[name, at, ended] for name, (at, ended) in self.known.items()]}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        fs, path = _located(self.folder)
        before = {name: (at, ended) for name, at, ended in start["files"]}
        if not self.known:
            # after a restart files keep the order of the checkpoint
            self.known = {name: (at, ended) for name, at, ended in end["files"]}
        out = []
        for number, (name, at, ended) in enumerate(end["files"]):
            begin, had_ended = before.get(name, (0, False))
            if at > begin or ended != had_ended:
                places, _ = _whole(fs, f"{path}/{name}", begin, at)
                out += _ranges(number, name, places, _TOO_LONG if ended and not had_ended else None)
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        yield from _read(self.folder, partition)


class FramesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packet_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FramesReader:
        return FramesReader(self.options["path"])

    def streamReader(self, schema) -> FramesStreamReader:
        return FramesStreamReader(self.options["path"])


def packets(rows: DataFrame) -> DataFrame:
    """The packets (PACKETS) of the source's rows, without its errors."""
    return rows.where("error is null").drop("source", "error")
