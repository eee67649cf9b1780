"""Byte files in the shared folder, by way of Arrow's file systems (local, HDFS, S3, GCS by their URIs)."""

from __future__ import annotations

import time
import uuid

import pyarrow.fs as pafs


def located(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def attempt(name: str) -> str:
    """name with a mark of its own for each try of a task: of two tries, neither can overwrite what the other wrote."""
    return f"{name}-{uuid.uuid4().hex[:12]}"


class Renamed:
    """A file under a temporary name that gets its own name when it is complete; a lost task leaves only the former."""

    def __init__(self, folder: str, name: str):
        self.fs, path = located(folder)
        self.path, self.tried = f"{path}/{name}", f"{path}/_tried/{name}.{uuid.uuid4().hex}"
        self.fs.create_dir(f"{path}/_tried", recursive=True)
        self.out = self.fs.open_output_stream(self.tried)
        self.size = 0

    def write(self, data: bytes) -> int:
        """The offset at which data begins."""
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return at

    def done(self) -> str:
        self.out.close()
        self.fs.move(self.tried, self.path)
        return self.path


class Ranges:
    """Reads byte ranges of files of one folder; each read is tried anew on its own, with a new handle."""

    def __init__(self, folder: str, tries: int = 3):
        self.fs, self.tries, self.handles = located(folder)[0], tries, {}

    def read(self, path: str, offset: int, length: int) -> bytes:
        for left in reversed(range(self.tries)):
            try:
                if path not in self.handles:
                    if len(self.handles) >= 32:
                        self.close()
                    self.handles[path] = self.fs.open_input_file(path)
                data = self.handles[path].read_at(length, offset)
                if len(data) != length:
                    raise OSError(f"{path}: {len(data)} of {length} bytes at {offset}")
                return data
            except OSError:
                self.close()
                if not left:
                    raise
                time.sleep(0.1 * (self.tries - left))
        raise AssertionError

    def close(self) -> None:
        for handle in self.handles.values():
            handle.close()
        self.handles.clear()
