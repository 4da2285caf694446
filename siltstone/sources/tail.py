"""A stream of the lines that are appended to growing files.

Register with ``spark.dataSource.register(LineTail)`` and read
``spark.readStream.format("line_tail").option("path", folder)``.  The query's checkpoint
holds a place for each file: how far its complete lines were read.  A last line without
its end waits for the next batch.  A file counts as rewritten, and is read from its
start, if its inode or its first bytes are others, if it is shorter than what was read, or
if it has the same size and another time.  The folder must be mounted by all executors.
Options: suffix (default .jsonl), chunk (most bytes of one task, default 64 MB).
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes at a file's start by which a rewritten file is told.
HEAD = 256
BLOCK = 1 << 20


class LineRange(InputPartition):
    def __init__(self, path: str, begin: int, end: int, first: bool):
        self.path, self.begin, self.end, self.first = path, begin, end, first


def _lines_end(handle, size: int) -> int:
    """The place after the last line end before `size`; 0 without one."""
    while size > 0:
        start = max(0, size - BLOCK)
        handle.seek(start)
        at = handle.read(size - start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        size = start
    return 0


def place_of(path: str, head: int | None = None) -> dict | None:
    """What the checkpoint holds of a file; None where it can't be read now."""
    try:
        with open(path, "rb") as handle:
            stat = os.fstat(handle.fileno())
            end = _lines_end(handle, stat.st_size)
            handle.seek(0)
            n = min(HEAD, end)
            return {"inode": stat.st_ino, "size": stat.st_size, "time": stat.st_mtime_ns, "end": end, "head": n, "crc": zlib.crc32(handle.read(n))}
    except OSError:
        return None


def _crc(path: str, n: int) -> int | None:
    try:
        with open(path, "rb") as handle:
            return zlib.crc32(handle.read(n))
    except OSError:
        return None


def rewritten(path: str, old: dict, new: dict) -> bool:
    if old["inode"] != new["inode"] or new["size"] < old["end"]:
        return True
    if new["size"] == old["size"] and new["time"] != old["time"]:
        return True
    return old["head"] > 0 and _crc(path, old["head"]) != old["crc"]


def read_lines(part: LineRange) -> Iterator[tuple[str, int, str]]:
    """(file, place, line) of the lines that begin in a range; a range inside a file begins after a line end."""
    try:
        handle = open(part.path, "rb")  # noqa: SIM115
    except OSError:
        return
    with handle:
        at = part.begin
        if not part.first:
            handle.seek(at - 1)
            at = at - 1 + len(handle.readline())
        handle.seek(at)
        while at < part.end:
            line = handle.readline()
            if not line.endswith(b"\n"):
                return
            yield part.path, at, line.rstrip(b"\r\n").decode("utf-8", "replace")
            at += len(line)


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root = options["path"].removeprefix("file://")
        self.suffix = options.get("suffix", ".jsonl")
        self.chunk = int(options.get("chunk", 64 << 20))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": {}}

    def latestOffset(self) -> dict:  # noqa: N802
        found = {}
        for folder, _, names in os.walk(self.root):
            for name in names:
                if name.endswith(self.suffix):
                    path = os.path.join(folder, name)
                    if (place := place_of(path)) is not None:
                        found[path] = place
        return {"files": dict(sorted(found.items()))}

    def partitions(self, start: dict, end: dict) -> list[LineRange]:
        out = []
        for path, new in end["files"].items():
            old = start["files"].get(path)
            begin = 0 if old is None or rewritten(path, old, new) else old["end"]
            for at in range(begin, new["end"], self.chunk):
                out.append(LineRange(path, at, min(at + self.chunk, new["end"]), at == begin))
        return out

    def read(self, partition: LineRange) -> Iterator[tuple]:
        return read_lines(partition)

    def commit(self, end: dict) -> None:
        """Nothing is kept beside the checkpoint."""


class LineTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "line_tail"

    def schema(self) -> str:
        return "file string, place long, line string"

    def streamReader(self, schema) -> TailReader:  # noqa: N802
        return TailReader(dict(self.options))
