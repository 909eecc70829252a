"""Streaming source for text logs that grow in place.

Spark's file source takes a file once; a training log is appended to. This source
keeps a byte offset per file and hands out the complete lines between two offsets.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

CHUNK = 64 << 20
_TAIL = 1 << 16


def complete_size(path: str) -> int:
    """Bytes up to and including the last line end."""
    with open(path, "rb") as handle:
        end = handle.seek(0, os.SEEK_END)
        while end > 0:
            start = max(0, end - _TAIL)
            handle.seek(start)
            cut = handle.read(end - start).rfind(b"\n")
            if cut >= 0:
                return start + cut + 1
            end = start
    return 0


def lines_between(path: str, start: int, end: int, first: bool) -> Iterator[tuple[str, int, str]]:
    """(path, byte position, line) of the lines that begin inside [start, end)."""
    with open(path, "rb") as handle:
        handle.seek(start)
        if not first:
            # The line that crosses into this chunk belongs to the one before.
            handle.seek(start - 1)
            handle.readline()
        while handle.tell() < end:
            pos = handle.tell()
            line = handle.readline()
            if not line:
                return
            yield path, pos, line.decode("utf-8", "replace").rstrip("\r\n")


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, end: int, first: bool):
        self.path, self.start, self.end, self.first = path, start, end, first


class GrowingLogReader(DataSourceStreamReader):
    def __init__(self, pattern: str):
        self.pattern = pattern

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {path: complete_size(path) for path in sorted(glob.glob(self.pattern, recursive=True))}

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        ranges = []
        for path, stop in end.items():
            begin = start.get(path, 0)
            for low in range(begin, stop, CHUNK):
                ranges.append(ByteRange(path, low, min(low + CHUNK, stop), low == begin))
        return ranges

    def read(self, partition: ByteRange) -> Iterator[tuple[str, int, str]]:
        return lines_between(partition.path, partition.start, partition.end, partition.first)


class GrowingLog(DataSource):
    """spark.readStream.format("growing_log").option("path", "<glob>").load()"""

    @classmethod
    def name(cls) -> str:
        return "growing_log"

    def schema(self) -> str:
        return "path string, pos bigint, line string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return GrowingLogReader(self.options["path"])
