"""Growing files of JSON lines as a stream: `spark.readStream.format("jsonl_tail")`, option path (a folder that all see).

An offset says of each file where its last whole line ends, and by what head (length and checksum of its first bytes) the file is known.
Both come from the files alone, and what a batch covers from the stream's checkpoint, so a reader that starts again goes on where the
checkpoint stands. A file whose head is another than the one in the offset was begun anew and is read from its start, as is one that is
shorter. Half a line waits for the rest. A batch is cut into ranges of about `maxbytes`; a range holds the lines that begin in it, however
long they are."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

HEAD, WINDOW = 1024, 1 << 16


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def lines_end(path: str, size: int) -> int:
    """The place behind the last line end among the first `size` bytes; 0 where there is none. Read backwards, a window at a time."""
    with open(path, "rb") as f:
        to = size
        while to > 0:
            at = max(0, to - WINDOW)
            f.seek(at)
            found = f.read(to - at).rfind(b"\n")
            if found >= 0:
                return at + found + 1
            to = at
    return 0


def head_of(path: str, n: int) -> int:
    with open(path, "rb") as f:
        return zlib.crc32(f.read(n))


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.most, self.from_now = options["path"], int(options.get("maxbytes", 1 << 26)), options.get("startingoffsets", "earliest") == "latest"

    def _ends(self) -> dict:
        out = {}
        for e in sorted(os.scandir(self.folder), key=lambda e: e.path):
            if e.name.endswith(".jsonl"):
                end = lines_end(e.path, e.stat().st_size)
                out[e.path] = {"end": end, "head": min(HEAD, end), "sum": head_of(e.path, min(HEAD, end))}
        return out

    def initialOffset(self) -> dict:
        return {"files": self._ends() if self.from_now else {}}

    def latestOffset(self) -> dict:
        return {"files": self._ends()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for path, to in end["files"].items():
            before = start["files"].get(path)
            if not os.path.exists(path):
                continue  # gone since; what it held can't be read any more
            same = before and before["end"] <= to["end"] and head_of(path, before["head"]) == before["sum"]
            at = before["end"] if same else 0
            out += [_Range(path, a, min(a + self.most, to["end"])) for a in range(at, to["end"], self.most)]
        return out

    def read(self, partition: _Range) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            at = max(0, partition.start - 1)
            f.seek(at)
            if partition.start:
                at += len(f.readline())  # the rest of a line that began before; just its end where one begins here
            while at < partition.end:
                line = f.readline()
                if not line.endswith(b"\n"):
                    return
                text = line.decode("utf-8", "replace").rstrip("\r\n")
                try:
                    good = isinstance(json.loads(text), dict)
                except ValueError:
                    good = False
                if good:
                    yield partition.path, at, text
                at += len(line)


class JsonlTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> str:
        return "path string, offset long, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JsonlTail)
