"""Files that grow, as a stream: finished lines only, each with its byte range.

The driver lists files and their sizes, nothing else; an offset is a size a file. Tasks read the bytes, a
range each. A line belongs to the range in which its line feed lies: a reader looks back for the line's
start, so a line is read once, however ranges and batches cut it, and an unfinished line waits for its line
feed. A file that is shorter than before is read anew from 0.

Files are listed and read with pyarrow.fs: a folder may be local, HDFS, S3 or GCS.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, byte_start bigint, byte_end bigint, raw string"
RANGE, BACK = 16 << 20, 1 << 16


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


def finished(file, start: int, end: int) -> Iterator[tuple[int, int, str]]:
    """byte_start, byte_end and text of the lines whose line feed lies in [start, end)."""
    data, at = file.read_at(end - start, start), start
    last = data.rfind(b"\n")
    if last < 0:
        return
    data = data[: last + 1]
    while at:  # back to the line feed before
        step = min(BACK, at)
        before = file.read_at(step, at - step)
        cut = before.rfind(b"\n")
        data, at = before[cut + 1 :] + data, at - step + cut + 1 if cut >= 0 else at - step
        if cut >= 0:
            break
    for line in data.split(b"\n")[:-1]:
        after = at + len(line) + 1
        if line.strip():
            yield at, after, line.removesuffix(b"\r").decode()
        at = after


class FollowReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.suffix = options["path"], options.get("suffix", ".jsonl")
        self.range = int(options.get("maxBytesPerTask", RANGE))

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        system, inner = self._system()
        found = system.get_file_info(fs.FileSelector(inner, recursive=True))
        return {f.path: f.size for f in found if f.is_file and f.path.endswith(self.suffix)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, upto in sorted(end.items()):
            at = start.get(path, 0)
            at = 0 if upto < at else at
            out += [Range(path, a, min(a + self.range, upto)) for a in range(at, upto, self.range)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if partition.end > partition.start:
            system, _ = self._system()
            with system.open_input_file(partition.path) as file:
                for at, after, raw in finished(file, partition.start, partition.end):
                    yield partition.path, at, after, raw

    def commit(self, end: dict) -> None:
        pass


class Follow(DataSource):
    """spark.readStream.format("follow_lines").load(folder), after spark.dataSource.register(Follow). Options:
    suffix of the files' names, maxBytesPerTask."""

    @classmethod
    def name(cls) -> str:
        return "follow_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FollowReader:
        return FollowReader(self.options)
