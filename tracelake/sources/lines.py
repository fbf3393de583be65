"""Line files with byte offsets, plain or compressed, and framed log files.

Evidence points at bytes, which text readers drop, so files are read whole and split in tasks; a file or
line above its bound is an error. What stands behind the last line feed is an unfinished line and waits.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The largest line and file, and the largest frame.
MOST_LINE, MOST_FILE, MOST_FRAME, HEADER = 16 << 20, 512 << 20, 64 << 20, 64
LINES = "path string, length long, line long, byte_start long, byte_end long, raw string"


def _plain(path: str, data: bytes) -> bytes:
    if not path.endswith((".zst", ".zstd")):
        return data
    import pyarrow as pa

    with pa.CompressedInputStream(pa.BufferReader(data), "zstd") as stream:  # reads concatenated frames
        return stream.read()


def _split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"]):
            data, rows, start = _plain(path, content), [], 0
            for number, line in enumerate(data[: data.rfind(b"\n") + 1].splitlines(keepends=True) if b"\r" not in data else data[: data.rfind(b"\n") + 1].split(b"\n")[:-1]):
                end = start + len(line) + (0 if line.endswith(b"\n") else 1)
                if end - start > MOST_LINE:
                    raise ValueError(f"resource_limit: the line at byte {start} of {path} is over {MOST_LINE} bytes")
                if line.strip():
                    rows.append((path, len(data), number, start, end, line.rstrip(b"\n").decode()))
                start = end
            for a in range(0, len(rows), 5000):
                yield pd.DataFrame(rows[a : a + 5000], columns=["path", "length", "line", "byte_start", "byte_end", "raw"])


def files(spark: SparkSession, *paths: str, glob: str = "*") -> DataFrame:
    """path, length, modified, content. Without content in the plan, contents aren't read: discovery."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(list(paths))
    return rows.select("path", "length", F.col("modificationTime").alias("modified"), "content")


def opened(path: str):
    """A file of any file system, for reading in a task."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_stream(inner, compression=None)


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path, length in zip(frame["path"], frame["length"]):  # a file a batch
            with opened(path) as file:
                yield pd.DataFrame({"path": [path], "length": [length], "content": [file.read()]})


def contents(found: DataFrame) -> DataFrame:
    """path, length, content: read by the task that has the path, so that filters and joins on paths come
    first and no content is shuffled."""
    return found.select("path", "length").mapInPandas(_read, "path string, length long, content binary")


def lines(found: DataFrame) -> DataFrame:
    """The finished, non-blank lines of files: path, length, line, byte_start, byte_end, raw."""
    bounded = found.where(F.when(F.col("length") > MOST_FILE, F.raise_error(F.concat(F.lit("resource_limit: too large: "), "path")).cast("boolean")).otherwise(True))
    return bounded.select("path", "content").mapInPandas(_split, LINES)


# Framed logs: a header, then frames of length, crc32 and payload.

FRAMES = "path string, place long, seq long, session_id string, kind short, ts_ms long, body binary, data_end long, stopped string"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def unframed(data: bytes) -> tuple[list[tuple], int, str]:
    """Frames up to the first that is torn, empty, too long or damaged; where they end; what stopped
    them. A frame with a right checksum that doesn't decode is an error, not an end."""
    at, found = HEADER, []
    while True:
        if at == len(data):
            return found, at, "end"
        if at + 8 > len(data):
            return found, at, "torn"
        size, crc = struct.unpack_from("<II", data, at)
        if size == 0 or size > MOST_FRAME:
            return found, at, "length"
        payload = data[at + 8 : at + 8 + size]
        if len(payload) < size:
            return found, at, "torn"
        if zlib.crc32(payload) != crc:
            return found, at, "checksum"
        try:
            seq, p = _varint(payload, 0)
            session, p = payload[p : p + 32].hex(), p + 32
            kind, p = payload[p], p + 1
            ts_ms, p = _varint(payload, p)
            n, p = _varint(payload, p)
            if p + n != size:
                raise IndexError
        except IndexError:
            raise ValueError(f"storage_error: the frame at byte {at} does not decode") from None
        found.append((seq, session, kind, ts_ms, payload[p:]))
        at += 8 + size


def _frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        for path, content in zip(frame["path"], frame["content"]):
            found, end, why = unframed(content)
            rows = [(path, i, *f, None, None) for i, f in enumerate(found)] + [(path, len(found), None, None, None, None, None, end, why)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FRAMES.split(", ")]).astype({"seq": "Int64", "kind": "Int16", "ts_ms": "Int64", "data_end": "Int64"})


def frames(found: DataFrame) -> DataFrame:
    """The log records of framed files, and for each file one last row with data_end and stopped."""
    return found.select("path", "content").mapInPandas(_frames, FRAMES)


def verified(records: DataFrame) -> DataFrame:
    """Of frames(): data_end, next_seq, session_count, frame_count and what stopped each file."""
    return records.groupBy("path").agg(F.max("data_end").alias("data_end"), F.coalesce(F.max("seq") + 1, F.lit(0)).alias("next_seq"), F.count_distinct("session_id").alias("session_count"), F.count("seq").alias("frame_count"), F.max("stopped").alias("stopped"))
