"""Sessions kept in SQLite files: a task reads one file from a backup that is consistent in itself.

The file may be written to meanwhile: the backup is one transaction's view. It is made in the task's memory,
so a database above the bound is an error; `sha256` and `size` are those of the backup's bytes. Tasks must
reach the files by path (a shared mount).
"""

from __future__ import annotations

import hashlib
import json
import sqlite3
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tracelake.errors import EngineError

# The largest database, the tables with their columns, and rows a batch.
MOST_DATABASE, BATCH = 512 << 20, 5_000
TABLES = {
    "session": ("sessions", "sessionId, cwd, title, status, createdAt, updatedAt, version", "sessionId"),
    "state": ("session_states", "sessionId, selectedProviderId, selectedModelId", "sessionId"),
    "message": ("messages", "sessionId, messageId, role, parts, attachments, toolMetadata, metadata, orderKey, createdAt, updatedAt", "sessionId, orderKey"),
}
ROWS = "path string, sha256 string, size long, native_session_id string, record string, ordinal long, body string"


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in ROWS.split(", ")]
    for path in (p for frame in frames for p in frame["path"]):
        place = unquote(urlparse(path).path)
        live, copy = sqlite3.connect(f"file:{quote(place)}?mode=ro", uri=True), sqlite3.connect(":memory:")
        try:
            pages, page = (live.execute(f"PRAGMA {x}").fetchone()[0] for x in ("page_count", "page_size"))
            if pages * page > MOST_DATABASE:
                raise EngineError("resource_limit", f"{path} is over {MOST_DATABASE} bytes")
            live.backup(copy)
            data = copy.serialize()
            known = (path, hashlib.sha256(data).hexdigest(), len(data))
            copy.row_factory = sqlite3.Row
            there = {r[0] for r in copy.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
            for record, (table, columns, order) in TABLES.items():
                if table not in there:
                    continue
                cursor, ordinal, last = copy.execute(f"SELECT {columns} FROM {table} ORDER BY {order}"), 0, None
                while batch := cursor.fetchmany(BATCH):
                    rows = []
                    for r in batch:
                        ordinal, last = (ordinal + 1 if r["sessionId"] == last else 0), r["sessionId"]
                        rows.append((*known, str(last), record, ordinal, json.dumps(dict(r), ensure_ascii=False, default=str)))
                    yield pd.DataFrame(rows, columns=names)
        finally:
            live.close()
            copy.close()


def databases(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The rows of SQLite session files, a file a task: path, sha256, size, native_session_id, record (session,
    state or message), ordinal (from 0 within session and record; messages by orderKey) and body, the row as
    JSON. A table that a file lacks gives no rows; no paths give an empty table."""
    given = spark.createDataFrame([(p,) for p in sorted(set(paths))], "path string")
    return given.repartition(max(len(set(paths)), 1), "path").mapInPandas(_read, ROWS)
