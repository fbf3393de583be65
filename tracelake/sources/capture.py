"""Raw lines of a running session as log records: a header, then a record for each line that is not blank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.errors import EngineError
from tracelake.operators.ingest import numbered

# The kinds of a capture's records.
HEADER, RAW_LINE = 0, 1


def records(lines: DataFrame, sessions: DataFrame, now_ms: int, base: int) -> DataFrame:
    """Log records of captured lines, numbered from base: session by session, the header first.

    sessions: session_id, path, harness, native_session_id, one a path. lines: sources.lines.lines(), of
    finished lines; blank ones give no record. A session without lines still has its header. Batches of a
    stream pass through foreachBatch with `base` the log's next number and only new sessions' headers wanted:
    then give `captured` sessions through resumed()."""
    if sessions.groupBy("path").count().where("count > 1").limit(1).count():
        raise EngineError("invalid_parameter", "several sessions of one path")
    header = F.to_json(F.struct("harness", "native_session_id", F.lit(now_ms).alias("started_at_ms")))
    heads = sessions.select("session_id", F.lit(HEADER).cast("short").alias("kind"), F.lit(-1).cast("long").alias("_at"), header.cast("binary").alias("body"))
    every = heads.unionByName(_raw(lines, sessions))
    return _log(every, now_ms, base)


def resumed(lines: DataFrame, sessions: DataFrame, now_ms: int, base: int) -> DataFrame:
    """More lines of sessions whose header is in the log already."""
    return _log(_raw(lines, sessions), now_ms, base)


def _raw(lines: DataFrame, sessions: DataFrame) -> DataFrame:
    met = lines.where(F.trim(F.translate("raw", "\t\r\f\v", "    ")) != "").join(sessions.select("path", "session_id"), "path")
    return met.select("session_id", F.lit(RAW_LINE).cast("short").alias("kind"), F.col("byte_start").alias("_at"), F.col("raw").cast("binary").alias("body"))


def _log(rows: DataFrame, now_ms: int, base: int) -> DataFrame:
    dealt = numbered(rows, ["session_id", "_at"], base)
    return dealt.select("seq", "session_id", "kind", F.lit(now_ms).cast("long").alias("ts_ms"), "body")
