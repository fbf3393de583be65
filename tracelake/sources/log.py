"""The log table and its scans. Predicates on seq and session reach the file scan; write the log sorted
by (session_id, seq) so that row groups can be passed over."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.errors import EngineError

SCHEMA = "seq long, session_id string, kind short, ts_ms long, body binary"
# Page sizes, the largest snapshot, the bytes of a file header and of a frame's prefix.
PAGE, MOST_PAGE, MOST_RECENT, MOST_SNAPSHOT, HEADER, PREFIX = 1_000, 10_000, 1_000, 100_000, 64, 8


def scan_all(log: DataFrame, from_seq: int = 0, limit: int | None = None) -> DataFrame:
    rows = log.where(F.col("seq") >= from_seq).orderBy("seq")
    return rows if limit is None else rows.limit(limit)


def scan(log: DataFrame, session_id, from_seq: int = 0, limit: int | None = None, session: str = "session_id") -> DataFrame:
    return scan_all(log.where(F.col(session) == session_id), from_seq, limit)


def get(log: DataFrame, session_id, seq: int, session: str = "session_id") -> DataFrame:
    """One row, or none."""
    return log.where((F.col(session) == session_id) & (F.col("seq") == seq))


def raw_session(log: DataFrame, session_id: str, from_seq: int = 0, most: int = MOST_SNAPSHOT) -> DataFrame:
    """All records of one session by seq. An id that is not 64 lower-case hex digits is an error, and so are
    more than `most` records."""
    if not re.fullmatch("[0-9a-f]{64}", session_id):
        raise EngineError("invalid_parameter", "a session id has 64 lower-case hex digits")
    rows = scan(log, session_id, from_seq)
    if log.where((F.col("session_id") == session_id) & (F.col("seq") >= from_seq)).limit(most + 1).count() > most:
        raise EngineError("resource_limit", f"the session has over {most} records")
    return rows


def session_ids(log: DataFrame, session: str = "session_id") -> DataFrame:
    return log.select(session).distinct().orderBy(session)


def stats(log: DataFrame, session: str = "session_id") -> DataFrame:
    """next_seq, session_count, records, and the bytes of the framed file where bodies are at hand."""
    more = [(F.lit(HEADER) + F.sum(F.length("body") + PREFIX)).alias("body_bytes")] if "body" in log.columns else []
    return log.agg(F.coalesce(F.max("seq") + 1, F.lit(0)).alias("next_seq"), F.count_distinct(session).alias("session_count"), F.count("*").alias("records"), *more)


def recent(log: DataFrame, n: int) -> DataFrame:
    """The last n sequence numbers; the highest is a scalar subquery over one column."""
    if not 1 <= n <= MOST_RECENT:
        raise EngineError("invalid_parameter", f"recent takes 1 to {MOST_RECENT}")
    return log.where(F.col("seq") >= log.agg(F.max("seq") + 1 - n).scalar())


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    has_more: bool
    next_from_seq: int | None


def page(log: DataFrame, from_seq: int = 0, limit: int = PAGE) -> Page:
    """One page; whether more follow is seen from one row beyond it."""
    if not 1 <= limit <= MOST_PAGE:
        raise EngineError("resource_limit", f"a page has 1 to {MOST_PAGE} rows")
    ahead = [r["seq"] for r in scan_all(log, from_seq, limit + 1).select("seq").collect()]
    more = len(ahead) > limit
    upto = ahead[limit] if more else None
    rows = scan_all(log, from_seq) if upto is None else scan_all(log.where(F.col("seq") < upto), from_seq)
    return Page(rows, more, upto)


def snapshot(log: DataFrame, as_of: int, most: int = MOST_SNAPSHOT) -> DataFrame:
    """All records below a sequence number; more than `most` is an error, not a truncation."""
    rows = log.where(F.col("seq") < as_of)
    if rows.limit(most + 1).count() > most:
        raise EngineError("resource_limit", f"the snapshot has over {most} records")
    return rows


def canonical(log: DataFrame) -> DataFrame:
    """Records that hold a canonical event, wrapped in {event, evidence} or bare; others are passed over.
    Adds event and evidence (JSON), event_id, event_type, event_session, timestamp, has_evidence."""
    text = F.col("body").cast("string")
    at = lambda path: F.get_json_object("event", path)
    read = log.withColumn("_t", F.when(F.try_parse_json(text).isNotNull(), text)).where("_t is not null")
    split = read.withColumn("event", F.coalesce(F.get_json_object("_t", "$.event"), F.col("_t"))).withColumn("evidence", F.get_json_object("_t", "$.evidence")).drop("_t")
    named = split.select("*", at("$.eventId").alias("event_id"), at("$.type").alias("event_type"), at("$.sessionId").alias("event_session"), at("$.timestamp").alias("timestamp"))
    kept = named.where((at("$.schemaVersion") == "1.0") & F.col("event_id").isNotNull() & F.col("event_type").isNotNull() & F.col("timestamp").isNotNull() & at("$.payload").isNotNull() & (F.col("event_session") == F.col("session_id")))
    e = lambda path: F.get_json_object("evidence", path)
    start, end = e("$.byteStart").try_cast("bigint"), e("$.byteEnd").try_cast("bigint")
    whole = (e("$.sessionId") == F.col("event_session")) & (e("$.eventId") == F.col("event_id")) & e("$.sourcePath").isNotNull() & e("$.parserVersion").isNotNull() & e("$.sourceDigest").rlike("^[0-9a-f]{64}$") & (start >= 0) & (start <= end)
    return kept.withColumn("has_evidence", F.coalesce(whole, F.lit(False)))
