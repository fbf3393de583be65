"""The fixed list queries; filters that are not given leave no predicate behind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.errors import EngineError

# The providers, and the largest pages.
PROVIDERS = ("claude", "codex", "pi", "kimi", "deepseek")
MOST, MOST_TIMELINE = 1000, 10_000


def checked(provider: str | None = None, session: str | None = None, start: int | None = None, end: int | None = None, limit: int = MOST, most: int = MOST) -> None:
    if provider is not None and provider not in PROVIDERS:
        raise EngineError("invalid_parameter", f"unknown provider {provider}")
    if session is not None and (len(session) != 64 or set(session) - set("0123456789abcdef")):
        raise EngineError("invalid_parameter", "a session id is 64 hex digits")
    if start is not None and end is not None and start > end:
        raise EngineError("invalid_parameter", "from is after to")
    if not 0 <= limit <= most:
        raise EngineError("resource_limit", f"limit is at most {most}")


def session_list(sessions: DataFrame, start: int | None = None, end: int | None = None, limit: int = MOST, offset: int = 0, provider: str | None = None, project: str | None = None, session=None) -> DataFrame:
    """Active sessions that overlap [start, end], the last updated first. Session ids that are text must
    be 64 hex digits."""
    checked(provider, session if isinstance(session, str) else None, start, end, limit)
    rows = sessions.where("active")
    for name, value in (("provider", provider), ("project", project), ("session", session)):
        rows = rows if value is None else rows.where(F.col(name) == value)
    rows = rows if start is None else rows.where(F.col("last_updated_ms") >= start)
    rows = rows if end is None else rows.where(F.col("first_seen_ms") <= end)
    return rows.orderBy(F.desc("last_updated_ms"), "session").offset(offset).limit(limit)


def timeline(events: DataFrame, session, start: int | None = None, end: int | None = None, history: bool = False, limit: int = 1000) -> DataFrame:
    """One session's events by seq, both ends of the time range included; inactive ones only with history."""
    checked(start=start, end=end, limit=limit, most=MOST_TIMELINE)
    rows = events.where(F.col("session") == session)
    if not history and "active" in events.columns:
        rows = rows.where("active")
    rows = rows if start is None else rows.where(F.col("ts_ms") >= start)
    rows = rows if end is None else rows.where(F.col("ts_ms") <= end)
    return rows.orderBy("seq").limit(limit)


def evidence(rows: DataFrame, seq: int) -> DataFrame:
    """One record's raw bytes, base64."""
    return rows.where(F.col("seq") == seq).withColumn("raw", F.base64("raw"))


def memory_list(memories: DataFrame, status: str, limit: int = MOST) -> DataFrame:
    checked(limit=limit)
    return memories.where(F.col("status") == status).orderBy(F.desc("updatedAtMs"), "memoryId").limit(limit)


def session_detail(sessions: DataFrame, session) -> DataFrame:
    """One active session; any other is not found."""
    row = sessions.where("active").where(F.col("session") == session)
    if row.isEmpty():
        raise EngineError("not_found", f"session {session}")
    return row


def memory_get(memories: DataFrame, memory_id) -> DataFrame:
    row = memories.where(F.col("memoryId") == memory_id)
    if row.isEmpty():
        raise EngineError("not_found", f"memory {memory_id}")
    return row


def source(checkpoints: DataFrame, provider: str, path) -> DataFrame:
    """The checkpoint of one source, or no row."""
    return checkpoints.where((F.col("provider") == provider) & (F.col("source_path") == path))


def source_exists(checkpoints: DataFrame, provider: str, path) -> bool:
    return not source(checkpoints, provider, path).isEmpty()


def source_paths(checkpoints: DataFrame, provider: str) -> DataFrame:
    return checkpoints.where(F.col("provider") == provider).select("source_path").distinct().orderBy("source_path")


def hits_with_context(hits: DataFrame, events: DataFrame, sessions: DataFrame, project: str | None = None, limit: int = MOST) -> DataFrame:
    """Search hits (seq, score) with their active event and, where there is one, its session; best score
    first, then seq. project: only hits of sessions of that project."""
    checked(limit=limit)
    named = sessions.select("session", *[F.col(c).alias(f"session_{c}") for c in ("title", "project", "provider") if c in sessions.columns])
    met = hits.select("seq", "score").join(events.where("active"), "seq").join(named, "session", "left")
    met = met if project is None else met.where(F.col("session_project") == project)
    return met.orderBy("score", "seq").limit(limit)


def diagnostics(filters: dict, as_of: int, limit: int, active_only: bool = True) -> dict:
    """What a list answer says about itself."""
    return {"bounded": True, "activeOnly": active_only, "limit": limit, "filters": {k: v for k, v in filters.items() if v is not None}, "asOfSeq": as_of}
