"""Memories: proposals over evidence, and their approval and revocation, as rows to append."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.errors import EngineError
from tracelake.plans.views import EVIDENCE

# The largest content, and the moves allowed.
MOST_CONTENT = 16_384
MOVES = {"approve": "candidate", "revoke": "approved"}


def propose(log: DataFrame, memory_id: str, content: str, scope: str, evidence: list[int], now_ms: int) -> DataFrame:
    """A candidate of revision 1. Every evidence number must be an evidence record of the log."""
    content = content.strip()
    if not 1 <= len(content.encode()) <= MOST_CONTENT or not scope or not evidence:
        raise EngineError("invalid_parameter", "a memory has content, scope and evidence")
    found = log.where((F.col("kind") == EVIDENCE) & F.col("seq").isin(sorted(set(evidence)))).select("seq").distinct().count()
    if found != len(set(evidence)):
        raise EngineError("invalid_parameter", "evidence that is no evidence record")
    row = (memory_id, "candidate", content, scope, evidence, 1, now_ms)
    return log.sparkSession.createDataFrame([row], "memoryId string, action string, content string, scope string, evidenceSeqs array<long>, revision long, updatedAtMs long")


def move(memories: DataFrame, memory_id: str, action: str, revision: int, now_ms: int) -> DataFrame:
    """approve or revoke, if the memory still has this revision and the move is allowed."""
    row = memories.where(F.col("memoryId") == memory_id).first()
    if row is None:
        raise EngineError("not_found", memory_id)
    if row.revision != revision:
        raise EngineError("snapshot_changed", f"revision is {row.revision}", retryable=True)
    if row.status != MOVES.get(action):
        raise EngineError("invalid_parameter", f"{action} of a memory that is {row.status}")
    fields = memories.where(F.col("memoryId") == memory_id).select("memoryId", F.lit(action).alias("action"), "content", "scope", "evidenceSeqs", (F.col("revision") + 1).alias("revision"), F.lit(now_ms).cast("long").alias("updatedAtMs"))
    return fields
