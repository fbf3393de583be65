"""Row access rules on the leaves of a query, and the audit rows that queries leave."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.errors import EngineError

AUDIT = "actor string, query_hash string, policy_hash string, as_of long, generation long, outcome string, at_ms long"
OUTCOMES = {"returned", "denied", "failed"}


@dataclass(frozen=True)
class Policy:
    """What an actor may see: a SQL predicate a table, and the tables closed to everyone."""

    rules: tuple[tuple[str, str], ...] = ()
    closed: tuple[str, ...] = ()

    def hash(self) -> str:
        """For cache keys and audit rows; the order of the rules doesn't count."""
        return hashlib.sha256(json.dumps([sorted(self.rules), sorted(self.closed)]).encode()).hexdigest()

    def leaf(self, name: str, df: DataFrame) -> DataFrame:
        """The rows of a table that may be seen. Counts, scores and joins above it see no others. A table
        without a rule is open; a row on which a rule is neither true nor false is not seen."""
        if name in self.closed:
            raise EngineError("permission_denied", name)
        for table, rule in self.rules:
            if table == name:
                df = df.where(F.coalesce(F.expr(rule), F.lit(False)))
        return df


def audited(spark: SparkSession, actor: str, query_hash: str, policy: Policy, as_of: int | None, generation: int, outcome: str, at_ms: int) -> DataFrame:
    """One audit row to append. It names hashes, never texts or parameters of a query."""
    if outcome not in OUTCOMES:
        raise EngineError("invalid_parameter", outcome)
    return spark.createDataFrame([(actor, query_hash, policy.hash(), as_of, generation, outcome, at_ms)], AUDIT)
