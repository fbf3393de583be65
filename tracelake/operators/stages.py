"""The pipeline's stages over one source, with a fixed snapshot and a result whose order is known."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.errors import EngineError
from tracelake.functions.predicates import duration_ms, time_ms

MOST_ROWS = 1000
API_VERSION = "1"
# The parameter types, and what stands for them in Python.
TYPES = {"string": str, "int": int, "double": float, "boolean": bool, "timestamp": int, "duration": int, "list": list}


def bound(parameters: dict, declared: dict[str, str]) -> dict[str, Column | list]:
    """Parameters of a query as literals. A missing one is invalid_parameter, one of another type type_error;
    timestamps and durations may be given as text."""
    out = {}
    for name, kind in declared.items():
        if name not in parameters:
            raise EngineError("invalid_parameter", f"${name} is missing")
        value = parameters[name]
        if isinstance(value, str) and kind == "timestamp":
            value = time_ms(value)
        elif isinstance(value, str) and kind == "duration":
            value = duration_ms(value)
        if not isinstance(value, TYPES[kind]) or (isinstance(value, bool) and kind != "boolean"):
            raise EngineError("type_error", f"${name} is no {kind}")
        out[name] = value if kind == "list" else F.lit(value)
    return out


def fresh(watermarks: dict[str, int], required: list[str], target: int | None = None) -> int:
    """Up to where a query may read: the least of the watermarks it needs. A target beyond that is not
    there yet, which a caller may try again."""
    upto = min(watermarks[name] for name in required)
    if target is not None and upto < target:
        raise EngineError("snapshot_changed", f"indexed through {upto}, not {target}", retryable=True)
    return upto


# The logical sources of a query, and the columns that name their rows.
SOURCES = {"sessions": ("session",), "events": ("seq",), "messages": ("session", "id"), "tools": ("session", "id"), "chunks": ("chunk",), "runs": ("session", "id"), "turns": ("session", "id"), "approvals": ("session", "id"), "memories": ("memoryId",), "edges": ("edge_id",)}


def source(tables: dict[str, DataFrame], name: str, seq: str | None = None, as_of: int | None = None) -> Rows:
    """`from`: a query over one of the logical sources that are at hand."""
    if name not in SOURCES:
        raise EngineError("parse_error", f"no source {name}")
    if name not in tables:
        raise EngineError("unsupported_capability", f"source {name} is not at hand")
    return Rows.of(tables[name], *SOURCES[name], seq=seq, as_of=as_of)


@dataclass(frozen=True)
class Result:
    """Rows in order, and what a caller needs to repeat or judge the query."""

    rows: DataFrame
    as_of: int | None
    query_hash: str
    warnings: list[str]
    stages: list[tuple[str, DataFrame]] = field(repr=False)
    watermarks: dict[str, int] = field(default_factory=dict)
    api_version: str = API_VERSION

    def explain(self) -> list[dict]:
        """Rows into and out of each stage. One query counts all of them, each from the source on with only the
        columns it needs. Nothing is counted in passing: a limit above would stop short of the last row, and a
        stage that is found empty is planned away with its counter."""
        counts = [df.groupBy().agg(F.count(F.lit(1)).alias("rows")).select(F.lit(i).alias("i"), "rows") for i, (_, df) in enumerate(self.stages)]
        out = [r["rows"] for r in sorted(reduce(DataFrame.union, counts).collect())]
        return [{"stage": name, "in": before, "rows": n} for (name, _), before, n in zip(self.stages, [None, *out], out)]

    def envelope(self) -> dict:
        """All but the rows."""
        return {"apiVersion": self.api_version, "queryHash": self.query_hash, "asOfSeq": self.as_of, "watermarks": self.watermarks, "warnings": self.warnings}


@dataclass(frozen=True)
class Rows:
    """A query so far. identity: the columns that name a row, the last keys of every order."""

    df: DataFrame
    identity: tuple[str, ...]
    as_of: int | None = None
    keys: tuple[tuple[str, str], ...] = ()
    limited: bool = False
    projected: tuple[tuple[str, str], ...] | None = None
    done: tuple[tuple[str, DataFrame], ...] = ()
    grouped: tuple[str, ...] | None = None

    def counted(self) -> Rows:
        """From here on each stage is explained; what lies before counts as one."""
        return replace(self, done=self.done[-1:])

    @classmethod
    def of(cls, df: DataFrame, *identity: str, seq: str | None = None, as_of: int | None = None) -> Rows:
        """Over a source at a fixed sequence: rows appended later than as_of are never seen."""
        if as_of is not None:
            df = df.where(F.col(seq) < as_of)
        return cls(df, identity, as_of, done=(("from", df),))

    def _then(self, stage: str, df: DataFrame, **changes) -> Rows:
        return replace(self, df=df, done=(*self.done, (stage, df)), **changes)

    def _order(self) -> list[Column]:
        keyed = [F.col(k).asc_nulls_first() if way == "asc" else F.col(k).desc_nulls_last() for k, way in self.keys]
        return [*keyed, *(F.col(k).asc_nulls_first() for k in self.identity)]

    def where(self, predicate: Column) -> Rows:
        return self._then("where", self.df.where(predicate))

    def search_text(self, query: str, text: str, evidence: Column | None = None) -> Rows:
        """Case-folded literal text; rows without complete evidence don't count."""
        if not isinstance(query, str):
            raise EngineError("type_error", "search text takes a string")
        found = F.coalesce(F.lower(F.col(text)).contains(query.lower()), F.lit(False))
        return self._then("search", self.df.where(found if evidence is None else evidence & found))

    def group_by(self, *keys: str) -> Rows:
        """summarize() must follow; then only keys and aggregates are seen, in order of the keys."""
        if missing := [k for k in keys if k not in self.df.columns]:
            raise EngineError("unknown_field", missing[0])
        return replace(self, grouped=keys)

    def summarize(self, **aggregates: Column) -> Rows:
        keys = self.grouped or ()
        df = self.df.groupBy(*keys).agg(*[a.alias(name) for name, a in aggregates.items()])
        return self._then("summarize", df, identity=keys, keys=(), projected=None, grouped=None)

    def sort_by(self, *keys: tuple[str, str]) -> Rows:
        for name, way in keys:
            if name not in self.df.columns:
                raise EngineError("unknown_field", name)
            if way not in ("asc", "desc"):
                raise EngineError("parse_error", way)
        return self._then("sort", self.df, keys=keys)

    def project(self, **columns: str) -> Rows:
        """output name = field. Only limit and sort_by may follow; these see the fields before projection."""
        if missing := [c for c in columns.values() if c not in self.df.columns]:
            raise EngineError("unknown_field", missing[0])
        return self._then("project", self.df, projected=tuple(columns.items()))

    def limit(self, n: int, offset: int = 0) -> Rows:
        if not isinstance(n, int) or n < 0:
            raise EngineError("type_error", "limit takes a whole number")
        if n > MOST_ROWS:
            raise EngineError("unsupported_capability", f"limit is at most {MOST_ROWS}")
        df = self.df.orderBy(*self._order())
        return self._then("limit", (df.offset(offset) if offset else df).limit(n), limited=True)

    def rows(self) -> DataFrame:
        """In order; without a limit of its own at most MOST_ROWS."""
        df = self.df if self.limited else self.df.orderBy(*self._order()).limit(MOST_ROWS)
        df = df.orderBy(*self._order())
        return df if self.projected is None else df.select(*[F.col(c).alias(name) for name, c in self.projected])

    def result(self, watermarks: dict[str, int] | None = None) -> Result:
        warnings = []
        if not self.limited and len(self.df.limit(MOST_ROWS + 1).select(*self.identity).take(MOST_ROWS + 1)) > MOST_ROWS:
            warnings.append("implicit_limit")
        plan = json.dumps([[name for name, _ in self.done], self.keys, self.projected, self.as_of], sort_keys=True)
        return Result(self.rows(), self.as_of, hashlib.sha256(plan.encode()).hexdigest(), warnings, list(self.done), watermarks or {})
