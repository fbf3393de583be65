"""Predicates of the pipeline: two-valued logic, explicit type errors, half-open ranges.

Equality and membership never give null: a missing value differs from every value. Ordered comparisons
need a value on both sides and raise type_error on a row that lacks one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.errors import EngineError

# Milliseconds of the duration suffixes.
UNITS = {"ms": 1, "s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}
_NOT_RE2 = re.compile(r"\(\?(?:[=!]|<[=!]|>)|\\[1-9]|\\k<|[*+?}]\+")
_WORD = "[0-9A-Za-z_]"
_BOUNDS = {"b": f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))", "B": f"(?:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))"}


def eq(a: Column, b) -> Column:
    return F.coalesce(a == b, F.lit(False))


def ne(a: Column, b) -> Column:
    return ~eq(a, b)


def is_in(a: Column, values: Iterable) -> Column:
    if isinstance(values, str):
        raise EngineError("type_error", "the right side of `in` is a list")
    return F.coalesce(a.isin(list(values)), F.lit(False))


def not_in(a: Column, values: Iterable) -> Column:
    return ~is_in(a, values)


def ordered(a: Column, op: str, b) -> Column:
    """a < b and so on; a row on which a side is null raises type_error."""
    b = b if isinstance(b, Column) else F.lit(b)
    result = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    return F.when(a.isNull() | b.isNull(), F.raise_error(F.lit("type_error: an ordered comparison met a missing value")).cast("boolean")).otherwise(result)


def both(a: Column, b: Column) -> Column:
    """`and`, left to right: b is not evaluated where a is false, so a guard keeps b from raising."""
    return F.when(a, b).otherwise(F.lit(False))


def either(a: Column, b: Column) -> Column:
    return F.when(a, F.lit(True)).otherwise(b)


def between(a: Column, low, high) -> Column:
    """Start inclusive, end exclusive; false for a missing value."""
    return F.coalesce((a >= low) & (a < high), F.lit(False))


def matches(a: Column, pattern: str) -> Column:
    """A regular expression of the RE2 kind: no look-around, back-references or possessive repetition;
    a word boundary is one of ASCII words."""
    if _NOT_RE2.search(pattern):
        raise EngineError("invalid_parameter", f"not an RE2 expression: {pattern}")
    ascii_bounds = re.sub(r"\\(.)", lambda m: _BOUNDS.get(m[1], m[0]), pattern)
    return F.coalesce(a.rlike(ascii_bounds), F.lit(False))


def json_path(doc: Column | str, path: str) -> Column:
    """A dotted path into JSON text, as a string; a leading `event.` is optional. Missing: null."""
    return F.get_json_object(doc, "$." + path.removeprefix("event."))


def duration_ms(text: str) -> int:
    found = re.fullmatch(r"(\d+)(ms|s|m|h|d)", text)
    if not found:
        raise EngineError("parse_error", f"not a duration: {text}")
    return int(found[1]) * UNITS[found[2]]


def time_ms(text: str) -> int:
    """An RFC 3339 time with its zone, in milliseconds."""
    if not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)", text):
        raise EngineError("parse_error", f"not a time with a zone: {text}")
    return round(datetime.fromisoformat(text.replace("Z", "+00:00")).timestamp() * 1000)


def before(a: Column, b: Column) -> Column:
    """a < b as text that people read, by the root locale's collation: a, B, c."""
    return F.collate(a, "UNICODE") < F.collate(b, "UNICODE")


def ascii_lower(a: Column | str) -> Column:
    return F.translate(a, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def epoch_ms(ntz: Column | str) -> Column:
    """Milliseconds of a timestamp without zone, taken as UTC whatever the session's zone."""
    name = ntz if isinstance(ntz, str) else ntz._jc.toString()
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', {name})")
