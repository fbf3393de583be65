"""Content addresses: SHA-256 over parts, each with its length in front; stable ids of JSON values.

A length is eight little-endian bytes; they are made with hex(), so ids stay in the JVM.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def le8(number: Column) -> Column:
    """A long as eight little-endian bytes."""
    big = F.lpad(F.hex(number.cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(big, i, 2) for i in range(15, 0, -2)]))


def framed(*parts: Column) -> Column:
    """SHA-256, in hex, of the parts (text or binary), each after its length."""
    binary = [p.cast("binary") for p in parts]
    return F.sha2(F.concat(*[x for p in binary for x in (le8(F.octet_length(p)), p)]), 256)


def session_id(provider: Column, native: Column) -> Column:
    return framed(provider, native)


def event_id(provider: Column, native: Column, generation: Column, identity: Column, event_type: Column, raw: Column) -> Column:
    return framed(provider, native, le8(generation), identity, event_type, F.sha2(raw.cast("binary"), 256))


def canonical_json(value) -> str:
    """Keys in code unit order, no spaces; for driver-side hashes of plans and bundles."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def stable_id(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()[:32]


def order_key(ms: Column, seq: Column) -> Column:
    """Sortable text of a time and a number."""
    return F.concat(F.lit("01"), F.lpad(F.lower(F.hex(ms)), 12, "0"), F.lit("-"), F.lpad((seq % 10000).cast("string"), 4, "0"))


def iso_ms(ms: Column) -> Column:
    """Milliseconds as RFC 3339 text in UTC, whatever the session's zone."""
    moment = F.timestamp_add("MILLISECOND", ms, F.expr("timestamp_ntz'1970-01-01 00:00:00'"))
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
