"""Page cursors that bind a query, its snapshot and a place, and notice tampering."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json

from tracelake.errors import EngineError


def _sign(key: bytes, data: bytes) -> bytes:
    return hmac.new(key, data, hashlib.sha256).digest()


def make(key: bytes, query_hash: str, as_of: int, generation: int, offset: int) -> str:
    data = json.dumps([query_hash, as_of, generation, offset]).encode()
    return base64.urlsafe_b64encode(_sign(key, data) + data).decode()


def read(key: bytes, token: str, query_hash: str, as_of: int, generation: int) -> int:
    """The offset, if the token is ours and the snapshot is still the same."""
    try:
        raw = base64.urlsafe_b64decode(token.encode())
        data = raw[32:]
        if not hmac.compare_digest(raw[:32], _sign(key, data)):
            raise ValueError
        query, at, gen, offset = json.loads(data)
    except ValueError:
        raise EngineError("invalid_parameter", "not a cursor of this engine") from None
    if query != query_hash:
        raise EngineError("invalid_parameter", "a cursor of another query")
    if (at, gen) != (as_of, generation):
        raise EngineError("snapshot_changed", "the snapshot has changed")
    return offset


def following(key: bytes, query_hash: str, as_of: int, generation: int, offset: int, rows: int, limit: int) -> str | None:
    """The next page's cursor; only a full page has one."""
    return make(key, query_hash, as_of, generation, offset + rows) if rows == limit else None
