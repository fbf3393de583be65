"""One exception class; callers branch on its code."""

from __future__ import annotations

# The codes a caller can meet.
CODES = {"parse_error", "type_error", "invalid_parameter", "unknown_field", "unsupported_capability", "resource_limit", "permission_denied", "cursor_expired", "snapshot_changed", "storage_error", "not_found"}


class EngineError(Exception):
    def __init__(self, code: str, message: str, retryable: bool = False, details: dict | None = None):
        assert code in CODES, code
        super().__init__(f"{code}: {message}")
        self.code, self.retryable, self.details = code, retryable, details or {}
