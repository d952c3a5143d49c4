"""The error of what can never work."""

from __future__ import annotations


class SchemaError(Exception):
    """A schema or an operation on it that can never work; code says which kind."""

    def __init__(self, reason: str, code: str = "invalid_operation") -> None:
        super().__init__(reason)
        self.code, self.reason = code, reason
