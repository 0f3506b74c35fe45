"""Errors of the engine."""

from __future__ import annotations


class DocumentError(Exception):
    """Base of all errors below."""


class ConnectionFailure(DocumentError):
    """The store can't be reached."""


class ConfigurationError(DocumentError):
    """Options that contradict each other."""


class OperationFailure(DocumentError):
    """An operation was refused or failed."""

    def __init__(self, error: str, code: int | None = None, details: dict | None = None) -> None:
        super().__init__(error)
        self.code, self.details = code, details


class CursorNotFound(OperationFailure):
    """The cursor's rows are gone."""


class WriteError(OperationFailure):
    """A write was refused."""


class DuplicateKeyError(WriteError):
    """A document with this ``_id`` is there already."""


class InvalidOperation(DocumentError):
    """An operation that this object doesn't offer in its state."""
