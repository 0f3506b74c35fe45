"""What writes return."""

from __future__ import annotations

from dataclasses import dataclass, field
from collections.abc import Callable
from typing import Any


@dataclass(frozen=True)
class WriteResult:
    acknowledged: bool = field(default=True, kw_only=True)


@dataclass(frozen=True)
class InsertOneResult(WriteResult):
    """The document's ``_id`` and its sequence number."""

    inserted_id: Any
    eid: int | None


@dataclass(frozen=True)
class InsertManyResult(WriteResult):
    """In the order of the documents."""

    inserted_ids: list
    eids: list


@dataclass(frozen=True)
class UpdateResult(WriteResult):
    """The counts; sequence numbers of the documents that were updated are fetched when asked for."""

    fetch: Callable[[], list]
    matched_count: int | None = None
    modified_count: int | None = None
    upserted_id: Any = None

    @property
    def raw_result(self) -> list:
        return self.fetch()


@dataclass(frozen=True)
class DeleteResult(WriteResult):
    """The count; sequence numbers of the documents that were deleted are fetched when asked for."""

    fetch: Callable[[], list]
    deleted_count: int

    @property
    def raw_result(self) -> list:
        return self.fetch()
