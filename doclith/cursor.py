"""The result of ``find``: a DataFrame until documents are asked for."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame

from doclith.operators import documents, ordering
from doclith.sources.codecs import Codecs


def document(row, codecs: Codecs | None = None) -> dict:
    """A row as a dictionary."""
    return (codecs or Codecs()).value(json.loads(row[documents.TEXT])) if documents.TEXT in row.__fields__ else row.asDict(recursive=True)


class Cursor:
    """``df`` is the DataFrame: filter it, join it, write it. Documents come to the driver by iteration or by index."""

    def __init__(self, df: DataFrame, query: dict | None = None, sort: Any = None, skip: int | None = None, limit: int | None = None, sequence: str | None = None, projection: list[str] | None = None, codecs: Codecs | None = None) -> None:
        self._codecs = codecs
        self._sequence = sequence or (documents.SEQUENCE if documents.SEQUENCE in df.columns else None)
        self._found = documents.matching(df, query)
        self.df = documents.find(df, query, sort, skip, limit, self._sequence, projection)
        self._ordered = sort is not None or bool(skip or limit)
        self._ahead: Iterator | None = None
        self._next: list = []
        self._count: int | None = None

    def sort(self, key: Any, direction: Any = None) -> Cursor:
        """Reorders what the cursor holds, after skip and limit; returns it."""
        keys = ordering.checked(key, direction)
        self.df = ordering.ordered(self.df, keys, self._sequence, documents.TEXT if documents.is_documents(self.df) else None)
        self._ordered, self._ahead, self._next = True, None, []
        return self

    def paginate(self, skip: int | None, limit: int | None) -> Cursor:
        if not self._ordered and self._sequence:
            self.df = self.df.orderBy(self._sequence)
        self.df = self.df.offset(skip or 0)
        self.df = self.df.limit(limit) if limit else self.df
        self._ordered, self._ahead, self._next, self._count = True, None, [], None
        return self

    def count(self, with_limit_and_skip: bool = False) -> int:
        """Of the documents that the cursor holds, counted once; the argument changes nothing."""
        if self._count is None:
            self._count = self.df.count()
        return self._count

    def _lines(self) -> DataFrame:
        return self.df if self._ordered or not self._sequence else self.df.orderBy(self._sequence)

    def __iter__(self) -> Iterator[dict]:
        return (document(r, self._codecs) for r in self._lines().toLocalIterator())

    def __len__(self) -> int:
        return self.count()

    def __getitem__(self, key: int | str) -> Any:
        """A document by its place, or a field of the last one that was found."""
        if isinstance(key, str):
            last = (self._found.orderBy(documents.F.desc(self._sequence)).limit(1) if self._sequence else self._found).tail(1)
            if not last:
                raise IndexError("no document was found")
            return document(last[0], self._codecs)[key]
        found = self._lines().offset(key).limit(1).collect() if key >= 0 else self._lines().tail(-key)[: 1 if key + self.count() >= 0 else 0]
        if not found:
            raise IndexError("no document at that place")
        return document(found[0], self._codecs)

    def hasNext(self) -> bool:
        """Looks one document ahead; a partition at a time comes to the driver."""
        if not self._next:
            if self._ahead is None:
                self._ahead = self._lines().toLocalIterator()
            self._next = [r for _, r in zip(range(1), self._ahead, strict=False)]
        return bool(self._next)

    def next(self) -> dict:
        """The next document; IndexError behind the last."""
        if not self.hasNext():
            raise IndexError("no more documents")
        return document(self._next.pop(), self._codecs)

    __next__ = next
