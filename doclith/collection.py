"""Collections: tables with a schema to read, and stores of documents to read and change."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclith.cursor import Cursor, document
from doclith.errors import CursorNotFound, DuplicateKeyError, InvalidOperation, OperationFailure
from doclith.operators import documents
from doclith.plans.filters import EVERYTHING
from doclith.results import DeleteResult, InsertManyResult, InsertOneResult, UpdateResult
from doclith.sources.codecs import Codecs
from doclith.sources.store import Manifest, Store


def generate_id() -> str:
    """A new document's id: 32 hexadecimal digits."""
    return uuid.uuid1().hex


def id_text(value: Any) -> str:
    """An id as canonical JSON text: equal ids have equal texts."""
    return json.dumps(value, sort_keys=True, allow_nan=False)


class Table:
    """A collection over any DataFrame with a schema. Filters are plain conditions on its columns."""

    def __init__(self, name: str, df: DataFrame, sequence: str | None = None) -> None:
        self.name, self._df, self._sequence = name, df, sequence
        self._codecs = Codecs()

    @property
    def df(self) -> DataFrame:
        return self._df

    def build_table(self) -> Table:
        return self

    def count(self) -> int:
        return self.df.count()

    def find(self, filter: dict | None = None, sort: Any = None, skip: int | None = None, limit: int | None = None, projection: list[str] | None = None) -> Cursor:
        return Cursor(self.df, self._codecs.tree(filter), sort, skip, limit, self._sequence, projection, self._codecs)

    def find_one(self, filter: dict | None = None) -> dict | None:
        """The first match, or None."""
        rows = documents.first(self.df, self._codecs.tree(filter), self._sequence).take(1)
        return document(rows[0], self._codecs) if rows else None

    def _refuse(self, *_: Any, **__: Any) -> Any:
        raise InvalidOperation("a table with a schema is read only; copy it to a collection of documents to change it")

    insert = insert_one = insert_many = insert_frame = update = update_one = update_many = delete_one = delete_many = remove = drop = _refuse


class Collection(Table):
    """A collection of documents of any shape, kept in a store."""

    def __init__(self, name: str, store: Store) -> None:
        super().__init__(name, None, documents.SEQUENCE)
        self._store, self._codecs = store, store.storage.codecs

    @property
    def df(self) -> DataFrame:
        """_seq, _id (JSON text), _doc (JSON text), _v (variant) of the newest snapshot."""
        return self._store.read()

    def count(self) -> int:
        return self._store.manifest().rows

    def build_table(self) -> Collection:
        if not self._store.exists():
            self._store.commit(Manifest(), [], 0, 0)
        return self

    def _frame(self, rows: list[tuple[int, str, str]]) -> DataFrame:
        return self._store.spark.createDataFrame(rows, "_seq BIGINT, _id STRING, _doc STRING").withColumn("_v", F.parse_json("_doc"))

    def _insert(self, docs: list[dict], bypass: bool) -> list[int]:
        before = self._store.manifest()
        for doc in docs:
            if not doc.get("_id"):
                doc["_id"] = generate_id()
        try:
            plain = [self._codecs.plain(d) for d in docs]
            rows = [(before.last + 1 + i, id_text(d["_id"]), json.dumps(d, allow_nan=False)) for i, d in enumerate(plain)]
        except (TypeError, ValueError) as e:
            raise OperationFailure(f"a document is not JSON: {e}") from e
        new = self._frame(rows)
        if not bypass:
            ids = [r[1] for r in rows]
            twice = ids[0] if len(ids) == 1 and before.rows and self._store.read(before).where(F.col("_id") == ids[0]).limit(1).count() else None
            if len(ids) > 1:
                found = documents.duplicates(self._store.read(before), new).take(1)
                twice = found[0]["_id"] if found else None
            if twice is not None:
                raise DuplicateKeyError(f"there is a document with the _id {twice} already")
        if rows:
            self._store.commit(before, [*before.parts, self._store.write(new)], before.rows + len(rows), rows[-1][0])
        return [r[0] for r in rows]

    def insert_one(self, doc: dict, bypass_document_validation: bool = False) -> InsertOneResult:
        """Adds a document, with a new ``_id`` if it has none; the dictionary gets it too."""
        if not isinstance(doc, dict):
            raise ValueError("a document is a dictionary")
        (eid,) = self._insert([doc], bypass_document_validation)
        return InsertOneResult(doc["_id"], eid)

    def insert_many(self, docs: list[dict], bypass_document_validation: bool = False) -> InsertManyResult:
        """Adds all documents or none."""
        if not isinstance(docs, list) or any(not isinstance(d, dict) for d in docs):
            raise ValueError("documents come as a list of dictionaries")
        eids = self._insert(docs, bypass_document_validation)
        return InsertManyResult([d["_id"] for d in docs], eids)

    def insert(self, docs: dict | list, **options: Any) -> InsertOneResult | InsertManyResult:
        return self.insert_many(docs, **options) if isinstance(docs, list) else self.insert_one(docs, **options)

    def insert_frame(self, df: DataFrame, bypass_document_validation: bool = False) -> int:
        """Adds the rows of a DataFrame as documents, on the executors; returns how many. Without an ``_id`` column, or
        where it is null, ids are made. Null fields are left out. Times are kept by the codec for them, if there is one."""
        before, df = self._store.manifest(), self._codecs.columns(df)
        made = F.regexp_replace(F.uuid(), "-", "")
        own = F.coalesce(F.col("_id").cast("string"), made) if "_id" in df.columns and dict(df.dtypes)["_id"] == "string" else F.col("_id") if "_id" in df.columns else made
        rest = [c for c in df.columns if c != "_id"]
        rows = df.select(own.alias("_own"), *rest).select(F.to_json(F.struct("_own")).alias("_j"), F.to_json(F.struct(F.col("_own").alias("_id"), *rest)).alias("_doc"))
        rows = rows.select(F.expr("substring(_j, 9, length(_j) - 9)").alias("_id"), "_doc", F.parse_json("_doc").alias("_v"))
        draft = f"{self._store.path}/drafts/{uuid.uuid4().hex}"
        rows.write.parquet(draft)
        kept = self._store.spark.read.parquet(draft)
        try:
            if not bypass_document_validation and documents.duplicates(self._store.read(before), kept).take(1):
                raise DuplicateKeyError("an _id is there already, or twice among the new ones")
            n = kept.count()
            self._store.commit(before, [*before.parts, self._store.write(documents.numbered(kept, before.last))], before.rows + n, before.last + n)
        finally:
            self._store.files.remove(draft)
        return n

    def _matched(self, before: Manifest, query: dict | None, once: bool) -> tuple[int, Callable[[], list[int]]]:
        """How many match, and a function that fetches their numbers as long as the snapshot's files are there."""
        found = documents.matching(self._store.read(before), query).select("_seq")
        if once:
            first = found.agg(F.min("_seq")).first()[0]
            return (0, list) if first is None else (1, lambda: [first])

        def fetch() -> list[int]:
            try:
                return [r["_seq"] for r in found.orderBy("_seq").collect()]
            except PySparkException as e:
                raise CursorNotFound("later writes have removed the snapshot that this result is of") from e

        return found.count(), fetch

    def _update(self, query: dict | None, update: dict, once: bool) -> UpdateResult:
        query, update, before = self._codecs.tree(query), {"$set": self._codecs.plain(documents.changes(update))}, self._store.manifest()
        n, fetch = self._matched(before, query, once)
        if n:
            part = self._store.write(documents.updated(self._store.read(before), query, update, once=once))
            self._store.commit(before, [part], before.rows, before.last)
        return UpdateResult(fetch, n, n if update["$set"] else 0)

    def update_one(self, query: dict | None, doc: dict) -> UpdateResult:
        """Sets fields of the first match."""
        return self._update(query, doc, once=True)

    def update_many(self, query: dict | None, doc: dict) -> UpdateResult:
        """Sets fields of every match."""
        return self._update(query, doc, once=False)

    def update(self, query: dict | None, doc: dict | list[dict]) -> UpdateResult | list[UpdateResult]:
        """One update, or a list of them in order."""
        return [self.update_one(query, d) for d in doc] if isinstance(doc, list) else self.update_one(query, doc)

    def _delete(self, query: dict | None, once: bool) -> DeleteResult:
        before, query = self._store.manifest(), self._codecs.tree(query)
        n, fetch = self._matched(before, query, once)
        if n == before.rows and not once and query == EVERYTHING:
            self._store.commit(before, [], 0, 0)
        elif n:
            part = self._store.write(documents.remaining(self._store.read(before), query, once=once))
            self._store.commit(before, [part], before.rows - n, before.last)
        return DeleteResult(fetch, n)

    def compact(self) -> None:
        """Writes the parts of all inserts as one."""
        before = self._store.manifest()
        if len(before.parts) > 1:
            self._store.commit(before, [self._store.write(self._store.read(before))], before.rows, before.last)

    def delete_one(self, query: dict | None) -> DeleteResult:
        """Removes the first match."""
        return self._delete(query, once=True)

    def delete_many(self, query: dict | None) -> DeleteResult:
        """Removes every match; {} empties the collection, and numbering starts again."""
        return self._delete(query, once=False)

    def remove(self, spec: dict | None, multi: bool = True) -> DeleteResult:
        return self.delete_many(spec) if multi else self.delete_one(spec)

    def drop(self, **_: Any) -> bool:
        """Removes the collection; True if it had documents."""
        return self._store.drop()
