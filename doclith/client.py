"""A folder of databases, each a folder of collections."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from doclith.collection import Collection, Table
from doclith.sources.store import Files, Storage, Store


class Database:
    def __init__(self, spark: SparkSession, path: str, name: str, storage: Storage | None = None) -> None:
        self._spark, self._path, self.name, self._storage = spark, path, name, storage
        self._tables: dict[str, Table] = {}

    def __getitem__(self, name: str) -> Table:
        return self._tables.get(name) or Collection(name, Store(self._spark, f"{self._path}/{name}", self._storage))

    def __getattr__(self, name: str) -> Table:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]

    def attach(self, name: str, df: DataFrame, sequence: str | None = None) -> Table:
        """Names a table with a schema, read where it is; ``sequence`` is a column that orders its rows."""
        self._tables[name] = Table(name, df, sequence)
        return self._tables[name]

    def collection_names(self) -> list[str]:
        """Also ``_default``, which every database has."""
        return sorted({"_default", *self._tables, *Files(self._spark, self._path).names(self._path)})


class Client:
    """``client[name]`` or ``client.name`` is a database; nothing is written before a collection is.

    How collections are kept is the argument ``storage``, or what a subclass returns as ``_storage``.
    """

    def __init__(self, spark: SparkSession, folder: str = "doclith", storage: Storage | None = None) -> None:
        self._spark, self._folder, self._given = spark, folder.rstrip("/"), storage or Storage()
        Files(spark, self._folder).make(self._folder)

    @property
    def _storage(self) -> Storage:
        return self._given

    def __getitem__(self, name: str) -> Database:
        return Database(self._spark, f"{self._folder}/{name}", name, self._storage)

    def __getattr__(self, name: str) -> Database:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]

    def close(self) -> None:
        """Nothing to close: the session belongs to the caller."""
