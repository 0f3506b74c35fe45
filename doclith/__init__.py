"""Doclith: a document query and processing engine on PySpark DataFrames."""

from doclith.client import Client, Database
from doclith.collection import Collection, Table, generate_id
from doclith.cursor import Cursor
from doclith.errors import (
    ConfigurationError,
    ConnectionFailure,
    CursorNotFound,
    DocumentError,
    DuplicateKeyError,
    InvalidOperation,
    OperationFailure,
    WriteError,
)
from doclith.results import DeleteResult, InsertManyResult, InsertOneResult, UpdateResult
from doclith.sources.codecs import Codecs, DateTimeCodec
from doclith.sources.store import Storage

__all__ = [
    "Client", "Codecs", "Collection", "ConfigurationError", "ConnectionFailure", "Cursor", "CursorNotFound", "Database", "DateTimeCodec", "DeleteResult", "DocumentError",
    "DuplicateKeyError", "InsertManyResult", "InsertOneResult", "InvalidOperation", "OperationFailure", "Storage", "Table", "UpdateResult", "WriteError", "generate_id",
]
