"""Collections as snapshots: Parquet parts, and a numbered manifest that names those that count.

A write puts its part down first and then the next manifest, by a rename that fails if that number is taken. Readers hold
the parts of one manifest, so they never see half a write, and a second writer with an old number fails. Paths go through
Hadoop's file systems, local or not.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclith.errors import ConfigurationError, OperationFailure
from doclith.sources.codecs import Codecs

TEXTS = "_seq BIGINT, _id STRING, _doc STRING"
SCHEMA = f"{TEXTS}, _v VARIANT"
KEPT = 2  # manifests whose parts stay, for readers that hold them


@dataclass
class Manifest:
    version: int = 0
    parts: list[str] = field(default_factory=list)
    rows: int = 0
    last: int = 0


@dataclass(frozen=True)
class Storage:
    """How collections are kept: the format of parts, options of its reader and writer, codecs by tag.

    A part's name tells its format, so that a collection can change it. Variants are kept in Parquet; elsewhere they
    are parsed when read.
    """

    format: str = "parquet"
    options: dict[str, str] = field(default_factory=dict)
    codecs: Codecs = field(default_factory=Codecs)

    def __post_init__(self) -> None:
        if self.format in ("csv", "text", "xml"):
            raise ConfigurationError(f"{self.format} files don't keep every string as it is")


class Files:
    """The few file operations that manifests need."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.conf, self.gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def make(self, name: str) -> None:
        self.fs.mkdirs(self.path(name))

    def names(self, name: str) -> list[str]:
        if not self.fs.exists(self.path(name)):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(name)))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Writes a new file in one step; False if it is there already."""
        draft = f"{name}.{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(draft), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            self._take(draft, name)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception.getClass().getName()):
                raise
            return False
        finally:
            self.fs.delete(self.path(draft), False)

    def _take(self, draft: str, name: str) -> None:
        """Gives the draft its name, unless that is taken: a link on local disks, and else a rename that replaces nothing."""
        if self.fs.getUri().getScheme() == "file":
            file = lambda x: self.jvm.java.io.File(self.path(x).toUri().getPath()).toPath()
            self.jvm.java.nio.file.Files.createLink(file(name), file(draft))
        else:
            none = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self.path(draft), self.path(name), none)

    def remove(self, name: str) -> bool:
        return self.fs.delete(self.path(name), True)


class Store:
    """One collection's folder."""

    def __init__(self, spark: SparkSession, path: str, storage: Storage | None = None) -> None:
        self.spark, self.path, self.files, self.storage = spark, path.rstrip("/"), Files(spark, path), storage or Storage()

    def _numbers(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.files.names(f"{self.path}/manifests") if n.endswith(".json")]

    def manifest(self) -> Manifest:
        numbers = self._numbers()
        return Manifest(**json.loads(self.files.read(f"{self.path}/manifests/{max(numbers):010d}.json"))) if numbers else Manifest()

    def exists(self) -> bool:
        return bool(self._numbers())

    def read(self, manifest: Manifest | None = None) -> DataFrame:
        manifest = manifest or self.manifest()
        if not manifest.parts:
            return self.spark.createDataFrame([], TEXTS).withColumn("_v", F.parse_json("_doc"))
        formats: dict[str, list[str]] = {}
        for p in manifest.parts:
            formats.setdefault(p.partition(".")[2] or "parquet", []).append(f"{self.path}/{p}")
        return reduce(DataFrame.unionByName, (self._parts(name, paths) for name, paths in formats.items()))

    def _parts(self, name: str, paths: list[str]) -> DataFrame:
        reader = self.spark.read.options(**self.storage.options if name == self.storage.format else {})
        if name == "parquet":
            return reader.schema(SCHEMA).parquet(*paths)
        return reader.schema(TEXTS).format(name).load(paths).withColumn("_v", F.parse_json("_doc"))

    def write(self, df: DataFrame) -> str:
        name = self.storage.format
        part = f"parts/{uuid.uuid4().hex}" + f".{name}" * (name != "parquet")
        columns = ["_seq", "_id", "_doc", *["_v"] * (name == "parquet")]
        df.select(*columns).write.options(**self.storage.options).format(name).save(f"{self.path}/{part}")
        return part

    def commit(self, before: Manifest, parts: list[str], rows: int, last: int) -> Manifest:
        """The next manifest; fails if another writer was faster. Parts that no recent manifest names are removed."""
        after = Manifest(before.version + 1, parts, rows, last)
        self.files.make(f"{self.path}/manifests")
        if not self.files.publish(f"{self.path}/manifests/{after.version:010d}.json", json.dumps(asdict(after))):
            raise OperationFailure("another write came first; read again")
        old = sorted(self._numbers())[:-KEPT]
        held = {p for n in sorted(self._numbers())[-KEPT:] for p in json.loads(self.files.read(f"{self.path}/manifests/{n:010d}.json"))["parts"]}
        for n in old:
            for p in json.loads(self.files.read(f"{self.path}/manifests/{n:010d}.json"))["parts"]:
                if p not in held:
                    self.files.remove(f"{self.path}/{p}")
            self.files.remove(f"{self.path}/manifests/{n:010d}.json")
        return after

    def drop(self) -> bool:
        """True if it existed and had rows."""
        had = self.exists() and self.manifest().rows > 0
        self.files.remove(self.path)
        return had
