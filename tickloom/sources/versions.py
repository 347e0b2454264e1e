"""Tables published in one step: version folders and one small pointer file.

Rows are written to a new folder below the table's path, checked there, and become the table when the
pointer file, which lists the folders that make it up, is replaced by a rename that the storage
system does in one step. A run that stops anywhere before leaves the old table as it was, and its
own folder is removed. The folders of the version before stay for readers that have already begun;
what is older is removed after publishing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

POINTER = "_current.json"
FOLDER = "snapshot_id"


class Storage:
    """The storage system of a path, as Spark's own Hadoop client sees it."""

    def __init__(self, spark: SparkSession, path: str):
        self.fs_classes = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.gateway, self.conf = spark.sparkContext._gateway, spark.sparkContext._jsc.hadoopConfiguration()
        self.path = path.rstrip("/")
        self.system = self.at("").getFileSystem(self.conf)

    def at(self, name: str):
        return self.fs_classes.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str) -> bool:
        return self.system.exists(self.at(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.system.listStatus(self.at(name)) if s.isDirectory())

    def remove(self, name: str) -> None:
        self.system.delete(self.at(name), True)

    def read(self, name: str) -> str:
        stream = self.system.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Write beside the file and rename over it."""
        beside = f"{name}.{uuid.uuid4().hex}"
        stream = self.system.create(self.at(beside), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        kind = getattr(self.fs_classes, "Options$Rename")
        options = self.gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        context = self.fs_classes.FileContext.getFileContext(self.at("").toUri(), self.conf)
        try:
            context.rename(self.system.makeQualified(self.at(beside)), self.system.makeQualified(self.at(name)), options)
        except Exception:
            self.remove(beside)
            raise


def pointer(spark: SparkSession, path: str) -> dict[str, list[str]] | None:
    """``current`` and ``previous`` folders of a published table, None where nothing is published."""
    storage = Storage(spark, path)
    return json.loads(storage.read(POINTER)) if storage.exists(POINTER) else None


def published(spark: SparkSession, path: str) -> bool:
    return pointer(spark, path) is not None


def read_published(spark: SparkSession, path: str, schema: T.StructType | None = None, folders: Sequence[str] | None = None) -> DataFrame:
    """The table the pointer names; ``folders`` reads some of its folders only."""
    listed = (pointer(spark, path) or {"current": []})["current"] if folders is None else list(folders)
    if not listed:
        if schema is None:
            raise ValueError(f"nothing is published at {path}")
        return spark.createDataFrame([], schema)
    reader = spark.read.option("basePath", path.rstrip("/"))
    if schema is not None:
        reader = reader.schema(T.StructType([*schema.fields, T.StructField(FOLDER, T.StringType())]))
    table = reader.parquet(*[f"{path.rstrip('/')}/{name}" for name in listed]).drop(FOLDER)
    return table if schema is None else table.select(*schema.names)


def publish(
    df: DataFrame, path: str, keep: Callable[[list[str]], list[str]] = lambda folders: [], partition_by: str | None = None,
    check: Callable[[DataFrame], None] = lambda staged: None, sort: Sequence[str] = (),
) -> DataFrame:
    """Write ``df`` to a new folder, ``check`` what was written, then make it the table together with the folders ``keep`` chooses of the present ones.

    ``sort`` places the rows by ranges, so that a large partition becomes several sorted files.
    """
    spark, storage = df.sparkSession, Storage(df.sparkSession, path)
    name = f"{FOLDER}={uuid.uuid4().hex}"
    before = pointer(spark, path) or {"current": [], "previous": []}
    placed = df.repartitionByRange(*sort).sortWithinPartitions(*sort) if sort else df
    writer = placed.write.option("compression", "zstd")
    try:
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{storage.path}/{name}")
        own = [f"{name}/{part}" for part in storage.names(name) if part.startswith(f"{partition_by}=")] if partition_by else [name]
        check(read_published(spark, path, df.schema, own))
        current = [*keep(before["current"]), *own]
        storage.replace(POINTER, json.dumps({"current": current, "previous": before["current"]}))
    except BaseException:
        storage.remove(name)
        raise
    used = {folder.split("/")[0] for folder in (*current, *before["current"])}
    for old in storage.names():
        if old.startswith(f"{FOLDER}=") and old not in used:
            storage.remove(old)
    return read_published(spark, path, df.schema)
