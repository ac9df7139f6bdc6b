"""Versioned snapshots: immutable Parquet folders, each committed by one file.

A write goes to a folder of its own; version n exists when the file `commits/<n>` does, which names
the folder and is created only when all tables are there. Nothing is deleted or renamed, so readers see
the version before or the version after at any time, and a writer that dies leaves at most a folder
that nobody reads (`sweep` deletes those). A writer states the version it read: if another has committed
the next one meanwhile, its file exists and the write is refused. Paths are resolved by Hadoop's file
systems, so a store may lie wherever the cluster can read and write.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("event_id", "title", "date", "location", "language", "translated_from", "source_short")] + [T.StructField("created_at", T.TimestampType())]
)
PARAGRAPHS = T.StructType([T.StructField("event_id", T.StringType()), T.StructField("sequence_number", T.IntegerType()), T.StructField("content", T.StringType()), T.StructField("role", T.StringType()), T.StructField("is_embedded", T.BooleanType())])


def ensure_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Older snapshots: columns that are absent become null ones; the order is the schema's."""
    have = set(df.columns)
    return df.select(*[F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


class Busy(RuntimeError):
    """Another writer has published."""


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._root = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{p}")

    def _commits(self) -> list[int]:
        if not self._fs.exists(self._at("commits")):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(self._at("commits")) if s.getLen())

    def version(self) -> int:
        return max(self._commits(), default=0)

    def _folder(self, v: int) -> str:
        return f"{self.path}/data/{self.spark.read.text(f'{self.path}/commits/{v:08d}').first()[0]}"

    def _tables(self, v: int) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder(v))
        return [s.getPath().getName() for s in self._fs.listStatus(at) if s.isDirectory()]

    def read(self, table: str, schema: T.StructType | None = None, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        if v == 0 or table not in self._tables(v):
            return self.spark.createDataFrame([], schema or T.StructType([]))
        df = self.spark.read.parquet(f"{self._folder(v)}/{table}")
        return ensure_columns(df, schema) if schema else df

    def publish(self, tables: dict[str, DataFrame], base: int) -> int:
        """Write all tables as the version after base; it exists when all are there."""
        if self.version() != base:
            raise Busy(f"version {self.version()} has been published since {base}")
        folder = f"{base + 1:08d}-{uuid.uuid4().hex}"
        try:
            for name, df in tables.items():
                df.write.parquet(f"{self.path}/data/{folder}/{name}")
            self._commit(base + 1, folder)
        except BaseException:
            self._fs.delete(self._at(f"data/{folder}"), True)
            raise
        return base + 1

    def _commit(self, v: int, folder: str) -> None:
        try:
            out = self._fs.create(self._at(f"commits/{v:08d}"), False)  # fails if another was first
        except Py4JJavaError as e:
            raise Busy(f"version {v} has been published") from e
        out.write(bytearray(f"{folder}\n".encode()))
        out.close()

    def sweep(self) -> int:
        """Delete folders and empty commits of writers that died; how many. No writer may be at work."""
        known = {self._folder(v).rsplit("/", 1)[1] for v in self._commits()}
        left = [s.getPath() for s in self._fs.listStatus(self._at("data")) if s.getPath().getName() not in known] if self._fs.exists(self._at("data")) else []
        left += [s.getPath() for s in self._fs.listStatus(self._at("commits")) if not s.getLen()] if self._fs.exists(self._at("commits")) else []
        for at in left:
            self._fs.delete(at, True)
        return len(left)

    def copy_to(self, path: str, force: bool = False) -> Store:
        """A staging copy of the current version; an existing one is overwritten only if forced."""
        other = Store(self.spark, path)
        if other.version() and not force:
            raise FileExistsError(path)
        v = self.version()
        other.publish({n: self.read(n, version=v) for n in self._tables(v)}, other.version())
        return other

    def manifest(self) -> dict:
        """Rows and an order-free digest of every table of the current version."""
        v, out = self.version(), {}
        for name in self._tables(v) if v else ():
            df = self.read(name, version=v)
            n, h = df.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0))).first()
            out[name] = {"rows": n, "digest": hashlib.sha256(str(h).encode()).hexdigest()}
        return out


def put_meta(meta: DataFrame, key: str, value: str) -> DataFrame:
    """meta (key, value) with the pair put, replacing an older value."""
    return meta.where(F.col("key") != key).unionByName(meta.sparkSession.createDataFrame([(key, value)], "key string, value string"))


def to_json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("json"))


def dumps(found: DataFrame, most: int = 1000) -> str:
    """A small report as JSON text, such as status counts; an error if it has more rows than that."""
    rows = found.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write to_json_rows() instead")
    return json.dumps([r.asDict(recursive=True) for r in rows], ensure_ascii=False)
