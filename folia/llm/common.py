"""What the training-data operators share: tables, written cut points, native helpers."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD_BREAKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="folia-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares. Where none is set, a temporary one on a single machine only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = _own_dir(spark.sparkContext.applicationId)
    return path.rstrip("/")


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/folia/{spark.sparkContext.applicationId}"


#: Folders of written tables that haven't been deleted.
_written: dict[str, None] = {}


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends, every later pass reads the
    narrow table, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = None
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _written.pop(path, None)


def drop(*tables: DataFrame) -> None:
    """Delete tables of cut() that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t.folder)


def written() -> set[str]:
    return set(_written)


def drop_all_but(spark: SparkSession, keep: set[str]) -> None:
    for path in written() - keep:
        _delete(spark, path)


def clean(spark: SparkSession) -> None:
    """Delete all that this application has written in between; its results must have been read."""
    _delete(spark, _folder(spark))
    _written.clear()


#: Rows of a looked-up table that are broadcast at most; copies of a larger one's rows.
LOOKUP, SPREAD = 1 << 17, 32


def lookup(rows: DataFrame, found: DataFrame, key: str, name: str, how: str = "inner") -> DataFrame:
    """rows joined with found (one row a key), however many rows share a key: found is broadcast if it
    is small, which is checked; otherwise its rows are copied SPREAD times and rows dealt out to them."""
    found = cut(found, name)
    if found.limit(LOOKUP + 1).count() <= LOOKUP:
        return rows.join(F.broadcast(found), key, how)
    copies = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)).cast("int")).join(copies, [key, "_salt"], how).drop("_salt")


def words(text: Column) -> Column:
    """The words of a text, unchanged; none for null."""
    text = F.coalesce(text, F.lit(""))
    for c in WORD_BREAKS[1:]:  # a single-character split needs no regular expression
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def count_chars(text: Column, chars: str) -> Column:
    """How many of the given ASCII characters the text has: by byte lengths, without a pattern."""
    rest = text
    for c in chars:
        rest = F.replace(rest, F.lit(c))
    return (F.octet_length(text) - F.octet_length(rest)).cast("long")


def split_words(text: str | None) -> list[str]:
    """words() in Python. str.split() alone also breaks at \\x1c-\\x1f, \\x85 and Unicode spaces."""
    if not text:
        return []
    if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return text.split()
    for c in "\t\n\x0b\x0c\r":
        if c in text:
            text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def crc32_sql(blob: str) -> str:
    """CRC-32 of a blob in SQL, byte by byte by the 256 steps of its rule."""
    steps = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ 0xEDB88320 * (c & 1)
        steps.append(f"{c}::UBIGINT")
    start = "4294967295::UBIGINT"
    step = f"xor([{', '.join(steps)}][CAST(xor(s, c) & 255 AS INTEGER) + 1], s >> 8)"
    return f"CASE WHEN octet_length({blob}) = 0 THEN 0::UBIGINT ELSE xor(list_reduce(list_prepend({start}, list_transform(regexp_extract_all(hex({blob}), '..'), lambda h: ('0x' || h)::UBIGINT)), lambda s, c: {step}), {start}) END"
