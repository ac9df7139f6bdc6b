"""Arrow batches in and out of Python workers, in slabs of bounded size."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from contextlib import suppress
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one slab at most (one longer row makes a slab of its own).
ROWS, BYTES = 1024, 8 << 20


def slabs(batches: Iterator[pa.RecordBatch], rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        step = max(1, min(rows, size * max(1, batch.num_rows) // max(1, batch.nbytes)))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application: they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_folia_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="folia-")) / "folia.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(target))
    context._folia_shipped = True


def release() -> None:
    """Give free memory back to the machine: a worker waits between tasks while other stages need it."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # of glibc alone
        ctypes.CDLL(None).malloc_trim(0)


def in_python(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, rows: int = ROWS) -> DataFrame:
    """df through Python, slab by slab. make() runs once per task and returns the slab's function,
    which is let go with all that it remembers when the task ends."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        try:
            for slab in slabs(batches, rows):
                out = work(slab)
                if out.num_rows:
                    yield out
        finally:
            work = slab = out = None
            release()

    return df.mapInArrow(run, schema)
