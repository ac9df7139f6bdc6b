"""Extension: postings kept up to date from a stream of documents (the batch engine needs none)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folia.operators.index import chunk_lines, postings, term_bucket


def index_stream(docs: DataFrame, target: str, checkpoint: str, key: str = "doc_id") -> StreamingQuery:
    """Each micro-batch's postings in a folder of its own: a batch that is run again overwrites its
    own folder, so every document is indexed exactly once."""

    def write(batch: DataFrame, epoch: int) -> None:
        postings(chunk_lines(batch, key)).withColumn("term_bucket", term_bucket(F.col("term"))).write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per window and type, with a watermark for late rows."""
    x = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return x.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def read_stream(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.readStream.schema(like.schema).parquet(path)
