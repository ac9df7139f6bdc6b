"""Differences between two snapshots of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("date", "location", "translated_from", "source_short")
ORDER = ("ADDED", "MODIFIED", "REMOVED", "UNCHANGED")


def body(paragraphs: Column) -> Column:
    """SHA-1 of a document's paragraphs, joined by line breaks."""
    return F.sha1(F.array_join(paragraphs, "\n"))


def bodies(paragraphs: DataFrame) -> DataFrame:
    """(event_id, n_paragraphs, body) of each document's paragraphs in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("sequence_number", "content"))), lambda s: s["content"])
    return paragraphs.groupBy("event_id").agg(F.count("*").alias("n_paragraphs"), body(ordered).alias("body"))


def keyed(events: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """One row per (title, language), of duplicates the highest id."""
    have = set(events.columns)
    x = events.select("event_id", F.trim("title").alias("title"), F.trim(F.coalesce("language", F.lit(""))).alias("language"), *[(F.col(c) if c in have else F.lit(None)).cast("string").alias(c) for c in FIELDS])
    x = x.join(bodies(paragraphs), "event_id", "left")
    row = F.struct("event_id", *FIELDS, "n_paragraphs", "body")
    return x.groupBy("title", "language").agg(F.max_by(row, F.col("event_id")).alias("r")).select("title", "language", "r.*")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(title, language, status, notes) of two keyed() tables; notes name what changed."""
    a, b = old.alias("a"), new.alias("b")
    x = a.join(b, (F.col("a.title") == F.col("b.title")) & (F.col("a.language") == F.col("b.language")), "full_outer")
    changed = [F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in FIELDS]
    size = F.when(~F.col("a.n_paragraphs").eqNullSafe(F.col("b.n_paragraphs")), F.concat(F.lit("paragraphs "), F.coalesce("a.n_paragraphs", F.lit(0)), F.lit(" to "), F.coalesce("b.n_paragraphs", F.lit(0))))
    body = F.when(~F.col("a.body").eqNullSafe(F.col("b.body")), F.coalesce(size, F.lit("content changed")))
    notes = F.array_join(F.array_compact(F.array(*changed, body)), ", ")
    status = F.when(F.col("a.event_id").isNull(), "ADDED").when(F.col("b.event_id").isNull(), "REMOVED").when(notes != "", "MODIFIED").otherwise("UNCHANGED")
    return x.select(F.coalesce("a.title", "b.title").alias("title"), F.coalesce("a.language", "b.language").alias("language"), status.alias("status"), F.when(status == "MODIFIED", notes).otherwise("").alias("notes"))


def status_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("status").agg(F.count("*").alias("n")).orderBy("status")
