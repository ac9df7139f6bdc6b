"""Catalog, facets and classifications over events (event_id, title, date, location, language)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from folia.functions.text import era, first_year, last_year, series, year


def catalog(events: DataFrame, tags: DataFrame) -> DataFrame:
    """Titled events with their sorted tags, by date and title."""
    lists = tags.groupBy("event_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    x = events.where(F.col("title").isNotNull()).join(lists, "event_id", "left")
    return x.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>"))).orderBy(F.coalesce("date", F.lit("")), "title", "event_id")


def tag_counts(tags: DataFrame) -> DataFrame:
    return tags.groupBy("tag").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "tag")


def languages(events: DataFrame) -> DataFrame:
    return events.where(F.col("language").isNotNull()).select("language").distinct().orderBy("language")


def date_range(events: DataFrame) -> DataFrame:
    d = events.where(F.length("date") >= 4)
    return d.agg(F.min(first_year(F.col("date"))).alias("min_year"), F.max(last_year(F.col("date"))).alias("max_year"))


def hierarchy(events: DataFrame) -> DataFrame:
    """(year, series, title, event_id) in that order, a row a document; a date without a year is Undated."""
    y = F.coalesce(F.nullif(F.regexp_extract("date", r"^(\d{4})", 1), F.lit("")), F.lit("Undated"))
    rows = events.where(F.col("title").isNotNull()).select(y.alias("year"), series(F.col("title")).alias("series"), "title", "event_id")
    return rows.orderBy("year", "series", "title", "event_id")


def facet(events: DataFrame, value: Column, unknown: str = "Unknown", by_value: bool = False) -> DataFrame:
    """(cluster, cnt) of a facet: most frequent first, or the greatest value first (years); what is
    unknown comes last."""
    c = F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit(unknown))
    counts = events.groupBy(c.alias("cluster")).agg(F.count("*").alias("cnt"))
    return counts.orderBy((F.col("cluster") == unknown).cast("int"), F.desc("cluster" if by_value else "cnt"), "cluster")


def timeline(events: DataFrame, bounds: tuple, unknown: str = "Unknown") -> DataFrame:
    """Events per era in the eras' order, empty ones left out."""
    names = [n for _, n in bounds] + [unknown]
    order = F.array_position(F.array(*map(F.lit, names)), F.col("cluster"))
    return events.groupBy(era(year(F.col("date")), bounds, unknown).alias("cluster")).agg(F.count("*").alias("cnt")).orderBy(order)


def counted(events: DataFrame, value: Column, limit: int | None = None) -> DataFrame:
    """(cluster, cnt) of a classification, most frequent first."""
    out = events.groupBy(value.alias("cluster")).agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "cluster")
    return out.limit(limit) if limit else out


def percent_of_max(counts: DataFrame) -> DataFrame:
    """For facet bars; counts has one row per facet value."""
    most = F.max("cnt").over(W.partitionBy(F.lit(1)))
    return counts.withColumn("pct", F.round(100.0 * F.col("cnt") / most, 6))


def series_rollup(events: DataFrame, tags: DataFrame, bounds: tuple, top_tags: int = 6) -> DataFrame:
    """Per series: years, most frequent place, top tags, language or Mixed, era, talks."""
    x = events.withColumns({"series": series(F.col("title")), "y": year(F.col("date"))})
    base = x.groupBy("series").agg(
        F.min("y").alias("min_year"), F.max("y").alias("max_year"), F.count("*").alias("talks"),
        F.when(F.count_distinct("language") > 1, "Mixed").otherwise(F.min("language")).alias("language"),
    )
    places = x.where(F.col("location").isNotNull()).groupBy("series", "location").agg(F.count("*").alias("n"))
    place = places.groupBy("series").agg(F.min(F.struct((-F.col("n")).alias("m"), "location"))["location"].alias("location"))
    used = x.select("event_id", "series").join(tags, "event_id").groupBy("series", "tag").agg(F.count("*").alias("n"))
    w = W.partitionBy("series").orderBy(F.desc("n"), "tag")
    ranked = used.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top_tags)
    best = ranked.groupBy("series").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "tag"))), lambda s: s["tag"]), ",").alias("tags"))
    return base.join(place, "series", "left").join(best, "series", "left").withColumn("era", era(F.col("min_year"), bounds))


def era_totals(rollup: DataFrame) -> DataFrame:
    return rollup.groupBy("era").agg(F.count("*").alias("series"), F.sum("talks").alias("talks"))


def weighted_tags(rollup: DataFrame) -> DataFrame:
    """Tags by the talks of the series that carry them."""
    x = rollup.where(F.col("tags").isNotNull()).select("talks", F.explode(F.split("tags", ",")).alias("tag"))
    return x.groupBy("tag").agg(F.sum("talks").alias("weight")).orderBy(F.desc("weight"), "tag")


def talks_in_series(events: DataFrame) -> DataFrame:
    """(series, first_date, n, event_id): talks numbered by date in their series, series by their first;
    a row a talk, whatever a series' size."""
    x = events.select(series(F.col("title")).alias("series"), F.coalesce("date", F.lit("")).alias("date"), "event_id")
    first = x.groupBy("series").agg(F.min("date").alias("first_date"))
    w = W.partitionBy("series").orderBy("date", "event_id")
    out = x.withColumn("n", F.row_number().over(w)).join(first, "series")
    return out.select("series", "first_date", "n", "event_id").orderBy("first_date", "series", "n")


def missing_values(events: DataFrame) -> DataFrame:
    share = lambda c: F.round(100.0 * F.count_if(F.col(c).isNull()) / F.count("*"), 6)
    return events.agg(F.count("*").alias("n"), F.count_if(F.col("location").isNull()).alias("no_location"), F.count_if(F.col("date").isNull()).alias("no_date"), share("location").alias("pct_location"), share("date").alias("pct_date"))


def page_of(events: DataFrame, page: int = 1, per_page: int = 50, q: str | None = None, tags: DataFrame | None = None, tag: str | None = None) -> DataFrame:
    """One page of the listing, by date, title and id; q: substring of title or place."""
    if page < 1 or not 1 <= per_page <= 200:
        raise ValueError("page is 1 or more, per_page 1 to 200")
    x = events.where(F.col("title").isNotNull())
    if q:
        x = x.where(F.col("title").ilike(f"%{q}%") | F.col("location").ilike(f"%{q}%"))
    if tag is not None and tags is not None:
        x = x.join(tags.where(F.col("tag") == tag), "event_id", "left_semi")
    return x.orderBy(F.coalesce("date", F.lit("")), "title", "event_id").offset((page - 1) * per_page).limit(per_page)
