"""Writes as new snapshots: events and paragraphs in, events and paragraphs out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from folia.functions.text import canonical_language, canonical_title, era, series, year

PATCHABLE = ("title", "date", "location", "language", "translated_from", "source_short")


def resolve(events: DataFrame, batch: DataFrame) -> DataFrame:
    """batch (title, language, ...) with event_id of the document it means: the same title and
    language, else the same canonical title; the lowest id of several; null for new ones."""
    lang = lambda c: F.lower(F.coalesce(canonical_language(F.col(c)), F.lit("")))
    exact = events.groupBy(F.col("title").alias("_t"), lang("language").alias("_l")).agg(F.min("event_id").alias("_exact"))
    canon = events.groupBy(canonical_title(F.col("title")).alias("_c"), lang("language").alias("_l2")).agg(F.min("event_id").alias("_canon"))
    x = batch.withColumns({"_bt": F.col("title"), "_bl": lang("language"), "_bc": canonical_title(F.col("title"))})
    x = x.join(exact, (F.col("_bt") == F.col("_t")) & (F.col("_bl") == F.col("_l")), "left").join(canon, (F.col("_bc") == F.col("_c")) & (F.col("_bl") == F.col("_l2")), "left")
    return x.select(*batch.columns, F.coalesce("_exact", "_canon").alias("event_id"))


def new_id(title, language):
    """Deterministic, so that a retried write is the same write."""
    return F.sha1(F.concat_ws("|", canonical_title(title), F.coalesce(language, F.lit(""))))


def upsert(rows: DataFrame, batch: DataFrame, key: str = "event_id") -> DataFrame:
    """rows without those whose key the batch has, and the batch: a document's paragraphs are replaced
    as a whole."""
    return rows.join(batch.select(key).distinct(), key, "left_anti").unionByName(batch.select(*rows.columns))


def delete(rows: DataFrame, ids: DataFrame, key: str = "event_id") -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_anti")


def plan_batch(events: DataFrame, actions: DataFrame) -> DataFrame:
    """actions (action: add, modify or delete; title, language) with event_id and error (null: fine)."""
    known = F.col("event_id").isNotNull()
    error = F.when((F.col("action") == "add") & known, "exists").when(F.col("action").isin("modify", "delete") & ~known, "absent").when(~F.col("action").isin("add", "modify", "delete"), "unknown action")
    return resolve(events, actions).withColumn("error", error)


def apply_batch(events: DataFrame, planned: DataFrame, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """(events, report): all actions or, if one fails, none. planned has the events' columns too."""
    tables, report = apply_documents({"events": events}, planned, dry_run)
    return tables["events"], report


def apply_documents(tables: dict[str, DataFrame], planned: DataFrame, dry_run: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, report) of a batch over whole documents: all actions or, if one fails, none.

    tables: events, and if kept paragraphs, tags, or any others with event_id. planned: plan_batch's
    rows with the events' columns, and `paragraphs`, an array of the new texts in order (or of structs
    with content and role). A written document's paragraphs are replaced, numbered from 1, a modified
    one keeps its id, title and tags; what a deleted document has in any table goes. The results are
    meant for one Store.publish, so that readers see all of it or nothing."""
    report = planned.groupBy("action", F.col("error").isNull().alias("ok")).agg(F.count("*").alias("n"))
    if dry_run or planned.where(F.col("error").isNotNull()).limit(1).count():
        return tables, report
    events = tables["events"]
    gone = planned.where(F.col("action") == "delete").select("event_id")
    write = planned.where(F.col("action") != "delete").withColumn("event_id", F.coalesce(F.col("event_id"), new_id(F.col("title"), F.col("language"))))
    out = {name: delete(df, gone) for name, df in tables.items()}
    old = events.select("event_id", F.col("title").alias("_t"))
    kept = write.join(old, "event_id", "left").withColumn("title", F.coalesce("_t", "title"))
    out["events"] = upsert(out["events"], kept)
    if "paragraphs" in tables and "paragraphs" in planned.columns:
        out["paragraphs"] = replace_paragraphs(out["paragraphs"], write)
    return out, report


def replace_paragraphs(paragraphs: DataFrame, write: DataFrame) -> DataFrame:
    """paragraphs, those of write's documents (event_id, paragraphs) replaced."""
    item = write.schema["paragraphs"].dataType.elementType
    x = write.select("event_id", F.posexplode("paragraphs").alias("_i", "_p"))
    fields = {f.name for f in item.fields} if hasattr(item, "fields") else set()
    value = {"event_id": F.col("event_id"), "sequence_number": F.col("_i") + 1, "content": F.col("_p.content") if fields else F.col("_p")}
    new = x.select(*[(value.get(f.name, F.col(f"_p.{f.name}") if f.name in fields else F.lit(None))).cast(f.dataType).alias(f.name) for f in paragraphs.schema.fields])
    return paragraphs.join(write.select("event_id").distinct(), "event_id", "left_anti").select(*paragraphs.columns).unionByName(new)


def ingest_best_effort(tables: dict[str, DataFrame], batch: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, report) of documents (title, language, ..., paragraphs) that are added or replaced one
    by one: those without title or paragraphs are left out and reported (title, language, error); of
    several with the same canonical title and language the last by title wins."""
    error = F.when(F.coalesce(F.trim("title"), F.lit("")) == "", "missing title").when(F.coalesce(F.size("paragraphs"), F.lit(0)) <= 0, "no body")
    x = resolve(tables["events"], batch.withColumn("error", error)).withColumn("event_id", F.coalesce(F.col("event_id"), new_id(F.col("title"), F.col("language"))))
    w = W.partitionBy(F.col("error").isNull(), "event_id").orderBy(F.desc("title"))
    x = x.withColumn("_n", F.row_number().over(w))
    x = x.withColumn("error", F.coalesce("error", F.when(F.col("_n") > 1, "replaced by a later one"))).drop("_n")
    good = x.where(F.col("error").isNull()).withColumn("action", F.lit("modify"))
    out, _ = apply_documents(tables, good)
    return out, x.select("title", "language", "error")


def patch(events: DataFrame, event_id, fields: dict) -> DataFrame:
    if bad := set(fields) - set(PATCHABLE):
        raise ValueError(f"not to be changed: {sorted(bad)}")
    return events.withColumns({c: F.when(F.col("event_id") == event_id, F.lit(v)).otherwise(F.col(c)) for c, v in fields.items()})


def set_tags(tags: DataFrame, event_id, names: list[str]) -> DataFrame:
    """The document's tags replaced by the names, trimmed and lower-cased, blanks left out."""
    spark = tags.sparkSession
    new = sorted({n.strip().lower() for n in names if n.strip()})
    return tags.where(F.col("event_id") != event_id).unionByName(spark.createDataFrame([(event_id, n) for n in new], tags.schema))


def impute_locations(events: DataFrame, prefixes: tuple[tuple[str, str], ...], bounds: tuple) -> DataFrame:
    """Missing places: the series' most frequent, else the first prefix rule, else the era of the
    own year, else the era of the series' (upper) median year."""
    x = events.withColumns({"_s": series(F.col("title")), "_y": year(F.col("date"))})
    seen = x.where(F.col("location").isNotNull() & (F.col("location") != "")).groupBy("_s", "location").agg(F.count("*").alias("n"))
    usual = seen.groupBy("_s").agg(F.min(F.struct((-F.col("n")).alias("m"), "location"))["location"].alias("_p1"))
    # The median from counts per year: no series' rows meet in a list.
    years = x.where(F.col("_y").isNotNull()).groupBy("_s", "_y").agg(F.count("*").alias("n"))
    w = W.partitionBy("_s").orderBy("_y")
    years = years.withColumns({"below": F.sum("n").over(w), "all": F.sum("n").over(W.partitionBy("_s"))})
    median = years.where(F.col("below") > F.floor(F.col("all") / 2)).groupBy("_s").agg(F.min("_y").alias("_m"))
    rule = F.lit(None).cast("string")
    for start, place in reversed(prefixes):
        rule = F.when(F.col("_s").startswith(start), place).otherwise(rule)
    by_era = lambda y: F.when(y.isNotNull(), era(y, bounds))
    y = x.join(usual, "_s", "left").join(median, "_s", "left")
    return y.withColumn("location", F.coalesce(F.nullif(F.col("location"), F.lit("")), "_p1", rule, by_era(F.col("_y")), by_era(F.col("_m")))).select(*events.columns)


def impute_dates(events: DataFrame) -> DataFrame:
    """Missing dates: the first of January of the series' first year."""
    first = events.where(year(F.col("date")).isNotNull()).groupBy(series(F.col("title")).alias("_s")).agg(F.min(year(F.col("date"))).alias("_y"))
    x = events.withColumn("_k", series(F.col("title"))).join(first, F.col("_k") == F.col("_s"), "left")
    return x.withColumn("date", F.coalesce("date", F.concat(F.col("_y").cast("string"), F.lit("-01-01")))).select(*events.columns)


def topic_tags(texts: DataFrame, rules: dict[str, tuple[str, ...]]) -> DataFrame:
    """(event_id, tag): documents of which the text (event_id, text) has a word of the rule."""
    low = F.lower(F.coalesce("text", F.lit("")))
    hits = F.array_compact(F.array(*[F.when(F.lit(False) if not words else _contains(low, words), F.lit(tag)) for tag, words in sorted(rules.items())]))
    return texts.select("event_id", F.explode(hits).alias("tag")).distinct()


def _contains(low, words):
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """First wins among rows with the same key."""
    w = W.partitionBy(key).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")
