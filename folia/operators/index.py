"""Paragraphs, postings and their statistics."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from folia.functions.text import stemmed, tokens

BUCKETS = 64
META_PREFIX = "event page"
# White space at the ends of lines and blocks, all of Unicode's space separators.
SPACES = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"


def trimmed(parts: Column) -> Column:
    """The strings of an array without spaces at their ends. A lambda: F.trim itself takes a second
    argument, and transform would pass it each string's number as the characters to trim."""
    return F.transform(parts, lambda s: F.trim(s, F.lit(SPACES)))


def lines(text: Column, breaks: str = "\n") -> Column:
    """The non-blank lines of a text, trimmed, in order; none for null. breaks: characters that end a line."""
    return F.filter(trimmed(F.split(F.coalesce(text, F.lit("")), f"[{breaks}]")), lambda s: s != "")


def has_lines(text: Column) -> Column:
    """Whether lines() has any; without cutting the text."""
    return F.coalesce(text.rlike(f"[^\n{SPACES}]"), F.lit(False))


def chunk_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), start: int = 0, breaks: str = "\n\r\x0b") -> DataFrame:
    """(event_id, sequence_number, content, *keep): the non-blank lines, trimmed, in order. Vertical
    tabs and carriage returns break lines too, unless breaks leaves them out."""
    x = docs.select(F.col(key).alias("event_id"), *keep, F.posexplode(lines(F.col(text), breaks)).alias("_p", "content"))
    return x.select("event_id", (F.col("_p") + start).cast("int").alias("sequence_number"), "content", *keep)


def chunk_blocks(text: Column, least: int = 20, least_line: int = 10) -> Column:
    """Blocks between blank lines of at least 20 characters; if there are none, lines of at least 10."""
    blocks = F.filter(trimmed(F.split(text, r"\n{2,}")), lambda s: F.length(s) >= least)
    return F.when(F.size(blocks) > 0, blocks).otherwise(F.filter(trimmed(F.split(text, "\n")), lambda s: F.length(s) >= least_line))


def is_meta(prefix: str = META_PREFIX) -> Column:
    """Front matter: sequence 0, or text that opens with the boilerplate prefix."""
    return (F.col("sequence_number") == 0) | F.lower(F.col("content")).startswith(prefix)


def analysed(paragraphs: DataFrame) -> DataFrame:
    """paragraphs with tok (tokens), base (tokens of the document before this paragraph) and meta."""
    w = W.partitionBy("event_id").orderBy("sequence_number").rowsBetween(W.unboundedPreceding, -1)
    x = paragraphs.withColumns({"tok": tokens(F.col("content")), "meta": is_meta()})
    return x.withColumn("base", F.coalesce(F.sum(F.size("tok")).over(w), F.lit(0)))


def term_bucket(term: Column) -> Column:
    """By the first two characters, so that prefixes prune too."""
    return F.pmod(F.hash(F.substring(term, 1, 2)), F.lit(BUCKETS))


KEEP = ("term", "field", "event_id", "sequence_number", "pos", "rp", "meta", "len")


def postings(paragraphs: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """KEEP: one row per token of content, and of titles (once a document, without a paragraph).
    len: the paragraph's tokens and its title's; events: (event_id, title)."""
    x = analysed(paragraphs)
    of_title = F.lit(0)
    if events is not None:
        titled = events.select("event_id", tokens(F.col("title")).alias("_title"))
        x, of_title = x.join(titled, "event_id", "left"), F.coalesce(F.size("_title"), F.lit(0))
    x = x.select("event_id", "sequence_number", "meta", "base", (F.size("tok") + of_title).alias("len"), F.posexplode("tok").alias("pos", "term"))
    out = x.select("term", F.lit("content").alias("field"), "event_id", "sequence_number", "pos", (F.col("base") + F.col("pos")).cast("bigint").alias("rp"), "meta", "len")
    if events is not None:
        number = F.lit(None).cast(paragraphs.schema["sequence_number"].dataType)
        t = titled.select("event_id", F.size("_title").alias("len"), F.posexplode("_title").alias("pos", "term"))
        out = out.unionByName(t.select("term", F.lit("title").alias("field"), "event_id", number.alias("sequence_number"), "pos", F.col("pos").cast("bigint").alias("rp"), F.lit(False).alias("meta"), "len"))
    return out


def analysed_terms(rows: DataFrame) -> DataFrame:
    """Postings of the stemmed index: the distinct vocabulary is analysed, the text isn't touched again."""
    return rows.join(stemmed(rows.select("term")), "term").withColumn("term", F.col("stem")).drop("stem").select(*rows.columns)


def vocabulary(rows: DataFrame) -> DataFrame:
    """(term, df, cf): paragraphs and occurrences of each term in contents. Paragraphs without an
    event_id can't be told apart and count in cf alone."""
    rows = rows.where(F.col("field") == "content").groupBy("term", "event_id", "sequence_number").agg(F.count("*").alias("n"))
    return rows.groupBy("term").agg(F.count("event_id").alias("df"), F.sum("n").alias("cf"))


def numbered(paragraphs: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """paragraphs with meta and len."""
    x = paragraphs.withColumns({"meta": is_meta(), "len": F.size(tokens(F.col("content")))})
    if events is not None:
        titled = events.select("event_id", F.size(tokens(F.col("title"))).alias("_t"))
        x = x.join(titled, "event_id", "left").withColumn("len", F.col("len") + F.coalesce("_t", F.lit(0))).drop("_t")
    return x


@dataclass(frozen=True)
class Index:
    """What searches read: postings of either analyzer (KEEP, analyzer, term_bucket), paragraphs with
    meta and len, and one row of corpus statistics (N, avgdl)."""

    rows: DataFrame
    paragraphs: DataFrame
    stats: DataFrame

    def find(self, words: set[str], prefixes: set[str], analyzer: str) -> DataFrame:
        """Postings of the words, and of all terms with the prefixes: partitions are pruned by analyzer
        and bucket, row groups by term."""
        x = self.rows.where(F.col("analyzer") == analyzer)
        if all(len(p) > 1 for p in prefixes):
            x = x.where(F.col("term_bucket").isin(sorted({_bucket(w) for w in words | prefixes})))
        wanted = F.col("term").isin(sorted(words)) if words else F.lit(False)
        for p in sorted(prefixes):
            wanted = wanted | F.col("term").startswith(p)
        return x.where(wanted)


@cache
def _bucket(word: str) -> int:
    spark = SparkSession.active()
    return spark.range(1).select(term_bucket(F.lit(word))).first()[0]


def _with_analyzers(rows: DataFrame) -> DataFrame:
    both = rows.withColumn("analyzer", F.lit("exact")).unionByName(analysed_terms(rows).withColumn("analyzer", F.lit("stemmed")))
    return both.withColumn("term_bucket", term_bucket(F.col("term")))


def index_of(paragraphs: DataFrame, events: DataFrame | None = None) -> Index:
    """An index that is computed on each search: for a few documents."""
    full = numbered(paragraphs, events)
    return Index(_with_analyzers(postings(paragraphs, events)), full, _stats(full))


def _stats(paragraphs: DataFrame) -> DataFrame:
    return paragraphs.agg(F.count("*").alias("N"), F.avg("len").alias("avgdl"))


def write_index(paragraphs: DataFrame, events: DataFrame | None, path: str) -> DataFrame:
    """Write the index of paragraphs and titles; returns its status (table, n). Postings are
    range-partitioned by bucket, term and document, so a frequent term is several tasks' and files'
    work, and lie sorted by term in folders of analyzer and bucket; paragraphs are sorted by document."""
    spark = paragraphs.sparkSession
    exact = f"{path}/tokens"
    postings(paragraphs, events).write.mode("overwrite").parquet(exact)
    rows = _with_analyzers(spark.read.parquet(exact))
    order = ("analyzer", "term_bucket", "term", "event_id", "rp")
    rows.repartitionByRange(*order[:4]).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("analyzer", "term_bucket").parquet(f"{path}/postings")
    numbered(paragraphs, events).repartitionByRange("event_id").sortWithinPartitions("event_id", "sequence_number").write.mode("overwrite").parquet(f"{path}/paragraphs")
    out = read_index(spark, path)
    _stats(out.paragraphs).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    at = spark._jvm.org.apache.hadoop.fs.Path(exact)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    counts = out.rows.groupBy(F.concat(F.lit("postings "), "analyzer").alias("table")).agg(F.count("*").alias("n"))
    return counts.union(out.paragraphs.agg(F.lit("paragraphs"), F.count("*")))


def read_index(spark: SparkSession, path: str) -> Index:
    stats = f"{path}/stats"
    at = spark._jvm.org.apache.hadoop.fs.Path(stats)
    ready = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    paragraphs = spark.read.parquet(f"{path}/paragraphs")
    return Index(spark.read.parquet(f"{path}/postings"), paragraphs, spark.read.parquet(stats) if ready else _stats(paragraphs))
