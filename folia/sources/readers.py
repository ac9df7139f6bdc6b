"""Sources: CSV dumps, JSON documents, word-processor files, marked-up lines, pages, batch folders."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from folia.functions.text import role_slug
from folia.operators.index import chunk_blocks, chunk_lines
from folia.operators.writer import new_id
from folia.shipping import ship

FIELD = r"^@\s*([A-Za-z]+)\s*=\s*(.*)$"
BODY = "eventtext"


def place_of(text: Column) -> Column:
    """What follows `place:` up to the line's end or the words `event page`; null without it."""
    found = F.regexp_extract(text, r"(?is)place:\s*(.*?)(?=\n|event page)", 1)
    return F.when(text.rlike(r"(?is)place:\s*(.*?)(?=\n|event page)"), F.nullif(F.trim(found), F.lit("")))


def read_csv_dump(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, paragraphs) of a dump with id, title, time, language, eventText. Of rows with the
    same id the first is the event (by line order in the text); the paragraphs of all are kept."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"').where(F.coalesce(F.trim("id"), F.lit("")) != "")
    rows = rows.withColumn("_n", F.monotonically_increasing_id())
    w = W.partitionBy("id").orderBy("_n")
    first = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
    events = first.select(F.col("id").alias("event_id"), "title", F.col("time").alias("date"), place_of(F.col("eventText")).alias("location"), "language")
    return events, chunk_lines(rows, "id", "eventText")


def ingest_json(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, paragraphs, rejected) of documents (title, date, location, language, content):
    paragraphs count from 1; without any paragraph a document is rejected."""
    x = docs.withColumns({"event_id": new_id(F.col("title"), F.col("language")), "_p": chunk_blocks(F.coalesce("content", F.lit("")))})
    good = x.where(F.size("_p") > 0)
    paragraphs = good.select("event_id", F.posexplode("_p").alias("_i", "content")).select("event_id", (F.col("_i") + 1).alias("sequence_number"), "content")
    return good.drop("_p", "content"), paragraphs, x.where(F.size("_p") == 0).select(*docs.columns)


def header_and_body(lines: DataFrame, key: str = "path", order: str = "pos", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(headers, body) of marked-up lines: `@field=value` until the first other line, or until
    `@eventText=`, whose own value is the body's first paragraph. headers: (key, fields map)."""
    t = F.trim(F.coalesce(F.col(text), F.lit("")))
    name = F.lower(F.regexp_extract(t, FIELD, 1))
    x = lines.where(t != "").withColumns({"_name": name, "_value": F.trim(F.regexp_extract(t, FIELD, 2))})
    w = W.partitionBy(key).orderBy(order)
    starts = (F.col("_name") == "") | (F.col("_name") == BODY)
    x = x.withColumn("_in", F.max(starts.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)) == 1)
    heads = x.where(~F.col("_in"))
    last = heads.groupBy(key, "_name").agg(F.max_by("_value", order).alias("_value"))
    headers = last.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_name", "_value"))).alias("fields"))
    own = F.when(F.col("_name") == BODY, F.col("_value")).otherwise(F.trim(text))
    opened = F.max(F.when(F.col("_in"), 1)).over(w.rowsBetween(W.unboundedPreceding, -1))
    body = x.where("_in").withColumn("content", F.when(opened.isNull(), own).otherwise(F.trim(text))).where("content <> ''")
    seq = F.row_number().over(W.partitionBy(key).orderBy(order)).alias("sequence_number")
    style = role_slug(F.col("style")) if "style" in lines.columns else F.lit(None).cast("string")
    return headers, body.select(key, seq, "content", style.alias("role"))


def document_errors(headers: DataFrame, body: DataFrame, key: str = "path") -> DataFrame:
    """(key, error): empty document, missing title or no body; null where all is well."""
    n = body.groupBy(key).agg(F.count("*").alias("n"))
    x = headers.join(n, key, "full_outer")
    title = F.coalesce(F.trim(F.col("fields")["title"]), F.lit(""))
    error = F.when(F.col("fields").isNull() & F.col("n").isNull(), "empty document").when(title == "", "missing title").when(F.col("n").isNull(), "no body")
    return x.select(key, error.alias("error"))


def read_word_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, text, style): non-blank paragraphs of all .docx files below path, lock files aside."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").load(path)
    files = files.where(~F.element_at(F.split("path", "/"), -1).startswith("~$")).select("path", "content")

    def parse(batches):
        for pdf in batches:
            rows = [(p, i, t, s) for p, c in zip(pdf["path"], pdf["content"], strict=True) for i, (t, s) in enumerate(word_paragraphs(c))]
            yield pd.DataFrame(rows, columns=["path", "pos", "text", "style"])

    ship(spark)
    return files.mapInPandas(parse, "path string, pos int, text string, style string")


def word_paragraphs(content: bytes) -> list[tuple[str, str | None]]:
    """(text, style name) of the paragraphs of one file; none if it isn't a readable archive."""
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml"))
            styles = ElementTree.fromstring(z.read("word/styles.xml")) if "word/styles.xml" in z.namelist() else None
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []
    names = {s.get(f"{ns}styleId"): s.find(f"{ns}name").get(f"{ns}val") for s in styles.iter(f"{ns}style") if s.find(f"{ns}name") is not None} if styles is not None else {}
    out = []
    for p in body.iter(f"{ns}p"):
        text = "".join("\t" if n.tag == f"{ns}tab" else "\n" if n.tag == f"{ns}br" else n.text or "" for n in p.iter() if n.tag in (f"{ns}t", f"{ns}tab", f"{ns}br"))
        style = p.find(f"{ns}pPr/{ns}pStyle")
        name = style.get(f"{ns}val") if style is not None else None
        if text.strip():
            out.append((text.strip(), names.get(name, name)))
    return out


def batch_actions(files: DataFrame, path: str = "path") -> DataFrame:
    """files with action (add, modify, delete) by the folder that holds them; others are left out."""
    action = F.lower(F.regexp_extract(F.col(path), r"(?i)/(add|modify|delete)/[^/]+$", 1))
    return files.withColumn("action", action).where(F.col("action") != "")


ARCHIVE_BYTES = 1 << 31


def read_word_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, text, style, error): the paragraphs of all .docx files in the .zip archives below path,
    under `archive!/member`. Executors read the archives where they lie. Each file is read as far as
    it can be: one row with an error stands for an archive or member that can't (not an archive, too
    large, an archive inside an archive, empty, unreadable)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(path)
    ready = files.select("path", F.when(F.col("length") <= ARCHIVE_BYTES, F.col("content")).alias("content"))

    def parse(batches):
        for pdf in batches:
            rows = [r for p, c in zip(pdf["path"], pdf["content"], strict=True) for r in archive_rows(p, c)]
            yield pd.DataFrame(rows, columns=["path", "pos", "text", "style", "error"]).astype({"pos": "Int32"})

    ship(spark)
    return ready.mapInPandas(parse, "path string, pos int, text string, style string, error string")


def archive_rows(path: str, content: bytes | None) -> list[tuple]:
    bad = lambda at, why: (at, None, None, None, why)
    if content is None:
        return [bad(path, "too large")]
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        return [bad(path, "not an archive")]
    out = []
    for name in z.namelist():
        at, last = f"{path}!/{name}", plain_name(name)
        if name.lower().endswith(".zip"):
            out.append(bad(at, "an archive inside an archive"))
        elif last.lower().endswith(".docx") and not last.startswith("~$") and not name.startswith("__MACOSX/"):
            try:
                found = word_paragraphs(z.read(name))
            except (zipfile.BadZipFile, RuntimeError, OSError):  # damaged or encrypted
                found = []
            out += [(at, i, t, s, None) for i, (t, s) in enumerate(found)] or [bad(at, "unreadable")]
    return out or [bad(path, "empty archive")]


def parse_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, lang, language, body): markup stripped natively; scripts and styles go."""
    html = F.coalesce("html", F.lit(""))
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    body = F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))
    pick = lambda pattern: F.nullif(F.trim(F.regexp_extract(html, pattern, 1)), F.lit(""))
    return pages.select("page_id", "url", pick(r"(?is)<title>(.*?)</title>").alias("title"), pick(r'(?i)<html[^>]*\blang="([^"]*)"').alias("language"), body.alias("body"))


def plain_name(path: str) -> str:
    return re.sub(r"^.*/", "", path)


# Language codes of headers and file names.
LANGUAGE_CODES = {"EN": "English", "HI": "Hindi"}


def header_events(headers: DataFrame, key: str = "path") -> DataFrame:
    """Events of parsed headers: the language from its field, else the file name's `_LXX`, else
    Unknown; codes become names, other values title case; the short source stays with translations
    only; `none` and unknown languages of origin pass as they are."""
    f = lambda name: F.nullif(F.trim(F.col("fields")[name]), F.lit(""))
    codes = F.create_map(*[F.lit(x) for pair in LANGUAGE_CODES.items() for x in pair])
    raw = F.coalesce(f("language"), F.nullif(F.regexp_extract(key, r"(?i)_L([A-Za-z]{2})\.docx$", 1), F.lit("")))
    named = lambda c: F.coalesce(F.try_element_at(codes, F.upper(c)), F.initcap(c))
    origin = f("translatedfrom")
    source = F.when(origin.isNotNull() & (F.lower(origin) != "none"), f("sourceshort"))
    return headers.select(
        key, f("title").alias("title"), f("time").alias("date"), F.coalesce(named(raw), F.lit("Unknown")).alias("language"),
        F.coalesce(F.try_element_at(codes, F.upper(origin)), origin).alias("translated_from"), source.alias("source_short"),
    )
