"""Matching, ranking and display over an index's postings: a search reads the postings of its own
words, and paragraphs only to show them. Every entry returns a DataFrame; nothing is collected.

Record level: each unit is looked for in all paragraphs at once (one aggregation by document).
Within-N: positions are document-global, the smallest window ends at some position and starts at the
smallest of the units' latest positions before it, so one running window suffices.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from folia.functions.text import MARKS, TOKEN, analysed_word
from folia.operators.index import Index
from folia.plans.query import Node, SearchQuery, Term, parse

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
HITS, TOO_MANY = 3, 500
SORTS = ("rank", "title", "date")
#: A token of a text as it is written: no token is made of marks alone that folding takes away.
_MARKS = f"[\\u{MARKS.start:04x}-\\u{MARKS.stop - 1:04x}]"
SHOWN = f"{_MARKS}*(?!{_MARKS}){TOKEN}"


def occurrences(index: Index, terms: tuple[Term, ...], exact: bool = False) -> DataFrame:
    """(i, event_id, sequence_number, pos, rp, meta, len, n): the places of terms[i], n tokens long; in
    titles without a paragraph. One scan for all terms of a word, one for each phrase."""
    analyzer = "exact" if exact else "stemmed"
    keep = ("event_id", "sequence_number", "pos", "rp", "meta", "len")
    parts = []
    fits = lambda t, k: F.col("term").startswith(t.words[k]) if t.prefix and k == len(t.words) - 1 else F.col("term") == t.words[k]
    in_place = lambda t: (F.col("field") == t.field) & ((F.col("pos") == 0) if t.first and len(t.words) == 1 else F.lit(True))
    single = [(i, t) for i, t in enumerate(terms) if len(t.words) == 1]
    if single:
        found = index.find({t.words[0] for _, t in single if not t.prefix}, {t.words[0] for _, t in single if t.prefix}, analyzer)
        which = F.array_compact(F.array(*[F.when(fits(t, 0) & in_place(t), F.lit(i)) for i, t in single]))
        parts.append(found.select(F.explode(which).alias("i"), *keep, F.lit(1).alias("n")))
    for i, t in enumerate(terms):
        if (n := len(t.words)) == 1:
            continue
        last = {t.words[-1]} if t.prefix else set()
        found = index.find({*t.words[: n - 1], *(() if t.prefix else t.words[-1:])}, last, analyzer).where(in_place(t))
        places = F.array_compact(F.array(*[F.when(fits(t, k), F.lit(k)) for k in range(n)]))
        x = found.select(*keep, F.explode(places).alias("k"))
        x = x.groupBy("event_id", "sequence_number", (F.col("pos") - F.col("k")).alias("pos"), (F.col("rp") - F.col("k")).alias("rp"), "meta", "len").agg(F.count_distinct("k").alias("c"))
        x = x.where((F.col("c") == n) & ((F.col("pos") == 0) if t.first else F.lit(True)))
        parts.append(x.select(F.lit(i).alias("i"), *keep, F.lit(n).alias("n")))
    return reduce(DataFrame.unionByName, parts)


def _numbers(query: SearchQuery) -> list[list[int]]:
    """Of each group the numbers of its terms in query.terms."""
    out, at = [], 0
    for g in query.groups:
        out.append(list(range(at, at + len(g))))
        at += len(g)
    return out


def _group_of(query: SearchQuery, bit: bool = False) -> Column:
    """The group to which term i belongs, or its bit."""
    return F.get(F.array(*[F.lit(1 << g if bit else g).cast("bigint") for g, ns in enumerate(_numbers(query)) for _ in ns]), F.col("i"))


def all_words(occ: DataFrame, query: SearchQuery) -> DataFrame:
    """(event_id, hit_count, rank) of documents with every unit in some paragraph that isn't front
    matter; hit_count: such paragraphs with any unit."""
    x = occ.where(~F.col("meta")).groupBy("event_id", "sequence_number").agg(F.bit_or(_group_of(query, bit=True)).alias("g"))
    x = x.groupBy("event_id").agg(F.count("*").alias("hit_count"), F.bit_or("g").alias("g"))
    return x.where(F.col("g") == (1 << len(query.groups)) - 1).select("event_id", "hit_count", (-F.log1p("hit_count")).alias("rank"))


def within(occ: DataFrame, query: SearchQuery) -> DataFrame:
    """(event_id, span, lo, hi, hit_count, rank) of documents whose smallest covering window is no
    wider than the distance; the leftmost of equal ones. A query without a distance of its own looks
    for windows inside a paragraph, with at most the distance of tokens between the words."""
    inside = query.level == "paragraph_near"
    key = ["event_id", "sequence_number"] if inside else ["event_id"]
    at = "pos" if inside else "rp"
    x = occ.where(~F.col("meta")).select(*key, F.col(at).cast("bigint").alias("rp"), _group_of(query).alias("g"))
    w = W.partitionBy(*key).orderBy("rp").rangeBetween(W.unboundedPreceding, W.currentRow)
    lefts = [F.max(F.when(F.col("g") == i, F.col("rp"))).over(w) for i in range(len(query.groups))]
    x = x.select(*key, "rp", *[c.alias(f"l{i}") for i, c in enumerate(lefts)])
    lefts = [F.col(f"l{i}") for i in range(len(query.groups))]
    x = x.where(reduce(lambda a, b: a & b, [c.isNotNull() for c in lefts])).withColumn("lo", F.least(*lefts))
    best = x.groupBy(*key).agg(F.min(F.struct((F.col("rp") - F.col("lo")).alias("span"), F.col("lo"), F.col("rp").alias("hi"))).alias("b"))
    most = query.distance + 1 if inside else query.distance
    return best.where(F.col("b.span") <= most).select(*key, "b.span", "b.lo", "b.hi", F.lit(1).cast("bigint").alias("hit_count"), (-F.log1p(F.lit(1))).alias("rank"))


def _holds(node: Node, has: Callable[[int], Column], at: list[int]) -> Column:
    """A paragraph-level query as one boolean column; has(i): the paragraph has term i."""
    if node.op == "term":
        at.append(at[-1] + 1)
        return has(at[-2])
    parts = [_holds(p, has, at) for p in node.parts]
    if node.op == "not":
        return parts[0] & ~parts[1]
    return reduce(lambda a, b: a & b, parts) if node.op == "and" else reduce(lambda a, b: a | b, parts)


def paragraph_hits(index: Index, occ: DataFrame, query: SearchQuery) -> DataFrame:
    """(event_id, sequence_number, meta, len, f0, f1, ...): paragraphs in which the query holds, front
    matter included, and how often each term stands there. A title's words stand in every paragraph of
    their document."""
    n = len(query.terms)
    freq = [F.count_if(F.col("i") == i).alias(f"f{i}") for i in range(n)]
    own = occ.where(F.col("sequence_number").isNotNull()).groupBy("event_id", "sequence_number", "meta", "len").agg(*freq)
    if any(t.field == "title" for t in query.terms):
        titles = occ.where(F.col("sequence_number").isNull()).groupBy("event_id").agg(*[f.alias(f"t{i}") for i, f in enumerate(freq)])
        all_of = index.paragraphs.select("event_id", "sequence_number", "meta", "len").join(titles, "event_id", "left")
        own = all_of.join(own.drop("meta", "len"), ["event_id", "sequence_number"], "left")
        either = [(F.coalesce(f"t{i}", F.lit(0)) + F.coalesce(f"f{i}", F.lit(0))).alias(f"f{i}") for i in range(n)]
        own = own.select("event_id", "sequence_number", "meta", "len", *either)
    return own.where(_holds(query.tree, lambda i: F.col(f"f{i}") > 0, [0]))


def bm25(index: Index, occ: DataFrame, query: SearchQuery, hits: DataFrame) -> DataFrame:
    """(event_id, sequence_number, meta, score) of hits: the smaller the better. Statistics are exact
    over all paragraphs; a paragraph's length counts its document's title too."""
    n = len(query.terms)
    df = occ.where(F.col("sequence_number").isNotNull()).groupBy("i").agg(F.count_distinct("event_id", "sequence_number").alias("df"))
    if any(t.field == "title" for t in query.terms):
        sizes = index.paragraphs.groupBy("event_id").agg(F.count("*").alias("df"))
        titled = occ.where(F.col("sequence_number").isNull()).select("i", "event_id").distinct().join(sizes, "event_id")
        df = df.unionByName(titled.groupBy("i").agg(F.sum("df").alias("df")))
    dfs = df.agg(*[F.coalesce(F.max(F.when(F.col("i") == i, F.col("df"))), F.lit(0)).alias(f"n{i}") for i in range(n)])
    y = hits.join(F.broadcast(index.stats.join(dfs)))  # one row each
    score = F.lit(0.0)
    for i in range(n):
        idf = F.greatest(F.log((F.col("N") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5)), F.lit(LEAST_IDF))
        f = F.col(f"f{i}").cast("double")
        score = score - idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    return y.select("event_id", "sequence_number", "meta", score.alias("score"))


def by_document(scored: DataFrame) -> DataFrame:
    """(event_id, hit_count, best, rank): hits boost the best paragraph's score."""
    x = scored.groupBy("event_id").agg(F.count("*").alias("hit_count"), F.min("score").alias("best"))
    return x.withColumn("rank", F.col("best") * F.greatest(F.log1p("hit_count"), F.lit(1.0)))


def title_only(index: Index, query: SearchQuery, content_hits: DataFrame, exact: bool = False) -> DataFrame:
    """(event_id): documents whose title has the phrase while no paragraph does."""
    terms = tuple(replace(t, field="title") for t in query.terms)
    x = occurrences(index, terms, exact).groupBy("event_id").agg(F.count_distinct("i").alias("c")).where(F.col("c") == len(terms))
    return x.select("event_id").join(content_hits.select("event_id").distinct(), "event_id", "left_anti")


def totals(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count_distinct("event_id").alias("total"), F.count("*").alias("total_hits"))


def first_hits(hits: DataFrame, n: int = HITS, order: str = "sequence_number") -> DataFrame:
    """The first n matching paragraphs of each document (a group limit before the shuffle), with the
    document's full count joined on."""
    w = W.partitionBy("event_id").orderBy(*dict.fromkeys((order, "sequence_number")))
    top = hits.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
    return top.join(hits.groupBy("event_id").agg(F.count("*").alias("hit_count")), "event_id")


def check(limit: int, sort: str) -> None:
    if not 1 <= limit <= 500:
        raise ValueError("limit is 1 to 500")
    if sort not in SORTS:
        raise ValueError(f"sort is one of {', '.join(SORTS)}")


def top(ranked: DataFrame, limit: int = 200, sort: str = "rank", events: DataFrame | None = None) -> DataFrame:
    """The best documents, ties by id; sort by title or date reorders them after the cut."""
    check(limit, sort)
    out = ranked.orderBy("rank", "event_id").limit(limit)
    if events is not None:
        out = out.join(events, "event_id", "left")
    if sort == "title":
        return out.orderBy(F.lower(F.coalesce("title", F.lit(""))), "event_id")
    if sort == "date":
        return out.orderBy(F.coalesce("date", F.lit("9999")), "event_id")
    return out.orderBy("rank", "event_id")


def highlight(content: Column, starts: Column, ends: Column, open_: str = "«", close: str = "»") -> Column:
    """content with marks before the tokens numbered in starts and after those in ends: what the index
    found is shown, whatever its stems or accents."""
    words, gaps = F.regexp_extract_all(content, F.lit(SHOWN), F.lit(0)), F.split(content, SHOWN)
    mark = lambda at, i, sign: F.when(F.array_contains(at, i), sign).otherwise("")
    marked = F.transform(words, lambda w, i: F.concat(F.get(gaps, i), mark(starts, i, open_), w, mark(ends, i, close)))
    return F.concat(F.array_join(marked, ""), F.coalesce(F.element_at(gaps, -1), F.lit("")))


def marks(occ: DataFrame) -> DataFrame:
    """(event_id, sequence_number, starts, ends) of the terms' places in paragraphs."""
    x = occ.where(F.col("sequence_number").isNotNull()).groupBy("event_id", "sequence_number")
    return x.agg(F.collect_set("pos").alias("starts"), F.collect_set(F.col("pos") + F.col("n") - 1).alias("ends"))


def positive(query: SearchQuery) -> list[int]:
    """Numbers of the terms that a hit may show: all but those after NOT."""
    out: list[int] = []

    def walk(node: Node, at: int, good: bool) -> int:
        if node.op == "term":
            if good:
                out.append(at)
            return at + 1
        for j, p in enumerate(node.parts):
            at = walk(p, at, good and not (node.op == "not" and j))
        return at

    if query.tree is None:
        return list(range(len(query.terms)))
    walk(query.tree, 0, True)
    return out


def window_hits(occ: DataFrame, spans: DataFrame) -> DataFrame:
    """occ inside the documents' windows."""
    key = ["event_id", "sequence_number"] if "sequence_number" in spans.columns else ["event_id"]
    at = F.col("pos") if len(key) == 2 else F.col("rp")
    return occ.where(~F.col("meta")).join(spans.select(*key, "lo", "hi"), key).where(at.between(F.col("lo"), F.col("hi"))).select(occ.columns)


@dataclass(frozen=True)
class Found:
    """ranked: (event_id, hit_count, rank) of all documents; hits: (event_id, sequence_number, score),
    paragraphs to show, the first ones lowest; shown: the places to mark; totals: one row."""

    ranked: DataFrame
    hits: DataFrame
    shown: DataFrame
    totals: DataFrame


def find(index: Index, q: str, allowed: DataFrame | None = None, exact: bool = False) -> Found:
    """allowed: (event_id) of the documents that filters leave."""
    query = parse(q, None if exact else analysed_word)
    occ = occurrences(index, query.terms, exact)
    only = (lambda x: x.join(allowed, "event_id", "left_semi")) if allowed is not None else (lambda x: x)
    shown = only(occ.where(F.col("i").isin(positive(query))))
    by_place = lambda x: x.where(~F.col("meta")).select("event_id", "sequence_number", F.col("sequence_number").cast("double").alias("score")).distinct()
    if query.level in ("near", "paragraph_near"):
        spans = within(only(occ), query)
        shown = window_hits(shown, spans)
        ranked = spans.groupBy("event_id").agg(F.count("*").alias("hit_count"), F.min("rank").alias("rank"))
        return Found(ranked, by_place(shown), shown, spans.agg(F.count_distinct("event_id").alias("total"), F.count("*").alias("total_hits")))
    if query.level == "record":
        ranked = all_words(only(occ), query)
        return Found(ranked, by_place(shown.join(ranked, "event_id", "left_semi")), shown, ranked.agg(F.count("*").alias("total"), F.coalesce(F.sum("hit_count"), F.lit(0)).alias("total_hits")))
    hits = only(paragraph_hits(index, occ, query))
    scored = bm25(index, occ, query, hits)
    ranked, total = by_document(scored).select("event_id", "hit_count", "rank"), totals(hits)
    if query.phrase_only:
        titled = only(title_only(index, query, hits, exact)).select("event_id", F.lit(1).cast("bigint").alias("hit_count"), F.lit(0.0).alias("rank"))
        ranked = ranked.unionByName(titled)
        total = total.join(titled.agg(F.count("*").alias("_t"))).select((F.col("total") + F.col("_t")).alias("total"), "total_hits")
    return Found(ranked, scored.where(~F.col("meta")).select("event_id", "sequence_number", "score"), shown, total)


def search(index: Index, q: str, events: DataFrame, where: Column | None = None, limit: int = 200, sort: str = "rank", exact: bool = False, n: int = HITS, most: int = TOO_MANY) -> DataFrame:
    """The best documents of a query: the events' columns, hit_count, rank, total, total_hits, and hits,
    their first n paragraphs with hl (content only where nothing is marked). Of more than `most`
    documents each has one hit, without content. where filters events."""
    check(limit, sort)
    found = find(index, q, events.where(where).select("event_id") if where is not None else None, exact)
    best = found.ranked.orderBy("rank", "event_id").limit(limit)
    hits = first_hits(found.hits.join(F.broadcast(best.select("event_id")), "event_id", "left_semi"), n, "score").select("event_id", "sequence_number", "rn")
    # At most n hits of at most 500 documents.
    shown = F.broadcast(hits.join(marks(found.shown), ["event_id", "sequence_number"], "left"))
    x = index.paragraphs.join(shown, ["event_id", "sequence_number"])
    hl = highlight(F.col("content"), F.coalesce("starts", F.array().cast("array<int>")), F.coalesce("ends", F.array().cast("array<int>")))
    role = [c for c in ("role",) if c in index.paragraphs.columns]
    x = x.select("event_id", "rn", "sequence_number", *role, "content", hl.alias("hl")).withColumn("content", F.when(F.col("hl") == F.col("content"), F.col("content")))
    lists = x.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("rn", "sequence_number", *role, "content", "hl"))).alias("hits"))
    kind = lists.schema["hits"].dataType
    out = best.join(lists, "event_id", "left").withColumn("hits", F.coalesce("hits", F.array().cast(kind))).join(F.broadcast(found.totals))
    out = out.withColumn("hits", F.when(F.col("total") <= most, F.col("hits")).otherwise(_without_content(F.slice("hits", 1, 1))))
    return top(out, limit, sort, events)


def _without_content(hits: Column) -> Column:
    return F.transform(hits, lambda h: h.withField("content", F.lit(None).cast("string")))


def document(index: Index, events: DataFrame, event_id=None, title: str | None = None, q: str | None = None, exact: bool = False) -> DataFrame:
    """One document's paragraphs in order, with hl where the query stands. By title the earliest date."""
    one = events.where(F.col("event_id") == event_id) if event_id is not None else events.where(F.col("title") == title).orderBy(F.coalesce("date", F.lit("")), "event_id").limit(1)
    one = F.broadcast(one.select("event_id"))
    out = index.paragraphs.drop("meta", "len").join(one, "event_id")
    if q:
        places = marks(find(index, q, one, exact).shown)
        out = out.join(places, ["event_id", "sequence_number"], "left").withColumn("hl", F.when(F.col("starts").isNotNull(), highlight(F.col("content"), F.col("starts"), F.col("ends")))).drop("starts", "ends")
    return out.orderBy("sequence_number")
