import itertools
import random

import pytest
from pyspark.sql import functions as F

from folia.archive import Archive
from folia.functions.text import analysed_word, token_words, tokens
from folia.operators import search
from folia.operators.index import chunk_blocks, chunk_lines, index_of, read_index, write_index
from folia.plans.query import QuerySyntaxError, parse

EVENTS = [
    ("a", "Quiet Days ~ 01", "1974-05-08", "Pune", "English", None),
    ("b", "Quiet Days ~ 02", "1979/1981 ?", "Bombay", "en", "Hindi"),
    ("c", "Loud Nights ~ 01", None, None, "Hindi", "none"),
    ("d", "Silver Lake ~ 01", "1990", "Pune", "English", None),
    ("e", "Silver Lake ~ 02", "1991", "Pune", "English", None),
]
PARAGRAPHS = [
    ("a", 0, "river stone cloud"),  # front matter
    ("a", 1, "A river runs here"),
    ("a", 2, "then a stone falls"),
    ("a", 3, "and a cloud passes by, river and river"),
    ("b", 1, "river " + "word " * 40 + "end"),
    ("b", 2, "stone at the far side"),
    ("c", 1, "event page of river stone cloud"),
    ("c", 2, "नदी का पानी और पत्थर"),
    ("d", 1, "the Silver Lake shines"),
    ("d", 2, "nothing else"),
    ("e", 1, "women's river"),
]


@pytest.fixture(scope="module")
def unindexed(spark):
    """Searches analyse all paragraphs."""
    e = spark.createDataFrame(EVENTS, "event_id string, title string, date string, location string, language string, translated_from string")
    p = spark.createDataFrame(PARAGRAPHS, "event_id string, sequence_number int, content string")
    t = spark.createDataFrame([("a", "calm"), ("b", "calm"), ("a", "water")], "event_id string, tag string")
    return Archive(e, p, t)


@pytest.fixture(scope="module")
def archive(unindexed, tmp_path_factory):
    a = Archive(unindexed.events, unindexed.paragraphs, unindexed.tag_rows)
    a.reindex(str(tmp_path_factory.mktemp("index")))
    return a


def ids(df):
    return [r.event_id for r in df.collect()]


def test_record_level(archive):
    found = archive.search("river stone cloud").collect()
    assert [(r.event_id, r.hit_count) for r in found] == [("a", 3)]  # three words in three paragraphs; front matter doesn't count
    assert ids(archive.search("event page")) == []
    first = found[0]
    assert (first.total, first.total_hits, [h.hl for h in first.hits]) == (1, 3, ["A «river» runs here", "then a «stone» falls", "and a «cloud» passes by, «river» and «river»"])
    assert [h.sequence_number for h in archive.hits("river stone").collect()] and {r.event_id for r in archive.hits("river stone").collect()} == {"a", "b"}
    assert set(ids(archive.search("(river OR नदी) AND (stone OR पत्थर)"))) == {"a", "b", "c"}


def test_ranking(archive):
    found = archive.search("river").collect()
    assert {r.event_id for r in found} == {"a", "b", "c", "e"}
    assert [r.rank for r in found] == sorted(r.rank for r in found)


def test_near(archive):
    assert ids(archive.search("NEAR(river stone, 6)")) == ["a"]  # across a paragraph break
    assert ids(archive.search("NEAR(river stone, 1)")) == []
    assert set(ids(archive.search("NEAR(river stone, 100)"))) == {"a", "b"}
    assert set(ids(archive.search("NEAR(river stone, 100)"))) <= set(ids(archive.search("river stone")))
    assert [r.hit_count for r in archive.search("NEAR(river stone, 100)").collect()] == [1, 1]


def test_near_against_enumeration(spark):
    rnd, rows, want = random.Random(3), [], {}
    for d in range(60):
        paragraphs = [[rnd.choice("abcxyzuvw") for _ in range(rnd.randrange(1, 9))] for _ in range(rnd.randrange(1, 5))]
        rows += [(d, i + 1, " ".join(p)) for i, p in enumerate(paragraphs)]
        at = {w: [i for i, t in enumerate(t for p in paragraphs for t in p) if t == w] for w in "xyz"}
        spans = [(max(c) - min(c), min(c)) for c in itertools.product(*at.values())]
        if spans and min(spans)[0] <= 6:
            want[d] = min(spans)
    p = spark.createDataFrame(rows, "event_id int, sequence_number int, content string")
    query = parse("NEAR(x y z, 6)")
    got = {r.event_id: (r.span, r.lo) for r in search.within(search.occurrences(index_of(p), query.terms), query).collect()}
    assert got == want and len(want) > 5


def test_phrase_and_title(archive):
    assert set(ids(archive.search('"silver lake"'))) == {"d", "e"}  # e by its title alone
    assert ids(archive.search("title:quiet")) and set(ids(archive.search("title:quiet"))) == {"a", "b"}
    assert ids(archive.search("riv* NOT stone")) == ids(archive.search("river NOT stone"))


def test_filters(archive):
    assert set(ids(archive.search("river", language="English"))) == {"a", "b", "e"}
    assert set(ids(archive.search("river", original=True))) == {"a", "c", "e"}
    assert ids(archive.search("river", date_from="1980", date_to="1985")) == ["b"]
    assert [r.title for r in archive.search("river", sort="title").collect()] == sorted(r.title for r in archive.search("river").collect())
    with pytest.raises(ValueError):
        archive.search("river", limit=0)


def test_hits_and_document(archive):
    hits = archive.hits("river").where("event_id = 'a'").orderBy("sequence_number").collect()
    assert [h.hl for h in hits] == ["A «river» runs here", "and a cloud passes by, «river» and «river»"]  # front matter isn't shown
    phrase = archive.document("d", q='"silver lake"').collect()
    assert [r.hl for r in phrase] == ["the «Silver Lake» shines", None]
    doc = archive.document("a", q="NEAR(river stone, 6)").collect()
    assert [(r.sequence_number, r.hl) for r in doc if r.hl] == [(1, "A «river» runs here"), (2, "then a «stone» falls")]
    assert [r.event_id for r in archive.document(title="Silver Lake ~ 01").collect()] == ["d", "d"]


def test_catalog(archive):
    rows = {r.event_id: r.tags for r in archive.catalog().collect()}
    assert rows["a"] == ["calm", "water"] and rows["d"] == []
    assert [(r.tag, r.cnt) for r in archive.tags().collect()] == [("calm", 2), ("water", 1)]
    assert archive.date_range().first().asDict() == {"min_year": "1974", "max_year": "1991"}
    assert [r.title for r in archive.hierarchy().where("year = 'Undated' AND series = 'Loud Nights'").collect()] == ["Loud Nights ~ 01"]
    assert {r.event_id for r in archive.browse(year="1990", location="Pune").collect()} == {"d"}
    with pytest.raises(ValueError):
        archive.list_documents(per_page=201)
    assert ids(archive.list_documents(tag="water")) == ["a"]
    bounds = ((1975, "first"), (None, "second"))
    assert [(r.cluster, r.cnt) for r in archive.clusters("timeline", bounds).collect()] == [("first", 1), ("second", 3), ("Unknown", 1)]


def test_written_index(spark, archive, unindexed, tmp_path):
    for q in ("river stone", "title:quiet"):
        a, b = (sorted((r.event_id, r.hit_count, round(r.rank, 6), str(r.hits)) for r in x.search(q).collect()) for x in (archive, unindexed))
        assert a == b and a
    path = str(tmp_path / "i")
    assert {r.table for r in write_index(archive.paragraphs, archive.events, path).collect()} == {"postings exact", "postings stemmed", "paragraphs"}
    plan = read_index(spark, path).find({"river"}, set(), "exact")._jdf.queryExecution().toString()
    filters = plan[plan.index("PartitionFilters") :]
    assert "term_bucket" in filters and "EqualTo(term,river)" in filters
    assert read_index(spark, path).find({"river"}, set(), "exact").count() == 7


def test_stems_accents_and_nasals(spark, tmp_path):
    rows = [("a", 1, "they were meditating"), ("b", 1, "a meditation on meditators"), ("c", 1, "यह अन्त है"), ("d", 1, "यह अंत है"), ("e", 1, "un été chaud"), ("f", 1, "un e\u0301te\u0301 froid")]
    p = spark.createDataFrame(rows, "event_id string, sequence_number int, content string")
    e = spark.createDataFrame([(r[0], f"T {r[0]}", None, None, "x", None) for r in rows], "event_id string, title string, date string, location string, language string, translated_from string")
    a = Archive(e, p)
    a.reindex(str(tmp_path / "i"))
    assert set(ids(a.search("meditate"))) == {"a", "b"} and ids(a.search("meditate", exact=True)) == []
    assert ids(a.search("meditating", exact=True)) == ["a"]
    assert set(ids(a.search("अन्त"))) == set(ids(a.search("अंत"))) == {"c", "d"} and ids(a.search("अन्त", exact=True)) == ["c"]
    assert set(ids(a.search("ete"))) == set(ids(a.search("été"))) == set(ids(a.search("e\u0301te\u0301", exact=True))) == {"e", "f"}
    assert {r.hl for r in a.hits("ETE").collect()} == {"un «été» chaud", "un «e\u0301te\u0301» froid"}
    assert set(ids(a.search("medit*"))) == {"a", "b"} and ids(a.search("meditat*")) == []  # prefixes are of stems


def test_query_words_are_split_as_texts_are(spark):
    for t in ("e\u0301te\u0301 Été", "a_b-c 1½ नदी का", "漢字かな x\u0331y", "İstanbul ǅ", "\u0301 a", "women's"):
        assert list(token_words(t)) == spark.createDataFrame([(t,)], "t string").select(tokens(F.col("t"))).first()[0]


def test_columns_first_words_and_joined_phrases(archive):
    assert set(ids(archive.search("{title}: (quiet OR silver)"))) == {"a", "b", "d", "e"}
    assert ids(archive.search("{content}: quiet")) == []
    assert set(ids(archive.search("{content title_search}: silver"))) == {"d", "e"}
    assert set(ids(archive.search("^river"))) == {"a", "b"} and ids(archive.search("^stone")) == ["b"]
    assert ids(archive.search("silver + lake")) == ids(archive.search("{content}: (silver + lake)")) == ["d"]
    assert ids(archive.search("NEAR(river cloud)")) == ["a"]  # inside one paragraph
    assert ids(archive.search("title:love")) == []
    for q in ("silver +", "{nowhere}: x", "x" * 501):
        with pytest.raises(QuerySyntaxError):
            archive.search(q)


def test_results_have_totals_and_too_many_are_trimmed(archive):
    found = archive.search("river", limit=1).collect()
    assert len(found) == 1 and (found[0].total, found[0].total_hits) == (4, 6)  # all documents, front matter among the hits
    assert len(found[0].hits) <= 3 and all(h.content is None and "«" in h.hl for h in found[0].hits)
    trimmed = search.search(archive.index, "river", archive.events, most=3).collect()
    assert all(len(r.hits) <= 1 and r.total == 4 for r in trimmed)
    phrase = archive.search('"silver lake"').collect()
    assert {(r.event_id, r.hit_count, len(r.hits)) for r in phrase} == {("d", 1, 1), ("e", 1, 0)} and phrase[0].total == 2


def test_blocks(spark):
    df = spark.createDataFrame([("x" * 25 + "\n\nshort\n\n" + "y" * 30,), ("a line of ten\nno",), ("no",)], "c string")
    assert [r[0] for r in df.select(F.size(chunk_blocks(F.col("c")))).collect()] == [2, 1, 0]


def sqlite(tokenizer, rows):
    import sqlite3

    db = sqlite3.connect(":memory:")
    try:
        db.execute(f"CREATE VIRTUAL TABLE t USING fts5(content, tokenize=\"{tokenizer}\")")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5")
    for r in rows:
        db.execute("INSERT INTO t VALUES (?)", (r[2],))
    return db


def test_bm25_agrees_with_sqlite(spark):
    rows = [p for p in PARAGRAPHS if p[2].isascii()]
    db = sqlite("unicode61 remove_diacritics 1", rows)
    p = spark.createDataFrame(rows, "event_id string, sequence_number int, content string")
    i = index_of(p)
    for q in ("stone", "river OR stone", '"river stone"'):
        want = {(rows[n - 1][0], rows[n - 1][1]): s for n, s in db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (q,))}
        query = parse(q)
        occ = search.occurrences(i, query.terms, exact=True)
        got = {(r.event_id, r.sequence_number): r.score for r in search.bm25(i, occ, query, search.paragraph_hits(i, occ, query)).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_stemmed_matches_agree_with_sqlite(spark, tmp_path):
    rnd = random.Random(4)
    parts = ("relat", "hop", "medit", "gener", "troubl", "agre", "controll", "happ", "form")
    ends = ("", "e", "ed", "es", "ing", "ion", "ional", "ations", "er", "ers", "y", "iness", "ly", "able", "ement", "ity", "ful", "s", "ize", "izing")
    word = lambda: rnd.choice(parts) + rnd.choice(ends)
    rows = [(f"d{i}", 1, " ".join(word() for _ in range(4))) for i in range(300)]
    db = sqlite("porter unicode61 remove_diacritics 1", rows)
    write_index(spark.createDataFrame(rows, "event_id string, sequence_number int, content string"), None, str(tmp_path / "i"))
    i = read_index(spark, str(tmp_path / "i"))
    for _ in range(12):
        a, b, c = word(), word(), word()
        q = rnd.choice((a, f"{a} OR {b}", f'"{a} {b}"', f"({a} OR {b}) AND NOT {c}".replace("AND NOT", "NOT"), f"^{a}", f"{a} + {b}"))
        want = {rows[n - 1][0] for (n,) in db.execute("SELECT rowid FROM t WHERE t MATCH ?", (q,))}
        query = parse(q, analysed_word)
        got = {r.event_id for r in search.paragraph_hits(i, search.occurrences(i, query.terms), query).collect()}
        assert got == want, q


def test_lines_keep_their_ends(spark):
    # A line's number was given to trim() as the characters to take away: line 1 lost a 1 at its end.
    lines = ["call 0", " call 171 ", "2", "", " three 3　", " ", "\tfive 5\t"]
    d = spark.createDataFrame([(7, "\n".join(lines))], "doc_id long, text string")
    assert [(r.sequence_number, r.content) for r in chunk_lines(d).orderBy("sequence_number").collect()] == [(0, "call 0"), (1, "call 171"), (2, "2"), (3, "three 3"), (4, "\tfive 5\t")]
    blocks = spark.createDataFrame([("0" * 20 + "\n\n " + "1" * 20 + "\n\n" + "2" * 19,), ("0000000000\n22 ",)], "c string").select(chunk_blocks(F.col("c")).alias("b"))
    assert [r.b for r in blocks.collect()] == [["0" * 20, "1" * 20], ["0000000000"]]


def test_marks_agree_with_sqlite(spark):
    rows = [("a", 0, "river river"), ("a", 1, "a river river river, River."), ("a", 2, "Ríver of rïver and rivers"), ("b", 0, "in river that river in"), ("b", 1, "«river» river"), ("b", 2, "íñ in Íñ")]
    db = sqlite("unicode61 remove_diacritics 1 categories 'L* N* Co Mn Mc'", rows)
    i = index_of(spark.createDataFrame(rows, "event_id string, sequence_number int, content string"))
    for q in ("river", "in", "river OR in"):
        want = {rows[n - 1][:2]: s for n, s in db.execute("SELECT rowid, highlight(t, 0, '[', ']') FROM t WHERE t MATCH ?", (q,))}
        x = i.paragraphs.join(search.marks(search.occurrences(i, parse(q).terms, exact=True)), ["event_id", "sequence_number"])
        hl = search.highlight(F.col("content"), F.col("starts"), F.col("ends"), "[", "]").alias("hl")
        assert {(r.event_id, r.sequence_number): r.hl for r in x.select("event_id", "sequence_number", hl).collect()} == want, q
