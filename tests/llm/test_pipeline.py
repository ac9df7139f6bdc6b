"""The pipeline's stages, each on its own input, against brute force."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folia.llm import language, quality
from tests.llm.test_operators import brute_links, brute_quality, brute_repeats

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before and after each stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        f(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((before, docs.collect()))
    return out


def test_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5
    for before, after in stages[:-1]:
        assert after[0].asDict().keys() == set(corpus_pipeline.COLUMNS) and len(after) <= len(before)


def test_quality(spark, stages):
    before, after = stages[0]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    failed = {r.doc_id for r in before if brute_quality(r.text)[-1]}
    assert not kept & failed
    good = [r.doc_id for r in before if labels.get(r.doc_id) == 1 and r.doc_id not in failed]
    assert sum(k in kept for k in good) >= 0.95 * len(good)
    assert all(r in before for r in after)


def test_language(stages):
    before, after = stages[1]
    assert {r.doc_id for r in before} == {r.doc_id for r in after}  # clean texts stay


def test_language_rejects(spark):
    rows = [(1, "12 34 !!", "en", "s", 8), (2, None, "en", "s", 0), *[(i, "the and with upon little street houses there this " * 3, "en", "s", 9) for i in range(3, 9)], *[(i, "der die das und mit nicht auf eine kleine Gasse " * 3, "de", "s", 9) for i in range(9, 15)]]
    rnd = random.Random(3)
    gibberish = " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(2, 9))) for _ in range(80))
    long = " ".join(rnd.choice("der die das und mit nicht auf eine kleine Gasse".split()) for _ in range(60_000))
    rows += [(15, gibberish, None, "s", 9), (16, long, None, "s", 9), (None, long[:300], "de", "s", 9), (17, "Все люди рождаются свободными", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, docs, SF).collect()} == {*range(3, 15), 16, None}


def awkward(spark):
    """Nulls in every column, repeated rows, one key with several texts, clashing and extra columns."""
    rnd = random.Random(9)
    stems = "the and with upon little street houses there this river stone quiet town never where people walk".split()
    prose = lambda n: " ".join(rnd.choice(stems) + rnd.choice(stems) for _ in range(n))
    a, b, c = prose(120), prose(150), prose(90)
    rows = [(1, a, "en", "s", 9), (1, a, "en", "s", 9), (1, b, "en", None, None), (2, a + " end", None, "s", 1), (None, c, "en", "s", 2), (None, c, "en", "t", 2), (None, prose(100), None, None, None), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (5, prose(40_000), "en", "s", 3), (6, "short", "en", "s", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return rows, df.withColumns({n: F.lit(7) for n in ("kept", "score", "i1", "k", "j", "length", "first", "_row")})


def test_awkward_rows_through_all_stages(spark):
    rows, docs = awkward(spark)
    stages = dict(corpus_pipeline.STAGES)
    good = [r for r in rows if r[1] and len(r[1]) > 5]
    out = stages["quality rules"](spark, docs, SF)
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted(good, key=str) and tuple(out.columns) == corpus_pipeline.COLUMNS
    out = stages["language ID"](spark, docs, SF)
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted((r for r in rows if r[1]), key=str)
    kept = [tuple(r) for r in stages["n-gram Jaccard join"](spark, docs, SF).collect()]
    want = [rows[0], rows[2], rows[4], rows[6], rows[7], rows[8], rows[9], rows[10]]
    assert sorted(kept, key=str) == sorted(want, key=str)
    texts = [(tuple(r)[0], r.text) for r in stages["substring dedup"](spark, docs, SF).collect()]
    assert len(texts) == len(rows) and (2, "") not in texts and sum(t == rows[0][1] for _, t in texts) == 2
    pieces = stages["best-fit packing"](spark, docs, SF).collect()
    assert sum(r.piece == 0 for r in pieces) == len(rows)


def test_near_duplicates(stages):
    before, after = stages[2]
    links = brute_links([(r.doc_id, r.text) for r in before])
    assert {r.doc_id for r in after} == {k for k, (c, _) in links.items() if c == k}


def test_substrings(stages):
    before, after = stages[3]
    want = brute_repeats([(r.doc_id, r.text) for r in before])
    source = {r.doc_id: r for r in before}
    for r in after:
        n, gone, kept = want[r.doc_id]
        assert r.text == (kept if gone else source[r.doc_id].text) and r.source == source[r.doc_id].source
        assert r.n_chars == (len(kept) if gone else source[r.doc_id].n_chars)
    assert len(after) == len(before)


def test_packing(stages):
    before, after = stages[4]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}
    held = collections.defaultdict(list)
    for r in after:
        held[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in v) <= 2048 for v in held.values())


def test_run_equals_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, got)) == sorted(map(key, stages[4][1]))


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, f in corpus_pipeline.STAGES:
        out = f(spark, docs, SF)
        assert out.count() == 0
        docs = out if set(out.columns) == set(corpus_pipeline.COLUMNS) else docs


def test_clean_documents_are_kept_at_a_larger_size(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.quality(docs, labels).join(labels, "doc_id").where("quality = 1 AND NOT base_failed")
    assert out.agg(F.avg(F.col("kept").cast("int"))).first()[0] > 0.98
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))))
    test = language.predict(docs.where(language.held_out(F.col("doc_id"))).select("lang", "text"), model)
    assert test.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
