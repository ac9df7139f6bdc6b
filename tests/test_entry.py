"""Every query with equivalent SQL agrees with it on the small tables."""

import math
import os
from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    return round(v, 5) if isinstance(v, float) and not math.isnan(v) else v if v is None else str(v)


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
def test_archive_queries_agree_with_sql(spark):
    import duckdb

    from folia.plans.registry import ORACLES, QUERIES

    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    wrong = []
    only = os.environ.get("ONLY", "").split()
    for name, sql in ORACLES.items():
        if only and name not in only:
            continue
        df = QUERIES[name](spark, SF)
        cols = sorted(df.columns)
        got = sorted([tuple(norm(r[c]) for c in cols) for r in df.collect()], key=str)
        cursor = db.execute(sql)
        names = [d[0] for d in cursor.description]
        want = sorted([tuple(norm(r[names.index(c)]) for c in cols) for r in cursor.fetchall()], key=str) if sorted(names) == cols else names
        if got != want:
            wrong.append(name)
    assert not wrong


def test_entry_imports(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) >= 40


#: Each line ends in its own number; some have spaces of other kinds at their ends, or a tab.
LINES = [[f"that call in {i}.{i}" for i in range(24)], ["", "  1", " 2 11　", "\t3\t", " ", "4 that 44", "five in 5 55"], [" "], None]


@pytest.mark.parametrize("name", ["body_hashes", "index_vocabulary", "index_paragraphs", "archive_hits"])
def test_lines_that_end_in_their_number(spark, tmp_path, name):
    import duckdb

    from folia.plans.registry import ORACLES, QUERIES

    docs = [(i, None if x is None else "\n".join(x), "en", "web") for i, x in enumerate(LINES)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).select(columns).collect())) == sorted(want.fetchall())


#: Documents that share an id or have none; lines with carriage returns and vertical tabs.
ODD = [
    (1, "that in\nline"), (1, "that\nin other"), (2, "one"), (2, "one"), (None, "that in\nline"), (None, "that\nin other"),
    (3, "that 1\r\nin 2\r\n\r\nend"), (4, "that\rthat"), (5, "\r\n"), (6, "that\x0bin\x0b\nevent page"), (7, "\x0b"), (8, " \n"), (9, None),
]


def check_odd_documents(spark, folder, name, docs=ODD):
    import duckdb

    from folia.plans.registry import ORACLES, QUERIES

    spark.createDataFrame([(*d, "en", "web") for d in docs], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = db.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, QUERIES[name](spark, str(folder)).select(columns).collect()), key=str) == sorted(want.fetchall(), key=str)


@pytest.mark.parametrize("name", ["body_hashes", "index_paragraphs", "index_vocabulary"])
def test_odd_documents(spark, tmp_path, name):
    check_odd_documents(spark, tmp_path, name)


def test_vocabulary_of_latin_letters_with_marks(spark, tmp_path):
    """Each Latin letter with one mark of U+1E00 to U+1EFF is folded, in the SQL and in SQLite's index too."""
    import sqlite3
    import unicodedata

    letters = [chr(c) for c in range(0x1E00, 0x1F00) if len(unicodedata.normalize("NFD", chr(c))) == 2 and unicodedata.normalize("NFD", chr(c))[0].isascii()]
    assert len(letters) == 152
    text = "\n".join(f"p{c}q {c}{c}" for c in letters)
    check_odd_documents(spark, tmp_path, "index_vocabulary", [(1, text)])
    db = sqlite3.connect(":memory:")
    db.execute("""CREATE VIRTUAL TABLE f USING fts5(x, tokenize = "unicode61 remove_diacritics 1 categories 'L* N* Co Mn Mc'")""")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, 'row')")
    db.execute("INSERT INTO f VALUES (?)", (text + "\nếq",))

    from folia.functions.text import token_words

    assert sorted(set(token_words(text + "\nếq"))) == sorted(r[0] for r in db.execute("SELECT term FROM v"))
