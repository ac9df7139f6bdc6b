"""Queries that SQL can express agree with it on the small tables."""

from pathlib import Path

import pytest

from folia.llm.registry import ORACLES, QUERIES
from tests.test_entry import SF, TABLES, norm


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted([tuple(norm(r[c]) for c in cols) for r in df.collect()], key=str)
    cursor = db.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == cols
    assert got == sorted([tuple(norm(r[names.index(c)]) for c in cols) for r in cursor.fetchall()], key=str)
