"""Every query runs on the smallest tables and gives what its SQL gives in another engine."""

import duckdb
import pytest

from lodestone.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(value):
    if isinstance(value, float):
        return "nan" if value != value else f"{value:.6g}"
    return str(value) if not isinstance(value, bool) else str(int(value))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted([same(r[c]) for c in columns] for r in df.collect())
    if name not in ORACLE_SQL:
        assert rows
        return
    got = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    want = sorted([same(r[names.index(c)]) for c in columns] for r in got.fetchall())
    assert rows == want
