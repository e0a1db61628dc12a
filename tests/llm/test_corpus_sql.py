"""The corpus queries that have SQL against another engine."""

import duckdb
import pytest

from lodestone.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_phrases", "op12_centroids"])
def test_sql(spark, name):
    df, duck = QUERIES[name](spark, SF), duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert names == df.columns and sorted(map(tuple, df.collect())) == sorted(got.fetchall())
