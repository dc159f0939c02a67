import duckdb
import pandas as pd
import pytest

from tickframe.plans.catalog import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple("-" if pd.isna(x) else f"{x + 0.0:.9g}" if isinstance(x, float) else str(x) for x in r) for r in frame.itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, duck, name):
    got = QUERIES[name](spark, DIR).toPandas()
    want = duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b) and len(a) > 0
    assert [x for x in zip(a, b) if x[0] != x[1]][:5] == []
