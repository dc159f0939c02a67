import duckdb
import pytest

from tickframe.llm.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    want = con.execute(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, DIR).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) > 0
    a, b = (sorted(map(tuple, x[sorted(got.columns)].astype(str).values.tolist())) for x in (got, want))
    assert [x for x in zip(a, b) if x[0] != x[1]][:5] == [] and len(a) == len(b)
