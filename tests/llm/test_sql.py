import duckdb
import pytest

from arkloom.llm import queries

TABLES = ("documents", "embeddings", "pages", "conversations", "labels")


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, f"/root/testdata/{sf}")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = sorted(c[0] for c in want.description)
    at = [[c[0] for c in want.description].index(c) for c in columns]
    assert sorted(got.columns) == columns
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())
