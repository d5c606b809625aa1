"""Every registered query of the record operators against its SQL in DuckDB."""

import os

import duckdb
import pytest

from mktstream.plans.queries import TABLE

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", TABLE)
def test_query_matches_sql(spark, name, tmp_path):
    query, sql = TABLE[name]
    out = str(tmp_path / name)
    query(spark, SF).write.parquet(out)
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    con.execute(f"CREATE TABLE want AS {sql}")
    columns = sorted(r[0] for r in con.sql("DESCRIBE want").fetchall())
    assert columns == sorted(r[0] for r in con.sql(f"DESCRIBE SELECT * FROM '{out}/*.parquet'").fetchall())
    pick = ", ".join(columns)
    kinds = [dict(con.sql(f"SELECT column_name, column_type FROM (DESCRIBE {q})").fetchall()) for q in ("want", f"SELECT * FROM '{out}/*.parquet'")]
    assert kinds[0] == kinds[1]
    for a, b in (("want", f"'{out}/*.parquet'"), (f"'{out}/*.parquet'", "want")):
        assert con.sql(f"SELECT count(*) FROM (SELECT {pick} FROM {a} EXCEPT ALL SELECT {pick} FROM {b})").fetchall() == [(0,)]
