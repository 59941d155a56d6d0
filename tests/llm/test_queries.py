"""Registered queries of the operators that have SQL, against DuckDB on the smallest tables."""

from pathlib import Path

import pytest

from quillframe.llm import queries

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the generated tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    base = duckdb.connect()
    for file in Path(FOLDER).glob("*.parquet"):
        base.execute(f"create view {file.stem} as select * from read_parquet('{file}')")
    want = base.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    frame = queries.QUERIES[name](spark, FOLDER)
    assert sorted(columns) == sorted(frame.columns)
    got = [tuple(r[c] for c in columns) for r in frame.collect()]
    assert sorted(got, key=repr) == sorted(map(tuple, want.fetchall()), key=repr)


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the generated tables")
@pytest.mark.parametrize("name", sorted(queries.PARTS))
def test_part_equals_its_sql(spark, monkeypatch, name):
    monkeypatch.setattr(queries, "QUERIES", queries.PARTS)
    monkeypatch.setattr(queries, "ORACLE_SQL", queries.PARTS_SQL)
    test_query_equals_its_sql(spark, name)
