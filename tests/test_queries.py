"""Every registered query of the CSV engine that has SQL, against DuckDB on the smallest tables."""

import decimal
import math
from pathlib import Path

import pytest

from quillframe.plans import driver_queries

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return float(value) if isinstance(value, decimal.Decimal) else value


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the generated tables")
@pytest.mark.parametrize("name", sorted(driver_queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    base = duckdb.connect()
    for file in Path(FOLDER).glob("*.parquet"):
        base.execute(f"create view {file.stem} as select * from read_parquet('{file}')")
    want = base.execute(driver_queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    frame = driver_queries.QUERIES[name](spark, FOLDER)
    assert sorted(columns) == sorted(frame.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in frame.collect()]
    assert sorted(got, key=repr) == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)
