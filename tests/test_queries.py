"""Every core query beside its SQL on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

from lodestone.queries import all_queries, all_sql

SF = "/root/testdata/sf0.001"
sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')").fetchall()
    return c


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, con, name):
    from verify import rows

    got = all_queries()[name](spark, SF).toPandas()
    sql = all_sql().get(name)
    if sql:
        want = con.execute(sql).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
