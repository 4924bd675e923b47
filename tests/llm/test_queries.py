"""Every llm query beside its SQL, where it has one, on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

from lodestone.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent / "tools"))


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    from verify import rows

    got = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        con = duckdb.connect()
        for p in Path(SF).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')").fetchall()
        want = con.execute(SQL[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
