"""Each panel query against its SQL on the smallest tables; those without SQL must give rows."""

import math
from pathlib import Path

import duckdb
import pytest

from riskpanel.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
#: Queries that have no row on the smallest tables: no quarter has 400 rows there. test_cohort_intervals tests them.
SPARSE = {"cohort_intervals"}
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(SF).iterdir():
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return f"{float(v):.8g}" if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else str(v)[:19]

    return sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    found = df.collect()
    if name in ORACLE_SQL:
        said = db.sql(ORACLE_SQL[name])
        assert sorted(df.columns) == sorted(said.columns)
        assert rows(df.columns, found) == rows(said.columns, said.fetchall())
    elif name not in SPARSE:
        assert found
