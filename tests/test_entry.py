"""The queries at the smallest scale against their SQL, and the contract's shape."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")
SLOW = {"temporal_transitions", "classifier"}


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return float(f"{float(v):.9g}") if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in SLOW])
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, str(DATA))
    rows = [tuple(r) for r in df.collect()]
    if name in entry.oracle_sql():
        cur = duck.execute(entry.oracle_sql()[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert normal(rows, df.columns) == normal(cur.fetchall(), names)


def test_sql_only_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
