"""Every query of the library against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tarnwatch import plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and (abs(a - b) <= 2e-6 * max(1, abs(a)) or math.isnan(a) and math.isnan(b)) or a == b
    return a == b


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda r: [str(x) for x in r if not isinstance(x, float)] + [x for x in r if isinstance(x, float)])
    rel = duck.sql(plans.ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    want = sorted(rel.select(", ".join(f'"{c}"' for c in columns)).fetchall(), key=lambda r: [str(x) for x in r if not isinstance(x, float)] + [x for x in r if isinstance(x, float)])
    assert len(got) == len(want)
    assert all(same(x, y) for a, b in zip(got, want) for x, y in zip(a, b))


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(plans.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
