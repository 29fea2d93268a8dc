"""Every registered practice query against its SQL, on the smallest tables."""

import math
import os

import pytest

from quillstone.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.exists(f"{SF}/events.parquet"):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def canonical(rows):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return f"{v:.9g}" if isinstance(v, float) else str(int(v)) if isinstance(v, bool) else str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    r = duck.execute(sql)
    names = [x[0] for x in r.description]
    assert sorted(names) == columns
    want = [tuple(dict(zip(names, x))[c] for c in columns) for x in r.fetchall()]
    assert canonical(got) == canonical(want)
