"""Every query at the smallest scale against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from driftmap.plans import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("lineitem", "supplier"):
        c.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return repr(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted([plain(r[c]) for c in cols] for r in df.collect())
    if name not in registry.ORACLES:
        assert got
        return
    r = duck.sql(registry.ORACLES[name])
    assert sorted(r.columns) == cols
    at = [r.columns.index(c) for c in cols]
    assert got == sorted([plain(x[i]) for i in at] for x in r.fetchall())
