"""Every registered query of the core against its SQL."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from impactframe import queries  # noqa: E402

DATA = "/root/testdata/sf0.001"
REGISTRY = queries.load()


@pytest.fixture(scope="module")
def views():
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{DATA}/{name}')")
    return c


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(REGISTRY.functions))
def test_equals_sql(spark, views, name):
    out = REGISTRY.functions[name](spark, DATA)
    columns = sorted(out.columns)
    got = [tuple(map(plain, r)) for r in out.select(*[f"`{c}`" for c in columns]).collect()]
    found = views.execute(REGISTRY.sql[name])
    order = [[d[0] for d in found.description].index(c) for c in columns]
    want = [tuple(plain(r[i]) for i in order) for r in found.fetchall()]
    key = lambda row: tuple((v is None, str(v)) for v in row)
    assert sorted(got, key=key) == sorted(want, key=key)
