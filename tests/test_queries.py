"""Every query with SQL gives the rows of its SQL on the smallest tables."""

from __future__ import annotations

import datetime as dt
import decimal
from collections import Counter
from pathlib import Path

import pytest

from reefglass.plans import catalog

duckdb = pytest.importorskip("duckdb")
SQL = catalog.oracle_sql()
REST = sorted(n for n in catalog.queries() if n not in SQL and not n.startswith(("p5", "p6")))


@pytest.fixture(scope="module")
def sql(data_dir):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in Path(data_dir).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float) and v == 0:
        return 0.0
    if isinstance(v, dt.datetime) and v.tzinfo:
        return v.astimezone(dt.UTC).replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data_dir, sql, name):
    df = catalog.queries()[name](spark, data_dir)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    res = sql.execute(SQL[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    want = Counter(tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall())
    assert got == want


@pytest.mark.parametrize("name", REST)
def test_runs(spark, data_dir, name):
    assert catalog.queries()[name](spark, data_dir).columns


def test_core_stands_without_the_subpackage():
    root = Path(catalog.__file__).resolve().parent.parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "reefglass.llm" not in p.read_text(), p
