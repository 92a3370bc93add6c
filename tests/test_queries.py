"""Every registered query of the library against its SQL on the smallest tables."""

import math
from decimal import Decimal

import duckdb
import pandas as pd
import pytest

from corpusloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, (float, Decimal)):
        return f"{float(value):.6g}"
    if isinstance(value, bool) or type(value).__name__ == "bool":
        return str(bool(value))
    if hasattr(value, "__len__") and not isinstance(value, str):
        return str([plain(x) for x in value])
    try:
        return f"{float(value):.6g}" if not isinstance(value, str) else value
    except (TypeError, ValueError):
        return str(value)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, sf_dir, name):
    got = registry.queries()[name](spark, sf_dir).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    want = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert sorted(map(tuple, got[columns].map(plain).values.tolist())) == sorted(map(tuple, want[columns].map(plain).values.tolist()))


def test_flagship_has_rows(spark, sf_dir):
    assert registry.flagship(spark, sf_dir).count() > 0
