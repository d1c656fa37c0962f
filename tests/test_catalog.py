from __future__ import annotations

import math
import os

import duckdb
import pytest

from millrace import catalog, catalog_functions  # noqa: F401
from millrace.plans.relational import TABLES

SF = "/root/testdata/sf0.001"


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return f"{value:.6g}" if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_article_fields_uses_all_cores(spark):
    """One small file of parts is much work."""
    assert catalog.QUERIES["article_fields"](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    rows = got.collect()
    if name in catalog.ORACLE_SQL:
        rel = duck.sql(catalog.ORACLE_SQL[name])
        names = sorted(got.columns)
        assert names == sorted(rel.columns)
        at = [rel.columns.index(n) for n in names]
        assert sorted(tuple(plain(r[n]) for n in names) for r in rows) == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    else:
        assert rows
