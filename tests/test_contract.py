"""The driver's contract, and queries against their SQL on the smallest tables."""

import glob
import math
import os
from collections import Counter

import pytest

import __spark_entry__ as entry
from pagemill.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
need = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), Counter(tuple(str(norm(r[k])) for k in order) for r in rows)


def test_names():
    assert set(ORACLE) <= set(QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


@need
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@need
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = QUERIES[name](spark, SF)
    r = con.execute(ORACLE[name])
    assert table(df.columns, df.collect()) == table([d[0] for d in r.description], r.fetchall())


@need
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns)
    df.write.format("noop").mode("overwrite").save()
