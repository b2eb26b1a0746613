"""Every query with a SQL twin gives the same rows as DuckDB."""

import math
import os

import duckdb
import pytest

from benchsieve.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f[:-8]} as select * from read_parquet('{sf}/{f}')")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v)


@pytest.mark.parametrize("name", sorted(k for k in QUERIES if k in SQL))
def test_equals_sql(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cur = db.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(norm(r[i]) for i in at) for r in cur.fetchall())


#: What every row of a query without a SQL twin must hold, and whether there must be rows.
HOLDS = {
    "audit_flat": "hits_preprint_dump >= unique_ngrams_preprint_dump and hits_preprint_dump >= docs_preprint_dump",
    "audit_bloom": "hits_bloom >= 0",
    "boot_numpy_like": "lo <= hi and replicates > 900",
    "boot_delta_by_n": "lo <= hi and max_abs >= abs(lo) and max_abs >= abs(hi) and replicates <= 10000",
    "boot_delta_ci_whole": "lo <= hi and max_abs >= abs(lo) and max_abs >= abs(hi)",
    "boot_single_ci_whole": "0 <= lo and lo <= hi and hi <= 100",
    "boot_two_sample_ci_whole": "-1 <= lo and lo <= hi and hi <= 1",
    "spearman_ci_whole": "-1.0000001 <= lo and lo <= hi and hi <= 1.0000001 and p between 0 and 1",
}


@pytest.mark.parametrize("name", sorted(k for k in QUERIES if k not in SQL))
def test_holds(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.count() > 0 and df.where(f"not ({HOLDS[name]})").count() == 0


def test_bloom_never_misses(spark, sf):
    exact = {r["problem_id"]: r["hits_total"] for r in QUERIES["audit_forward"](spark, sf).collect()}
    bloom = {r["problem_id"]: r["hits_bloom"] for r in QUERIES["audit_bloom"](spark, sf).collect()}
    assert bloom.keys() == exact.keys() and all(bloom[k] >= (exact[k] > 0) for k in exact)
