"""Every registered query against its DuckDB oracle on the smallest data set, plus the smoke entry."""

import math

import numpy as np
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.conftest import SF_SMALL

ORACLES = oracle_sql()
QUERIES = queries()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, np.generic):
        return v.item()
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(sorted((k, _norm(x)) for k, x in v.asDict().items()))
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    sql = ORACLES[name].replace("/root/testdata/sf0.01", SF_SMALL)
    df = QUERIES[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = duck.execute(sql)
    dcols = [d[0] for d in res.description]
    assert sorted(dcols) == cols
    idx = [dcols.index(c) for c in cols]
    want = sorted((tuple(_norm(r[i]) for i in idx) for r in res.fetchall()), key=repr)
    assert got == want


def test_rows_only_queries_run(spark):
    for name in sorted(set(QUERIES) - set(ORACLES)):
        assert QUERIES[name](spark, SF_SMALL).count() > 0, name


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.columns == ["query_id", "chunk_id", "score", "rank"]
    assert df.count() > 0
