"""Registered queries against their DuckDB oracle on the smallest fixture (sf0.001)."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

#: The panel's folds are empty on the smallest tables.
SMALL, PANEL = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
NAMES = sorted(entry.oracle_sql())


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def _bag(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def connections():
    out = {}
    for sf in (SMALL, PANEL):
        out[sf] = duckdb.connect()
        for t in TABLES:
            out[sf].execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return out


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, connections, name):
    sf = PANEL if name.startswith("panel_") else SMALL
    df = entry.queries()[name](spark, sf)
    rows = df.collect()
    assert rows, "an empty result proves nothing"
    res = connections[sf].execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(rows) == len(drows)
    assert _bag(df.columns, rows) == _bag(dcols, drows)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and "future_label" in df.columns
