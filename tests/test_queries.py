"""Every query with a SQL twin against DuckDB, on the smallest tables; the others must give rows."""

import duckdb
import pandas as pd
import pytest

from tessera.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels conversations".split()
SLOW = {"rf_grid", "gbt_ovr", "svm_grid", "et_grid", "leaf_boost_grid"}


@pytest.fixture(scope="session")
def oracle(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def rows(frame):
    plain = lambda v: None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else v.item() if hasattr(v, "item") else v
    return sorted(repr(tuple(map(plain, r))) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, oracle, sf, name):
    got, want = catalogue.QUERIES[name](spark, sf).toPandas(), oracle.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES) - SLOW))
def test_gives_rows(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", ["rf_grid", "et_grid"])
def test_model_grid(spark, sf, name):
    trials = catalogue.QUERIES[name](spark, sf).collect()
    assert len(trials) == 4 and all(0 <= t.macro_f1 <= 1 for t in trials)


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(catalogue.QUERIES) > 70
