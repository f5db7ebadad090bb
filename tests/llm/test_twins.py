"""Queries with a SQL twin against DuckDB, on a small table of odd texts and on the smallest of the given tables."""

from pathlib import Path

import duckdb
import pytest

from tessera.llm import registry
from tests.llm.helpers import documents, odd_texts
from tests.llm.test_substring_dedup import case

OF_DOCUMENTS = sorted(set(registry.ORACLES) - {"op10_url_filter", "op13_valid_time"})


def compare(spark, folder, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "sales", "client_changes"):
        path = Path(folder, f"{table}.parquet")
        if not path.exists():
            continue
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path / '*.parquet' if path.is_dir() else path}'")
    twin = con.execute(registry.ORACLES[name])
    columns = sorted(c[0] for c in twin.description)
    order = [[c[0] for c in twin.description].index(c) for c in columns]
    want = [tuple(r[i] for i in order) for r in twin.fetchall()]
    frame = registry.QUERIES[name](spark, folder)
    assert sorted(frame.columns) == columns
    assert sorted(map(repr, map(tuple, frame.select(columns).collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_given_tables(spark, sf, name):
    compare(spark, sf, name)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    texts = [*odd_texts(), *case()[:40], "a b c " * 300, "x " * 8, "| # |\n" * 30, "Zero ONE two three four five six seven eight nine ten eleven twelve thirteen"]
    texts = [t if t is None else " ".join(t.split(" ")[:3000]) for t in texts]  # the twins' lists take quadratic time
    documents(spark, texts).write.parquet(f"{folder}/documents.parquet")
    items = [("i1", "zero one two three four five six seven eight nine ten eleven twelve"), ("i2", "tail"), ("i3", ""), ("i4", None), ("i5", "a b"), ("i6", "tail"), ("i7", "漢字")]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.mark.parametrize("name", OF_DOCUMENTS)
def test_odd_texts(spark, odd, name):
    compare(spark, odd, name)
