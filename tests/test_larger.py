"""Queries against their SQL on rows that the small tables lack."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from loomery.plans.registry import QUERIES, SQL


def same_as_sql(spark, sf, name, tables):
    c = duckdb.connect()
    for t in tables:
        at = f"{sf}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at + '/*.parquet' if os.path.isdir(at) else at}'")
    want = c.execute(SQL[name])
    names = [x[0] for x in want.description]
    got = [tuple(r) for r in QUERIES[name](spark, str(sf)).select(*names).collect()]
    want = want.fetchall()
    assert sorted(got, key=str) == sorted(want, key=str)
    return len(got)


@pytest.mark.parametrize("users", [0, 1, 2, 150, 1501])
def test_log_values_with_many_users(spark, tmp_path, users):
    d = spark.range(2 * users).select(F.col("id").alias("event_id"), F.when(F.col("id") % 151 != 7, F.col("id") % max(users, 1)).alias("user_id"))
    d.write.parquet(str(tmp_path / "events.parquet"))
    assert same_as_sql(spark, tmp_path, "log_values", ["events"]) >= 3 * users


def test_merged_paths_with_large_and_missing_keys(spark, tmp_path):
    rows = [(1, 3), (1, 2_000_002), (2, 999_999), (2, 1_000_000), (2, 5_000_001), (3, 2_000_000), (3, 1_000_003), (None, 5), (None, 4_000_000), (4, None), (5, None), (5, 2)]
    spark.createDataFrame(rows, "o_custkey long, o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    assert same_as_sql(spark, tmp_path, "merged_paths", ["orders"]) == 6


def test_page_names_with_long_and_odd_urls(spark, tmp_path):
    urls = ["http://a/" + "b" * n for n in (47, 48, 49, 66, 67, 200)] + ["https://a/é" * 8, "http://a/b?x\n", "a/b?x\ny?z", "a/b\n", "a/b\r\n", "a/b?c\u0085d/e", "a/b?c d", "", None, "a/", "/?utm_source=feed", "a/b?utm_source="]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    assert same_as_sql(spark, tmp_path, "page_names", ["pages"]) == len(urls)
