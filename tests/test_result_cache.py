"""Cached results: the same input starts no scan, a changed one is recomputed, the bytes held are bounded."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marketspark.sources.result_cache import ResultCache, plan_text


@pytest.fixture
def places(tmp_path):
    return str(tmp_path / "in"), str(tmp_path / "cache")


def report(spark, path, least=0):
    return spark.read.parquet(path).where(F.col("id") >= least).groupBy((F.col("id") % 3).alias("k")).agg(F.sum("id").alias("s"))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_the_same_input_is_not_read_again(spark, places):
    path, folder = places
    spark.range(100).write.parquet(path)
    cache = ResultCache(spark, folder)
    first = cache.get(report(spark, path))
    again = ResultCache(spark, folder).get(report(spark, path))  # the query built anew, the cache opened anew
    assert rows(first) == rows(again) == rows(report(spark, path))
    assert all("/result-" in f for f in again.inputFiles()) and again.inputFiles() == first.inputFiles()
    other = cache.get(report(spark, path, 50))
    assert rows(other) == rows(report(spark, path, 50)) != rows(first)
    assert plan_text(report(spark, path)) == plan_text(report(spark, path)) != plan_text(report(spark, path, 50))


def test_a_changed_input_is_recomputed(spark, places):
    path, folder = places
    spark.range(100).write.parquet(path)
    cache = ResultCache(spark, folder)
    before = rows(cache.get(report(spark, path)))
    spark.range(1000, 1010).write.mode("append").parquet(path)
    after = cache.get(report(spark, path))
    assert rows(after) == rows(report(spark, path)) != before


def test_unstable_and_fileless_plans_are_not_kept(spark, places):
    path, folder = places
    spark.range(10).write.parquet(path)
    cache = ResultCache(spark, folder)
    assert cache.key(spark.read.parquet(path).withColumn("r", F.rand())) is None
    assert cache.key(spark.range(5)) is None and rows(cache.get(spark.range(3))) == [(0,), (1,), (2,)]


def test_the_bytes_held_are_bounded(spark, places):
    path, folder = places
    spark.range(1000).write.parquet(path)
    one = ResultCache(spark, folder)
    one.get(report(spark, path, 0))
    size = sum(b for _, b in one._held().values())
    cache = ResultCache(spark, folder, max_bytes=int(2.5 * size))
    for least in (1, 2, 0, 3):  # 1 is the one used longest ago when 3 comes
        assert rows(cache.get(report(spark, path, least))) == rows(report(spark, path, least))
    held = set(cache._held())
    key = lambda least: cache.key(report(spark, path, least))
    assert key(3) in held and key(1) not in held and sum(b for _, b in cache._held().values()) <= cache.max_bytes
    assert rows(cache.get(report(spark, path, 1))) == rows(report(spark, path, 1))  # and it comes back
    small = ResultCache(spark, folder + "2", max_bytes=10)
    assert rows(small.get(report(spark, path))) == rows(report(spark, path)) and not small._held()
