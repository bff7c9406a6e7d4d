"""Safe replacement of tables, restart of a broken rebuild, and figures observed while writing."""

from __future__ import annotations

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from marketspark.plans import quality as Q
from marketspark.plans import reports as R
from marketspark.plans import warehouse as W
from marketspark.sources import (
    input_version,
    materialise,
    raw_from_driver,
    read_range,
    read_table,
    save_as_table,
    table_record,
    write_table,
)
from marketspark.sources.fixtures import TRANSACTION_TIE_BREAK

SF = "/root/testdata/sf0.001"
TIE = {"transactions": TRANSACTION_TIE_BREAK}


@pytest.fixture
def root():
    return tempfile.mkdtemp(prefix="marketspark-rebuild-")


def failing(spark, n=1000):
    """Rows of which one raises while it is written, after others were written."""
    return spark.range(n).repartition(4).select(
        F.when(F.col("id") == n - 1, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("id"))


def values(df):
    return sorted(r.id for r in df.collect())


def test_a_failed_write_leaves_the_old_table(spark, root):
    path = os.path.join(root, "t")
    write_table(spark.range(5), path)
    held = read_table(spark, path)
    with pytest.raises(Exception, match="broken"):
        write_table(failing(spark), path)
    assert values(read_table(spark, path)) == values(held) == [0, 1, 2, 3, 4]
    assert table_record(spark, path).seq == 1
    write_table(spark.range(7), path)  # the next write replaces what the failed one left
    assert values(read_table(spark, path)) == list(range(7))
    assert values(held) == [0, 1, 2, 3, 4]  # a reader of the replaced table is not disturbed


def test_a_failed_first_write_leaves_no_table(spark, root):
    path = os.path.join(root, "t")
    with pytest.raises(Exception, match="broken"):
        write_table(failing(spark), path)
    assert table_record(spark, path).slot is None


def test_a_table_may_be_made_from_itself(spark, root):
    path = os.path.join(root, "t")
    write_table(spark.range(3), path)
    for _ in range(3):
        write_table(read_table(spark, path).select((F.col("id") * 2).alias("id")), path)
    assert values(read_table(spark, path)) == [0, 8, 16] and table_record(spark, path).seq == 4


def test_a_failed_catalog_write_leaves_the_old_table(spark):
    save_as_table(spark, spark.range(4), "rebuild_probe")
    with pytest.raises(Exception, match="broken"):
        save_as_table(spark, failing(spark), "rebuild_probe")
    assert values(spark.table("rebuild_probe")) == [0, 1, 2, 3]
    save_as_table(spark, spark.table("rebuild_probe").where("id > 1"), "rebuild_probe")
    assert values(spark.table("rebuild_probe")) == [2, 3]
    spark.sql("DROP TABLE rebuild_probe")


def test_plain_parquet_is_read_as_it_is(spark, root):
    spark.range(3).write.parquet(os.path.join(root, "plain"))
    assert values(read_table(spark, os.path.join(root, "plain"))) == [0, 1, 2]


def test_a_table_of_the_same_version_is_kept(spark, root):
    materialise(spark, spark.range(3), root, "t", version="1")
    assert values(materialise(spark, failing(spark), root, "t", version="1")) == [0, 1, 2]
    assert values(materialise(spark, spark.range(4), root, "t", version="2")) == [0, 1, 2, 3]
    assert values(materialise(spark, spark.range(5), root, "t")) == [0, 1, 2, 3, 4]  # no version: always written


def test_input_version_follows_the_files(spark, root):
    path = os.path.join(root, "in")
    spark.range(3).write.parquet(path)
    first = input_version(spark, [path])
    assert first == input_version(spark, [path])
    spark.range(3).write.mode("append").parquet(path)
    assert input_version(spark, [path]) != first


def test_a_rebuild_goes_on_where_it_stopped(spark, root, monkeypatch):
    raw = raw_from_driver(spark, SF)
    sixth = W.MARTS[5]
    seqs = lambda: {n: table_record(spark, p).seq for n, p in W._folders(root).items()}
    sound = W.DOWNSTREAM[sixth]
    monkeypatch.setitem(W.DOWNSTREAM, sixth, lambda m: sound(m).withColumn(
        "category", F.when(F.rand(1) >= 0, F.raise_error(F.lit("broken"))).cast("string")))
    with pytest.raises(Exception, match="broken"):
        W.build_all(spark, raw, root, TIE, version="v1")
    done = seqs()
    assert [n for n in W.MARTS if done[n]] == list(W.MARTS[:5])
    monkeypatch.setitem(W.DOWNSTREAM, sixth, sound)
    models = W.build_all(spark, raw, root, TIE, version="v1")
    assert set(seqs().values()) == {1}  # what stood was kept, the rest written once
    assert models[sixth].count() == models["dim_products"].count()

    # Figures observed on the way: the data tests read no table for NULL counts, with the same 37 rows.
    figures = W.written_figures(spark, root)
    stated = Q.dq_not_null(models, figures)
    assert "FileScan" not in stated._jdf.queryExecution().executedPlan().toString()
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(stated) == rows(Q.dq_not_null(models))
    report = Q.dq_report(models, figures)
    scans = report._jdf.queryExecution().executedPlan().toString().count("FileScan")
    assert scans < Q.dq_report(models)._jdf.queryExecution().executedPlan().toString().count("FileScan")
    assert rows(report) == rows(Q.dq_report(models)) and report.count() == 37

    # The pivot's columns are recorded too: no job before the action.
    spark.sparkContext.setJobGroup("mix", "event mix")
    mix = R.event_mix(models["fct_traffic_conversion"], W.event_types(figures))
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("mix")
    spark.sparkContext.setJobGroup("rest", "rest")
    assert mix.columns == R.event_mix(models["fct_traffic_conversion"]).columns
    assert rows(mix) == rows(R.event_mix(models["fct_traffic_conversion"]))


def test_nulls_are_observed(spark, root):
    df = spark.createDataFrame([(1, None), (None, None), (3, "x")], "customer_id long, loyalty_tier string").withColumn(
        "acquisition_channel", F.lit("a"))
    materialise(spark, df, root, "stg_customers", observe=W.observed_figures("stg_customers"))
    seen = table_record(spark, os.path.join(root, "stg_customers")).figures
    assert seen == {"nulls:customer_id": 1, "nulls:loyalty_tier": 2, "nulls:acquisition_channel": 0}


def test_a_month_is_read_from_its_files_only(spark, root):
    """Files hold ranges of time: a month of five years opens under a tenth of them, also where one moment is very frequent."""
    day = F.date_add(F.lit(dt.date(2018, 1, 1)), (F.col("id") * 7919 % 1826).cast("int")).cast("timestamp_ntz")
    t = F.when(F.col("id") % 3 == 0, F.lit(dt.datetime(2019, 6, 1)).cast("timestamp_ntz")).otherwise(day)
    facts = spark.range(30_000).select("id", F.when(F.col("id") % 500 != 0, t).alias("at"), (F.col("id") % 90).cast("double").alias("x"))
    path = os.path.join(root, "facts")
    write_table(facts.repartition(16), path, range_by=("at", "id"), files=60)
    files = lambda df: len(df.inputFiles())
    whole = read_table(spark, path)
    assert whole.count() == 30_000 and files(whole) >= 55
    hot = facts.where("at = timestamp_ntz'2019-06-01 00:00:00'").count()
    assert whole.where("at = timestamp_ntz'2019-06-01 00:00:00'").groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] < hot / 8
    for low, high in ((dt.datetime(2021, 3, 1), dt.datetime(2021, 4, 1)), (dt.datetime(2018, 1, 1), dt.datetime(2018, 2, 1))):
        month = read_range(spark, path, "at", low, high)
        want = facts.where((F.col("at") >= F.lit(low)) & (F.col("at") < F.lit(high)))
        assert files(month) < files(whole) / 10
        assert month.exceptAll(want).count() == 0 == want.exceptAll(month).count() and month.count() > 100
    assert read_range(spark, path, "at", dt.datetime(1999, 1, 1), dt.datetime(1999, 2, 1)).count() == 0


def test_facts_of_a_rebuild_are_read_by_time(spark, root):
    models = W.build_all(spark, raw_from_driver(spark, SF), root, TIE)
    facts, low, high = models["fct_transactions"], dt.datetime(1995, 1, 1), dt.datetime(1995, 3, 1)
    found = W.facts_between(spark, low, high, root)
    want = facts.where((F.col("transaction_timestamp") >= F.lit(low)) & (F.col("transaction_timestamp") < F.lit(high)))
    assert found.exceptAll(want).count() == 0 == want.exceptAll(found).count()
