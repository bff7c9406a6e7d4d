"""Expression helpers: the places where Spark defaults differ from the warehouse SQL."""

import datetime as dt

from pyspark.sql import functions as F

from marketspark import functions as MF


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def test_round_scales_in_binary(spark):
    # 1.005 is 1.00499999... in binary: the SQL ROUND gives 1.0, Spark's round gives 1.01.
    assert one(spark, MF.round_half_away(F.lit(1.005), 2)) == 1.0
    assert one(spark, F.round(F.lit(1.005), 2)) == 1.01
    assert one(spark, MF.round_half_away(F.lit(2.675), 2)) == 2.68  # 2.675 * 100 is exactly 267.5
    assert one(spark, MF.round_half_away(F.lit(-1.5), 0)) == -2.0


def test_int_cast_rounds_half_even(spark):
    assert one(spark, MF.to_int_rounded(F.lit("2.7"))) == 3
    assert one(spark, MF.to_int_rounded(F.lit(2.5))) == 2
    assert one(spark, MF.to_int_rounded(F.lit(3.5))) == 4
    assert one(spark, MF.to_int_rounded(F.lit("junk"))) is None


def test_refund_flag(spark):
    assert one(spark, MF.to_bool_flag(F.lit(1))) is True
    assert one(spark, MF.to_bool_flag(F.lit(0))) is False
    assert one(spark, MF.to_bool_flag(F.lit(None).cast("int"))) is False
    assert one(spark, MF.to_bool_flag(F.lit(2))) is False
    assert one(spark, MF.to_bool_flag(F.lit("True"))) is True
    assert one(spark, MF.to_bool_flag(F.lit("false"))) is False
    assert one(spark, MF.to_bool_flag(F.lit("1.0"))) is True


def test_month_diff_counts_boundaries(spark):
    jan31, feb1 = F.lit(dt.date(2021, 1, 31)), F.lit(dt.date(2021, 2, 1))
    assert one(spark, MF.month_diff(jan31, feb1)) == 1
    assert one(spark, MF.month_diff(F.lit(dt.date(2021, 3, 1)), F.lit(dt.date(2020, 12, 1)))) == -3


def test_month_start_is_date(spark):
    v = one(spark, MF.month_start(F.lit(dt.datetime(2021, 5, 17, 23, 59)).cast("timestamp_ntz")))
    assert v == dt.date(2021, 5, 1)


def test_text_cleaning(spark):
    assert one(spark, MF.clean_text(F.lit("  Paid Search "))) == "paid search"
    assert one(spark, MF.clean_text_or(F.lit(None).cast("string"), "unknown")) == "unknown"
    assert one(spark, MF.clean_text_or(F.lit(""), "unknown")) == ""
    assert one(spark, MF.capitalize(F.lit("nONE"))) == "None"


def test_rates_guard_zero(spark):
    assert one(spark, MF.pct(F.lit(1), F.lit(0))) is None
    assert one(spark, MF.pct_or_zero(F.lit(1), F.lit(0))) == 0.0
    assert one(spark, MF.pct_rounded(F.lit(1), F.lit(3))) == 33.33
    assert one(spark, MF.share_pct(F.lit(1), F.lit(4))) == 25.0


def test_null_safe_not_equal_keeps_null(spark):
    df = spark.createDataFrame([("bounce",), ("view",), (None,)], "t string")
    assert df.where(MF.not_equal_keep_null("t", "bounce")).count() == 2


def test_money_is_exact_cents(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (0.3,)], "x double")
    summed = df.agg(MF.exact_sum("x").alias("s"), F.count("x").alias("n"))
    assert summed.select(MF.money("s"), MF.money_mean("s", "n")).first() == (0.6, 0.2)
