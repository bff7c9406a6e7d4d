"""Expression helpers against DuckDB on random inputs (the parity ledger rules)."""

import datetime as dt
import random

import duckdb
from pyspark.sql import functions as F

from marketspark import functions as MF

N = 4000


def _spark_values(spark, values, ddl, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {ddl}")
    return [r.out for r in df.select("i", expr.alias("out")).orderBy("i").collect()]


def _duck_values(values, duck_type, expr):
    con = duckdb.connect()
    con.execute(f"CREATE TABLE t (i INTEGER, v {duck_type})")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(values)))
    return [r[0] for r in con.execute(f"SELECT {expr} FROM t ORDER BY i").fetchall()]


def test_round_matches_binary_scaled_round(spark):
    rng = random.Random(11)
    # Averages and ratios like the marts produce, plus exact half-cent ties.
    values = [rng.randint(1, 10**6) / rng.randint(1, 997) for _ in range(N)]
    values += [k / 1000 + 0.005 for k in range(0, 2000, 7)]
    got = _spark_values(spark, values, "double", MF.round_half_away("v", 2))
    want = _duck_values(values, "DOUBLE", "ROUND(v, 2)")
    assert got == want


def test_int_cast_matches(spark):
    rng = random.Random(12)
    values = [rng.choice([k + 0.5 for k in range(-20, 20)] + [rng.uniform(-1000, 1000)]) for _ in range(N)]
    got = _spark_values(spark, values, "double", MF.to_int_rounded("v"))
    want = _duck_values(values, "DOUBLE", "CAST(v AS INTEGER)")
    assert got == want


def test_month_diff_matches_datediff(spark):
    rng = random.Random(13)
    d0 = dt.date(1990, 1, 1)
    pairs = [(d0 + dt.timedelta(days=rng.randint(0, 15000)), d0 + dt.timedelta(days=rng.randint(0, 15000)))
             for _ in range(N)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a date, b date")
    got = [r.m for r in df.select("i", MF.month_diff("a", "b").alias("m")).orderBy("i").collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INTEGER, a DATE, b DATE)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", [(i, a, b) for i, (a, b) in enumerate(pairs)])
    want = [r[0] for r in con.execute("SELECT datediff('month', a, b) FROM t ORDER BY i").fetchall()]
    assert got == want


def test_cents_sums_are_order_independent(spark):
    rng = random.Random(14)
    values = [round(rng.uniform(-500, 5000), 2) for _ in range(N)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    forward = df.agg(MF.exact_sum("v").alias("s")).select(MF.money("s")).first()[0]
    shuffled = df.repartition(7).agg(MF.exact_sum("v").alias("s")).select(MF.money("s")).first()[0]
    exact = sum(round(v * 100) for v in values) / 100
    assert forward == shuffled == exact
