import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.operators import lag, metrics, ordered


def skewed(spark, n=3000):
    """A third of the rows under one key, some under null; many equal values."""
    draw = random.Random(5)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else draw.choice(["a", "b", "c", None])
        rows.append((key, i, float(draw.randint(0, 400)) / 4))
    draw.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k string, at bigint, value double").repartition(5)


def by_key(rows):
    groups = {}
    for key, at, value in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(key, []).append((at, value))
    return groups


@pytest.mark.parametrize("slice_s", [1, 60, 7200])
def test_running_max_before(spark, slice_s):
    rows, df = skewed(spark)
    # Half a minute a row, so that slices, days and ties in time all occur.
    timed = df.withColumn("t", F.timestamp_seconds(F.floor(F.col("at") / 2) * 60 + 1_700_000_000))
    out = ordered.running_max_before(timed, ["k"], "t", "at", "value", "high", slice_s)
    found = {r["at"]: r.high for r in out.collect()}
    expected = {}
    for values in by_key(rows).values():
        high = None
        for at, value in values:
            expected[at] = high
            high = value if high is None else max(high, value)
    assert found == expected


def jobs_of(spark, build):
    """How many jobs run while a plan is built."""
    spark.sparkContext.setJobGroup("planning", "")
    build()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup("planning"))


def test_plans_are_built_without_running_jobs(spark):
    _, df = skewed(spark)
    timed = df.withColumn("t", F.timestamp_seconds("at"))
    assert jobs_of(spark, lambda: metrics.exact_percentile(df, ["k"], "value", 0.99, "p")) == 0
    assert jobs_of(spark, lambda: lag.late_audit(timed, "k", "t", "t", "at", 3600)) == 0


@pytest.mark.parametrize("accuracy", [10_000, 50])
@pytest.mark.parametrize("q", [0.99, 0.5, 0.0, 1.0])
def test_percentile_equals_the_built_in(spark, monkeypatch, accuracy, q):
    monkeypatch.setattr(metrics, "SKETCH_ACCURACY", accuracy)
    rows, df = skewed(spark)
    found = {r.k: r.p for r in metrics.exact_percentile(df, ["k"], "value", q, "p").collect()}
    assert found == {r.k: r.p for r in df.groupBy("k").agg(F.percentile("value", q).alias("p")).collect()}
    for key, values in by_key(rows).items():
        assert found[key] == pytest.approx(np.percentile([v for _, v in values], q * 100), abs=1e-9)


def test_percentile_of_one_key_with_most_rows(spark, monkeypatch):
    monkeypatch.setattr(metrics, "SKETCH_ACCURACY", 200)
    df = spark.range(60_000).select(
        F.when(F.col("id") % 50 > 0, "hot").otherwise("cold").alias("k"),
        (F.xxhash64("id") % 100_000 / 7).alias("value"),
    )
    for q in (0.001, 0.37, 0.99):
        found = {r.k: r.p for r in metrics.exact_percentile(df, ["k"], "value", q, "p").collect()}
        assert found == {r.k: r.p for r in df.groupBy("k").agg(F.percentile("value", q).alias("p")).collect()}


def test_percentile_ignores_nulls(spark):
    df = spark.createDataFrame([("a", None), ("a", 4.0), ("b", None)], "k string, value double")
    assert {r.k: r.p for r in metrics.exact_percentile(df, ["k"], "value", 0.99, "p").collect()} == {"a": 4.0}


def test_late_flags_need_an_earlier_higher_mark(spark):
    rows = [(0, 1, "2024-01-01 00:00:10", "2024-01-01 00:01:00"), (0, 2, "2024-01-01 00:00:04", "2024-01-01 00:01:01"),
            (0, 3, "2024-01-01 00:00:05", "2024-01-01 00:01:02"), (1, 4, "2024-01-01 00:00:00", "2024-01-01 00:02:00")]
    df = spark.createDataFrame(rows, "p int, id bigint, ts string, arrival string").select(
        "p", "id", F.col("ts").cast("timestamp"), F.col("arrival").cast("timestamp")
    )
    out = lag.late_flags(df, "p", "arrival", "ts", "id")
    assert {r.id: r.late for r in out.collect()} == {1: False, 2: True, 3: False, 4: False}


def test_as_of_takes_the_last_entry_at_or_before(spark):
    from rivulet.operators import lag

    draw = random.Random(4)
    index = [(draw.choice([0, 0, 0, 1, None]), draw.randrange(30_000), draw.randrange(1000)) for _ in range(400)]
    points = [(draw.choice([0, 0, 0, 1, None, 2]), draw.randrange(-5, 30_000), k) for k in range(600)] + [(0, None, 999)]
    got = lag.as_of(
        spark.createDataFrame(points, "p int, at long, id int").repartition(5),
        spark.createDataFrame([*index, (0, None, 5), (0, 7, None)], "p int, at long, v int"), ["p"], "at", "v",
    )
    found = {r.id: (r.p, r["at"], r.v) for r in got.collect()}
    assert len(found) == len(points)
    for p, at, k in points:
        known = [(a, v) for q, a, v in index if q == p and at is not None and a <= at]
        assert found[k] == (p, at, max(known)[1] if known else None)


def test_time_lag_of_sparse_and_unknown_partitions(spark):
    from rivulet.operators import lag

    index = spark.createDataFrame(
        [(0, 10, "2024-01-01 00:00:10"), (0, 20, "2024-01-01 00:00:30"), (1, 5, "2024-01-01 00:01:00")],
        "p int, o long, ts string",
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    commits = spark.createDataFrame([(0, 9), (0, 10), (0, 19), (0, 99), (1, 5), (2, 5)], "p int, o long")
    rows = lag.time_lag(commits, index, ["p"], "o", "ts").collect()
    assert {(r.p, r.o): r.millis_behind for r in rows} == {
        (0, 9): None, (0, 10): 20_000, (0, 19): 20_000, (0, 99): 0, (1, 5): 0, (2, 5): None
    }
