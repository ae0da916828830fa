import random
import re

import pytest
from pyspark.sql import functions as F

from rivulet.operators import alarms, metrics
from rivulet.plans import catalog


def points(spark, rows):
    """(minute, value, dims...) as datapoints from midnight on."""
    return spark.createDataFrame(rows, "minute int, value double, stream string").select(
        (F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(mins=F.col("minute"))).alias("ts"),
        "value", "stream",
    )


def minutes(rows, *columns):
    return sorted((r.period.hour * 60 + r.period.minute, *[r[c] for c in columns]) for r in rows)


def test_stats_by_period(spark):
    df = points(spark, [(0, 1.0, "s"), (4, 3.0, "s"), (5, 10.0, "s")])
    for stat, first in (("Average", 2.0), ("Sum", 4.0), ("Minimum", 1.0), ("Maximum", 3.0), ("p99", 2.98)):
        found = minutes(metrics.metric_stat(df, ["stream"], 300, stat).collect(), "stat")
        assert found == [(0, pytest.approx(first)), (5, 10.0)]


def test_rate_skips_the_first_period_and_spans_gaps(spark):
    stats = metrics.metric_stat(points(spark, [(0, 5.0, "s"), (1, 8.0, "s"), (4, 2.0, "s")]), ["stream"], 60, "Maximum")
    assert minutes(metrics.metric_rate(stats, ["stream"]).collect(), "rate") == [(1, 3.0), (4, -2.0)]


def test_math(spark):
    row = spark.createDataFrame([(30000.0, 10.0, 0.0)], "a double, b double, z double").select(
        metrics.gc_percent(F.col("a")).alias("gc"), metrics.per_second(F.col("a")).alias("ps"),
        metrics.percent_of(F.col("a"), F.col("z")).alias("nothing"),
        metrics.availability(F.col("b"), F.col("a")).alias("up"),
        metrics.availability(F.col("b"), F.col("z")).alias("down"),
        metrics.availability(F.col("z"), F.col("z")).alias("idle"),
    ).first()
    assert (row.gc, row.ps, row.nothing, row.down, row.idle) == (50.0, 100.0, None, 0.0, None)
    assert row.up == pytest.approx(100 - 1000 / 30000)


def test_aligned_keeps_periods_of_either_side(spark):
    df = points(spark, [(0, 1.0, "x"), (1, 2.0, "y"), (2, 3.0, "x"), (2, 4.0, "y")])
    legs = {"m1": (F.col("stream") == "x", "Sum"), "m2": (F.col("stream") == "y", "Minimum")}
    assert sorted(
        (r.period.minute, r.m1, r.m2) for r in metrics.aligned(df, [], 60, legs).collect()
    ) == [(0, 1.0, None), (1, None, 2.0), (2, 3.0, 4.0)]


def test_latest_and_annotation(spark):
    stats = metrics.metric_stat(points(spark, [(0, 100.0, "s"), (9, 99.0, "s")]), ["stream"], 60, "Maximum")
    assert minutes(metrics.latest(stats, ["stream"]).collect(), "stat") == [(9, 99.0)]
    lined = metrics.annotate(stats, *catalog.DISK_LINE)
    assert minutes(lined.collect(), "reached", "label") == [
        (0, True, "Maximum disk usage"), (9, False, "Maximum disk usage")
    ]


def test_missing_periods_and_policy(spark):
    stats = metrics.metric_stat(points(spark, [(0, 1.0, "s"), (3, 9.0, "s")]), ["stream"], 60, "Maximum")
    filled = alarms.fill_periods(stats, ["stream"], 60)
    assert minutes(filled.collect(), "stat") == [(0, 1.0), (1, None), (2, None), (3, 9.0)]
    for policy, gap in ((alarms.BREACHING, "ALARM"), (alarms.NOT_BREACHING, "OK")):
        states = alarms.consecutive_state(stats, ["stream"], 60, ">", 5.0, 1, policy)
        assert minutes(states.collect(), "state") == [(0, "OK"), (1, gap), (2, gap), (3, "ALARM")]


def test_consecutive_periods_and_transitions(spark):
    values = [9, 9, 1, 9, 9, 9, 9, 1]
    stats = metrics.metric_stat(points(spark, [(i, float(v), "s") for i, v in enumerate(values)]), ["stream"], 60, "Maximum")
    states = alarms.consecutive_state(stats, ["stream"], 60, ">", 5.0, 3)
    assert [s for _, s in minutes(states.collect(), "state")] == ["OK"] * 5 + ["ALARM"] * 2 + ["OK"]
    assert minutes(alarms.transitions(states, ["stream"]).collect(), "previous", "state") == [
        (5, "OK", "ALARM"), (7, "ALARM", "OK")
    ]


@pytest.mark.parametrize("comparison, fired", [(">", [False, False, True]), (">=", [False, True, True]), ("<=", [True, True, False])])
def test_comparisons(spark, comparison, fired):
    stats = metrics.metric_stat(points(spark, [(0, 1.0, "s"), (1, 2.0, "s"), (2, 3.0, "s")]), ["stream"], 60, "Maximum")
    states = alarms.alarm_state(stats, comparison, 2.0)
    assert [s == "ALARM" for _, s in minutes(states.collect(), "state")] == fired


def test_unknown_comparison():
    with pytest.raises(ValueError):
        alarms.breach(None, "<", None)


# What the alarms are set to: (threshold, comparison, periods, statistic, period, missing data).
EXPECTED = {
    "IteratorAge": (60000, ">=", 1, "Maximum", 60, "breaching"),
    "ReadProvisioned": (0.01, ">=", 1, "Average", 60, "breaching"),
    "WriteProvisioned": (0.01, ">=", 1, "Average", 60, "breaching"),
    "PutRecord": (0.95, "<=", 1, "Average", 60, "notBreaching"),
    "PutRecords": (0.95, "<=", 1, "Average", 60, "notBreaching"),
    "GetRecords": (0.98, "<=", 1, "Average", 60, "breaching"),
    "DataFreshness": (900, ">", 1, "Maximum", 300, "breaching"),
    "IncomingBytes": (75, ">", 1, "Sum", 300, "breaching"),
    "IncomingPutRequests": (75, ">", 1, "Sum", 300, "breaching"),
    "IncomingRecords": (75, ">", 1, "Sum", 300, "breaching"),
    "Downtime": (0, ">", 1, "Average", 60, "breaching"),
    "Checkpoint": (0, ">", 1, "Average", 60, "breaching"),
    "CpuUtilization": (80, ">", 1, "Maximum", 60, "breaching"),
    "HeapMemory": (90, ">", 1, "Maximum", 60, "breaching"),
    "GCPercent": (60, ">", 1, "Maximum", 60, "breaching"),
    "RecordsOut": (0, "<=", 1, "Average", 60, "breaching"),
    "MillisBehind": (60000, ">", 1, "Maximum", 60, "breaching"),
}


def test_alarm_catalogue():
    found = {
        s.alarm: (s.threshold, s.comparison, s.evaluation_periods, s.stat, s.period_s, s.treat_missing)
        for s in catalog.alarm_specs()
    }
    assert found == EXPECTED


def test_every_alarm_watches_a_known_metric():
    watched = {s[:4] for s in catalog.metric_specs()}
    for s in catalog.alarm_specs():
        assert (s.namespace, s.metric_name, s.stat, s.period_s) in watched
        if s.over_metric:
            assert (s.namespace, s.over_metric, s.over_stat, s.period_s) in watched


def test_cluster_metrics_do_not_fan_out(spark):
    df = points(spark, [(0, 1.0, "1"), (0, 5.0, "2")]).select(
        "ts", F.lit(catalog.BROKER).alias("namespace"),
        F.explode(F.array(F.lit("CpuUser"), F.lit("GlobalTopicCount"), F.lit("NetworkRxErrors"))).alias("metric_name"),
        F.create_map(F.lit("broker"), F.col("stream")).alias("dims"), "value",
    )
    board = metrics.metric_board(df, catalog.metric_table(spark, catalog.metric_specs()), ["broker"])
    assert sorted((r.metric_name, r.broker or "", r.stat, r.stat_value) for r in board.collect()) == [
        ("CpuUser", "1", "Maximum", 1.0), ("CpuUser", "2", "Maximum", 5.0), ("GlobalTopicCount", "", "Maximum", 5.0),
        ("NetworkRxErrors", "1", "Sum", 1.0), ("NetworkRxErrors", "2", "Sum", 5.0),
    ]


def test_limit_alarm_as_published_and_per_second(spark):
    df = points(spark, [(0, 300.0, "IncomingBytes"), (0, 2.0, "BytesPerSecondLimit")]).select(
        "ts", F.lit(catalog.DELIVERY).alias("namespace"), F.col("stream").alias("metric_name"),
        F.create_map(F.lit("name"), F.lit("n")).alias("dims"), "value",
    )
    for per_second, value, state in ((False, 15000.0, "ALARM"), (True, 50.0, "OK")):
        specs = [s for s in catalog.alarm_specs(per_second) if s.alarm == "IncomingBytes"]
        row = alarms.evaluate_alarms(df, specs, ["name"]).first()
        assert (row.value, row.state, row.name) == (pytest.approx(value), state, "n")


def test_source_dims():
    assert catalog.source_dims("my-input-stream") == {"Id": "my_input_stream", "Flow": "Input"}


def test_catalogue_without_ratios(spark):
    df = points(spark, [(0, 90.0, "n"), (1, 10.0, "n"), (3, 10.0, "n")]).select(
        "ts", F.lit(catalog.APPLICATION).alias("namespace"), F.lit("cpuUtilization").alias("metric_name"),
        F.create_map(F.lit("name"), F.col("stream")).alias("dims"), "value",
    )
    specs = [s for s in catalog.alarm_specs() if s.alarm in ("CpuUtilization", "HeapMemory")]
    states = alarms.evaluate_alarms(df, specs, ["name"]).collect()
    assert minutes([r for r in states if r.alarm == "CpuUtilization"], "name", "state") == [
        (0, "n", "ALARM"), (1, "n", "OK"), (2, "n", "ALARM"), (3, "n", "OK"),
    ]
    # Its metric never came, and missing periods breach.
    assert minutes([r for r in states if r.alarm == "HeapMemory"], "name", "state") == [
        (m, None, "ALARM") for m in range(4)
    ]


def test_alarms_cover_the_common_range_and_silent_metrics(spark):
    df = points(spark, [(0, 1.0, "a"), (9, 1.0, "a"), (4, 9.0, "b")]).select(
        "ts", F.lit("n").alias("namespace"), F.lit("m").alias("metric_name"),
        F.create_map(F.lit("stream"), F.col("stream")).alias("dims"), "value",
    )
    specs = [
        catalog.AlarmSpec("Seen", "n", "m", "Maximum", 60, ">", 5.0, alarms.BREACHING),
        catalog.AlarmSpec("Quiet", "n", "other", "Maximum", 60, ">", 5.0, alarms.NOT_BREACHING),
        catalog.AlarmSpec("Lost", "n", "other", "Maximum", 300, ">", 5.0, alarms.BREACHING, 2),
    ]
    found = {}
    for r in alarms.evaluate_alarms(df, specs, ["stream"]).collect():
        found.setdefault((r.alarm, r.stream), {})[r.period.minute] = r.state
    assert set(found) == {("Seen", "a"), ("Seen", "b"), ("Quiet", None), ("Lost", None)}
    assert found["Seen", "b"] == dict.fromkeys(range(10), "ALARM")
    assert [found["Seen", "a"][m] for m in range(10)] == ["OK"] + ["ALARM"] * 8 + ["OK"]
    assert found["Quiet", None] == dict.fromkeys(range(10), "OK")
    assert found["Lost", None] == {0: "OK", 5: "ALARM"}


def brute_states(points, spec, first, last):
    """State of every period from the definition: walk them in order."""
    out, streak = {}, 0
    for n in range(first // spec.period_s, last // spec.period_s + 1):
        own = [v for t, v in points if t // spec.period_s == n]
        value = max(own) if own else None
        bad = value > spec.threshold if own else spec.treat_missing == alarms.BREACHING
        streak = streak + 1 if bad else 0
        out[n * spec.period_s] = (value, "ALARM" if streak >= spec.evaluation_periods else "OK")
    return out


def test_states_match_a_walk_over_all_periods(spark):
    draw = random.Random(3)
    series = {
        name: [(draw.randrange(low, high), float(draw.randint(0, 9))) for _ in range(n)]
        for name, low, high, n in (("a", 0, 6000, 40), ("b", 2000, 2100, 3), ("c", 5900, 6001, 9), ("d", 0, 6000, 400))
    }
    series["edges"] = [(0, 1.0), (6000, 1.0)]
    rows = [(t, "n", "m", {"k": k}, v) for k, own in series.items() for t, v in own]
    df = spark.createDataFrame(rows, "t long, namespace string, metric_name string, dims map<string,string>, value double")
    df = df.select(F.timestamp_seconds("t").alias("ts"), "namespace", "metric_name", "dims", "value")
    specs = [
        catalog.AlarmSpec(f"{policy}{periods}", "n", "m", "Maximum", 60, ">", 5.0, policy, periods)
        for policy in (alarms.BREACHING, alarms.NOT_BREACHING) for periods in (1, 2, 5)
    ] + [catalog.AlarmSpec("Silent", "n", "none", "Maximum", 300, ">", 5.0, alarms.BREACHING, 3)]
    found = {}
    for r in alarms.evaluate_alarms(df, specs, ["k"]).collect():
        found.setdefault((r.alarm, r.k), {})[int(r.period.timestamp())] = (r.value, r.state)
    want = {(s.alarm, k): brute_states(own, s, 0, 6000) for s in specs[:-1] for k, own in series.items()}
    want["Silent", None] = brute_states([], specs[-1], 0, 6000)
    assert found == want


def test_a_year_of_silence_needs_no_long_array(spark):
    rows = [(0, 9.0), (365 * 86_400, 9.0)]
    stats = spark.createDataFrame(rows, "t long, stat double").select(
        F.timestamp_seconds("t").alias("period"), "stat", F.lit("s").alias("stream")
    )
    filled = alarms.fill_periods(stats, ["stream"], 60)
    assert filled.count() == 525_601
    assert filled.agg(F.count("stat"), F.count_distinct("period")).first() == (2, 525_601)
    assert alarms.repeated(spark.range(3), F.col("id") * 1500, "n").groupBy("id").agg(
        F.count("*"), F.min("n"), F.max("n")
    ).orderBy("id").collect() == [(1, 1500, 0, 1499), (2, 3000, 0, 2999)]


def test_the_catalogue_reads_the_table_twice_at_most(spark, sf_dir):
    from rivulet.plans.queries import REGISTRY

    for name in ("alarm_board", "alarm_catalogue"):
        df = REGISTRY[name](spark, sf_dir)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        final = plan[: plan.index("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
        scans = {m for m in re.findall(r"FileScan parquet.*?ReadSchema: \S+", final, re.S)}
        assert len({re.sub(r"#\d+L?|plan_id=\d+|id=#\d+", "", s) for s in scans}) <= 2


def test_merged_sketches_keep_to_their_rank_error(spark):
    rows = spark.range(0, 200_000, 1, 7).select(
        F.timestamp_seconds(F.col("id") % 7200).alias("ts"), (F.col("id") % 3).cast("string").alias("broker"),
        (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) * 1.0).alias("value"), F.lit("s").alias("stream"),
    )
    kept = metrics.quantile_sketches(rows, ["stream", "broker"])
    assert kept.count() == 360
    values = {}
    for r in rows.select(F.floor(F.unix_seconds("ts") / 3600).alias("h"), "value").collect():
        values.setdefault(r.h, []).append(r.value)
    for q in (0.5, 0.99):
        for r in metrics.merged_quantile(kept, ["stream"], 3600, q).collect():
            own = values[int(r.period.timestamp()) // 3600]
            rank = sum(v <= r.stat for v in own) / len(own)
            assert r.datapoints == len(own) and abs(rank - q) <= metrics.SKETCH_RANK_ERROR
    small = metrics.merged_quantile(kept.where("broker = '1'"), ["stream", "broker"], 300, 0.99)
    assert small.count() == 24


def test_sketches_of_nulls_and_no_rows(spark):
    none = spark.createDataFrame([("s", "2024-01-01", None)], "stream string, ts string, value double")
    none = none.withColumn("ts", F.col("ts").cast("timestamp"))
    kept = metrics.quantile_sketches(none, ["stream"])
    assert [r.datapoints for r in kept.collect()] == [0]
    assert metrics.merged_quantile(kept, ["stream"], 300, 0.99).collect() == []
    assert metrics.quantile_sketches(none.where("false"), ["stream"]).collect() == []


def test_quantiles_made_exact_from_merged_sketches(spark):
    rows = spark.range(0, 60_000, 1, 5).select(
        F.timestamp_seconds(F.col("id") % 7200).alias("ts"), (F.col("id") % 3).cast("string").alias("broker"),
        (F.pmod(F.xxhash64("id"), F.lit(20_011)) * 1.0).alias("value"), F.lit("s").alias("stream"),
    )
    values = {}
    for r in rows.select(F.floor(F.unix_seconds("ts") / 3600).alias("h"), "value").collect():
        values.setdefault(r.h, []).append(r.value)
    kept = metrics.quantile_sketches(rows, ["stream", "broker"])
    # Sketches that miss datapoints, or all of them, give bounds that do not hold.
    off = metrics.quantile_sketches(rows.where("value < 9000 and ts < timestamp'1970-01-01 01:00:00'"), ["stream", "broker"])
    high = metrics.quantile_sketches(rows.where("value > 19900"), ["stream", "broker"])
    for sketches in (kept, off, high):
        for q in (0.0, 0.5, 0.99, 1.0):
            found = metrics.exact_quantile(rows, sketches, ["stream"], 3600, q).collect()
            assert len(found) == 2
            for r in found:
                own = sorted(values[int(r.period.timestamp()) // 3600])
                assert (r.datapoints, r.stat) == (len(own), own[max(-(-len(own) * int(q * 100) // 100), 1) - 1])


def test_exact_quantiles_of_odd_values(spark):
    nan = float("nan")
    rows = [(0, None, "s"), (6, nan, "s"), (7, nan, "s"), (11, 1.0, None), (12, None, None), (13, 2.0, None), (16, 3.0, "s"), (16, nan, "s")]
    df = points(spark, rows)
    found = metrics.exact_quantile(df, metrics.quantile_sketches(df, ["stream"]), ["stream"], 300, 0.5).collect()
    assert list(map(repr, minutes(found, "stream", "datapoints", "stat"))) == list(map(repr, [
        (0, "s", 0, None), (5, "s", 2, nan), (10, None, 2, 1.0), (15, "s", 2, 3.0)
    ]))
    none = df.where("false")
    assert metrics.exact_quantile(none, metrics.quantile_sketches(none, ["stream"]), ["stream"], 300, 0.5).collect() == []
