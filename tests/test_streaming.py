import glob
import gzip
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from rivulet.operators import delivery, routing
from rivulet.plans.queries import REGISTRY, streamed_events
from rivulet.session import shared_dir, workspace
from rivulet.sources import archive, streams, ticks
from rivulet.streaming import buffers, sinks, windows


def tick_rows(spark, n, start="2024-01-01 00:00:00"):
    return spark.range(n).select(
        (F.to_timestamp(F.lit(start)) + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("event_time"),
        F.element_at(F.array(*map(F.lit, ticks.TICKERS)), (F.col("id") % 5 + 1).cast("int")).alias("ticker"),
        (F.col("id") % 100).cast("double").alias("price"),
    )


def tick_files(spark, path):
    return streams.read_files(spark, path, tick_rows(spark, 1).schema, files_per_trigger=1)


def test_shared_dir_is_the_named_one(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == named and workspace(spark, "x").startswith(named)


@pytest.mark.parametrize("writers", [None, 2])
def test_tick_sink_survives_restart_without_duplicates(spark, tmp_path, writers):
    source, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "cp"))

    def run():
        stream = sinks.with_dt_hr(sinks.hot_ticks(tick_files(spark, source)))
        sinks.sink_ticks(stream, out, checkpoint, None, writers).awaitTermination()
        return sinks.read_ticks(spark, out)

    tick_rows(spark, 120).coalesce(1).write.mode("append").parquet(source)
    assert run().count() == 49
    assert run().count() == 49
    tick_rows(spark, 120, "2024-01-02 00:00:00").coalesce(1).write.mode("append").parquet(source)
    rows = run()
    assert rows.count() == 98 and rows.distinct().count() == 98
    assert {r.hr for r in rows.select("hr").distinct().collect()} == {"00", "01"}
    assert set(os.listdir(out)) >= {"ticker=AAPL", "_spark_metadata"}


def test_tick_sink_writes_with_several_tasks_and_one_file_per_value(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    tick_rows(spark, 3000).orderBy(F.xxhash64("event_time")).coalesce(1).write.parquet(source)
    stream = sinks.with_dt_hr(sinks.hot_ticks(tick_files(spark, source)))
    sinks.sink_ticks(stream, out, str(tmp_path / "cp"), None, 3).awaitTermination()
    files = glob.glob(f"{out}/ticker=*/dt=*/hr=*/*.json")
    assert len({os.path.dirname(f) for f in files}) == len(files)
    assert len({os.path.basename(f).split("-")[1] for f in files}) == 3


def test_streamed_files_match_batch(spark, sf_dir):
    out = REGISTRY["hot_ticks"](spark, sf_dir).where(F.col("dt") == "2024-01-05")
    root = workspace(spark, "t")
    stream = streamed_events(spark, sf_dir).select(
        F.col("ts").alias("event_time"), F.col("event_type").alias("ticker"), F.col("value").alias("price")
    )
    day = sinks.with_dt_hr(sinks.hot_ticks(stream)).where(F.col("dt") == "2024-01-05")
    sinks.sink_ticks(day, f"{root}/o", f"{root}/c", None).awaitTermination()
    columns = ["ticker", "price", "dt", "hr"]
    written = sinks.read_ticks(spark, f"{root}/o").select(*columns).collect()
    assert sorted(written) == sorted(out.select(*columns).collect()) != []


def test_partition_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "p")
    sinks.with_dt_hr(tick_rows(spark, 200)).write.partitionBy("ticker", "dt", "hr").json(path)
    plan = sinks.read_ticks(spark, path).where("ticker = 'AAPL' AND hr = '01'")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ticker" in text


def line_stream(spark, path, n=400):
    spark.range(n).select(
        F.to_timestamp(F.lit("2024-03-05 07:30:00")).alias("arrival"),
        F.to_json(F.struct(F.col("id"), F.when(F.col("id") % 10 > 0, F.concat(F.lit("k"), (F.col("id") % 2).cast("string"))).alias("key"))).alias("line"),
        F.when(F.col("id") == 7, "json").alias("error_type"),
    ).coalesce(1).write.parquet(path)
    return streams.read_files(spark, path, "arrival timestamp, line string, error_type string")


def test_archive_sink_layout_errors_and_repeat(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    stream = line_stream(spark, source)
    for attempt in ("a", "b"):
        # A second checkpoint repeats batch 0, as after a failure before its commit.
        sinks.archive_sink(stream, out, str(tmp_path / attempt), interval_s=None).awaitTermination()
        data = glob.glob(f"{out}/data/year=2024/month=03/day=05/hour=07/batch=0/*.txt.gz")
        lines = [json.loads(x) for f in data for x in gzip.open(f, "rt")]
        assert sorted(x["id"] for x in lines) == [i for i in range(400) if i != 7]
        bad = glob.glob(f"{out}/errors/year=2024/month=03/day=05/hour=07/error_type=json/batch=0/*.txt.gz")
        assert [json.loads(x)["id"] for f in bad for x in gzip.open(f, "rt")] == [7]


def test_dynamic_partitions_and_missing_key(spark, tmp_path):
    from rivulet.operators.decode import extract_keys

    out = str(tmp_path / "out")
    keyed = extract_keys(line_stream(spark, str(tmp_path / "in")), {"key": ".key"}, "line")
    sinks.dynamic_partition_sink(keyed, out, str(tmp_path / "c"), ["key"], interval_s=None).awaitTermination()
    assert sorted(os.path.basename(p) for p in glob.glob(f"{out}/data/key=*")) == ["key=k0", "key=k1"]
    missing = spark.read.text(f"{out}/errors").where("error_type = 'partition_key'")
    assert missing.count() == 40


@pytest.mark.parametrize("delimiter", [True, False])
def test_objects_stay_below_the_buffer_size(spark, tmp_path, delimiter):
    out = str(tmp_path / "o")
    lines = spark.range(3000).select(
        F.lit("x").alias("p"), F.to_json(F.struct("id", F.repeat(F.lit("é"), 500).alias("t"))).alias("line")
    )
    delivery.write_objects(lines, out, ["p"], buffer_mb=1, compression="UNCOMPRESSED", delimiter=delimiter)
    files = glob.glob(f"{out}/p=x/*.txt")
    assert len(files) >= 3 and max(map(os.path.getsize, files)) <= 1024 * 1024
    text = "".join(open(f, encoding="utf-8").read() for f in files)
    assert (text.count("\n") == 3000) if delimiter else (text.count("\n") == len(files))
    decoder, at, ids = json.JSONDecoder(), 0, []
    while at < len(text):
        item, at = decoder.raw_decode(text, at)
        ids.append(item["id"])
        at += int(text[at : at + 1] == "\n")
    assert sorted(ids) == list(range(3000))


def test_one_long_line_does_not_shrink_all_files_and_nulls_stay(spark, tmp_path):
    rows = [("x", "y" * 3_000_000 if k == 700 else None if k == 5 else f"line {k}\n") for k in range(2000)]
    lines = spark.createDataFrame(rows, "p string, line string").repartition(3)
    out = str(tmp_path / "o")
    delivery.write_objects(lines, out, ["p"], buffer_mb=1, compression="UNCOMPRESSED")
    files = glob.glob(f"{out}/p=x/*.txt")
    assert len(files) <= 12
    written = "".join(open(f, encoding="utf-8").read() for f in files).split("\n")[:-1]
    assert sorted(written) == sorted((line or "").removesuffix("\n") for _, line in rows)
    none = spark.createDataFrame([("e", None)] * 3, "p string, line string")
    delivery.write_objects(none, out, ["p"], compression="UNCOMPRESSED")
    assert spark.read.text(f"{out}/p=e").count() == 3


def test_state_follows_open_periods(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "ts timestamp, stream string, value double"
    for hour in range(6):
        spark.range(60).select(
            F.timestamp_seconds(F.lit(1_704_067_200 + 3600 * hour) + F.col("id") * 60).alias("ts"),
            F.lit("s").alias("stream"), F.lit(1.0).alias("value"),
        ).coalesce(1).write.mode("append").parquet(source)
    stats = windows.metric_stream(streams.read_files(spark, source, schema, files_per_trigger=1), ["stream"], 600)
    query = windows.latest_to_table(stats, out, checkpoint)
    query.awaitTermination()
    rows = windows.read_latest(spark, out, ["stream"]).collect()
    assert len(rows) == 36 and all(r.datapoints == 10 for r in rows)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) <= 13 and held[-1] <= 8


@pytest.mark.parametrize("name, codec", [("GZIP", "gzip"), ("Snappy", "snappy"), ("HADOOP_SNAPPY", "snappy"), ("UNCOMPRESSED", "none")])
def test_codecs(name, codec):
    assert delivery.codec(name) == codec


def test_zip_is_refused():
    with pytest.raises(ValueError, match="ZIP"):
        delivery.codec("ZIP")


@pytest.mark.parametrize("options", [{"interval_s": 59}, {"interval_s": 901}, {"buffer_mb": 0}, {"buffer_mb": 129}])
def test_buffer_bounds(spark, options):
    with pytest.raises(ValueError):
        sinks.archive_sink(None, "o", "c", **options)


def test_fixed_records_per_object(spark, tmp_path):
    out = str(tmp_path / "o")
    delivery.write_fixed_count(spark.range(100), out, flush_size=10, tasks=2)
    sizes = [sum(1 for _ in open(f)) for f in glob.glob(f"{out}/*.json")]
    assert sum(sizes) == 100 and max(sizes) == 10
    with pytest.raises(ValueError):
        delivery.write_fixed_count(spark.range(1), out, 0, 1)


def test_archive_is_read_back_in_log_order(spark, tmp_path):
    lines = spark.createDataFrame([
        ('{"topic":"t","partition":1,"offset":0,"value":"YQ=="}',), ('{"topic":"t","partition":0,"offset":1,"value":"?"}',),
        ('{"topic":"t","partition":0,"offset":0,"value":"Yg=="}',), ("{bad",),
    ], "value string")
    lines.write.text(str(tmp_path / "a"))
    rows = archive.read_archive(spark, str(tmp_path / "a")).collect()
    assert [(r.partition, r.offset, r.payload, r.error_type) for r in rows] == [
        (None, None, None, "json"), (0, 0, "b", None), (0, 1, None, None), (1, 0, "a", None),
    ]


def test_replay_reads_only_matching_partitions(spark, tmp_path):
    path = str(tmp_path / "h")
    spark.range(60).select("id", (2016 + F.col("id") % 4).cast("int").alias("dropoff_year")).write.partitionBy("dropoff_year").parquet(path)
    schema = "id bigint, dropoff_year int"
    stream = archive.replay(
        spark, path, schema, F.col("dropoff_year") == 2018, files_per_trigger=1
    )
    query = stream.writeStream.format("memory").queryName("replayed").trigger(availableNow=True).start()
    query.awaitTermination()
    listed = sum(p["sources"][0]["numInputRows"] for p in query.recentProgress)
    assert listed == 15, "other partitions are not read"
    assert {r.dropoff_year for r in spark.table("replayed").collect()} == {2018}
    assert spark.table("replayed").count() == 15


ODD_KEYS = ["plain", "A:B", "A,B", "{x}", "50%", "%41", " two words ", "a=b", "a/b", "#", "'q'", "*", "[z]", "ä", "\\"]


def test_replay_streams_odd_and_null_partitions_and_later_ones(spark, tmp_path):
    path, out, checkpoint = (str(tmp_path / n) for n in ("h", "out", "cp"))
    schema = "id bigint, k string, day int"

    def lay(first, keys):
        rows = [(first + i, k, i % 2) for i, k in enumerate(keys)]
        spark.createDataFrame(rows, schema).write.mode("append").partitionBy("k", "day").parquet(path)
        return rows

    def run():
        wanted = ~F.col("k").eqNullSafe("plain")
        stream = archive.replay(spark, path, schema, wanted, files_per_trigger=4)
        query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True)
        query.start(out).awaitTermination()
        return sorted(map(tuple, spark.read.schema(schema).parquet(out).collect()))

    rows = lay(0, [*ODD_KEYS, None])
    assert run() == sorted(r for r in rows if r[1] != "plain")
    rows += lay(100, ["later", "A:B", None])
    assert run() == sorted(r for r in rows if r[1] != "plain")


def test_replay_within_a_glob(spark, tmp_path):
    path = str(tmp_path / "h")
    spark.createDataFrame([(i, f"2024-0{i % 3 + 1}-01") for i in range(9)], "id bigint, dt string").write.partitionBy("dt").parquet(path)
    stream = archive.replay(spark, path, "id bigint, dt string", F.lit(True), within="dt=2024-0[12]-*")
    stream.writeStream.format("memory").queryName("within").trigger(availableNow=True).start().awaitTermination()
    assert {r.dt for r in spark.table("within").collect()} == {"2024-01-01", "2024-02-01"}


def test_late_rows_are_dropped_behind_the_watermark(spark, tmp_path):
    source, checkpoint, out = (str(tmp_path / n) for n in ("in", "cp", "out"))
    schema = "ts timestamp, stream string, value double"

    def add(*times):
        rows = spark.createDataFrame([(t, "s", 1.0) for t in times], "ts string, stream string, value double")
        rows.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)

    def run():
        stats = windows.metric_stream(streams.read_files(spark, source, schema), ["stream"], 60)
        late = windows.LateRows()
        spark.streams.addListener(late)
        query = windows.latest_to_table(stats, out, checkpoint, mode="append")
        query.awaitTermination()
        deadline = time.time() + 20
        while time.time() < deadline and not any(late.dropped.values()):
            time.sleep(0.2 if done else 20)
        spark.streams.removeListener(late)
        return sum(late.dropped.values())

    done = []
    add("2024-01-01 00:00:10", "2024-01-01 00:05:00")
    windows.latest_to_table(
        windows.metric_stream(streams.read_files(spark, source, schema), ["stream"], 60), out, checkpoint, mode="append"
    ).awaitTermination()
    done.append(True)
    # 00:00:20 is behind the watermark 00:04:55; 00:04:57 and 00:10:00 are not.
    add("2024-01-01 00:00:20", "2024-01-01 00:04:57", "2024-01-01 00:10:00")
    assert run() == 1
    done = spark.read.parquet(out).orderBy("period").collect()
    assert [(r.period.minute, r.datapoints) for r in done] == [(0, 1), (4, 1), (5, 1)]


def test_console_and_rate_sources(spark, tmp_path, capfd):
    source = str(tmp_path / "in")
    tick_rows(spark, 3).coalesce(1).write.parquet(source)
    sinks.console(tick_files(spark, source), str(tmp_path / "c")).awaitTermination()
    live = ticks.tick_stream(spark)
    assert live.isStreaming and set(live.columns) == {"tick_id", "ticker", "price", "event_time"}


def test_generated_ticks_do_not_depend_on_partitions(spark):
    now = F.current_timestamp()
    one = ticks.gen_ticks(spark.range(500).coalesce(1), "id", now).drop("event_time").collect()
    many = ticks.gen_ticks(spark.range(500).repartition(7), "id", now).drop("event_time").collect()
    assert sorted(one) == sorted(many)
    assert {r.ticker for r in one} == set(ticks.TICKERS) and all(0 <= r.price < 100 for r in one)
    other = ticks.gen_ticks(spark.range(500), "id", now, seed=1).drop("event_time").collect()
    assert sorted(one) != sorted(other)


def test_admission_options():
    assert streams.admission() == {"maxOffsetsPerTrigger": "100"}
    assert streams.rate_admission(10) == {"maxOffsetsPerTrigger": "1000"}
    assert streams.buffered(500, 300) == {"minOffsetsPerTrigger": "500", "maxTriggerDelay": "300s"}
    for wrong in (0, 10_001, -1):
        with pytest.raises(ValueError):
            streams.admission(wrong)
    for wrong in (0, 901):
        with pytest.raises(ValueError):
            streams.rate_admission(wrong)


@pytest.mark.parametrize("hours", [23, 8761])
def test_retention_bounds(spark, hours):
    with pytest.raises(ValueError):
        streams.retain(spark.range(1), "id", hours, F.lit(None))


def test_start_positions(spark, tmp_path):
    source = str(tmp_path / "in")
    tick_rows(spark, 10).coalesce(1).write.parquet(source)
    late = streams.read_files(
        spark, source, tick_rows(spark, 1).schema, start=streams.LATEST, since="2024-01-01 00:07:00", ts="event_time"
    )
    query = late.writeStream.format("memory").queryName("late_start").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("late_start").count() == 3
    with pytest.raises(ValueError):
        streams.read_files(spark, source, tick_rows(spark, 1).schema, start=streams.LATEST)
    with pytest.raises(ValueError):
        streams.read_topic(spark, "localhost:9092", "t", start="middle")


def test_sql_on_the_tick_table_with_a_python_function(spark):
    import pandas as pd

    messages = spark.createDataFrame([
        ('{"event_time":"2020-08-01 12:00:00.000","ticker":"AMZN","price":50}',),
        ('{"event_time":"2020-08-01T13:00:00.000","ticker":"AMZN","price":51}',),
        ('{"event_time":"never","ticker":"AMZN","price":52}',),
    ], "value string")
    streams.register_tick_table(spark, messages, "ticks_here")

    @F.pandas_udf("double")
    def doubled(price: pd.Series) -> pd.Series:
        return price * 2

    spark.udf.register("doubled", doubled)
    rows = spark.sql("SELECT doubled(price) AS d, hour(event_time) AS h FROM ticks_here WHERE price > 50").collect()
    assert [(r.d, r.h) for r in rows] == [(102.0, 13)]


def partitions_of(df, key):
    return df.select(key, F.spark_partition_id().alias("p")).distinct().groupBy(key).count()


def test_routing(spark):
    rows = tick_rows(spark, 1000)
    sizes = [r["count"] for r in routing.rebalance(rows, 4).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 4
    assert {r["count"] for r in partitions_of(routing.route_by_key(rows, 4, "ticker"), "ticker").collect()} == {1}
    salt = F.pmod(F.xxhash64("event_time"), F.lit(8))
    spread = partitions_of(routing.route_by_key(rows, 4, "ticker", salt), "ticker")
    assert max(r["count"] for r in spread.collect()) > 1


@pytest.mark.parametrize("shards", [0, 201])
def test_shard_bounds(spark, shards):
    from rivulet.functions.shards import shard_of

    with pytest.raises(ValueError):
        shard_of(F.col("id"), shards)


def trickle(spark, path, batches, lines_of):
    for b in range(batches):
        rows = spark.createDataFrame(lines_of(b), "prefix string, line string")
        rows.coalesce(1).write.mode("append").parquet(path)
    return streams.read_files(spark, path, "prefix string, line string", files_per_trigger=1)


def objects_of(out):
    found = {}
    for f in sorted(glob.glob(f"{out}/prefix=*/reason=*/batch=*/*.txt")):
        prefix, reason = f.split("prefix=")[1].split("/")[0], f.split("reason=")[1].split("/")[0]
        found.setdefault((prefix, reason), []).append(open(f, encoding="utf-8").read())
    return found


def test_a_trickle_gives_few_full_objects_and_survives_a_restart(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))

    def lines_of(b):
        return [("p", f"{b}-{i} " + "é" * 1_000) for i in range(150)] + [("q", None if b == 1 else f"only {b}\n")]

    def run(batches, first):
        stream = trickle(spark, source, batches, lambda b: lines_of(first + b))
        query = buffers.buffered_sink(
            stream, out, checkpoint, ["prefix"], interval_s=900, buffer_mb=1, compression="UNCOMPRESSED"
        )
        buffers.catch_up(query)

    run(4, 0)
    assert {k: len(v) for k, v in objects_of(out).items()} == {("p", "size"): 1}
    run(4, 4)
    full = objects_of(out)[("p", "size")]
    assert len(full) == 2 and all(1_040_000 < len(t.encode()) <= 1_048_576 for t in full)
    waiting = buffers.waiting_lines(spark, checkpoint).collect()
    written = [line for text in full for line in text.split("\n")[:-1]]
    kept = [r.line for r in waiting if r.prefix == "p"]
    assert sorted(written + kept) == sorted(x for b in range(8) for p, x in lines_of(b) if p == "p")
    assert sorted(r.line for r in waiting if r.prefix == "q") == sorted(["", *(f"only {b}" for b in range(8) if b != 1)])


def test_buffers_flush_after_the_interval(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(delivery, "INTERVAL_S", (1, 900))
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    stream = trickle(spark, source, 1, lambda b: [("p", f"line {i}") for i in range(5)])
    query = buffers.buffered_sink(
        stream, out, checkpoint, ["prefix"], interval_s=1, compression="UNCOMPRESSED", lanes=2
    )
    deadline = time.time() + 90
    while time.time() < deadline and sum(t.count("\n") for v in objects_of(out).values() for t in v) < 5:
        time.sleep(0.5)
    query.stop()
    assert set(objects_of(out)) == {("p", "interval")}
    assert sorted("".join(objects_of(out)[("p", "interval")]).split()) == sorted("line 0 line 1 line 2 line 3 line 4".split())


def test_null_lines_without_a_delimiter_go_to_the_errors(spark, tmp_path):
    out = str(tmp_path / "o")
    lines = spark.createDataFrame([("x", "{}"), ("x", None), ("x", "[]")], "p string, line string")
    with pytest.raises(Exception, match="null line"):
        delivery.write_objects(lines, out, ["p"], compression="UNCOMPRESSED", delimiter=False)
    source = str(tmp_path / "in")
    rows = spark.createDataFrame(
        [("2024-01-01 00:00:00", "{}"), ("2024-01-01 00:00:00", None), (None, "[]")], "t string, line string"
    )
    rows.select(F.col("t").cast("timestamp").alias("arrival"), "line").coalesce(1).write.parquet(source)
    stream = streams.read_files(spark, source, "arrival timestamp, line string")
    sinks.archive_sink(
        stream, f"{out}/s", str(tmp_path / "c"), interval_s=None, compression="UNCOMPRESSED", delimiter=False
    ).awaitTermination()
    assert spark.read.text(f"{out}/s/data").count() == 2
    assert [r.error_type for r in spark.read.text(f"{out}/s/errors").collect()] == ["line"]


def test_compaction_keeps_few_folders_and_the_newest_rows(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "table", "cp"))
    schema = "ts timestamp, stream string, value double"

    def run(first, last):
        for b in range(first, last):
            rows = [(f"2024-01-01 00:{m:02d}:30", f"s{m % 3}", float(b)) for m in range(b % 5, 20, 5)]
            frame = spark.createDataFrame(rows, "ts string, stream string, value double")
            frame.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)
        points = streams.read_files(spark, source, schema, files_per_trigger=1)
        stats = windows.metric_stream(points, ["stream"], 60, delay="1 day")
        windows.compacting_to_table(stats, path, checkpoint, ["stream"], merge_at=3).awaitTermination()

    run(0, 9)
    left = windows.folders(spark, path)
    assert len(left) == 1 and "/level=2/" in left[0]
    run(9, 12)
    assert len(windows.folders(spark, path)) <= 3
    got = {(r.period.minute, r.stream): (r.datapoints, r.Sum, r.Maximum) for r in windows.read_latest(spark, path, ["stream"]).collect()}
    want = {}
    for b in range(12):
        for m in range(b % 5, 20, 5):
            n, total, _ = want.get((m, f"s{m % 3}"), (0, 0.0, 0))
            want[m, f"s{m % 3}"] = (n + 1, total + b, float(b))
    assert got == want
    assert len(glob.glob(f"{path}_manifest/slot=*")) == 2


def test_streamed_sketches_give_percentiles(spark, tmp_path):
    from rivulet.operators import metrics

    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "table", "cp"))
    rows = spark.range(3000).select(
        F.timestamp_seconds(F.col("id") % 600).alias("ts"), (F.col("id") % 2).cast("string").alias("broker"),
        (F.col("id") * 7919 % 3001).cast("double").alias("value"),
    )
    rows.repartition(3).write.parquet(source)
    points = streams.read_files(spark, source, rows.schema, files_per_trigger=1)
    sketches = windows.sketch_stream(points, ["broker"], delay="1 day")
    windows.latest_to_table(sketches, path, checkpoint).awaitTermination()
    kept = windows.read_latest(spark, path, ["broker"])
    assert kept.count() == 20
    (got,) = metrics.merged_quantile(kept, [], 3600, 0.99).collect()
    exact = sorted(r.value for r in rows.collect())
    assert got.datapoints == 3000
    assert abs(sum(v <= got.stat for v in exact) / 3000 - 0.99) <= metrics.SKETCH_RANK_ERROR


def test_objects_hold_exactly_so_many_records(spark, tmp_path):
    rows = [("hot", k) for k in range(1_003)] + [("cold", k) for k in range(5)] + [(None, k) for k in range(40)]
    df = spark.createDataFrame(rows, "p string, id long").repartition(7)
    out = str(tmp_path / "o")
    delivery.write_exact_count(df, out, ["p"], "id", 10, tasks=4, slice_rows=50)
    sizes = {}
    for f in glob.glob(f"{out}/p=*/*.json"):
        sizes.setdefault(f.split("p=")[1].split("/")[0], []).append(sum(1 for _ in open(f)))
    assert sorted(sizes["hot"]) == [3] + [10] * 100 and sizes["cold"] == [5]
    assert sizes["__HIVE_DEFAULT_PARTITION__"] == [10] * 4
    read = spark.read.schema("id long, p string").json(out)
    assert sorted((r.p or "", r.id) for r in read.collect()) == sorted((p or "", k) for p, k in rows)


def test_live_late_rows_equal_the_audit_and_survive_a_restart(spark, tmp_path):
    from rivulet.operators import lag

    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    rows = spark.range(400).select(
        F.col("id"), (F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 2)).cast("int").alias("p"),
        F.timestamp_seconds(F.col("id")).alias("arrival"),
        F.timestamp_seconds(F.col("id") - F.col("id") * 7919 % 23).alias("ts"),
    )

    def run(first, last):
        for turn in range(first, last):
            rows.where(F.floor(F.col("id") / 100) == turn).coalesce(1).write.mode("append").parquet(source)
        stream = streams.read_files(spark, source, rows.schema, files_per_trigger=1)
        windows.late_rows_sink(stream, out, checkpoint, "p", "arrival", "ts", "id").awaitTermination()

    run(0, 2)
    run(2, 4)
    want = {r.id: r.late for r in lag.late_flags(rows, "p", "arrival", "ts", "id").collect()}
    got = {r.id: r.late for r in spark.read.parquet(f"{out}/rows").withColumn("late", F.col("late").cast("boolean")).collect()}
    assert got == want and 0 < sum(want.values()) < 400


def test_late_stream_takes_turns_of_many_files(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    nowhen = events.limit(2).withColumns({"event_id": -F.col("event_id") - 1, "ts": F.lit(None).cast("timestamp_ntz")})
    events.unionByName(nowhen).repartition(6).write.parquet(str(tmp_path / "events.parquet"))
    got, want = (
        sorted(map(repr, REGISTRY[name](spark, str(tmp_path)).collect())) for name in ("late_stream", "late_audit")
    )
    assert got == want


def counted(path):
    return sorted(sum(1 for _ in open(f)) for f in glob.glob(f"{path}/*.json"))


def test_fixed_counts_on_a_mounted_disk_take_no_process_per_file(spark, tmp_path):
    out = str(tmp_path / "o")
    df = spark.range(95).withColumn("text", F.when(F.col("id") % 2 == 0, F.lit('"ä\n')))
    delivery.write_fixed_count(df, out, flush_size=10, tasks=3)
    delivery.write_fixed_count(df, f"file://{out}", flush_size=10, tasks=1)
    sizes = counted(out)
    assert sum(sizes) == 190 and max(sizes) == 10 and len([n for n in sizes if n < 10]) <= 4
    # Hadoop's local file system leaves a checksum beside each file that it makes with the help of two processes.
    assert sorted(f for f in os.listdir(out) if not f.endswith(".json")) == ["_SUCCESS"]
    read = spark.read.schema(df.schema).json(out)
    assert sorted(map(repr, read.collect())) == sorted(map(repr, df.unionByName(df).collect()))


def test_fixed_counts_elsewhere_and_of_a_job_that_fails(spark, tmp_path):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.counted.link./o", f"file://{tmp_path}")
    delivery.write_fixed_count(spark.range(25), "viewfs://counted/o/p", flush_size=10, tasks=1)
    assert counted(tmp_path / "p") == [5, 10, 10]
    bad = spark.range(50).select(F.when(F.col("id") < 49, F.col("id")).otherwise(F.raise_error(F.lit("no"))).alias("id"))
    with pytest.raises(Exception, match="no"):
        delivery.write_fixed_count(bad, str(tmp_path / "q"), flush_size=10, tasks=2)
    assert glob.glob(f"{tmp_path}/q/*.json") == []


def test_exact_counts_by_odd_prefixes_take_no_process_per_file(spark, tmp_path):
    names = ["a=b/c", "till #3 'x'?", "{%41}", "é ß", "..", None]
    name = F.element_at(F.array(*map(F.lit, names)), (F.col("id") % len(names) + 1).cast("int"))
    df = spark.range(150).select("id", name.alias("p"), (F.date_add(F.lit("2024-01-01"), (F.col("id") % 2).cast("int"))).alias("a:day"))
    out = str(tmp_path / "o")
    delivery.write_exact_count(df, out, ["p", "a:day"], "id", 10, tasks=4, slice_rows=50)
    df.write.partitionBy("p", "a:day").json(str(tmp_path / "want"))
    assert set(os.listdir(out)) - {"_SUCCESS"} == {f for f in os.listdir(tmp_path / "want") if f.startswith("p=")}
    folders = glob.glob(f"{out}/p=*/*/")
    assert len(folders) == 6 and all(sorted(counted(f)) == [5, 10, 10] for f in folders)
    assert glob.glob(f"{out}/**/.*", recursive=True) == []
    read = spark.read.schema(df.schema).json(out)
    assert sorted(map(repr, read.collect())) == sorted(map(repr, df.collect()))


def test_buffered_objects_take_more_files_and_lanes_with_the_volume(spark, sf_dir, tmp_path, monkeypatch):
    import duckdb

    from rivulet.plans import oracles, queries

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lang = F.when(F.col("doc_id") % 9 != 0, F.col("lang"))
    documents.crossJoin(spark.range(8)).withColumns({"doc_id": F.col("doc_id") + F.col("id") * 1000, "lang": lang}).drop(
        "id").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    started, sink = {}, buffers.buffered_sink

    def noted(stream, *args, **options):
        started.update(options, files=sum(f.endswith(".parquet") for f in os.listdir(args[0][: -len("out")] + "in")))
        return sink(stream, *args, **options)

    monkeypatch.setattr(buffers, "buffered_sink", noted)
    monkeypatch.setattr(queries, "TASK_BYTES", 256 * 1024, raising=False)
    rows = REGISTRY["buffered_objects"](spark, str(tmp_path)).collect()
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        want = db.execute(oracles.ORACLES["buffered_objects"]).fetchall()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))
    total, hottest = (f([r.bytes for r in rows]) for f in (sum, max))
    assert total / started["files"] <= 256 * 1024 and hottest / 4 / started["lanes"] <= 256 * 1024
    assert started["lanes"] > 1 and started["files"] > 4
