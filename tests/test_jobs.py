import json

from pyspark.sql import functions as F

from rivulet.operators import decode, delivery, packing
from rivulet.sources import streams
from rivulet.streaming import jobs, sinks
from tests.doubles import priced


def stream_of(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return streams.read_files(spark, path, schema)


def test_sql_over_the_stream_table_into_partitioned_files(spark, tmp_path):
    rows = [
        (json.dumps({"event_time": f"2020-08-01 1{i}:00:00.000", "ticker": "AMZN", "price": 45 + 2 * i}),)
        for i in range(5)
    ]
    messages = stream_of(spark, str(tmp_path / "in"), [*rows, ("{bad",)], "value string")
    streams.register_tick_table(spark, messages, "stock_table")
    kept = spark.sql("""
        SELECT event_time, ticker, price, date_format(event_time, 'yyyy-MM-dd') AS dt,
               date_format(event_time, 'HH') AS hr
        FROM stock_table WHERE price > 50""")
    assert kept.isStreaming
    sinks.sink_ticks(kept, str(tmp_path / "out"), str(tmp_path / "c"), None).awaitTermination()
    out = sinks.read_ticks(spark, str(tmp_path / "out")).orderBy("hr").collect()
    assert [(r.ticker, r.price, r.dt, r.hr) for r in out] == [
        ("AMZN", 51.0, "2020-08-01", "13"), ("AMZN", 53.0, "2020-08-01", "14")
    ]


def test_ride_job_with_and_without_a_client(spark, tmp_path):
    rows = [(json.dumps({"trip_id": i, "vehicle_id": 1}),) for i in (0, 20, 21, 40)]
    messages = stream_of(spark, str(tmp_path / "in"), [*rows, ("{bad",), ('{"vehicle_id":2}',)], "value string")
    found = []
    for name, make_client in (("native", None), ("called", lambda: priced)):
        out = str(tmp_path / name)
        jobs.ride_job(messages, out, str(tmp_path / f"c{name}"), make_client).awaitTermination()
        rows = spark.read.parquet(out).collect()
        found.append(sorted((r.ride_request_id, r.trip_id, r.expected_fare) for r in rows if not r.error_type))
        assert sorted(r.error_type for r in rows if r.error_type) == ["json", "trip_id"]
    assert found[0] == found[1]
    assert [ride for ride, _, _ in found[0]] == [20, 40] and all(trip is None for _, trip, _ in found[0])


def test_delivery_job_keeps_what_was_not_delivered(spark, tmp_path):
    big = "x" * packing.MAX_BYTES
    rows = [("t", 0, i, 0, "CREATE_TIME", big if i == 5 else "AAAA") for i in range(8)]
    schema = decode.LOG_RECORD.simpleString()[len("struct<"):-1].replace(":", " ")
    records = stream_of(spark, str(tmp_path / "in"), rows, schema)

    def make_client():
        return lambda lines: [delivery.RETRYABLE if '"offset":3,' in line else None for line in lines]

    jobs.delivery_job(
        records, packing.invocation_of(F.col("offset"), 100), make_client, str(tmp_path / "out"),
        str(tmp_path / "c"), backoff=float,
    ).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out/outcomes")).orderBy("offset").collect()
    assert [r.offset for r in out] == list(range(8))
    lost = {r.offset: (r.attempts, r.error, len(r.line)) for r in out if r.status == delivery.LOST}
    assert lost[3][:2] == (4, delivery.RETRYABLE) and lost[5][:2] == (0, "oversize")
    assert lost[5][2] > packing.MAX_BYTES and set(lost) == {3, 5}
    assert all(r.line is None for r in out if r.status == delivery.DELIVERED)
