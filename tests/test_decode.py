import base64
import json

from pyspark.sql import functions as F

from rivulet.functions.fare import fare, fare_status
from rivulet.functions.payload import encode_payload
from rivulet.functions.times import parse_event_time
from rivulet.operators import decode, enrich
from tests.doubles import priced

import pytest


def b64(text):
    return base64.b64encode(text.encode()).decode()


def test_stream_envelope_of_one_record(spark):
    text = json.dumps({"Records": [{"kinesis": {"partitionKey": "1", "data": b64("Hello World"), "sequenceNumber": "7"}}]})
    rows = decode.parse_envelope(spark.createDataFrame([(1, text)], "id int, body string"), "body", decode.STREAM_ENVELOPE)
    out = decode.explode_stream_envelope(rows)
    assert [(r.payload, r.error_type) for r in out.collect()] == [("Hello World", None)]
    assert out.count() == 1


def test_stream_envelope_without_data_is_an_error_row(spark):
    rows = spark.createDataFrame([(json.dumps({"Records": [{"foo": "bar"}]}),)], "body string")
    out = decode.explode_stream_envelope(decode.parse_envelope(rows, "body", decode.STREAM_ENVELOPE)).collect()
    assert [(r.payload, r.error_type) for r in out] == [(None, "base64")]


def test_envelopes_that_cannot_be_read_or_are_empty_stay_as_error_rows(spark):
    texts = ["{bad", "{}", '{"Records":[]}', '{"records":{"t-0":[]}}', None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    for schema, explode in (
        (decode.STREAM_ENVELOPE, decode.explode_stream_envelope), (decode.LOG_ENVELOPE, decode.explode_log_envelope)
    ):
        out = explode(decode.parse_envelope(rows, "body", schema).drop("eventSource")).collect()
        assert sorted((r.id, r.position, r.error_type) for r in out) == [(k, None, "envelope") for k in range(5)]


def test_log_envelope_of_three_records(spark):
    def record(partition, offset, text):
        return {"topic": "MyTopic", "partition": partition, "offset": offset, "timestamp": offset,
                "timestampType": "CREATE_TIME", "value": b64(text)}

    text = json.dumps({"records": {
        "MyTopic-0": [record(0, 0, "12345"), record(0, 1, "12346")], "MyTopic-1": [record(1, 0, "12347")],
    }})
    rows = decode.parse_envelope(spark.createDataFrame([(text,)], "body string"), "body", decode.LOG_ENVELOPE)
    out = decode.explode_log_envelope(rows)
    assert sorted((r.topic_partition, r.position, r.payload) for r in out.collect()) == [
        ("MyTopic-0", 0, "12345"), ("MyTopic-0", 1, "12346"), ("MyTopic-1", 0, "12347"),
    ]
    summary = {r.topic_partition: r.records for r in decode.consume_summary(out, ["topic_partition"]).collect()}
    assert summary == {"MyTopic-0": 2, "MyTopic-1": 1, None: 3}


def test_payload_stays_on_one_line(spark):
    text = "x" * 1000
    row = spark.createDataFrame([(text,)], "t string").select(encode_payload(F.col("t")).alias("v")).first()
    assert row.v == b64(text)


def test_decode_json_drops_unknown_and_nulls_missing(spark):
    rows = spark.createDataFrame([('{"trip_id": 5, "other": 1}',), ("{bad",), (None,), ('{"trip_id": "x"}',)], "value string")
    out = decode.decode_json(rows, decode.RIDE_REQUEST).collect()
    assert [(r.trip_id, r.vehicle_id, r.error_type) for r in out] == [
        (5, None, None), (None, None, "json"), (None, None, "json"), (None, None, "json"),
    ]


def test_encode_omits_nulls(spark):
    row = spark.createDataFrame([(1, None, 2.5)], "a int, b int, c double")
    assert decode.encode_json(row, ["a", "b", "c"]).first().value == '{"a":1,"c":2.5}'


@pytest.mark.parametrize("text, expected", [
    ("2020-08-01 12:00:00.000", "2020-08-01 12:00:00"),
    ("2020-08-01 12:00:00", "2020-08-01 12:00:00"),
    ("2020-08-01T12:00:00.123456", "2020-08-01 12:00:00.123456"),
    ("2020-08-01T12:00:00.5Z", "2020-08-01 12:00:00.5"),
    ("2020-08-01T12:00:00+02:00", "2020-08-01 10:00:00"),
    ("yesterday", None),
    (None, None),
])
def test_parse_event_time(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(parse_event_time(F.col("t")).cast("string")).first()[0] == expected


@pytest.mark.parametrize("objects", [
    ['{"a":1}'],
    ['{"a":1}', '{"b":2}', '{"c":3}'],
    ['{"a":{"b":{"c":1}}}', '{"d":[{"e":1},{"f":{}}]}'],
    ['{"a":"}{"}', '{"b":"x} {y"}'],
    ['{"a":"\\"}{\\""}', '{"b":"\\\\"}', '{"c":"\\\\\\"}{"}'],
    ['{}', '{}'],
])
@pytest.mark.parametrize("between", ["", " ", "\n"])
def test_deaggregate(spark, objects, between):
    rows = spark.createDataFrame([(1, between.join(objects))], "id int, value string")
    out = sorted((r.position, r.object) for r in decode.deaggregate(rows).collect())
    assert [text for _, text in out] == objects


def test_deaggregate_long_strings(spark):
    objects = [json.dumps({"a": "}{\"\\" * 20_000}), json.dumps({"b": "z" * 100_000})]
    rows = spark.createDataFrame([("".join(objects),)], "value string")
    assert [r.object for r in decode.deaggregate(rows).orderBy("position").collect()] == objects


def test_extract_keys_nested_and_missing(spark):
    rows = spark.createDataFrame([('{"a":{"b":1,"c":"x"},"d":{"e":2}}',), ('{"a":{}}',), ("{bad",)], "value string")
    out = decode.extract_keys(rows, {"b": ".a.b", "c": "$.a.c", "d": ".d"}).collect()
    assert [(r.b, r.c, r.d) for r in out] == [("1", "x", '{"e":2}'), (None, None, None), (None, None, None)]


@pytest.mark.parametrize("path", ["a", ".a[0]", ".a | .b", ""])
def test_extract_keys_takes_paths_only(spark, path):
    with pytest.raises(ValueError):
        decode.extract_keys(spark.createDataFrame([("{}",)], "value string"), {"k": path})


def test_fare_for_an_id_and_for_none(spark):
    row = spark.range(123, 124).select(fare(F.col("id")).alias("f"), fare_status(F.col("id")).alias("s")).first()
    status, body = priced("123")
    assert (row.s, status) == (200, 200) and json.loads(body)["expected_fare"] == row.f
    for missing in (None, "0", "nan", ""):
        assert priced(missing)[0] == 400
    empty = spark.createDataFrame([(0.0,), (float("nan"),), (None,)], "id double")
    assert {tuple(r) for r in empty.select(fare_status(F.col("id")), fare(F.col("id"))).collect()} == {(400, None)}


def test_fare_of_negative_id_matches_call(spark):
    row = spark.createDataFrame([(-7,)], "id bigint").select(fare(F.col("id"))).first()
    assert json.loads(priced("-7")[1])["expected_fare"] == row[0]


def test_request_without_trip_id_goes_to_errors(spark):
    rows = spark.createDataFrame([(20, None), (None, 3)], "trip_id bigint, ride_request_id bigint")
    out = enrich.with_request_id(rows).collect()
    assert [(r.trip_id, r.ride_request_id, r.error_type) for r in out] == [(None, 20, None), (None, None, "trip_id")]


def test_sampling_truncates_like_the_sign(spark):
    out = enrich.sample_mod(spark.createDataFrame([(-40,), (-1,), (0,), (20,), (21,)], "id bigint"), "id")
    assert sorted(r.id for r in out.collect()) == [-40, 0, 20]
