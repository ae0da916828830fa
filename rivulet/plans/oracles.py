"""The same results in SQL, for comparison. Nothing in the library reads this module."""

from __future__ import annotations

from rivulet.plans.catalog import metric_specs, watched_metrics

BAD = "event_id % 97 = 0"
LOG_VALUE = f"to_base64(encode(CASE WHEN {BAD} THEN '{{bad' ELSE props END))"

LOG_RECORDS = f"""
log_records AS (
  SELECT 'events' AS topic, CAST(user_id % 3 AS INTEGER) AS "partition", event_id AS "offset",
         (epoch_us(ts) // 1000) AS "timestamp", 'CREATE_TIME' AS timestamp_type, {LOG_VALUE} AS value,
         CASE WHEN {BAD} THEN '{{bad' ELSE props END AS payload
  FROM events)"""

ENVELOPES = """
placed AS (
  SELECT topic, "partition", "offset", "offset" // 100 AS invocation,
         CASE WHEN "offset" % 89 <> 0 THEN payload END AS payload,
         CASE WHEN "offset" % 89 = 0 THEN 'base64' END AS error_type
  FROM log_records),
good AS (SELECT * FROM placed WHERE invocation % 7 NOT IN (3, 5)),
lost AS (SELECT DISTINCT invocation FROM placed WHERE invocation % 7 IN (3, 5))"""

LINES = f"""{LOG_RECORDS},
lines AS (
  SELECT topic, "partition", "offset",
         '{{"topic":"' || topic || '","partition":' || "partition" || ',"offset":' || "offset"
         || ',"timestamp":' || "timestamp" || ',"timestampType":"' || timestamp_type
         || '","value":"' || value || '"}}' || chr(10) AS line
  FROM log_records),
sized AS (SELECT *, CAST(strlen(line) AS BIGINT) AS size FROM lines)"""

RIDES = f"""
rides AS (
  SELECT event_id, event_type, user_id AS vehicle_id FROM events
  WHERE event_type = 'purchase' AND NOT {BAD} AND event_id % 20 = 0)"""


def fare(ride_id: str) -> str:
    part = f"((2.718281828459045::DOUBLE * {ride_id}::DOUBLE) % 1.0::DOUBLE)"
    return (
        f"floor({part} * 91::DOUBLE + 10::DOUBLE) * "
        f"(1::DOUBLE + {part} * 0.4::DOUBLE - 0.2::DOUBLE)"
    )


def period(seconds: str | int, ts: str = "ts") -> str:
    width = f"({seconds}::BIGINT * 1000000)"
    return f"make_timestamp(epoch_us({ts}) // {width} * {width})"


def shard(key: str, shards: int = 4) -> str:
    return (
        f"CAST((CAST(concat('0x', substr(md5({key}::VARCHAR), 1, 8)) AS BIGINT) * {shards}) // 4294967296 "
        "AS INTEGER)"
    )


def draw(label: str) -> str:
    digest = f"substr(md5('{label}:42:' || event_id), 1, 8)"
    return f"(CAST(concat('0x', {digest}) AS BIGINT) / 4294967296.0::DOUBLE)"


STATS_SQL = {"Average": "avg", "Sum": "sum", "Minimum": "min", "Maximum": "max"}

HOURLY_MAX = f"""
hourly AS (
  SELECT event_type AS stream, {period(3600)} AS period, max(value) AS stat FROM events GROUP BY 1, 2)"""

def grid(low: str, high: str) -> str:
    return f"""
grid AS (
  SELECT stream, unnest(generate_series({low}, {high}, INTERVAL 1 HOUR)) AS period
  FROM hourly GROUP BY stream),
filled AS (SELECT g.stream, g.period, h.stat FROM grid g LEFT JOIN hourly h USING (stream, period))"""


GRID = grid("min(period)", "max(period)")
FULL_GRID = grid("(SELECT min(period) FROM hourly)", "(SELECT max(period) FROM hourly)")

LOGS = """
app_logs AS (
  SELECT event_id, ts,
         CASE event_type
           WHEN 'view' THEN 'Deploying task to flink-taskmanager-' || (user_id % 7)
           WHEN 'signup' THEN 'Loading property: parallelism.default, ' || (event_id % 5)
           WHEN 'click' THEN 'AccessDenied while reading the source'
           WHEN 'purchase' THEN 'ResourceNotFoundException: no such sink'
           WHEN 'error' THEN 'Task switched from RUNNING to RESTARTING' END AS message,
         CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS message_type,
         'application/app-' || (user_id % 5) AS application_arn
  FROM events)"""


def log_match(text: str) -> str:
    return f"""WITH {LOGS}
SELECT event_id, ts, message, message_type FROM app_logs
WHERE regexp_matches(application_arn, 'application/app-1') AND regexp_matches(message, '{text}')
ORDER BY ts DESC, event_id DESC LIMIT 20"""


def text(value: str | None) -> str:
    return "NULL" if value is None else f"'{value}'"


POINTS = """
points AS (
  SELECT ts, 'rivulet/events' AS namespace, event_type AS metric_name, CAST(user_id % 3 + 1 AS VARCHAR) AS broker,
         value FROM events)"""


def catalogue_points(watched: list[tuple[str, str]]) -> str:
    names = ", ".join(f"({i}, '{ns}', '{name}')" for i, (ns, name) in enumerate(watched))
    return f"""
watched(turn, namespace, metric_name) AS (VALUES {names}),
points AS (
  SELECT ts, namespace, metric_name, CAST(user_id % 3 + 1 AS VARCHAR) AS broker, value
  FROM events JOIN watched ON event_id % {len(watched)} = turn)"""


# Fixed values, written out again for comparison: the published alarms and the metrics they read.
PUBLISHED_ALARMS = """
    ('IteratorAge', 'AWS/Kinesis', 'GetRecords.IteratorAgeMilliseconds', 'Maximum', 60, '>=', 60000, 'breaching', 1, 1, 1, NULL, NULL),
    ('ReadProvisioned', 'AWS/Kinesis', 'ReadProvisionedThroughputExceeded', 'Average', 60, '>=', 0.01, 'breaching', 1, 1, 1, NULL, NULL),
    ('WriteProvisioned', 'AWS/Kinesis', 'WriteProvisionedThroughputExceeded', 'Average', 60, '>=', 0.01, 'breaching', 1, 1, 1, NULL, NULL),
    ('PutRecord', 'AWS/Kinesis', 'PutRecord.Success', 'Average', 60, '<=', 0.95, 'notBreaching', 1, 1, 1, NULL, NULL),
    ('PutRecords', 'AWS/Kinesis', 'PutRecords.Success', 'Average', 60, '<=', 0.95, 'notBreaching', 1, 1, 1, NULL, NULL),
    ('GetRecords', 'AWS/Kinesis', 'GetRecords.Success', 'Average', 60, '<=', 0.98, 'breaching', 1, 1, 1, NULL, NULL),
    ('DataFreshness', 'AWS/Firehose', 'DeliveryToS3.DataFreshness', 'Maximum', 300, '>', 900, 'breaching', 1, 1, 1, NULL, NULL),
    ('IncomingBytes', 'AWS/Firehose', 'IncomingBytes', 'Sum', 300, '>', 75, 'breaching', 1, 100, 1, 'BytesPerSecondLimit', 'Minimum'),
    ('IncomingPutRequests', 'AWS/Firehose', 'IncomingPutRequests', 'Sum', 300, '>', 75, 'breaching', 1, 100, 1, 'PutRequestsPerSecondLimit', 'Minimum'),
    ('IncomingRecords', 'AWS/Firehose', 'IncomingRecords', 'Sum', 300, '>', 75, 'breaching', 1, 100, 1, 'RecordsPerSecondLimit', 'Minimum'),
    ('Downtime', 'AWS/KinesisAnalytics', 'downtime', 'Average', 60, '>', 0, 'breaching', 1, 1, 1, NULL, NULL),
    ('Checkpoint', 'AWS/KinesisAnalytics', 'numberOfFailedCheckpoints', 'Average', 60, '>', 0, 'breaching', 1, 1, 1, NULL, NULL),
    ('CpuUtilization', 'AWS/KinesisAnalytics', 'cpuUtilization', 'Maximum', 60, '>', 80, 'breaching', 1, 1, 1, NULL, NULL),
    ('HeapMemory', 'AWS/KinesisAnalytics', 'heapMemoryUtilization', 'Maximum', 60, '>', 90, 'breaching', 1, 1, 1, NULL, NULL),
    ('GCPercent', 'AWS/KinesisAnalytics', 'oldGenerationGCTime', 'Maximum', 60, '>', 60, 'breaching', 1, 100, 60000, NULL, NULL),
    ('RecordsOut', 'AWS/KinesisAnalytics', 'numRecordsOutPerSecond', 'Average', 60, '<=', 0, 'breaching', 1, 1, 1, NULL, NULL),
    ('MillisBehind', 'AWS/KinesisAnalytics', 'millisBehindLatest', 'Maximum', 60, '>', 60000, 'breaching', 1, 1, 1, NULL, NULL)"""
PUBLISHED_METRICS = [
    ("AWS/Kinesis", "GetRecords.IteratorAgeMilliseconds"), ("AWS/Kinesis", "ReadProvisionedThroughputExceeded"),
    ("AWS/Kinesis", "WriteProvisionedThroughputExceeded"), ("AWS/Kinesis", "PutRecord.Success"),
    ("AWS/Kinesis", "PutRecords.Success"), ("AWS/Kinesis", "GetRecords.Success"),
    ("AWS/Firehose", "DeliveryToS3.DataFreshness"), ("AWS/Firehose", "IncomingBytes"),
    ("AWS/Firehose", "BytesPerSecondLimit"), ("AWS/Firehose", "IncomingPutRequests"),
    ("AWS/Firehose", "PutRequestsPerSecondLimit"), ("AWS/Firehose", "IncomingRecords"),
    ("AWS/Firehose", "RecordsPerSecondLimit"), ("AWS/KinesisAnalytics", "downtime"),
    ("AWS/KinesisAnalytics", "numberOfFailedCheckpoints"), ("AWS/KinesisAnalytics", "cpuUtilization"),
    ("AWS/KinesisAnalytics", "heapMemoryUtilization"), ("AWS/KinesisAnalytics", "oldGenerationGCTime"),
    ("AWS/KinesisAnalytics", "numRecordsOutPerSecond"), ("AWS/KinesisAnalytics", "millisBehindLatest"),
]
# The alarms of the board, written out again.
BOARD = """
    ('ViewPeak', 'rivulet/events', 'view', 'Maximum', 3600, '>', 80, 'breaching', 1, 1, 1, NULL, NULL),
    ('ClickLow', 'rivulet/events', 'click', 'Average', 3600, '<=', 41.2371, 'notBreaching', 2, 1, 1, NULL, NULL),
    ('SignupVolume', 'rivulet/events', 'signup', 'Sum', 3600, '>=', 60.0037, 'breaching', 3, 1, 1, NULL, NULL),
    ('PurchaseFloor', 'rivulet/events', 'purchase', 'Minimum', 3600, '<=', 5, 'notBreaching', 1, 1, 1, NULL, NULL),
    ('ErrorShare', 'rivulet/events', 'error', 'Sum', 3600, '>', 75.0013, 'breaching', 1, 100, 1, 'view', 'Maximum'),
    ('NeverSeen', 'rivulet/events', 'refund', 'Sum', 3600, '>', 1, 'breaching', 2, 1, 1, NULL, NULL)"""


def alarm_ctes(rows: str) -> str:
    """Alarm states by grid, left join and runs of breaching periods."""
    by_stat = " ".join(f"WHEN '{name}' THEN {fn}(p.value)" for name, fn in STATS_SQL.items())

    def side(metric: str, stat: str) -> str:
        return f"""
  SELECT s.alarm, p.broker, {period("s.period_s", "p.ts")} AS period, CASE s.{stat} {by_stat} END AS v
  FROM points p JOIN specs s ON p.namespace = s.namespace AND p.metric_name = s.{metric}
  GROUP BY s.alarm, s.{stat}, p.broker, 3"""

    return f"""
listed(alarm, namespace, metric_name, stat, period_s, comparison, threshold, treat_missing, evaluation_periods,
       scale, per, over_metric, over_stat) AS (VALUES {rows}),
specs AS (SELECT * REPLACE (threshold::DOUBLE AS threshold, scale::DOUBLE AS scale, per::DOUBLE AS per) FROM listed),
m1 AS ({side("metric_name", "stat")}),
m2 AS ({side("over_metric", "over_stat")}),
both_sides AS (
  SELECT coalesce(m1.alarm, m2.alarm) AS alarm, coalesce(m1.broker, m2.broker) AS broker,
         coalesce(m1.period, m2.period) AS period, m1.v AS v1, m2.v AS v2
  FROM m1 FULL JOIN m2 ON m1.alarm = m2.alarm AND m1.broker = m2.broker AND m1.period = m2.period),
valued AS (
  SELECT b.alarm, broker, period,
         CASE WHEN over_metric IS NULL THEN v1 * scale / per ELSE scale * (v1 / nullif(v2, 0)) END AS value
  FROM both_sides b JOIN specs USING (alarm)),
spans AS (
  SELECT alarm, broker, period_s, {period("period_s", "(SELECT min(ts) FROM points)")} AS low,
         {period("period_s", "(SELECT max(ts) FROM points)")} AS high
  FROM (SELECT DISTINCT alarm, broker FROM valued
        UNION ALL SELECT alarm, NULL FROM specs WHERE alarm NOT IN (SELECT alarm FROM valued)) JOIN specs USING (alarm)),
grid AS (
  SELECT alarm, broker, unnest(generate_series(low, high, to_seconds(period_s))) AS period FROM spans),
judged AS (
  SELECT g.alarm, g.broker, g.period, v.value, s.evaluation_periods,
         coalesce(CASE s.comparison WHEN '>' THEN v.value > s.threshold WHEN '>=' THEN v.value >= s.threshold
                                    WHEN '<=' THEN v.value <= s.threshold END,
                  s.treat_missing = 'breaching') AS breached
  FROM grid g JOIN specs s USING (alarm)
  LEFT JOIN valued v ON v.alarm = g.alarm AND v.broker IS NOT DISTINCT FROM g.broker AND v.period = g.period),
runs AS (
  SELECT *, count(*) FILTER (WHERE NOT breached) OVER (PARTITION BY alarm, broker ORDER BY period) AS run
  FROM judged),
streaks AS (
  SELECT *, count(*) FILTER (WHERE breached) OVER (PARTITION BY alarm, broker, run ORDER BY period) AS streak
  FROM runs),
states AS (
  SELECT alarm, broker, period, value,
         CASE WHEN breached AND streak >= evaluation_periods THEN 'ALARM' ELSE 'OK' END AS state
  FROM streaks)"""


def stat_query(expression: str) -> str:
    return (
        f"SELECT event_type AS stream, {period(300)} AS period, {expression} AS stat FROM events GROUP BY 1, 2"
    )


OUTCOMES = f"""{LINES},
kinds AS (
  SELECT *, "offset" // 525 AS invocation, "offset" * 7919 % 11 AS kind,
         (row_number() OVER (PARTITION BY "offset" // 525 ORDER BY topic, "partition", "offset") - 1) // 500 + 1
           AS batch_no
  FROM sized),
outcomes AS (
  SELECT invocation, batch_no, topic, "partition", "offset",
         CAST(CASE kind WHEN 0 THEN 4 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 1 END AS INTEGER) AS attempts,
         CASE WHEN kind IN (0, 3) THEN 'lost' ELSE 'delivered' END AS status,
         CASE kind WHEN 0 THEN 'ServiceUnavailableException' WHEN 3 THEN 'InternalFailure' END AS error
  FROM kinds)"""

# What JSON text escapes among the characters that documents hold.
DOCUMENT_LINE = (
    "'{\"doc_id\":' || doc_id || ',\"text\":\"' || replace(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), "
    "'\"', chr(92) || '\"'), chr(10), chr(92) || 'n'), chr(9), chr(92) || 't'), chr(13), chr(92) || 'r') || '\"}'"
)

PARTS = """strftime(ts, '%Y') AS "year", strftime(ts, '%m') AS "month", strftime(ts, '%d') AS "day",
       strftime(ts, '%H') AS "hour\""""

DAY = PARTS[: PARTS.index(",\n")]

ORACLES: dict[str, str] = {
    "tick_table": f"""
SELECT CASE WHEN NOT {BAD} THEN event_type END AS ticker, CASE WHEN NOT {BAD} THEN value END AS price,
       CASE WHEN NOT {BAD} THEN date_trunc('millisecond', ts) END AS event_time,
       CASE WHEN {BAD} THEN 'json' END AS error_type
FROM events""",
    "archive_roundtrip": f"""
WITH {LOG_RECORDS} SELECT topic, "partition", "offset", payload FROM log_records""",
    "replay_slice": """
SELECT event_id, CASE event_type WHEN 'view' THEN 'web:eu,us' WHEN 'click' THEN '{app} 50%'
                 WHEN 'purchase' THEN 'till #3 ''x''' END AS origin,
       '2024-01-08' AS week, event_type, value FROM events
WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15' AND event_type <> 'signup' """,
    "gen_ticks": f"""
SELECT event_id AS tick_id,
       (['AAPL', 'AMZN', 'MSFT', 'INTC', 'TBV'])[CAST(floor({draw("ticker")} * 5) AS INTEGER) + 1] AS ticker,
       round({draw("price")} * 100.0::DOUBLE, 2) AS price, ts AS event_time
FROM events""",
    "retention_trim": """
SELECT event_id, ts, event_type, value FROM events
WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 168 HOUR""",
    "stream_envelope": f"""
WITH {LOG_RECORDS}, {ENVELOPES}
SELECT invocation,
       CAST(row_number() OVER (PARTITION BY invocation ORDER BY "offset") - 1 AS INTEGER) AS position,
       CAST("partition" AS VARCHAR) AS partition_key,
       lpad(CAST("offset" AS VARCHAR), 20, '0') AS sequence_number, payload, error_type
FROM good
UNION ALL SELECT invocation, NULL, NULL, NULL, NULL, 'envelope' FROM lost""",
    "log_envelope": f"""
WITH {LOG_RECORDS}, {ENVELOPES}
SELECT invocation, topic || '-' || "partition" AS topic_partition,
       CAST(row_number() OVER (PARTITION BY invocation, "partition" ORDER BY "offset") - 1 AS INTEGER) AS position,
       "offset", payload, error_type
FROM good
UNION ALL SELECT invocation, NULL, NULL, NULL, NULL, 'envelope' FROM lost""",
    "consume_summary": f"""
WITH {LOG_RECORDS}
SELECT topic || '-' || "partition" AS topic_partition, count(*) AS records, count(payload) AS decoded
FROM log_records GROUP BY ROLLUP (1)""",
    "decode_ride": f"""
SELECT event_id, CASE WHEN NOT {BAD} THEN event_id END AS trip_id, CAST(NULL AS BIGINT) AS ride_request_id,
       CASE WHEN NOT {BAD} THEN user_id END AS vehicle_id, CAST(NULL AS DOUBLE) AS expected_fare,
       CASE WHEN {BAD} THEN 'json' END AS error_type
FROM events""",
    "encode_ride": """
SELECT event_id,
       '{"trip_id":' || event_id || ',"vehicle_id":' || user_id
       || CASE WHEN event_type = 'purchase' THEN ',"expected_fare":' || value ELSE '' END || '}' AS value
FROM events""",
    "ride_sampled": f"""
WITH {RIDES}
SELECT event_id, CAST(NULL AS BIGINT) AS trip_id, event_id AS ride_request_id, vehicle_id, NULL AS error_type FROM rides
UNION ALL SELECT event_id, NULL, NULL, NULL, 'json' FROM events WHERE event_type = 'purchase' AND {BAD}""",
    "fare_model": f"""
SELECT event_id, CAST(CASE WHEN event_id = 0 THEN 400 ELSE 200 END AS INTEGER) AS status,
       CASE WHEN event_id <> 0 THEN {fare("event_id")} END AS expected_fare
FROM events""",
    "hot_ticks": """
SELECT ts AS event_time, event_type AS ticker, value AS price, strftime(ts, '%Y-%m-%d') AS dt,
       strftime(ts, '%H') AS hr
FROM events WHERE value > 50""",
    "parse_times": f"""
SELECT event_id, CASE WHEN NOT {BAD} THEN date_trunc('millisecond', ts) END AS event_time,
       CASE WHEN {BAD} THEN 'json' END AS error_type
FROM events""",
    "jq_keys": f"""
SELECT event_id, CASE WHEN NOT {BAD} THEN event_type END AS ticker,
       CASE WHEN NOT {BAD} THEN CAST(user_id AS VARCHAR) END AS customer
FROM events""",
    "deaggregate": """
SELECT event_id, 0::INTEGER AS position, props AS object FROM events
UNION ALL
SELECT event_id, 1::INTEGER, '{"id": ' || event_id || ', "note": "a}{\\"b"}' FROM events
UNION ALL
SELECT event_id, 2::INTEGER, '{"in": {"type": "' || event_type || '"}}' FROM events""",
    "shard_load": f"""
SELECT {shard("user_id")} AS shard, count(*) AS records, CAST(sum(strlen(props)) AS BIGINT) AS bytes
FROM events GROUP BY 1""",
    "archive_lines": f"""
WITH {LINES} SELECT topic, "partition", "offset", line, size FROM sized""",
    "pack_count": f"""
WITH {LINES},
placed AS (
  SELECT "offset" // 525 AS invocation, size,
         row_number() OVER (PARTITION BY "offset" // 525 ORDER BY topic, "partition", "offset") - 1 AS position
  FROM sized)
SELECT invocation, position // 500 + 1 AS batch_no, count(*) AS records, CAST(sum(size) AS BIGINT) AS bytes
FROM placed GROUP BY 1, 2""",
    "pack_bytes": """
WITH RECURSIVE sized AS (
  SELECT doc_id // 100 AS invocation,
         CAST(strlen('{"topic":"' || lang || '","partition":0,"offset":' || doc_id || ',"value":"'
                     || to_base64(encode(text)) || '"}') + 1 AS BIGINT) AS size,
         lang, doc_id
  FROM documents),
placed AS (
  SELECT invocation, size, row_number() OVER (PARTITION BY invocation ORDER BY lang, doc_id) AS position
  FROM sized WHERE size <= 32768),
packed AS (
  SELECT invocation, position, size, CAST(1 AS BIGINT) AS batch_no, CAST(1 AS BIGINT) AS held, size AS used
  FROM placed WHERE position = 1
  UNION ALL
  SELECT n.invocation, n.position, n.size,
         CASE WHEN p.held + 1 > 500 OR p.used + n.size > 32768 THEN p.batch_no + 1 ELSE p.batch_no END,
         CASE WHEN p.held + 1 > 500 OR p.used + n.size > 32768 THEN 1 ELSE p.held + 1 END,
         CASE WHEN p.held + 1 > 500 OR p.used + n.size > 32768 THEN n.size ELSE p.used + n.size END
  FROM packed p JOIN placed n ON n.invocation = p.invocation AND n.position = p.position + 1)
SELECT invocation, batch_no, count(*) AS records, CAST(sum(size) AS BIGINT) AS bytes
FROM packed GROUP BY 1, 2
UNION ALL SELECT invocation, NULL, count(*), CAST(sum(size) AS BIGINT) FROM sized WHERE size > 32768 GROUP BY 1""",
    "delivery_outcome": f"""
WITH {OUTCOMES} SELECT * FROM outcomes""",
    "delivery_report": f"""
WITH {OUTCOMES}
SELECT invocation, batch_no, count(*) AS attempted, count(*) FILTER (WHERE status = 'delivered') AS delivered,
       count(*) FILTER (WHERE attempts > 1) AS retried, count(*) FILTER (WHERE status = 'lost') AS lost,
       max(attempts) AS calls,
       count(*) FILTER (WHERE status = 'delivered') * 100 / count(*) AS delivered_percent
FROM outcomes GROUP BY 1, 2""",
    "object_sizes": f"""
SELECT lang AS prefix, count(*) AS records, CAST(sum(strlen({DOCUMENT_LINE}) + 1) AS BIGINT) AS bytes, true AS bounded
FROM documents GROUP BY 1""",
    "buffered_objects": f"""
SELECT lang AS prefix, count(*) AS records, CAST(sum(strlen({DOCUMENT_LINE}) + 1) AS BIGINT) AS bytes, true AS full
FROM documents GROUP BY 1""",
    "no_delimiter": """
SELECT lang AS prefix, CASE WHEN doc_id % 50 <> 0 THEN doc_id END AS doc_id,
       CASE WHEN doc_id % 50 <> 0 THEN md5(text) END AS digest,
       CASE WHEN doc_id % 50 = 0 THEN 'line' END AS error_type
FROM documents""",
    "codec_roundtrip": f"""
SELECT codec, count(*) AS records, CAST(sum(strlen({DOCUMENT_LINE})) AS BIGINT) AS bytes
FROM documents, (VALUES ('GZIP'), ('HADOOP_SNAPPY'), ('Snappy'), ('UNCOMPRESSED')) AS codecs(codec) GROUP BY 1""",
    "fixed_count": """
SELECT count(*) AS records, CAST(100 AS BIGINT) AS most FROM events""",
    "exact_count": """
SELECT event_type AS prefix, count(*) AS records, count(*) // 100 AS full, count(*) % 100 AS last FROM events GROUP BY 1""",
    "keyed_routes": """
SELECT user_id, count(*) AS records, CAST(1 AS BIGINT) AS tasks FROM events GROUP BY 1""",
    "even_routes": """
SELECT count(*) AS records, CAST(4 AS BIGINT) AS tasks FROM events""",
    "dead_letter_bisect": f"""
WITH RECURSIVE {LOG_RECORDS},
numbered AS (
  SELECT "offset" // 525 AS invocation, topic, "partition", "offset", payload = '{{bad' AS bad,
         row_number() OVER (PARTITION BY "offset" // 525 ORDER BY topic, "partition", "offset") - 1 AS place
  FROM log_records),
placed AS (SELECT *, place // 200 + 1 AS batch_no, place % 200 AS pos FROM numbered),
batches AS (
  SELECT invocation, batch_no, count(*) AS n, coalesce(list(pos) FILTER (WHERE bad), []) AS bads
  FROM placed GROUP BY 1, 2),
ranges AS (
  SELECT invocation, batch_no, bads, 0::BIGINT AS low, n AS high FROM batches
  UNION ALL
  SELECT invocation, batch_no, bads, CASE half WHEN 0 THEN low ELSE (low + high) // 2 END,
         CASE half WHEN 0 THEN (low + high) // 2 ELSE high END
  FROM ranges, (VALUES (0), (1)) AS halves(half)
  WHERE high - low > 1 AND len(list_filter(bads, lambda x: x >= low AND x < high)) > 0)
SELECT p.invocation, p.batch_no, p."partition", p."offset",
       CAST(count(*) + CASE WHEN any_value(bad) THEN 2 ELSE 0 END AS INTEGER) AS attempts,
       CASE WHEN any_value(bad) THEN 'lost' ELSE 'delivered' END AS status,
       CASE WHEN any_value(bad) THEN 'JSONDecodeError' END AS error
FROM placed AS p JOIN ranges AS r
  ON p.invocation = r.invocation AND p.batch_no = r.batch_no AND p.pos >= r.low AND p.pos < r.high
GROUP BY 1, 2, 3, 4""",
    "latest_start": """
SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-15'""",
    "tick_sql": f"""
SELECT event_type AS ticker, strftime(ts, '%Y-%m-%d') AS dt, count(*) AS ticks, max(value) AS highest
FROM events WHERE value > 50 AND NOT {BAD} GROUP BY 1, 2""",
    "time_prefix": f"""
SELECT event_id, {PARTS} FROM events""",
    "error_routing": f"""
SELECT CASE WHEN {BAD} THEN 'errors' ELSE 'data' END AS route, {DAY},
       CASE WHEN {BAD} THEN 'json' END AS error_type, count(*) AS records
FROM events GROUP BY ALL""",
    "dynamic_partition": f"""
SELECT CASE WHEN NOT {BAD} THEN event_type END AS ticker, {DAY},
       CASE WHEN {BAD} THEN 'partition_key' END AS error_type, count(*) AS records
FROM events GROUP BY ALL""",
    "partitioned_counts": """
SELECT event_type AS ticker, strftime(ts, '%Y-%m-%d') AS dt, strftime(ts, '%H') AS hr, count(*) AS records,
       max(value) AS highest
FROM events WHERE value > 50 GROUP BY 1, 2, 3""",
    "dead_letter": f"""
SELECT CAST(user_id % 3 AS INTEGER) AS "partition", event_id AS "offset", CASE WHEN {BAD} THEN 'json' END AS error
FROM events""",
    "late_audit": f"""
WITH arrivals AS (
  SELECT event_id, ts, CAST(user_id % 3 AS INTEGER) AS "partition",
         ts + to_seconds((event_id * 7919) % 1200) AS arrival
  FROM events),
marked AS (
  SELECT *, max(ts) OVER (PARTITION BY "partition" ORDER BY arrival, event_id
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high_water
  FROM arrivals)
SELECT "partition", {period(3600, "arrival")} AS period, count(*) AS records,
       count(*) FILTER (WHERE ts < high_water - INTERVAL 5 SECOND) AS late
FROM marked GROUP BY 1, 2""",
    "event_time_latency": f"""
SELECT event_type AS stream, {period(3600)} AS period,
       min((epoch_us(ts) // 1000) - 5000 - (event_id * 7919 % 1200) * 1000) - min((epoch_us(ts) // 1000)) AS latency_ms
FROM events GROUP BY 1, 2""",
    "consumer_lag": """
WITH arrivals AS (
  SELECT CAST(user_id % 3 AS INTEGER) AS "partition", event_id, ts, (event_id * 7919) % 1200 < 900 AS consumed FROM events),
latest AS (SELECT "partition", max(event_id) AS latest_offset, max(ts) AS newest FROM arrivals GROUP BY 1),
done AS (
  SELECT "partition", max(event_id) AS committed_offset, max(ts) AS reached FROM arrivals WHERE consumed GROUP BY 1)
SELECT "partition", latest_offset, committed_offset, latest_offset - committed_offset AS offset_lag,
       (epoch_us(newest) // 1000) - (epoch_us(reached) // 1000) AS millis_behind
FROM latest JOIN done USING ("partition")""",
    "metric_stream": f"""
SELECT {period(3600)} AS period, event_type AS stream, count(*) AS datapoints, round(avg(value), 9) AS average,
       round(sum(value), 9) AS total, min(value) AS lowest, max(value) AS highest
FROM events GROUP BY 1, 2""",
    "metric_stream_compacted": f"""
SELECT {period(3600)} AS period, event_type AS stream, count(*) AS datapoints, round(avg(value), 9) AS average,
       round(sum(value), 9) AS total, min(value) AS lowest, max(value) AS highest, true AS few
FROM events GROUP BY 1, 2""",
    "metric_avg": stat_query("round(avg(value), 9)"),
    "metric_sum": stat_query("round(sum(value), 9)"),
    "metric_min": stat_query("min(value)"),
    "metric_max": stat_query("max(value)"),
    "metric_p99": stat_query("round(quantile_cont(value, 0.99), 9)"),
    "metric_by_broker": f"""
SELECT event_type AS stream, CAST(user_id % 3 + 1 AS VARCHAR) AS broker, {period(300)} AS period,
       max(value) AS stat
FROM events GROUP BY 1, 2, 3""",
    "metric_rollup": f"""
WITH points AS (
  SELECT {period(3600)} AS period, event_type AS stream, CAST({shard("user_id")} AS VARCHAR) AS shard, value
  FROM events)
SELECT period, stream, shard, count(*) AS datapoints, round(sum(value), 9) AS "sum", max(value) AS maximum
FROM points GROUP BY GROUPING SETS ((period, stream), (period, stream, shard))""",
    "metric_rate": f"""
WITH {HOURLY_MAX},
rates AS (
  SELECT stream, period,
         (stat - lag(stat) OVER w) / (epoch(period) - epoch(lag(period) OVER w)) * 60 AS rate
  FROM hourly WINDOW w AS (PARTITION BY stream ORDER BY period))
SELECT * FROM rates WHERE rate IS NOT NULL""",
    "gc_percent": f"""
WITH {HOURLY_MAX} SELECT stream, period, (stat * 100) / 60000 AS gc_percent FROM hourly""",
    "per_second": f"""
SELECT event_type AS stream, {period(300)} AS period, round(sum(value) / 300, 9) AS per_second
FROM events GROUP BY 1, 2""",
    "delivery_success": f"""
SELECT CAST(user_id % 3 AS INTEGER) AS "partition", {period(300)} AS period,
       avg(CASE WHEN event_type <> 'error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100 AS success
FROM events GROUP BY 1, 2""",
    "limit_percent": f"""
WITH sides AS (
  SELECT CAST(user_id % 3 + 1 AS VARCHAR) AS broker, {period(300)} AS period,
         sum(ceil(value)) FILTER (WHERE event_type = 'view') AS m1,
         min(ceil(value)) FILTER (WHERE event_type = 'purchase') AS m2
  FROM events GROUP BY 1, 2)
SELECT broker, period, 100 * (m1 / nullif(m2, 0)) AS percent,
       100 * (m1 / 300 / nullif(m2, 0)) AS percent_per_second
FROM sides""",
    "availability": f"""
WITH sides AS (
  SELECT CAST(user_id % 3 + 1 AS VARCHAR) AS broker, {period(3600)} AS period,
         CAST(count(*) FILTER (WHERE event_type = 'error') AS DOUBLE) AS errors, CAST(count(*) AS DOUBLE) AS invocations
  FROM events GROUP BY 1, 2)
SELECT broker, period, 100 - 100 * errors / nullif(greatest(errors, invocations), 0) AS availability
FROM sides""",
    "disk_annotation": f"""
SELECT event_type AS stream, CAST(user_id % 3 + 1 AS VARCHAR) AS broker, {period(3600)} AS period,
       max(value) AS stat, 'Maximum disk usage' AS label, 100.0::DOUBLE AS line, max(value) >= 100 AS reached
FROM events GROUP BY 1, 2, 3""",
    "metric_p99_merged": f"""
SELECT event_type AS stream, {period(86400)} AS period, count(value) AS datapoints, quantile_disc(value, 0.99) AS p99
FROM events GROUP BY 1, 2""",
    "time_lag": """
WITH log AS (
  SELECT CAST(CASE WHEN user_id % 10 < 8 THEN 0 ELSE user_id % 3 END AS INTEGER) AS "partition", event_id AS "offset", ts,
         CAST(user_id % 2 AS INTEGER) AS consumer
  FROM events),
idx AS (SELECT "partition", "offset", ts FROM log WHERE "offset" % 10 = 0),
newest AS (SELECT "partition", max(ts) AS newest FROM idx GROUP BY 1)
SELECT c."partition", c.consumer, c."offset", i.ts AS reached,
       epoch_us(newest) // 1000 - epoch_us(i.ts) // 1000 AS millis_behind
FROM (SELECT * FROM log WHERE "offset" % 7 = 3) AS c
ASOF LEFT JOIN idx AS i ON c."partition" = i."partition" AND c."offset" >= i."offset"
LEFT JOIN newest ON newest."partition" = c."partition\"""",
    "metric_latest": f"""
WITH stats AS (
  SELECT event_type AS stream, CAST({shard("user_id")} AS VARCHAR) AS shard, {period(300)} AS period,
         max(value) AS stat
  FROM events GROUP BY 1, 2, 3)
SELECT stream, shard, period, stat FROM stats
QUALIFY row_number() OVER (PARTITION BY stream, shard ORDER BY period DESC) = 1""",
    "alarm_threshold": f"""
WITH {HOURLY_MAX}
SELECT stream, period, stat, CASE WHEN stat > 80 THEN 'ALARM' ELSE 'OK' END AS state FROM hourly""",
    "alarm_missing": f"""
WITH {HOURLY_MAX}, {FULL_GRID}
SELECT stream, period, CASE WHEN coalesce(stat > 80, true) THEN 'ALARM' ELSE 'OK' END AS breaching,
       CASE WHEN coalesce(stat > 80, false) THEN 'ALARM' ELSE 'OK' END AS not_breaching
FROM filled""",
    "alarm_consecutive": f"""
WITH {HOURLY_MAX}, {GRID}
SELECT stream, period, stat,
       CASE WHEN sum(CASE WHEN coalesce(stat > 80, true) THEN 1 ELSE 0 END)
                 OVER (PARTITION BY stream ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3
            THEN 'ALARM' ELSE 'OK' END AS state
FROM filled""",
    "alarm_board": f"""
WITH {POINTS}, {alarm_ctes(BOARD)}
SELECT alarm, broker, period, round(value, 6) AS value, state FROM states""",
    "alarm_transitions": f"""
WITH {POINTS}, {alarm_ctes(BOARD)},
stepped AS (
  SELECT alarm, broker, period, lag(state) OVER (PARTITION BY alarm, broker ORDER BY period) AS previous, state
  FROM states)
SELECT * FROM stepped WHERE previous <> state""",
    "alarm_catalogue": f"""
WITH {catalogue_points(PUBLISHED_METRICS)}, {alarm_ctes(PUBLISHED_ALARMS)}
SELECT alarm, broker, state, count(*) AS periods FROM states GROUP BY 1, 2, 3""",
    "log_task_distribution": f"""
WITH {LOGS}
SELECT regexp_extract(message, ' to flink-taskmanager-(.*?)$', 1) AS task_manager, count(*) AS deployments
FROM app_logs WHERE regexp_matches(message, 'Deploying')
GROUP BY 1 ORDER BY deployments DESC, task_manager LIMIT 20""",
    "log_parallelism": f"""
WITH {LOGS}
SELECT event_id, ts, regexp_extract(message, 'default, (.*?)$', 1) AS parallelism
FROM app_logs WHERE regexp_matches(message, 'property: parallelism.default, ')
ORDER BY ts, event_id LIMIT 20""",
    "log_access_denied": log_match("AccessDenied"),
    "log_not_found": log_match("ResourceNotFoundException"),
    "log_failures": log_match("switched from RUNNING to RESTARTING"),
}

_PRICED = f"""
WITH {RIDES}
SELECT CAST(NULL AS BIGINT) AS trip_id, event_id AS ride_request_id, vehicle_id, {fare("event_id")} AS expected_fare,
       NULL AS error_type
FROM rides WHERE event_id <> 0
UNION ALL SELECT NULL, NULL, NULL, NULL, 'json' FROM events WHERE event_type = 'purchase' AND {BAD}"""
ORACLES["ride_enriched"] = _PRICED
ORACLES["ride_job"] = _PRICED
ORACLES["late_stream"] = ORACLES["late_audit"]


def _board() -> str:
    rows = ", ".join(
        f"({text(s.namespace)}, {text(s.metric_name)}, {text(s.stat)}, {s.period_s}, {s.fans_out})"
        for s in metric_specs()
    )
    by_stat = " ".join(f"WHEN '{name}' THEN {fn}(value)" for name, fn in STATS_SQL.items())
    return f"""
WITH {catalogue_points(watched_metrics())},
specs(namespace, metric_name, stat, period_s, fans_out) AS (VALUES {rows})
SELECT namespace, metric_name, CAST(period_s AS INTEGER) AS period_s,
       CASE WHEN fans_out THEN broker END AS broker, {period("period_s")} AS period, stat,
       round(CASE stat {by_stat} ELSE quantile_cont(value, 0.99) END, 9) AS stat_value
FROM points JOIN specs USING (namespace, metric_name)
GROUP BY namespace, metric_name, period_s, 4, 5, stat"""


ORACLES["metric_board"] = _board()
