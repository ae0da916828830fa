"""Metric and alarm catalogues as data rows."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from rivulet.operators.metrics import FIVE_MINUTES, MINUTE
from rivulet.session import fixed_table


class MetricSpec(NamedTuple):
    namespace: str
    metric_name: str
    stat: str
    period_s: int
    fans_out: bool = True


class AlarmSpec(NamedTuple):
    alarm: str
    namespace: str
    metric_name: str
    stat: str
    period_s: int
    comparison: str
    threshold: float
    treat_missing: str
    evaluation_periods: int = 1
    scale: float = 1.0
    per: float = 1.0
    over_metric: str | None = None
    over_stat: str | None = None


# Namespaces and names under which the services publish their metrics.
STREAM, FUNCTION, DELIVERY, APPLICATION, BROKER = (
    "AWS/Kinesis", "AWS/Lambda", "AWS/Firehose", "AWS/KinesisAnalytics", "AWS/Kafka",
)

# Every metric that is watched, with its statistics, by (namespace, period).
WATCHED: dict[tuple[str, int], dict[str, str]] = {
    (STREAM, MINUTE): {
        "GetRecords.IteratorAgeMilliseconds": "Maximum",
        "ReadProvisionedThroughputExceeded": "Average",
        "WriteProvisionedThroughputExceeded": "Average",
        "PutRecord.Success": "Average",
        "PutRecords.Success": "Average",
        "GetRecords.Success": "Average",
    },
    (FUNCTION, MINUTE): {
        "Invocations": "Sum",
        "Duration": "Minimum Average Maximum",
        "Errors": "Maximum",
        "Throttles": "Sum",
        "IteratorAge": "Maximum",
        "ConcurrentExecutions": "Maximum",
    },
    (DELIVERY, FIVE_MINUTES): {
        "IncomingBytes": "Sum",
        "IncomingPutRequests": "Sum",
        "IncomingRecords": "Sum",
        "ThrottledRecords": "Sum",
        "BytesPerSecondLimit": "Minimum",
        "PutRequestsPerSecondLimit": "Minimum",
        "RecordsPerSecondLimit": "Minimum",
        "DataReadFromKinesisStream.Records": "Sum",
        "DataReadFromKinesisStream.Bytes": "Sum",
        "ThrottledGetRecords": "Average",
        "DeliveryToS3.Success": "Average",
        "DeliveryToS3.DataFreshness": "Maximum",
        "DeliveryToS3.Records": "Sum",
        "DeliveryToS3.Bytes": "Sum",
    },
    (APPLICATION, MINUTE): {
        "downtime": "Average",
        "uptime": "Minimum",
        "fullRestarts": "Maximum",
        "numberOfFailedCheckpoints": "Average",
        "lastCheckpointDuration": "Maximum",
        "lastCheckpointSize": "Average",
        "cpuUtilization": "Maximum",
        "heapMemoryUtilization": "Maximum",
        "oldGenerationGCCount": "Maximum",
        "oldGenerationGCTime": "Maximum",
        "threadsCount": "Maximum",
        "numRecordsInPerSecond": "Average",
        "numRecordsOutPerSecond": "Average",
        "currentInputWatermark": "Minimum",
        "currentOutputWatermark": "Minimum",
        "numLateRecordsDropped": "Maximum",
        "millisBehindLatest": "Maximum",
        "records_lag_max": "Maximum",
    },
    (BROKER, FIVE_MINUTES): {
        "CpuUser": "Maximum",
        "KafkaDataLogsDiskUsed": "Maximum",
        "MessagesInPerSec": "Maximum",
        "UnderReplicatedPartitions": "Maximum",
        "BytesOutPerSec": "Maximum",
        "BytesInPerSec": "Maximum",
        "NetworkRxPackets": "Average",
        "NetworkTxPackets": "Average",
        "NetworkRxErrors": "Sum",
        "NetworkTxErrors": "Sum",
        "GlobalPartitionCount": "Maximum",
        "GlobalTopicCount": "Maximum",
        "OfflinePartitionsCount": "Maximum",
        "ZooKeeperRequestLatencyMsMean": "p99",
    },
}

# Metrics that exist once per cluster; the other ones fan out by their dimensions.
PER_CLUSTER = (
    "GlobalPartitionCount", "GlobalTopicCount", "OfflinePartitionsCount", "ZooKeeperRequestLatencyMsMean",
)

# The reference line of the disk report.
DISK_LINE = ("Maximum disk usage", 100)

# Fixed values: (alarm, metric, statistic, comparison, threshold, missing periods), then for an alarm on
# an expression its factor and what it divides by: a number, or the minimum of another metric.
_ALARMS = {
    (STREAM, MINUTE): [
        ("IteratorAge", "GetRecords.IteratorAgeMilliseconds", "Maximum", ">=", 60000, "breaching"),
        ("ReadProvisioned", "ReadProvisionedThroughputExceeded", "Average", ">=", 0.01, "breaching"),
        ("WriteProvisioned", "WriteProvisionedThroughputExceeded", "Average", ">=", 0.01, "breaching"),
        ("PutRecord", "PutRecord.Success", "Average", "<=", 0.95, "notBreaching"),
        ("PutRecords", "PutRecords.Success", "Average", "<=", 0.95, "notBreaching"),
        ("GetRecords", "GetRecords.Success", "Average", "<=", 0.98, "breaching"),
    ],
    (DELIVERY, FIVE_MINUTES): [
        ("DataFreshness", "DeliveryToS3.DataFreshness", "Maximum", ">", 900, "breaching"),
        ("IncomingBytes", "IncomingBytes", "Sum", ">", 75, "breaching", 100, "BytesPerSecondLimit"),
        ("IncomingPutRequests", "IncomingPutRequests", "Sum", ">", 75, "breaching", 100, "PutRequestsPerSecondLimit"),
        ("IncomingRecords", "IncomingRecords", "Sum", ">", 75, "breaching", 100, "RecordsPerSecondLimit"),
    ],
    (APPLICATION, MINUTE): [
        ("Downtime", "downtime", "Average", ">", 0, "breaching"),
        ("Checkpoint", "numberOfFailedCheckpoints", "Average", ">", 0, "breaching"),
        ("CpuUtilization", "cpuUtilization", "Maximum", ">", 80, "breaching"),
        ("HeapMemory", "heapMemoryUtilization", "Maximum", ">", 90, "breaching"),
        ("GCPercent", "oldGenerationGCTime", "Maximum", ">", 60, "breaching", 100, 60000),
        ("RecordsOut", "numRecordsOutPerSecond", "Average", "<=", 0, "breaching"),
        ("MillisBehind", "millisBehindLatest", "Maximum", ">", 60000, "breaching"),
    ],
}


def metric_specs() -> list[MetricSpec]:
    return [
        MetricSpec(namespace, metric, stat, period, metric not in PER_CLUSTER)
        for (namespace, period), group in WATCHED.items()
        for metric, stats in group.items()
        for stat in stats.split()
    ]


def alarm_specs(per_second: bool = False) -> list[AlarmSpec]:
    """The alarm catalogue. As published, the limit alarms set a period's sum against a limit per
    second; ``per_second`` brings the sum to the same unit first."""
    specs = []
    for (namespace, period), group in _ALARMS.items():
        for name, metric, stat, comparison, threshold, missing, *math in group:
            spec = AlarmSpec(name, namespace, metric, stat, period, comparison, float(threshold), missing)
            if math and isinstance(math[1], str):
                factor = math[0] / period if per_second else math[0]
                spec = spec._replace(scale=float(factor), over_metric=math[1], over_stat="Minimum")
            elif math:
                spec = spec._replace(scale=float(math[0]), per=float(math[1]))
            specs.append(spec)
    return specs


def watched_metrics() -> list[tuple[str, str]]:
    """(namespace, name) of every watched metric."""
    return list(dict.fromkeys((s.namespace, s.metric_name) for s in metric_specs()))


def alarm_metrics() -> list[tuple[str, str]]:
    """(namespace, name) of every metric that an alarm reads."""
    legs = [(s.namespace, name) for s in alarm_specs() for name in (s.metric_name, s.over_metric) if name]
    return list(dict.fromkeys(legs))


METRIC_COLUMNS = "namespace string, metric_name string, stat string, period_s int, fans_out boolean"

def metric_table(spark: SparkSession, specs: list[MetricSpec]) -> DataFrame:
    return fixed_table(spark, specs, METRIC_COLUMNS)


def source_dims(stream: str) -> dict[str, str]:
    """Extra dimensions of the per-source application metric."""
    return {"Id": stream.replace("-", "_"), "Flow": "Input"}
