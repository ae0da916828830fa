"""Operational reports over application logs. The limit is part of each report."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Report size, the texts that are looked for, and the globs that are parsed.
REPORT_ROWS = 20
DEPLOYING = "Deploying"
TASK_MANAGER = " to flink-taskmanager-"
PARALLELISM = "property: parallelism.default, "
PARALLELISM_VALUE = "default, "
ACCESS_DENIED = "AccessDenied"
NOT_FOUND = "ResourceNotFoundException"
RESTARTING = "switched from RUNNING to RESTARTING"


def after(column: str, marker: str):
    """What the glob ``marker*`` captures: everything behind the marker to the end of the message."""
    text = F.col(column)
    at = F.locate(marker, text)
    return F.when(at > 0, F.substring(text, at + len(marker), F.length(text)))


def task_distribution(logs: DataFrame, k: int = REPORT_ROWS) -> DataFrame:
    """The task managers that received most deployments."""
    return (
        logs.where(F.contains("message", F.lit(DEPLOYING)))
        .groupBy(after("message", TASK_MANAGER).alias("task_manager"))
        .agg(F.count(F.lit(1)).alias("deployments"))
        .orderBy(F.desc("deployments"), "task_manager")
        .limit(k)
    )


def parallelism_changes(logs: DataFrame, k: int = REPORT_ROWS) -> DataFrame:
    """The oldest settings of the default parallelism."""
    return (
        logs.where(F.contains("message", F.lit(PARALLELISM)))
        .orderBy("ts", "event_id")
        .limit(k)
        .select("event_id", "ts", after("message", PARALLELISM_VALUE).alias("parallelism"))
    )


def match_logs(logs: DataFrame, application: str, text: str, k: int = REPORT_ROWS) -> DataFrame:
    """The newest messages of one application that contain a text."""
    return (
        logs.where(F.contains("application_arn", F.lit(application)) & F.contains("message", F.lit(text)))
        .orderBy(F.desc("ts"), F.desc("event_id"))
        .limit(k)
        .select("event_id", "ts", "message", "message_type")
    )
