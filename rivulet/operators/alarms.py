"""Threshold alarms over period statistics."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from rivulet.functions.times import period_start
from rivulet.operators.metrics import STATS, by_dims
from rivulet.session import fixed_table

ALARM, OK = "ALARM", "OK"

# How comparisons and missing-data policies are written.
COMPARISONS = {
    ">": lambda value, threshold: value > threshold,
    ">=": lambda value, threshold: value >= threshold,
    "<=": lambda value, threshold: value <= threshold,
}
BREACHING, NOT_BREACHING = "breaching", "notBreaching"


def breach(value: Column, comparison: str, threshold: Column) -> Column:
    if comparison not in COMPARISONS:
        raise ValueError(f"comparison must be one of {', '.join(COMPARISONS)}")
    return COMPARISONS[comparison](value, threshold)


def breach_by_spec(value: Column, comparison: Column, threshold: Column) -> Column:
    """The same, where each row names its own comparison."""
    return reduce(
        lambda rest, sign: F.when(comparison == sign, breach(value, sign, threshold)).otherwise(rest),
        COMPARISONS,
        F.lit(None).cast("boolean"),
    )


def alarm_state(stats: DataFrame, comparison: str, threshold: float, value: str = "stat") -> DataFrame:
    """State of each period that has a datapoint."""
    fired = breach(F.col(value), comparison, F.lit(threshold))
    return stats.withColumn("state", F.when(fired, ALARM).otherwise(OK))


# No array is longer than this, however long a gap.
CHUNK = 1024


def repeated(df: DataFrame, count: Column, number: str) -> DataFrame:
    """Each row ``count`` times (not at all below 1), numbered from 0 in ``number``; counts of any size
    are spread in two steps of short arrays."""
    counted = df.withColumn("__count", count.cast("long")).where("__count >= 1")
    last = (F.col("__count") - 1).cast("long")
    chunked = counted.withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / CHUNK))))
    low = F.col("__chunk") * CHUNK
    return chunked.withColumn(number, F.explode(F.sequence(low, F.least(low + CHUNK - 1, last)))).drop(
        "__count", "__chunk"
    )


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from one timestamp to another, zoned or not."""
    return F.floor((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1_000_000)


def fill_periods(stats: DataFrame, keys: list[str], period_s: Column | int, value: str = "stat") -> DataFrame:
    """Every period from the first to the last of each series; ``value`` is null in added ones.

    Each period is repeated up to the one that follows it, so no grid is built and nothing joined.
    A series holds one row per period: its length depends on time, not on the volume of datapoints.
    """
    series = Window.partitionBy(*keys).orderBy("period")
    step = F.lit(period_s) if isinstance(period_s, int) else period_s
    others = [c for c in stats.columns if c not in ("period", value)]
    ahead = stats.withColumns({"__step": step, "__next": F.lead("period").over(series)})
    steps = F.floor(seconds_between(F.col("period"), F.col("__next")) / F.col("__step"))
    return repeated(ahead, F.coalesce(steps, F.lit(1)), "__i").select(
        *others, (F.col("period") + F.make_dt_interval(secs=F.col("__i") * F.col("__step"))).alias("period"),
        F.when(F.col("__i") == 0, F.col(value)).alias(value),
    )


def over_range(
    stats: DataFrame, keys: list[str], period_s: Column | int, start: Column, end: Column, value: str = "stat",
    silent: DataFrame | None = None,
) -> DataFrame:
    """Give every series a row for the first and the last period of the evaluation range.

    Rows that are added have a null ``value``; with ``fill_periods`` behind it, a series that starts
    late, ends early or, as a row of ``silent``, never came is evaluated over the whole range. The
    columns of ``silent`` are those of ``stats`` but the period and the value.
    """
    others = [c for c in stats.columns if c not in ("period", value)]
    series = stats.select(*others) if silent is None else stats.select(*others).unionByName(silent.select(*others))
    ends = F.array(period_start(start, period_s), period_start(end, period_s))
    added = series.distinct().withColumn("period", F.explode(ends)).where("period IS NOT NULL").withColumn(
        value, F.lit(None).cast(stats.schema[value].dataType)
    )
    return stats.unionByName(added).groupBy(*others, "period").agg(F.max(value).alias(value))


def with_missing(breached: Column, treat_missing: Column | str) -> Column:
    """A period without data breaches, or not, by policy."""
    policy = F.lit(treat_missing) if isinstance(treat_missing, str) else treat_missing
    return F.coalesce(breached, policy == BREACHING)


def over_consecutive(fired: DataFrame, keys: list[str], evaluation_periods: Column | int) -> DataFrame:
    """Alarm when this period and the ones before it, ``evaluation_periods`` in all, breach.

    Counts the periods since the last one that did not breach, so E may differ per row. Periods must
    be filled, and ``breached`` never null.
    """
    series = Window.partitionBy(*keys).orderBy("period")
    upto = series.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = fired.withColumn("__at", F.row_number().over(series))
    good = F.max(F.when(~F.col("breached"), F.col("__at"))).over(upto)
    streak = F.col("__at") - F.coalesce(good, F.lit(0))
    state = F.when(streak >= evaluation_periods, ALARM).otherwise(OK)
    return numbered.withColumn("state", state).drop("__at", "breached")


def consecutive_state(
    stats: DataFrame,
    keys: list[str],
    period_s: int,
    comparison: str,
    threshold: float,
    evaluation_periods: int = 1,
    treat_missing: str = BREACHING,
    value: str = "stat",
) -> DataFrame:
    """One alarm from period statistics: fill, apply the policy, evaluate over E periods."""
    filled = fill_periods(stats, keys, period_s, value)
    breached = with_missing(breach(F.col(value), comparison, F.lit(threshold)), treat_missing)
    return over_consecutive(filled.withColumn("breached", breached), keys, evaluation_periods)


def evaluate_alarms(metrics: DataFrame, specs: list[NamedTuple], dims: list[str]) -> DataFrame:
    """A whole alarm catalogue over a metric table: states per (alarm, dims, period).

    All alarms are evaluated from the first to the last timestamp of the table, whenever their own
    datapoints came; an alarm without any is one series with null dims, judged by its policy.
    The catalogue is written by hand, so its rows are sent to every task. A datapoint meets each
    alarm it feeds as numerator or denominator, and one grouping yields both sides of every ratio.

    The table is read twice: once for its range and the alarms that have data (one row), once for the
    statistics. States come from the periods that have data, see ``judged``.
    """
    spark = metrics.sparkSession
    legs = []
    for spec in specs:
        if spec.comparison not in COMPARISONS or spec.treat_missing not in (BREACHING, NOT_BREACHING):
            raise ValueError(f"alarm {spec.alarm}: unknown comparison or missing-data policy")
        legs.append((spec.alarm, spec.namespace, spec.metric_name, "m1", spec.period_s))
        if spec.over_metric:
            legs.append((spec.alarm, spec.namespace, spec.over_metric, "m2", spec.period_s))
    leg_table = fixed_table(
        spark, legs, "alarm string, namespace string, metric_name string, leg string, period_s bigint"
    )
    rule_table = fixed_table(
        spark,
        [
            (
                s.alarm, s.stat, s.over_stat, s.scale, s.per, s.comparison, s.threshold,
                s.treat_missing, s.evaluation_periods, s.period_s,
            )
            for s in specs
        ],
        "alarm string, stat string, over_stat string, scale double, per double, comparison string, "
        "threshold double, treat_missing string, evaluation_periods int, period_s bigint",
    )

    fed = metrics.join(F.broadcast(leg_table.select("namespace", "metric_name", "alarm")), ["namespace", "metric_name"], "left")
    facts = fed.agg(F.struct(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.collect_set("alarm").alias("alarms")
    )).scalar()
    points = by_dims(metrics, dims).join(F.broadcast(leg_table), ["namespace", "metric_name"])
    timed = points.withColumn("period", period_start(F.col("ts"), F.col("period_s")))
    keys = ["alarm", *dims]
    sides = timed.groupBy(*keys, "period_s", "period").agg(*[
        agg(F.when(F.col("leg") == leg, F.col("value"))).alias(f"{leg}_{name}")
        for leg in ("m1", "m2")
        for name, agg in STATS.items()
    ])

    def chosen(leg: str, stat: str) -> Column:
        return F.coalesce(*[F.when(F.col(stat) == name, F.col(f"{leg}_{name}")) for name in STATS])

    m1, m2 = chosen("m1", "stat"), chosen("m2", "over_stat")
    value = F.when(F.col("over_stat").isNull(), m1 * F.col("scale") / F.col("per")).otherwise(
        F.col("scale") * F.try_divide(m1, m2)
    )
    rule = ["comparison", "threshold", "treat_missing", "evaluation_periods"]
    ruled = sides.join(F.broadcast(rule_table.drop("period_s")), "alarm").select(
        *keys, "period_s", "period", *rule, value.alias("stat")
    )
    silent = rule_table.where(~F.array_contains(facts["alarms"], F.col("alarm"))).select(
        "alarm", *[F.lit(None).cast(ruled.schema[d].dataType).alias(d) for d in dims], "period_s",
        F.lit(None).cast(ruled.schema["period"].dataType).alias("period"), *rule, F.lit(None).cast("double").alias("stat"),
    )
    return judged(ruled.unionByName(silent), keys, facts["start"], facts["end"])


def judged(ruled: DataFrame, keys: list[str], start: Column, end: Column) -> DataFrame:
    """States of every period from ``start`` to ``end``, per series: ``keys``, period, value, state.

    ``ruled`` has a row for each period with data and the rule's columns; a series without data is one row
    without a period. Gaps are arithmetic on the numbers of the periods: a gap breaches as a whole or not
    at all, so the last period that did not breach is known from the rows with data alone, in one window
    over them. Rows of gaps are only written out at the end.
    """
    width = F.col("period_s")
    first, last = period_start(start, width), period_start(end, width)
    missing = F.col("treat_missing") == BREACHING
    breached = with_missing(breach_by_spec(F.col("stat"), F.col("comparison"), F.col("threshold")), F.col("treat_missing"))
    numbered = ruled.withColumns({
        "__n": F.floor(seconds_between(first, last) / width),
        "__at": F.floor(seconds_between(first, F.col("period")) / width), "__breached": breached,
    })
    series = Window.partitionBy(*keys).orderBy("__at")
    before = F.coalesce(F.lag("__at").over(series), F.lit(-1))
    stepped = numbered.withColumns({
        "__before": before, "__next": F.coalesce(F.lead("__at").over(series), F.col("__n") + 1),
    })
    gap_good = F.when(~missing & (F.col("__before") < F.col("__at") - 1), F.col("__at") - 1)
    good = F.greatest(F.when(~F.col("__breached"), F.col("__at")), gap_good)
    upto = series.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = stepped.withColumn("__good", F.coalesce(F.max(good).over(upto), F.lit(-1)))
    # The row itself and the gap behind it; before the first row of a series also the gap there, which starts at 0.
    leads = F.col("__before") == -1
    own = F.struct(
        F.col("__at").alias("__from"), F.col("__next").alias("__to"), F.col("__good").alias("__since"),
        F.lit(True).alias("__data"),
    )
    lead = F.struct(
        F.lit(0).cast("long").alias("__from"), F.coalesce("__at", F.col("__n") + 1).alias("__to"),
        F.lit(-1).cast("long").alias("__since"), F.lit(False).alias("__data"),
    )
    parts = F.when(F.col("__at").isNull(), F.array(lead)).when(leads, F.array(lead, own)).otherwise(F.array(own))
    spread = repeated(held.select("*", F.inline(parts)), F.col("__to") - F.col("__from"), "__i")
    at = F.col("__from") + F.col("__i")
    is_data = F.col("__data") & (F.col("__i") == 0)
    bad = F.when(is_data, F.col("__breached")).otherwise(missing)
    state = F.when(bad & (at - F.col("__since") >= F.col("evaluation_periods")), ALARM).otherwise(OK)
    return spread.select(
        *keys, (first + F.make_dt_interval(secs=at * width)).alias("period"),
        F.when(is_data, F.col("stat")).alias("value"), state.alias("state"),
    )


def transitions(states: DataFrame, keys: list[str]) -> DataFrame:
    """Periods whose state differs from the one before, with both states."""
    series = Window.partitionBy(*keys).orderBy("period")
    changed = states.withColumn("previous", F.lag("state").over(series))
    return changed.where(F.col("previous") != F.col("state")).select(*keys, "period", "previous", "state")
