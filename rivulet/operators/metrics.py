"""Period statistics over metric datapoints, and arithmetic on them."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from rivulet.functions.times import period_start
from rivulet.operators.ordered import same_keys

MINUTE, FIVE_MINUTES = 60, 300

STATS: dict[str, Callable[[Column], Column]] = {
    "Average": F.avg,
    "Sum": F.sum,
    "Minimum": F.min,
    "Maximum": F.max,
}

# The percentile sketch's ranks are off by one part in this many at most.
SKETCH_ACCURACY = 10_000


def by_dims(df: DataFrame, dims: list[str], source: str = "dims") -> DataFrame:
    """Lift dimensions out of the map; leaving one out widens the metric to its remaining ones."""
    others = [c for c in df.columns if c != source]
    return df.select(*others, *[F.col(source).getItem(d).alias(d) for d in dims])


def with_period(df: DataFrame, period_s: int, ts: str = "ts") -> DataFrame:
    """Replace the timestamp by the start of its tumbling period, before any grouping."""
    return df.withColumn("period", period_start(F.col(ts), period_s)).drop(ts)


def metric_stat(df: DataFrame, keys: list[str], period_s: int, stat: str, out: str = "stat") -> DataFrame:
    """One statistic per key and period. All but percentiles combine before the shuffle."""
    timed = with_period(df, period_s)
    if stat.startswith("p"):
        return exact_percentile(timed, [*keys, "period"], "value", float(stat[1:]) / 100, out)
    return timed.groupBy(*keys, "period").agg(STATS[stat](F.col("value")).alias(out))


def exact_percentile(df: DataFrame, keys: list[str], value: str, q: float, out: str) -> DataFrame:
    """Interpolated percentile per group, exact for groups of any size, in one lazy plan.

    A sketch that combines before the shuffle gives two values of the group between which the wanted
    rank must lie, a few thousandths of the group apart. Rows become value counts; all counts below
    the lower value are one number, those above the upper one are left out, and only what lies
    between is put in order. Groups too small for the sketch's bounds to be sure have their lowest
    and highest values for bounds.
    """
    data = df.select(*keys, value).where(F.col(value).isNotNull())
    margin = 3 / SKETCH_ACCURACY
    bounds = data.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.min(value).alias("__first"), F.max(value).alias("__last"),
        F.percentile_approx(value, [max(q - margin, 0.0), min(q + margin, 1.0)], SKETCH_ACCURACY).alias("__band"),
    )
    sure = F.col("__n") >= 10 * SKETCH_ACCURACY
    counts = data.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__rows"))
    placed = same_keys(counts, bounds, keys).withColumns({
        "__low": F.when(sure, F.col("__band")[0]).otherwise(F.col("__first")),
        "__high": F.when(sure, F.col("__band")[1]).otherwise(F.col("__last")),
    }).where(F.col(value) <= F.col("__high"))
    # What is below the band becomes one row without a value, which comes first.
    inside = placed.withColumn(value, F.when(F.col(value) >= F.col("__low"), F.col(value)))
    merged = inside.groupBy(*keys, "__n", value).agg(F.sum("__rows").alias("__rows"))
    upto = Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ranked = merged.withColumn("__upto", F.sum("__rows").over(upto))
    rank = F.lit(q) * (F.col("__n") - 1)

    def holds(position: Column) -> Column:
        return (F.col("__upto") > position) & (F.col("__upto") - F.col("__rows") <= position)

    at_low, at_high = holds(F.floor(rank)), holds(F.ceil(rank))
    found = ranked.where(at_low | at_high).groupBy(*keys).agg(
        F.max(F.when(at_low, F.col(value))).alias("__low"),
        F.max(F.when(at_high, F.col(value))).alias("__high"),
        F.max(rank).alias("__rank"),
    )
    below, above = F.col("__rank") - F.floor("__rank"), F.ceil("__rank") - F.col("__rank")
    between = above * F.col("__low") + below * F.col("__high")
    exact = F.when(F.col("__low") == F.col("__high"), F.col("__low")).otherwise(between)
    return found.select(*keys, exact.alias(out))


# Size of the quantile sketches, and how far the rank of an estimate may be off (a share of the
# datapoints, at 99 % confidence). Groups of at most this many datapoints are kept whole.
SKETCH_K, SKETCH_RANK_ERROR = 2000, 0.0025


def quantile_sketches(df: DataFrame, keys: list[str], period_s: int = MINUTE, k: int = SKETCH_K) -> DataFrame:
    """keys, period, datapoints and a quantile sketch of ``value``: the finest level that is kept.

    A sketch has a few kilobytes whatever the number of datapoints, combines before the shuffle, and
    merges with others, so any coarser period and any wider dimension comes from these rows alone.
    Null values are no datapoints. Works on streams, too.
    """
    return with_period(df, period_s).groupBy(*keys, "period").agg(
        F.count("value").alias("datapoints"), F.kll_sketch_agg_double("value", F.lit(k)).alias("sketch")
    )


def merged_quantile(
    sketches: DataFrame, keys: list[str], period_s: int, q: float, out: str = "stat", k: int = SKETCH_K
) -> DataFrame:
    """Quantile by ``keys`` and a coarser period, from sketches: the smallest value whose rank is at least
    ``q``, off by ``SKETCH_RANK_ERROR`` in rank at most and exact where the datapoints fit a sketch.

    Keys that are left out are merged over, as brokers into their cluster. Groups without a datapoint
    have no row.
    """
    merged = _merged_sketches(sketches, keys, period_s, k)
    return merged.select(
        *keys, "period", "datapoints", F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(out)
    )


def _merged_sketches(sketches: DataFrame, keys: list[str], period_s: int, k: int) -> DataFrame:
    timed = sketches.where("datapoints > 0").withColumn("period", period_start(F.col("period"), period_s))
    return timed.groupBy(*keys, "period").agg(
        F.sum("datapoints").alias("datapoints"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch")
    )


def exact_quantile(
    df: DataFrame, sketches: DataFrame, keys: list[str], period_s: int, q: float, out: str = "stat", k: int = SKETCH_K
) -> DataFrame:
    """The quantile that ``merged_quantile`` estimates, made exact from the datapoints ``df`` behind the sketches.

    The merged sketches give two values between which the wanted one lies. Datapoints become value counts, and
    sums over these tell how many lie before the band and whether the band holds the wanted rank; only what lies
    within it is put in order. A sketch errs with some chance, and may be missing: a bound that does not hold is
    given up, so the result is exact all the same. A group of nulls alone has no datapoint and no quantile.
    """
    groups, margin = [*keys, "period"], 2 * SKETCH_RANK_ERROR
    counts = with_period(df, period_s).groupBy(*groups, "value").agg(F.count("value").alias("__rows"))

    def bound(rank: float) -> Column:
        # What is not a number is a datapoint, the greatest, but in no sketch.
        held = F.kll_sketch_get_n_double("sketch") > 0
        return F.when(held, F.kll_sketch_get_quantile_double("sketch", F.lit(min(max(rank, 0.0), 1.0))))

    bands = _merged_sketches(sketches, keys, period_s, k).select(
        *groups, bound(q - margin).alias("__low"), bound(q + margin).alias("__high")
    )
    placed = same_keys(counts, bands, groups, "left")
    sums = placed.groupBy(*groups, "__low", "__high").agg(
        F.sum("__rows").alias("datapoints"),
        F.sum(F.when(F.col("value") < F.col("__low"), F.col("__rows")).otherwise(0)).alias("__below"),
        F.sum(F.when(F.col("value") <= F.col("__high"), F.col("__rows")).otherwise(0)).alias("__upto"),
    ).withColumn("__rank", F.greatest(F.ceil(F.lit(Decimal(str(q))) * F.col("datapoints")).cast("long"), F.lit(1)))
    sure = sums.select(
        *groups, "datapoints", "__rank",
        F.when(F.col("__below") < F.col("__rank"), F.col("__low")).alias("__low"),
        F.when(F.col("__below") < F.col("__rank"), F.col("__below")).otherwise(0).alias("__below"),
        F.when(F.col("__upto") >= F.col("__rank"), F.col("__high")).alias("__high"),
    )
    low, high = F.coalesce("__low", "value"), F.coalesce("__high", "value")
    inside = same_keys(counts, sure, groups).where(
        F.col("value").between(low, high) | (F.col("datapoints") == 0)
    )
    upto = Window.partitionBy(*groups).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = inside.withColumn("__upto", F.col("__below") + F.sum("__rows").over(upto))
    holds = (F.col("__upto") >= F.col("__rank")) & (F.col("__upto") - F.col("__rows") < F.col("__rank"))
    return ranked.where(holds | (F.col("datapoints") == 0)).select(*groups, "datapoints", F.col("value").alias(out))


def metric_rollup(df: DataFrame, levels: list[str], period_s: int) -> DataFrame:
    """Statistics at every level of a dimension hierarchy in one pass, e.g. stream and its shards.

    Partial results are combined per full key before the levels are expanded.
    """
    timed = with_period(df, period_s)
    finest = timed.groupBy("period", *levels).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.max("value").alias("m")
    )
    sets = [["period", *levels[: i + 1]] for i in range(len(levels))]
    return finest.groupingSets(sets, "period", *levels).agg(F.sum("n").alias("datapoints"), F.sum("s").alias("sum"), F.max("m").alias("maximum"))


def metric_rate(stats: DataFrame, keys: list[str], value: str = "stat", per_s: int = 60) -> DataFrame:
    """Change per ``per_s`` seconds between consecutive periods; a series' first period has none."""
    series = Window.partitionBy(*keys).orderBy("period")
    seconds = F.unix_seconds("period") - F.lag(F.unix_seconds("period")).over(series)
    change = F.col(value) - F.lag(value).over(series)
    return stats.withColumn("rate", change / seconds * per_s).where(F.col("rate").isNotNull())


def aligned(
    df: DataFrame, keys: list[str], period_s: int, legs: dict[str, tuple[Column, str]]
) -> DataFrame:
    """Several statistics side by side per key and period, null where a metric has no datapoint.

    ``legs`` maps an output name to (which rows, statistic). One grouping aligns all of them, with no
    join and no second scan.
    """
    timed = with_period(df, period_s)
    columns = [STATS[stat](F.when(rows, F.col("value"))).alias(name) for name, (rows, stat) in legs.items()]
    return timed.groupBy(*keys, "period").agg(*columns)


def gc_percent(m1: Column) -> Column:
    return (m1 * 100) / 60000


def per_second(m1: Column, period_s: int = FIVE_MINUTES) -> Column:
    return m1 / period_s


def as_percent(m1: Column) -> Column:
    return m1 * 100


def percent_of(m1: Column, m2: Column) -> Column:
    return 100 * F.try_divide(m1, m2)


def availability(errors: Column, invocations: Column) -> Column:
    """Success rate; null where nothing was invoked and nothing failed."""
    return 100 - F.try_divide(100 * errors, F.greatest(errors, invocations))


def annotate(stats: DataFrame, label: str, line: float, value: str = "stat") -> DataFrame:
    """Add a constant reference line and whether the value reaches it."""
    return stats.withColumns({
        "label": F.lit(label), "line": F.lit(float(line)), "reached": F.col(value) >= line
    })


def latest(stats: DataFrame, keys: list[str], value: str = "stat") -> DataFrame:
    """The newest period of each series: an aggregate, so no sort and no window."""
    return stats.groupBy(*keys).agg(
        F.max("period").alias("period"), F.max_by(value, "period").alias(value)
    )


def metric_board(metrics: DataFrame, specs: DataFrame, dims: list[str]) -> DataFrame:
    """Every statistic of a spec catalogue in one pass over the metric table.

    ``specs`` holds (namespace, metric_name, stat, period_s, fans_out); where it comes from the fixed
    catalogue Spark sees its size and sends it to every task. A metric that does not fan out is
    taken over all values of the dimensions, which are null in its rows.
    """
    periods = specs.groupBy("namespace", "metric_name", "period_s", "fans_out").agg(
        F.sort_array(F.collect_set("stat")).alias("wanted")
    )
    rows = by_dims(metrics, dims).join(periods, ["namespace", "metric_name"])
    timed = rows.withColumns({
        "period": period_start(F.col("ts"), F.col("period_s").cast("bigint")),
        **{dim: F.when(F.col("fans_out"), F.col(dim)) for dim in dims},
    })
    keys = ["namespace", "metric_name", "period_s", "wanted", *dims, "period"]
    plain = timed.groupBy(*keys).agg(*[agg(F.col("value")).alias(name) for name, agg in STATS.items()])
    long = plain.select(
        *[k for k in keys if k != "wanted"],
        F.explode(
            F.filter(
                F.array(*[
                    F.struct(F.lit(name).alias("stat"), F.col(name).alias("stat_value")) for name in STATS
                ]),
                lambda s: F.array_contains("wanted", s["stat"]),
            )
        ).alias("s"),
    )
    out = [k for k in keys if k != "wanted"]
    board = long.select(*out, "s.stat", "s.stat_value")
    percentiles = exact_percentile(
        timed.where(F.array_contains("wanted", "p99")), out, "value", 0.99, "stat_value"
    )
    return board.unionByName(percentiles.withColumn("stat", F.lit("p99")).select(*board.columns))
