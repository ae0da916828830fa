"""Generated stock ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rivulet.functions.shards import uniform
from rivulet.sources.streams import STEADY_RATE

# The tickers, drawn evenly, and the price range.
TICKERS = ["AAPL", "AMZN", "MSFT", "INTC", "TBV"]
HIGHEST_PRICE = 100.0


def tick_columns(tick_id: Column, seed: int, decimals: int | None = None) -> list[Column]:
    """Ticker and price drawn from the row's id, so a retried task draws the same ones."""
    pick = F.floor(uniform(seed, tick_id, "ticker") * len(TICKERS)).cast("int")
    price = uniform(seed, tick_id, "price") * HIGHEST_PRICE
    if decimals is not None:
        price = F.round(price, decimals)
    return [F.element_at(F.array(*map(F.lit, TICKERS)), pick + 1).alias("ticker"), price.alias("price")]


def gen_ticks(ids: DataFrame, id_column: str, event_time: Column, seed: int = 42, decimals: int | None = None) -> DataFrame:
    """One tick per id; ``ids`` may be ``spark.range(n)`` or any table with a unique id."""
    tick_id = F.col(id_column)
    return ids.select(
        tick_id.alias("tick_id"), *tick_columns(tick_id, seed, decimals), event_time.alias("event_time")
    )


def tick_stream(spark: SparkSession, per_second: int = STEADY_RATE, seed: int = 42) -> DataFrame:
    """An endless stream of ticks at a steady rate, stamped with the current time."""
    rows = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return rows.select(
        F.col("value").alias("tick_id"), *tick_columns(F.col("value"), seed), F.col("timestamp").alias("event_time")
    )
