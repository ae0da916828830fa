"""Fare estimate for a ride request, as one native expression."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Fixed values of the fare model.
LOWEST_FARE = 10
FARE_STEPS = 91
NOISE_SPREAD = 0.4
NOISE_SHIFT = 0.2
OK_STATUS = 200
BAD_REQUEST = 400
GATEWAY_TIMEOUT = 504


def usable_id(ride_id: Column) -> Column:
    ride_id = ride_id.cast("double")
    return F.coalesce((ride_id != 0) & ~F.isnan(ride_id), F.lit(False))


def fare_status(ride_id: Column) -> Column:
    return F.when(usable_id(ride_id), OK_STATUS).otherwise(BAD_REQUEST)


def fare(ride_id: Column) -> Column:
    """Expected fare, null where the request would be refused."""
    part = (F.lit(math.e) * ride_id.cast("double")) % F.lit(1.0)
    base = F.floor(part * FARE_STEPS + LOWEST_FARE).cast("double")
    return F.when(usable_id(ride_id), base * (1 + part * NOISE_SPREAD - NOISE_SHIFT))

