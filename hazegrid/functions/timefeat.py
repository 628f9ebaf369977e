"""Calendar, cyclic and interaction features; time formatting."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazegrid import constants as K


def day_of_week(ts: Column) -> Column:
    """Monday = 0."""
    return F.weekday(ts)


def calendar_features(ts: Column) -> list[Column]:
    return [
        F.hour(ts).alias("hour"),
        day_of_week(ts).alias("day_of_week"),
        F.dayofmonth(ts).alias("day"),
        day_of_week(ts).alias("weekday"),
        F.month(ts).alias("month"),
        F.quarter(ts).alias("quarter"),
        (day_of_week(ts) >= 5).cast("int").alias("is_weekend"),
        (F.floor((F.month(ts) % 12) / 3) + 1).cast("int").alias("season"),
    ]


def _turn(x: Column, period: int) -> Column:
    return x * F.lit(2 * math.pi) / F.lit(period)


def cyclic_features(ts: Column) -> list[Column]:
    hour, dow, month = _turn(F.hour(ts), 24), _turn(day_of_week(ts), 7), _turn(F.month(ts), 12)
    return [
        F.sin(hour).alias("hour_sin"),
        F.cos(hour).alias("hour_cos"),
        F.sin(dow).alias("day_sin"),
        F.cos(dow).alias("day_cos"),
        F.cos(month).alias("month_cos"),
    ]


def interaction_features(columns: list[str]) -> list[Column]:
    """Those whose inputs exist."""
    have, out = set(columns), []
    if {"temperature", "humidity"} <= have:
        out.append((F.col("temperature") * F.col("humidity") / 100).alias("temp_humidity_interaction"))
    if {"wind_speed", "wind_direction"} <= have:
        angle = F.radians("wind_direction")
        out.append((F.col("wind_speed") * F.cos(angle)).alias("wind_u"))
        out.append((F.col("wind_speed") * F.sin(angle)).alias("wind_v"))
    if {"pm2_5", "pm10"} <= have:
        out.append((F.col("pm2_5") / (F.col("pm10") + F.lit(1e-6))).alias("pm25_pm10_ratio"))
    return out


def format_seconds(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def format_minutes(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def horizon_label(hours: Column) -> Column:
    out = None
    for h, label in K.HORIZON_LABELS.items():
        out = F.when(hours == h, label) if out is None else out.when(hours == h, label)
    return out.otherwise(F.concat(hours.cast("string"), F.lit("h")))


def horizon_date(as_of: Column, hours: Column) -> Column:
    return F.date_format(as_of + F.make_dt_interval(hours=hours), "yyyy-MM-dd")
