"""Landed API responses and the regular hourly axis."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazegrid.plans.attach import attach, join_null_safe, keeps_names
from hazegrid.session import checkpointed


def explode_hourly_response(
    df: DataFrame, variables: Sequence[str], keys: Sequence[str] = ("series_id",),
    start: str = "start", end: str = "end", interval: str = "interval_s",
) -> DataFrame:
    """One array per variable plus start / end (exclusive) / step in seconds -> one row per step."""
    steps = F.when(
        F.col(end) > F.col(start),
        F.sequence(F.col(start), F.col(end) - F.col(interval), F.col(interval)),
    ).otherwise(F.array().cast("array<bigint>"))
    zipped = F.arrays_zip(steps.alias("t"), *[F.col(v) for v in variables])
    return (
        df.select(*keys, F.explode(zipped).alias("r"))
        .where(F.col("r.t").isNotNull())
        .select(*keys, F.timestamp_seconds("r.t").alias("ts"), *[F.col(f"r.{v}").alias(v) for v in variables])
    )


def _span(df: DataFrame, key: str, ts: str, per_series: bool) -> DataFrame:
    """Series with the ends of their axis. The list of series is computed once and stored, so the
    rows are passed over only once more, for the join."""
    series = df.groupBy(key).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    if per_series:
        return series
    series = checkpointed(series)
    return attach(series.select(key), series.agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")), [])


@keeps_names
def hourly_grid(df: DataFrame, key: str = "series_id", ts: str = "ts", per_series: bool = False) -> DataFrame:
    """Gap-free hourly axis per series with the given rows left-joined to it.

    The axis spans the whole table, or each series' own range; rows without a series are a series. Days are unfolded first and
    hours second, so no row ever holds more than one entry per day.
    """
    span = _span(df, key, ts, per_series)
    day = F.explode(F.sequence(F.date_trunc("day", "_lo"), F.date_trunc("day", "_hi"), F.expr("INTERVAL 1 DAY")))
    hour = F.explode(F.sequence(F.col("_d"), F.col("_d") + F.expr("INTERVAL 23 HOURS"), F.expr("INTERVAL 1 HOUR")))
    axis = (
        span.select(key, "_lo", "_hi", day.alias("_d"))
        .select(key, "_lo", "_hi", hour.alias(ts))
        .where(F.col(ts).between(F.col("_lo"), F.col("_hi")))
        .select(key, ts)
    )
    return join_null_safe(axis, df, [key, ts])


@keeps_names
def daily_grid(df: DataFrame, key: str = "series_id", ts: str = "ts") -> DataFrame:
    """Gap-free daily axis over the whole table's date range."""
    span = _span(df, key, ts, False)
    days = F.explode(F.sequence(F.col("_lo"), F.col("_hi"), F.expr("INTERVAL 1 DAY")))
    return join_null_safe(span.select(key, days.alias(ts)), df, [key, ts])


def lookback_range(as_of: dt.date, days: int = 92) -> tuple[dt.date, dt.date]:
    """Collection range: the ``days`` days that end the day before ``as_of``."""
    end = as_of - dt.timedelta(days=1)
    return end - dt.timedelta(days=days - 1), end


def in_lookback(date_col: Column, as_of: Column, days: int = 92) -> Column:
    return date_col.between(F.date_sub(as_of, days), F.date_sub(as_of, 1))


def join_sources(weather: DataFrame, air: DataFrame, keys: Sequence[str] = ("series_id", "ts")) -> DataFrame:
    """Inner join of two hourly sources; (series, hour) is the key, so no key is hot."""
    return weather.join(air, list(keys), "inner")
