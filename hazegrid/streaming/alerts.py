"""Hazard alerts; the same functions serve batch tables and streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazegrid import constants as K


def _level(aqi: Column, field: int) -> Column:
    out = None
    for row in K.ALERT_LEVELS:
        out = F.when(aqi >= row[0], F.lit(row[field])) if out is None else out.when(aqi >= row[0], F.lit(row[field]))
    return out


def hazard_alerts(df: DataFrame, place: str = "city", ts: str = "ts", aqi: str = "aqi", extra: Sequence[str] = ()) -> DataFrame:
    """One alert per reading at or above the lowest threshold; stateless, so it runs in append
    mode on a stream. The id is the place and the instant; ``extra`` columns are kept."""
    a = F.col(aqi)
    return df.where(a >= K.ALERT_LEVELS[-1][0]).select(
        F.concat_ws("@", F.col(place), F.date_format(ts, "yyyyMMddHHmmss")).alias("id"),
        F.col(place),
        F.col(ts).alias("ts"),
        _level(a, 1).alias("type"),
        _level(a, 2).alias("title"),
        F.concat(F.col(place), F.lit(": AQI "), F.bround(a, 0).cast("bigint").cast("string"), F.lit(" - "), _level(a, 3))
        .alias("message"),
        _level(a, 4).alias("duration_minutes"),
        F.lit(False).alias("dismissed"),
        F.lit(True).alias("is_hazardous"),
        *extra,
    )


def unavailable_alerts(df: DataFrame, place: str = "city", ts: str = "ts", aqi: str = "aqi") -> DataFrame:
    """One warning per poll that brought no value; stateless like ``hazard_alerts``."""
    kind, title, message, minutes = K.UNAVAILABLE_ALERT
    return df.where(F.col(aqi).isNull()).select(
        F.concat_ws("@", F.col(place), F.date_format(ts, "yyyyMMddHHmmss")).alias("id"),
        F.col(place),
        F.col(ts).alias("ts"),
        F.lit(kind).alias("type"),
        F.lit(title).alias("title"),
        F.lit(message).alias("message"),
        F.lit(minutes).alias("duration_minutes"),
        F.lit(False).alias("dismissed"),
        F.lit(False).alias("is_hazardous"),
    )


def active_alerts(alerts: DataFrame, as_of: Column, dismissals: DataFrame | None = None) -> DataFrame:
    """Alerts shown at ``as_of``: raised, not expired, not dismissed."""
    live = alerts.where(
        ~F.col("dismissed")
        & (F.col("ts") <= as_of)
        & (as_of < F.col("ts") + F.make_dt_interval(mins=F.col("duration_minutes")))
    )
    return live.join(dismissals.select("id").distinct(), "id", "left_anti") if dismissals is not None else live


def last_check(df: DataFrame, place: str = "city", ts: str = "ts", aqi: str = "aqi") -> DataFrame:
    """Per place the last reading, whether it is hazardous, and whether there was no value."""
    last = df.groupBy(place).agg(F.max(ts).alias("checked_ts"), F.max_by(aqi, ts).alias("aqi_value"))
    return last.select(
        place,
        "checked_ts",
        "aqi_value",
        F.coalesce(F.col("aqi_value") >= K.ALERT_LEVELS[-1][0], F.lit(False)).alias("is_hazardous"),
        F.col("aqi_value").isNull().alias("data_unavailable"),
    )
