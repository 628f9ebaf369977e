"""Serving queries over city readings (city, ts, aqi, ...)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazegrid import constants as K
from hazegrid.functions import aqi as A
from hazegrid.functions.timefeat import format_minutes
from hazegrid.operators.clean import fill_both
from hazegrid.operators.windows import diff1
from hazegrid.plans.attach import attach, join_null_safe, keeps_names
from hazegrid.plans.blocks import global_positions
from hazegrid.sources.stores import require_columns


def latest_per_city(df: DataFrame, city: str = "city", ts: str = "ts") -> DataFrame:
    """The row at each city's latest timestamp; the smallest row wins ties."""
    rest = [c for c in df.columns if c not in (city, ts)]
    last = df.where(F.col(ts).isNotNull()).groupBy(city).agg(
        F.min(F.struct((-F.unix_micros(ts)).alias("_o"), F.col(ts), *rest)).alias("_r")
    )
    return last.select(*[F.col(city) if c == city else F.col(f"_r.{c}") for c in df.columns])


def locations(df: DataFrame, city: str = "city", ts: str = "ts") -> DataFrame:
    """Cities with their current index and formatted time."""
    return latest_per_city(df.select(city, "state", "country", "aqi", ts), city, ts).select(
        city, "state", "country", F.col("aqi").alias("current_aqi"), format_minutes(F.col(ts)).alias("last_updated")
    )


def filter_city(df: DataFrame, name: str, city: str = "city", must_exist: bool = False) -> DataFrame:
    out = df.where(F.lower(city) == name.lower())
    if must_exist and out.isEmpty():
        raise LookupError(f"No data found for city: {name}")
    return out


def with_as_of(df: DataFrame, as_of: Column | None, ts: str = "ts") -> DataFrame:
    """Add ``_now``: the given instant, else the latest timestamp of the table."""
    if as_of is not None:
        return df.withColumn("_now", as_of)
    return attach(df, df.agg(F.max(ts).alias("_now")), [])


def filter_last_days(df: DataFrame, days: int, as_of: Column | None = None, ts: str = "ts") -> DataFrame:
    if not 1 <= days <= 21:
        raise ValueError("days must be between 1 and 21")
    return with_as_of(df, as_of, ts).where(F.col(ts) >= F.col("_now") - F.make_dt_interval(F.lit(days))).drop("_now")


def historical(df: DataFrame, city_name: str | None = None, days: int = 7, as_of: Column | None = None,
               city: str = "city", ts: str = "ts") -> DataFrame:
    """Last days of one city (or of all), gaps filled forward then backward within the city."""
    cols = list(K.HISTORY_COLUMNS)
    require_columns(df, [ts, *cols])
    recent = filter_last_days(df, days, as_of, ts)
    picked = filter_city(recent, city_name, city) if city_name else recent
    return fill_both(picked.select(city, ts, *cols), cols, [city], ts, gap_free=False)


def overview(df: DataFrame, as_of: Column | None = None, city: str = "city", ts: str = "ts") -> DataFrame:
    """Current index and risk, mean of the last week, trend against the week before; all cities
    in one aggregation."""
    t, now = F.col(ts), F.col("_now")
    week, fortnight = now - F.expr("INTERVAL 7 DAYS"), now - F.expr("INTERVAL 14 DAYS")
    recent, older = t >= week, (t >= fortnight) & (t < week)
    agg = with_as_of(df.select(city, ts, "aqi"), as_of, ts).groupBy(city).agg(
        F.max_by("aqi", t).alias("current_aqi"),
        F.max(t).alias("_t"),
        F.avg(F.when(recent, F.col("aqi"))).alias("_w"),
        F.avg(F.when(older, F.col("aqi"))).alias("_o"),
    )
    filled = agg.select(city, "current_aqi", "_t", F.coalesce("_w", "current_aqi").alias("_w"), "_o")
    return filled.select(
        city,
        "current_aqi",
        A.risk_level_strict(F.col("current_aqi")).alias("current_risk_level"),
        F.round("_w", 2).alias("weekly_avg"),
        A.trend_direction(F.col("_w"), F.coalesce("_o", "_w")).alias("trend_direction"),
        format_minutes(F.col("_t")).alias("last_updated"),
    )


@keeps_names
def city_stats(df: DataFrame, city: str = "city", ts: str = "ts", gap_free: bool = False) -> DataFrame:
    """Summary per city. The "days" of the dashboard count rows, i.e. hours; the true-day
    counts (days whose mean exceeds the limit) stand beside them."""
    stepped = diff1(df.select(city, ts, "aqi"), {"_d": "aqi"}, [city], ts, gap_free)
    a, d = F.col("aqi"), F.col("_d")
    hourly = stepped.groupBy(city).agg(
        F.avg(a).alias("mean_aqi"), F.max(a).alias("max_aqi"), F.min(a).alias("min_aqi"),
        F.stddev_samp(a).alias("std_aqi"), F.count_if(a > 100).alias("hours_over_100"),
        F.count_if(a > 150).alias("hours_over_150"), F.count_if(d < 0).alias("improving_steps"),
        F.count_if(d > 0).alias("worsening_steps"), F.avg(d).alias("mean_change"),
    )
    days = daily_mean(df, city, ts).groupBy(city).agg(
        F.count_if(F.col("daily_aqi") > 100).alias("days_over_100"),
        F.count_if(F.col("daily_aqi") > 150).alias("days_over_150"),
    )
    return join_null_safe(hourly, days, [city], "inner")


def daily_mean(df: DataFrame, city: str = "city", ts: str = "ts") -> DataFrame:
    return df.groupBy(city, F.to_date(ts).alias("day")).agg(F.avg("aqi").alias("daily_aqi"))


def report_insights(df: DataFrame, city: str = "city") -> DataFrame:
    """Best and worst city by mean index."""
    means = df.groupBy(city).agg(F.avg("aqi").alias("m")).where(F.col("m").isNotNull())
    return means.agg(
        F.min(F.struct("m", city)).alias("lo"), F.min(F.struct((-F.col("m")).alias("m"), city)).alias("hi"),
        F.count(F.lit(1)).alias("cities"),
    ).select(
        F.col(f"lo.{city}").alias("best_city"), F.col("lo.m").alias("best_mean_aqi"),
        F.col(f"hi.{city}").alias("worst_city"), (-F.col("hi.m")).alias("worst_mean_aqi"), "cities",
    )


def quick_stats(df: DataFrame, city: str = "city", ts: str = "ts") -> DataFrame:
    """Best and worst city by current index, and how many are monitored."""
    now = latest_per_city(df.select(city, "aqi", ts), city, ts)
    return now.agg(
        F.min(F.when(F.col("aqi").isNotNull(), F.struct("aqi", city))).alias("lo"),
        F.min(F.when(F.col("aqi").isNotNull(), F.struct((-F.col("aqi")).alias("aqi"), F.col(city)))).alias("hi"),
        F.count(F.lit(1)).alias("cities_monitored"),
    ).select(
        F.col(f"lo.{city}").alias("best_city"), F.col("lo.aqi").alias("best_aqi"),
        F.col(f"hi.{city}").alias("worst_city"), (-F.col("hi.aqi")).alias("worst_aqi"), "cities_monitored",
    )


def rank_cities(current: DataFrame, value: str = "current_aqi", city: str = "city") -> DataFrame:
    """Cities from cleanest to worst with medal and title of the first three. The table is sorted by
    ranges, so no single task sees all cities."""
    ranked = global_positions(current, [F.col(value).asc_nulls_last(), F.col(city)], "_p").withColumn("rank", (F.col("_p") + 1).cast("int")).drop("_p")
    medal, title = F.lit(None).cast("string"), F.lit(None).cast("string")
    for place, m, t in K.RANK_MEDALS:
        medal, title = F.when(F.col("rank") == place, m).otherwise(medal), F.when(F.col("rank") == place, t).otherwise(title)
    return ranked.withColumn("medal", medal).withColumn("title", title)


def join_city_dim(df: DataFrame, coords: DataFrame, city: str = "city") -> DataFrame:
    """Latitude and longitude per city; the dimension is measured before it is broadcast."""
    return attach(df, coords, [city])


def city_compare(df: DataFrame, coords: DataFrame, as_of: Column | None = None, city: str = "city",
                 ts: str = "ts") -> DataFrame:
    """Overview, class token, rank and coordinates of every city."""
    ranked = rank_cities(overview(df, as_of, city, ts), "current_aqi", city)
    classed = ranked.withColumn("aqi_class", A.risk_class_strict(F.col("current_aqi")))
    return join_city_dim(classed, coords, city)


# --- forecasts ---------------------------------------------------------------------------


def forecast_hourly(current: DataFrame, points: Mapping[int, str], max_hours: int = 72, city: str = "city",
                    ts: str = "ts", value: str = "aqi") -> DataFrame:
    """Hourly curve through (0, current) and the horizon forecasts, flat beyond the last one.

    ``points``: horizon hours -> column of its forecast. Null forecasts leave their point out; the hours before the
    first point, or all of them without any point, have a null forecast.
    """
    if not 1 <= max_hours <= 72:
        raise ValueError("Maximum horizon is 72 hours.")
    known = F.filter(
        F.array(
            F.struct(F.lit(0).alias("x"), F.col(value).alias("y")),
            *[F.struct(F.lit(h).alias("x"), F.col(c).alias("y")) for h, c in sorted(points.items())],
        ),
        lambda p: p["y"].isNotNull(),
    )
    hours = current.withColumn("_k", known).select(
        city, ts, "_k", F.explode(F.sequence(F.lit(1), F.lit(max_hours))).alias("horizon_hours")
    )
    h = F.col("horizon_hours")
    left = F.try_element_at(F.filter("_k", lambda p: p["x"] <= h), F.lit(-1))
    right = F.try_element_at(F.filter("_k", lambda p: p["x"] >= h), F.lit(1))
    seg = hours.select(city, ts, "horizon_hours", left.alias("a"), right.alias("b"))
    a, b = F.col("a"), F.col("b")
    y = F.when(b.isNull() | (a["x"] == b["x"]), a["y"]).otherwise(
        a["y"] + (b["y"] - a["y"]) / (b["x"] - a["x"]) * (h - a["x"])
    )
    rounded = seg.select(
        city, (F.col(ts) + F.make_dt_interval(hours=h)).alias("forecast_ts"), "horizon_hours",
        F.round(y, 2).alias("predicted_aqi"),
    )
    return rounded.withColumn("risk_level", A.risk_level_strict(F.col("predicted_aqi")))


def next_hours(forecast: DataFrame, n: int = 6, city: str = "city") -> DataFrame:
    """First hours of each city's curve (the curve starts at hour 1)."""
    return forecast.where(F.col("horizon_hours") <= n).select(
        city, "forecast_ts", "horizon_hours", F.floor("predicted_aqi").alias("aqi_shown"),
        A.risk_band(F.col("predicted_aqi")).alias("label"),
    )


def worst_hour(forecast: DataFrame, city: str = "city") -> DataFrame:
    """Hour with the highest forecast per city, the earliest on ties; a null forecast only where there is no other."""
    best = F.min(F.struct(F.col("predicted_aqi").isNull(), (-F.col("predicted_aqi")).alias("v"), "horizon_hours", "forecast_ts"))
    return forecast.groupBy(city).agg(best.alias("b")).select(
        city, (-F.col("b.v")).alias("predicted_aqi"), F.col("b.horizon_hours").alias("horizon_hours"),
        F.col("b.forecast_ts").alias("forecast_ts"),
        A.risk_band(-F.col("b.v")).alias("label"), A.risk_advice(-F.col("b.v")).alias("advice"),
    )


def union_labeled(frames: Mapping[str, DataFrame], label: str = "city_label") -> DataFrame:
    out = None
    for name, f in frames.items():
        f = f.withColumn(label, F.lit(name))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def labeled(df: DataFrame, by: str, prefix: str = "", label: str = "city_label") -> DataFrame:
    """What ``union_labeled`` gives for one frame per value of ``by``, without splitting the table."""
    return df.withColumn(label, F.concat(F.lit(prefix), F.col(by)))


def sample_rows(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """``n`` pseudo-random rows, the same for the same seed: those with the least MD5 of keys and seed."""
    drawn = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))
    return df.orderBy(drawn, *keys).limit(n)


def minmax_scale(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Each column to [0, 1] by its range; constant columns give 0."""
    span = df.groupBy(*keys).agg(
        *[F.min(c).alias(f"_lo_{c}") for c in cols], *[F.max(c).alias(f"_hi_{c}") for c in cols]
    )
    joined = attach(df, span, keys)

    def scaled(c):
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        return (F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).when(F.col(c).isNotNull(), 0.0)).alias(c)

    return joined.select(*[scaled(c) if c in cols else F.col(c) for c in df.columns])


def minmax_inverse(scaled: Column, lo: Column, hi: Column) -> Column:
    return scaled * (hi - lo) + lo
