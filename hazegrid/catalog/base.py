"""Registry of queries with their check SQL, and the panels they run on.

Every panel is derived by Spark from the driver tables; ``*_SQL`` are the same panels as common
table expressions for the check engine.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazegrid import constants as K
from hazegrid.functions import aqi as A
from hazegrid.operators.windows import future_targets, rolling_mean
from hazegrid.sources.hourly import hourly_grid
from hazegrid.session import checkpointed
from hazegrid.sources.stores import read_store

DIGITS = 6


@dataclass
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def finish(df: DataFrame) -> DataFrame:
    """Output form shared with the check SQL: doubles to 6 digits, timestamps without zone."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            c = (F.round(c, DIGITS) + F.lit(0.0)).alias(f.name)
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz").alias(f.name)
        out.append(c)
    return df.select(*out)


def query(name: str, sql: str | None = None, doubles: Sequence[str] = ()):
    """Register a query. ``doubles`` are the columns the check SQL rounds like ``finish``."""
    if sql is not None and doubles:
        rounded = ", ".join(f"round({c}::DOUBLE, {DIGITS}) + 0.0 AS {c}" for c in doubles)
        sql = f"SELECT * REPLACE ({rounded}) FROM ({sql}) AS answer"

    def wrap(fn):
        REGISTRY[name] = Query(lambda spark, sf_dir: finish(fn(spark, sf_dir)), sql)
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return read_store(spark, f"{sf_dir}/{name}.parquet", columns or None)


# --- panels --------------------------------------------------------------------------------

BASE = ("pm2_5", "pm10", "co", "no2", "so2", "o3", "temperature", "humidity", "wind_speed", "wind_direction")
SERIES = {
    "city": (lambda: F.col("event_type"), "event_type"),
    "station": (lambda: F.concat(F.lit("st"), F.floor(F.col("user_id") / 20).cast("string")), "'st' || (user_id // 20)"),
}


def _sixteenths(total: str, per: str) -> str:
    """Mean of integer cents cut to 1/16: exact in integers, so every engine and every order of
    summation gives the same value."""
    return f"cast(({total}) * 16 div nullif({per}, 0) as double) / 16"


def hourly_panel(spark: SparkSession, sf_dir: str, kind: str = "city") -> DataFrame:
    """Events as an hourly panel: mean, extremes and band means of the values stand for the
    pollutants, counts and key sums for the weather. Only observed hours; heavy nulls."""
    ev = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    ev = ev.withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))

    def mean_where(hit: str):
        return F.expr(_sixteenths(f"sum(if({hit}, cents, null))", f"100 * count_if({hit})"))

    return ev.groupBy(
        SERIES[kind][0]().alias("series_id"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts")
    ).agg(
        mean_where("true").alias("pm2_5"),
        F.expr(_sixteenths("max(cents)", "100")).alias("pm10"),
        F.expr(_sixteenths("min(cents)", "1000")).alias("co"),
        mean_where("cents < 5000").alias("no2"),
        mean_where("cents >= 8000").alias("so2"),
        mean_where("cents between 2000 and 6000").alias("o3"),
        (F.lit(10.0) + F.count(F.lit(1))).alias("temperature"),
        (F.lit(40.0) + F.sum("user_id") % 60).alias("humidity"),
        F.count_if(F.col("cents") > 5000).cast("double").alias("wind_speed"),
        (F.sum("event_id") % 360).cast("double").alias("wind_direction"),
    )


def _sql_sixteenths(total: str, per: str) -> str:
    return f"((({total}) * 16)::BIGINT // nullif({per}, 0)::BIGINT)::DOUBLE / 16"


def panel_sql(kind: str = "city") -> str:
    def mean_where(hit):
        return _sql_sixteenths(f"sum(CASE WHEN {hit} THEN cents END)", f"(100 * sum(CASE WHEN {hit} THEN 1 ELSE 0 END))")

    return f"""panel AS (
  SELECT {SERIES[kind][1]} AS series_id, date_trunc('hour', ts) AS ts,
    {mean_where('true')} AS pm2_5, {_sql_sixteenths('max(cents)', '100')} AS pm10,
    {_sql_sixteenths('min(cents)', '1000')} AS co,
    {mean_where('cents < 5000')} AS no2, {mean_where('cents >= 8000')} AS so2,
    {mean_where('cents BETWEEN 2000 AND 6000')} AS o3,
    10e0 + count(*) AS temperature, 40e0 + sum(user_id) % 60 AS humidity,
    sum(CASE WHEN cents > 5000 THEN 1 ELSE 0 END)::DOUBLE AS wind_speed,
    (sum(event_id) % 360)::DOUBLE AS wind_direction
  FROM (SELECT *, round(value * 100)::BIGINT AS cents FROM events) GROUP BY 1, 2)"""


def gridded(spark: SparkSession, sf_dir: str, kind: str = "city") -> DataFrame:
    return hourly_grid(hourly_panel(spark, sf_dir, kind))


def grid_sql(kind: str = "city") -> str:
    return panel_sql(kind) + """,
axis AS (
  SELECT s.series_id, h.ts FROM (SELECT DISTINCT series_id FROM panel) s,
    (SELECT unnest(generate_series((SELECT min(ts) FROM panel), (SELECT max(ts) FROM panel), INTERVAL 1 HOUR)) AS ts) h),
grid AS (
  SELECT a.series_id, a.ts, p.* EXCLUDE (series_id, ts)
  FROM axis a LEFT JOIN panel p ON p.series_id = a.series_id AND p.ts = a.ts)"""


def stored(df: DataFrame) -> DataFrame:
    """Panel written once: for operators that pass over their input several times."""
    return checkpointed(df)


def with_aqi(grid: DataFrame) -> DataFrame:
    rolled = rolling_mean(grid, {"pm2_5_24h": ("pm2_5", 24)}, gap_free=True)
    return rolled.withColumn("aqi", A.epa_aqi(F.col("pm2_5_24h"), "pm2_5", "ug/m3"))


def sql_aqi(x: str, pollutant: str) -> str:
    arms = " ".join(
        f"WHEN {x} BETWEEN {float(a)!r}e0 AND {float(b)!r}e0 "
        f"THEN {(i - h) / (b - a)!r}e0 * ({x} - {float(a)!r}e0) + {float(h)!r}e0"
        for a, b, h, i in K.BREAKPOINTS[pollutant]
    )
    return f"(CASE {arms} END)"


def aqi_grid(spark: SparkSession, sf_dir: str, kind: str = "city") -> DataFrame:
    return with_aqi(gridded(spark, sf_dir, kind))


def aqi_grid_sql(kind: str = "city") -> str:
    return grid_sql(kind) + f""",
rolled AS (
  SELECT *, avg(pm2_5) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)
    AS pm2_5_24h FROM grid),
aqi_grid AS (SELECT *, {sql_aqi('pm2_5_24h', 'pm2_5')} AS aqi FROM rolled)"""


def readings(spark: SparkSession, sf_dir: str, kind: str = "city") -> DataFrame:
    """City readings as the serving layer knows them; each event type (or station) is a city."""
    return aqi_grid(spark, sf_dir, kind).select(
        F.col("series_id").alias("city"), F.concat(F.lit("state of "), "series_id").alias("state"),
        F.lit("Testland").alias("country"), "ts", "aqi", F.col("pm2_5").alias("pm25"), "pm10", "o3", "no2", "so2", "co",
        "temperature", "humidity", "wind_direction", "wind_speed",
    )


def readings_sql(kind: str = "city") -> str:
    return aqi_grid_sql(kind) + """,
readings AS (
  SELECT series_id AS city, 'state of ' || series_id AS state, 'Testland' AS country, ts, aqi, pm2_5 AS pm25, pm10, o3,
    no2, so2, co, temperature, humidity, wind_direction, wind_speed FROM aqi_grid)"""


MODELS = tuple(f"persist_{h}h" for h in K.HORIZONS)


def persistence(spark: SparkSession, sf_dir: str, kind: str = "city") -> DataFrame:
    """Predictions "as it was h hours ago", long form."""
    from hazegrid.plans.blocks import halo_window

    src = aqi_grid(spark, sf_dir, kind).select("series_id", "ts", F.col("aqi").alias("y"))
    wide = halo_window(src, ["series_id"], lambda w: [F.lag("y", h).over(w).alias(f"persist_{h}h") for h in K.HORIZONS],
                       before=max(K.HORIZONS), gap_free=True)
    return wide.unpivot(["series_id", "ts", "y"], list(MODELS), "model", "yhat")


def persistence_sql(kind: str = "city") -> str:
    arms = " UNION ALL ".join(
        f"SELECT series_id, ts, aqi AS y, 'persist_{h}h' AS model, "
        f"lag(aqi, {h}) OVER (PARTITION BY series_id ORDER BY ts) AS yhat FROM aqi_grid"
        for h in K.HORIZONS
    )
    return aqi_grid_sql(kind) + f",\npreds AS ({arms})"


def targets_grid(spark: SparkSession, sf_dir: str, kind: str = "city") -> DataFrame:
    return future_targets(aqi_grid(spark, sf_dir, kind), gap_free=True)


def targets_sql(kind: str = "city") -> str:
    leads = ", ".join(f"lead(aqi, {h}) OVER (PARTITION BY series_id ORDER BY ts) AS aqi_{h}h" for h in K.HORIZONS)
    return aqi_grid_sql(kind) + f",\ntargets AS (SELECT *, {leads} FROM aqi_grid)"


def daily_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean order value per region and day on a gap-free daily axis: long series."""
    from hazegrid.sources.hourly import daily_grid

    orders = table(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_totalprice")
    cust = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region", "r_regionkey", "r_name")
    daily = (
        orders.join(cust, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy(F.col("r_name").alias("series_id"), F.col("o_orderdate").cast("timestamp").alias("ts"))
        .agg(F.expr(_sixteenths("sum(cast(round(o_totalprice * 100) as bigint))", "100000 * count(*)")).alias("value"))
    )
    return daily_grid(daily)


DAILY_SQL = f"""daily AS (
  SELECT r_name AS series_id, o_orderdate AS ts,
    {_sql_sixteenths('sum(round(o_totalprice * 100)::BIGINT)', '(100000 * count(*))')} AS value
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2),
daily_grid AS (
  SELECT s.series_id, h.ts, d.value FROM (SELECT DISTINCT series_id FROM daily) s CROSS JOIN
    (SELECT unnest(generate_series((SELECT min(ts) FROM daily), (SELECT max(ts) FROM daily), INTERVAL 1 DAY)) AS ts) h
    LEFT JOIN daily d ON d.series_id = s.series_id AND d.ts = h.ts)"""


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as registered model versions: one workspace per customer, horizon by value."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
              "o_orderpriority")
    price, prio = F.col("o_totalprice"), F.col("o_orderpriority")
    horizon = F.when(price < 150000, "24").when(price < 300000, "48").otherwise("72")
    model = (
        F.when(prio == "1-URGENT", "ExtraTrees").when(prio == "2-HIGH", "CatBoost").when(prio == "3-MEDIUM", "XGBoost")
        .when(prio == "5-LOW", "LightGBM").otherwise("Prophet")
    )
    text = (
        F.when(price > 450000, "Retrained on schedule")
        .when(F.col("o_orderstatus") == "F", F.concat(F.lit("The best model for "), horizon, F.lit("h is "), model))
        .when(F.col("o_orderstatus") == "O", F.concat(F.lit("best model: "), F.lower(model)))
        .otherwise(F.concat(F.lit("Nightly run. MODEL: "), F.upper(model)))
    )
    return o.select(
        F.col("o_custkey").alias("workspace"),
        F.concat(F.lit("aqi_forecast_model_"), horizon, F.lit("h")).alias("name"),
        F.col("o_orderkey").alias("version"),
        F.when(prio == "1-URGENT", "production").when(prio == "2-HIGH", "latest").alias("tag"),
        text.alias("description"),
        F.col("o_orderdate").cast("timestamp").alias("updated_at"),
    )


REGISTRY_SQL = """priced AS (
  SELECT *, CASE WHEN o_totalprice < 150000 THEN '24' WHEN o_totalprice < 300000 THEN '48' ELSE '72' END AS hz,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'ExtraTrees' WHEN '2-HIGH' THEN 'CatBoost' WHEN '3-MEDIUM' THEN 'XGBoost'
      WHEN '5-LOW' THEN 'LightGBM' ELSE 'Prophet' END AS model FROM orders),
registry AS (
  SELECT o_custkey AS workspace, 'aqi_forecast_model_' || hz || 'h' AS name, o_orderkey AS version,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'production' WHEN '2-HIGH' THEN 'latest' END AS tag,
    CASE WHEN o_totalprice > 450000 THEN 'Retrained on schedule'
      WHEN o_orderstatus = 'F' THEN 'The best model for ' || hz || 'h is ' || model
      WHEN o_orderstatus = 'O' THEN 'best model: ' || lower(model)
      ELSE 'Nightly run. MODEL: ' || upper(model) END AS description,
    o_orderdate AS updated_at FROM priced)"""


def sql_bands(x: str, rows: Sequence[tuple], field: int) -> str:
    arms = []
    for r in rows:
        text = str(r[field]).replace("'", "''")
        arms.append(f"WHEN {x} <= {r[0]} THEN '{text}'" if r[0] is not None else f"ELSE '{text}'")
    return f"(CASE WHEN {x} IS NULL THEN NULL {' '.join(arms)} END)"


def sql_strict(x: str, field: int = 2) -> str:
    arms = " ".join(f"WHEN {x} BETWEEN {r[0]} AND {r[1]} THEN '{r[field]}'" for r in K.STRICT_BANDS)
    return f"(CASE {arms} ELSE '{K.STRICT_ELSE[field - 2]}' END)"
