"""Queries: projections, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazegrid import constants as K
from hazegrid.catalog.base import (
    BASE, REGISTRY_SQL, aqi_grid, aqi_grid_sql, grid_sql, gridded, hourly_panel, panel_sql, persistence, persistence_sql,
    query, readings, readings_sql, registry, sql_aqi, sql_bands, sql_strict, table,
)
from hazegrid.functions import aqi as A
from hazegrid.functions import names as N
from hazegrid.functions import timefeat as TF
from hazegrid.operators import clean as C
from hazegrid.operators import serve as V
from hazegrid.operators.windows import rolling_mean
from hazegrid.sources.stores import encode_label

GASES = ("co", "no2", "so2", "o3")


@query("conv_ppb", f"""WITH {panel_sql()}
SELECT series_id, ts, {', '.join(f"{g} / {K.MOLAR_MASS[g] / K.MOLAR_VOLUME!r}e0 AS {g}_ppb" for g in GASES)},
  pm10 / {K.MOLAR_MASS['co2'] / K.MOLAR_VOLUME!r}e0 AS co2_ppb FROM panel""",
       [f"{g}_ppb" for g in (*GASES, "co2")])
def _(spark, d):
    p = hourly_panel(spark, d)
    return p.select("series_id", "ts", *[A.to_ppb(F.col(g), g).alias(f"{g}_ppb") for g in GASES],
                    A.to_ppb(F.col("pm10"), "co2").alias("co2_ppb"))


@query("conv_wind", f"WITH {panel_sql()} SELECT series_id, ts, wind_speed * 3.6e0 AS wind_kmh FROM panel", ["wind_kmh"])
def _(spark, d):
    return hourly_panel(spark, d).select("series_id", "ts", A.to_kmh(F.col("wind_speed")).alias("wind_kmh"))


@query("aqi_pm25", f"WITH {panel_sql()} SELECT series_id, ts, {sql_aqi('pm2_5', 'pm2_5')} AS aqi FROM panel", ["aqi"])
def _(spark, d):
    p = hourly_panel(spark, d)
    return p.select("series_id", "ts", A.epa_aqi(F.col("pm2_5"), "pm2_5", "ug/m3").alias("aqi"))


@query("aqi_pm25_truncated", f"""WITH {panel_sql()}, cut AS (
  SELECT series_id, ts, floor(round(pm2_5 * 10, 6)) / 10e0 AS x FROM panel)
SELECT series_id, ts, {sql_aqi('x', 'pm2_5')} AS aqi FROM cut""", ["aqi"])
def _(spark, d):
    """Index on concentrations cut to the table's precision: no value falls between bands."""
    p = hourly_panel(spark, d)
    return p.select("series_id", "ts", A.epa_aqi(F.col("pm2_5"), "pm2_5", "ug/m3", truncate=True).alias("aqi"))


# Averaging windows (hours) of each pollutant's index; 1 = hourly value.
AVERAGING = {"pm2_5": 24, "pm10": 24, "co": 8, "so2": 1, "o3": 8, "no2": 1}


def _sub_indices(spark, d):
    g = gridded(spark, d).withColumn("co", F.col("co") / 10)
    rolled = rolling_mean(g, {f"_{p}": (p, n) for p, n in AVERAGING.items() if n > 1}, gap_free=True)
    source = {p: F.col(f"_{p}") if n > 1 else F.col(p) for p, n in AVERAGING.items()}
    return rolled.select(
        "series_id", "ts", *[A.epa_aqi(c, p, K.TABLE_UNIT[p]).alias(f"aqi_{p}") for p, c in source.items()]
    )


def _sub_sql():
    roll = ", ".join(
        f"avg({'co / 10' if p == 'co' else p}) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING "
        f"AND CURRENT ROW) AS r_{p}" if n > 1 else f"{p} AS r_{p}"
        for p, n in AVERAGING.items()
    )
    subs = ", ".join(f"{sql_aqi(f'r_{p}', p)} AS aqi_{p}" for p in AVERAGING)
    return grid_sql() + f""",
rolls AS (SELECT series_id, ts, {roll} FROM grid),
subs AS (SELECT series_id, ts, {subs} FROM rolls)"""


SUBS = [f"aqi_{p}" for p in AVERAGING]


@query("aqi_all_pollutants", f"WITH {_sub_sql()} SELECT * FROM subs", SUBS)
def _(spark, d):
    return _sub_indices(spark, d)


@query("aqi_overall", f"WITH {_sub_sql()} SELECT series_id, ts, greatest({', '.join(SUBS)}) AS aqi FROM subs", ["aqi"])
def _(spark, d):
    return _sub_indices(spark, d).select("series_id", "ts", A.overall_aqi([F.col(c) for c in SUBS]).alias("aqi"))


@query("aqi_dominant", f"""WITH {_sub_sql()}
SELECT series_id, ts, CASE {' '.join(f"WHEN {c} = greatest({', '.join(SUBS)}) THEN '{c[4:]}'" for c in SUBS)} END AS dominant
FROM subs""")
def _(spark, d):
    return _sub_indices(spark, d).select(
        "series_id", "ts", A.dominant_pollutant({c[4:]: F.col(c) for c in SUBS}).alias("dominant"))


@query("aqi_range_join", f"WITH {panel_sql()} SELECT series_id, ts, pm10, {sql_aqi('pm10', 'pm10')} AS aqi FROM panel",
       ["pm10", "aqi"])
def _(spark, d):
    p = hourly_panel(spark, d).select("series_id", "ts", "pm10")
    return A.join_breakpoints(p, "pm10", "pm10").select("series_id", "ts", "pm10", "aqi")


@query("feat_calendar", f"""WITH {panel_sql()}
SELECT series_id, ts, hour(ts) AS hour, isodow(ts) - 1 AS day_of_week, day(ts) AS day, isodow(ts) - 1 AS weekday,
  month(ts) AS month, quarter(ts) AS quarter, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend,
  (month(ts) % 12) // 3 + 1 AS season FROM panel""")
def _(spark, d):
    return hourly_panel(spark, d).select("series_id", "ts", *TF.calendar_features(F.col("ts")))


@query("feat_calendar_orders", """
SELECT o_orderkey, hour(o_orderdate) AS hour, isodow(o_orderdate) - 1 AS day_of_week, day(o_orderdate) AS day,
  isodow(o_orderdate) - 1 AS weekday, month(o_orderdate) AS month, quarter(o_orderdate) AS quarter,
  CASE WHEN isodow(o_orderdate) >= 6 THEN 1 ELSE 0 END AS is_weekend, (month(o_orderdate) % 12) // 3 + 1 AS season
FROM orders""")
def _(spark, d):
    """Calendar features over all months of the year (the events cover one month only)."""
    return table(spark, d, "orders", "o_orderkey", "o_orderdate").select(
        "o_orderkey", *TF.calendar_features(F.col("o_orderdate")))


_CYC = """sin(hour(ts) * 2 * pi() / 24) AS hour_sin, cos(hour(ts) * 2 * pi() / 24) AS hour_cos,
  sin((isodow(ts) - 1) * 2 * pi() / 7) AS day_sin, cos((isodow(ts) - 1) * 2 * pi() / 7) AS day_cos,
  cos(month(ts) * 2 * pi() / 12) AS month_cos"""


@query("feat_cyclic", f"WITH {panel_sql()} SELECT series_id, ts, {_CYC} FROM panel",
       ["hour_sin", "hour_cos", "day_sin", "day_cos", "month_cos"])
def _(spark, d):
    return hourly_panel(spark, d).select("series_id", "ts", *TF.cyclic_features(F.col("ts")))


@query("feat_interaction", f"""WITH {panel_sql()}
SELECT series_id, ts, temperature * humidity / 100 AS temp_humidity_interaction,
  wind_speed * cos(radians(wind_direction)) AS wind_u, wind_speed * sin(radians(wind_direction)) AS wind_v,
  pm2_5 / (pm10 + 1e-6) AS pm25_pm10_ratio FROM panel""",
       ["temp_humidity_interaction", "wind_u", "wind_v", "pm25_pm10_ratio"])
def _(spark, d):
    p = hourly_panel(spark, d)
    return p.select("series_id", "ts", *TF.interaction_features(p.columns))


@query("clean_coerce", """SELECT event_id,
  CASE WHEN value > 100 OR value < 5 OR event_type = 'error' THEN 0e0 ELSE value END AS value FROM events""", ["value"])
def _(spark, d):
    ev = table(spark, d, "events", "event_id", "event_type", "value")
    text = (
        F.when(F.col("value") > 100, "bad").when(F.col("value") < 5, "Infinity").when(F.col("event_type") == "error", None)
        .otherwise(F.col("value").cast("string"))
    )
    return C.coerce_numeric(ev.select("event_id", text.alias("value")), ["value"])


@query("fmt_ts", """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS date_str, strftime(ts, '%Y-%m-%d %H:%M') AS minute_str,
  ts::DATE AS day FROM events""")
def _(spark, d):
    t = F.col("ts")
    return table(spark, d, "events", "event_id", "ts").select(
        "event_id", TF.format_seconds(t).alias("date_str"), TF.format_minutes(t).alias("minute_str"), F.to_date(t).alias("day"))


@query("risk_strict", f"""WITH {aqi_grid_sql()}
SELECT series_id, ts, {sql_strict('aqi')} AS risk_level, {sql_strict('aqi', 3)} AS risk_class FROM aqi_grid""")
def _(spark, d):
    a = F.col("aqi")
    return aqi_grid(spark, d).select("series_id", "ts", A.risk_level_strict(a).alias("risk_level"),
                                     A.risk_class_strict(a).alias("risk_class"))


@query("risk_band", f"""SELECT event_id, {sql_bands('value', K.RISK_BANDS, 1)} AS label,
  {sql_bands('value', K.RISK_BANDS, 2)} AS advice FROM events""")
def _(spark, d):
    v = F.col("value")
    return table(spark, d, "events", "event_id", "value").select(
        "event_id", A.risk_band(v).alias("label"), A.risk_advice(v).alias("advice"))


@query("status_band", f"""SELECT event_id, {sql_bands('value', K.STATUS_BANDS, 1)} AS status,
  {sql_bands('value', K.STATUS_BANDS, 2)} AS description FROM events""")
def _(spark, d):
    v = F.col("value")
    return table(spark, d, "events", "event_id", "value").select(
        "event_id", A.status_band(v).alias("status"), A.status_text(v).alias("description"))


@query("risk_score", f"""SELECT l_orderkey, l_linenumber, {sql_bands('l_quantity / 6', K.RISK_SCORES, 1)} AS level,
  {sql_bands('l_quantity / 6', K.RISK_SCORES, 3)} AS severity FROM lineitem""")
def _(spark, d):
    s = F.col("l_quantity") / 6
    return table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").select(
        "l_orderkey", "l_linenumber", A.risk_score_level(s).alias("level"), A.risk_score_severity(s).alias("severity"))


FEATURES = ("aqi", "temperature", "humidity", "wind_speed", "so2", "o3", "pressure")


@query("fill_defaults", f"""WITH {aqi_grid_sql('station')}
SELECT series_id, ts, coalesce(aqi, 50) AS aqi, coalesce(temperature, 25) AS temperature, coalesce(humidity, 60) AS humidity,
  coalesce(wind_speed, 5) AS wind_speed, coalesce(so2, 10) AS so2, coalesce(o3, 10) AS o3, 0e0 AS pressure FROM aqi_grid""",
       FEATURES)
def _(spark, d):
    g = aqi_grid(spark, d, "station").select("series_id", "ts", *FEATURES[:-1])
    return C.fill_defaults(g, FEATURES)


@query("default_by_name", """WITH names AS (SELECT DISTINCT event_type || '_' || nm AS feature FROM events, (VALUES
  ('aqi_lag'), ('Temp_x'), ('humidity'), ('wind_u'), ('PM10'), ('hour')) v(nm))
SELECT feature, CASE WHEN lower(feature) LIKE '%aqi%' THEN 50e0 WHEN lower(feature) LIKE '%temp%' THEN 25e0
  WHEN lower(feature) LIKE '%humidity%' THEN 60e0 WHEN lower(feature) LIKE '%wind%' THEN 5e0
  WHEN regexp_matches(lower(feature), 'pm25|pm10|o3|no2|so2|co') THEN 10e0 ELSE 0e0 END AS default_value FROM names""",
       ["default_value"])
def _(spark, d):
    """Defaults for feature names held in a table."""
    parts = F.explode(F.array(*[F.lit(x) for x in ("aqi_lag", "Temp_x", "humidity", "wind_u", "PM10", "hour")]))
    kinds = table(spark, d, "events", "event_type").distinct()
    named = kinds.select("event_type", parts.alias("nm")).select(F.concat_ws("_", "event_type", "nm").alias("feature"))
    return named.select("feature", N.default_value(F.col("feature")).alias("default_value"))


@query("forecast_labels", f"""WITH {persistence_sql()}
SELECT series_id, ts, regexp_extract(model, '(\\d+)h', 1)::INT AS hours,
  CASE model WHEN 'persist_24h' THEN 'Today' WHEN 'persist_48h' THEN 'Tomorrow' ELSE 'Day After Tomorrow' END AS label,
  strftime(ts + regexp_extract(model, '(\\d+)h', 1)::INT * INTERVAL 1 HOUR, '%Y-%m-%d') AS forecast_date FROM preds""")
def _(spark, d):
    h = F.regexp_extract("model", r"(\d+)h", 1).cast("int")
    return persistence(spark, d).select("series_id", "ts", h.alias("hours")).select(
        "series_id", "ts", "hours", TF.horizon_label(F.col("hours")).alias("label"),
        TF.horizon_date(F.col("ts"), F.col("hours")).alias("forecast_date"))


_NAMES_SQL = """catalog AS (SELECT DISTINCT 'c' || o_custkey AS owner,
  CASE WHEN l_linenumber = 7 THEN 'season' ELSE 'aqi_rolling_std_' || (24 * l_linenumber) || 'h_lag' || (o_orderkey % 100)
    || 'h' END AS feature FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query("regex_max_window", f"""WITH {_NAMES_SQL}
SELECT owner, max(coalesce(list_max(regexp_extract_all(feature, '(\\d+)h', 1)::INT[]), 0)) AS max_window
FROM catalog GROUP BY 1""")
def _(spark, d):
    """Largest window named in each owner's feature catalog."""
    rows = table(spark, d, "lineitem", "l_orderkey", "l_linenumber").join(
        table(spark, d, "orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    name = F.when(F.col("l_linenumber") == 7, "season").otherwise(
        F.concat(F.lit("aqi_rolling_std_"), F.col("l_linenumber") * 24, F.lit("h_lag"), F.col("o_orderkey") % 100, F.lit("h")))
    catalog = rows.select(F.concat(F.lit("c"), "o_custkey").alias("owner"), name.alias("feature"))
    return catalog.groupBy("owner").agg(F.max(N.max_window(F.col("feature"))).alias("max_window"))


def sql_best_model(x: str) -> str:
    found = "coalesce(" + ", ".join(f"nullif(regexp_extract({x}, '{p}', 1, 'i'), '')" for p in K.BEST_MODEL_PATTERNS) + ")"
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.CANONICAL_MODELS.items())
    return f"(CASE lower({found}) {arms} ELSE {found} END)"


@query("regex_best_model", f"""WITH {REGISTRY_SQL}
SELECT version, {sql_best_model('description')} AS model_type FROM registry""")
def _(spark, d):
    return registry(spark, d).select("version", N.parse_best_model(F.col("description")).alias("model_type"))


@query("enc_label", """WITH labels AS (SELECT p_type AS t, row_number() OVER (ORDER BY p_type) - 1 AS code
  FROM (SELECT DISTINCT p_type FROM part))
SELECT p_partkey, p_type, code AS type_code FROM part JOIN labels ON t = p_type""")
def _(spark, d):
    return encode_label(table(spark, d, "part", "p_partkey", "p_type"), "p_type", "type_code")


@query("scale_minmax", f"""WITH {grid_sql('station')}
SELECT series_id, ts, {', '.join(f"CASE WHEN max({c}) OVER s > min({c}) OVER s THEN ({c} - min({c}) OVER s) / (max({c}) OVER s - min({c}) OVER s) WHEN {c} IS NOT NULL THEN 0 END AS {c}" for c in BASE)}
FROM grid WINDOW s AS (PARTITION BY series_id)""", BASE)
def _(spark, d):
    g = gridded(spark, d, "station").select("series_id", "ts", *BASE)
    return V.minmax_scale(g, BASE, ["series_id"])


@query("filter_city", f"WITH {readings_sql()} SELECT city, ts, aqi FROM readings WHERE lower(city) = lower('CLICK')", ["aqi"])
def _(spark, d):
    return V.filter_city(readings(spark, d).select("city", "ts", "aqi"), "CLICK", must_exist=True)


@query("recs_join", f"""WITH {readings_sql()}, recs AS (SELECT * FROM (VALUES
  {', '.join("(%d, %d, '%s', '%s')" % (u or -1, i, t.replace("'", "''"), x.replace("'", "''")) for u, rs in K.RECOMMENDATIONS for i, (t, x) in enumerate(rs, 1))}
  ) v(band, rec_no, title, advice))
SELECT city, ts, rec_no, title, advice FROM readings JOIN recs
  ON band = CASE WHEN aqi <= 50 THEN 50 WHEN aqi <= 100 THEN 100 WHEN aqi <= 150 THEN 150 WHEN aqi > 150 THEN -1 END""")
def _(spark, d):
    return A.join_recommendations(readings(spark, d).select("city", "ts", "aqi"), "aqi").drop("aqi")
