"""Queries: scans, sources, sinks, set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hazegrid.catalog.base import (
    REGISTRY,
    MODELS, aqi_grid, aqi_grid_sql, grid_sql, gridded, hourly_panel, panel_sql, persistence, persistence_sql,
    query, readings, readings_sql, table,
)
from hazegrid.operators.serve import labeled
from hazegrid.session import scratch_dir
from hazegrid.sources import hourly as H
from hazegrid.sources import stores as S



@query("src_explode_arrays", f"WITH {grid_sql()} SELECT series_id, ts, pm2_5, pm10, temperature FROM grid",
       ["pm2_5", "pm10", "temperature"])
def _(spark, d):
    """Daily API responses (24 values per variable) unfolded to hours."""
    cell = F.struct("ts", "pm2_5", "pm10", "temperature")
    g = gridded(spark, d)
    day = g.groupBy("series_id", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    landed = day.select(
        "series_id",
        F.unix_seconds(F.col("cells")[0]["ts"]).alias("start"),
        (F.unix_seconds(F.col("cells")[0]["ts"]) + F.size("cells") * 3600).alias("end"),
        F.lit(3600).alias("interval_s"),
        *[F.col("cells")[n].alias(n) for n in ("pm2_5", "pm10", "temperature")],
    )
    return H.explode_hourly_response(landed, ["pm2_5", "pm10", "temperature"])


@query("src_csv_mixed_ts", f"""WITH {readings_sql()}
SELECT city, CASE WHEN hour(ts) < 18 THEN ts END AS ts, CASE WHEN hour(ts) < 22 THEN aqi END AS aqi, temperature
FROM readings""", ["aqi", "temperature"])
def _(spark, d):
    """Readings written as CSV with mixed timestamp layouts and bad cells, read back typed."""
    hour = F.hour("ts")
    text = (
        F.when(hour < 6, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(hour < 12, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
        .when(hour < 18, F.date_format("ts", "yyyy-MM-dd HH:mm"))
        .otherwise("not a time")
    )
    r = readings(spark, d)
    path = f"{scratch_dir(spark)}/readings-{uuid.uuid4().hex}"
    S.write_csv(r.select("city", text.alias("timestamp"), F.when(hour < 22, F.col("aqi").cast("string"))
                         .otherwise("n/a").alias("aqi"), "temperature"), path)
    back = S.read_readings_csv(spark, path, ["aqi", "temperature"])
    return back.select("city", F.col("timestamp").alias("ts"), "aqi", "temperature")


@query("src_csv_reordered", f"""WITH {readings_sql()}
SELECT city, ts, aqi, temperature FROM readings""", ["aqi", "temperature"])
def _(spark, d):
    """Two deliveries whose files name the same columns in another order."""
    r = readings(spark, d).select("city", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "aqi", "temperature")
    path = f"{scratch_dir(spark)}/readings-{uuid.uuid4().hex}"
    early = F.hour("timestamp") < 12
    S.write_csv(r.where(early), path)
    S.write_csv(r.where(~early).select("temperature", "aqi", "timestamp", "city"), path, mode="append")
    back = S.read_readings_csv(spark, path, ["aqi", "temperature"])
    return back.select("city", F.col("timestamp").alias("ts"), "aqi", "temperature")


@query("snk_upsert_store", """
WITH d AS (
  SELECT o_orderkey, o_totalprice, CASE WHEN o_orderstatus <> 'P' THEN year(o_orderdate) END AS part, 1 AS delivery FROM orders
  UNION ALL SELECT o_orderkey, o_totalprice + 1, CASE WHEN o_orderkey % 5 <> 0 THEN 2020 + o_orderkey % 3 END, 2 FROM orders WHERE o_orderkey % 4 = 0)
SELECT o_orderkey, o_totalprice, part FROM d QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY delivery DESC) = 1""", ["o_totalprice"])
def _(spark, d):
    """A store in files: the second delivery moves keys to other partitions, some to the null one."""
    o = table(spark, d, "orders", "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate")
    path = f"{scratch_dir(spark)}/store-{uuid.uuid4().hex}"
    first = o.select("o_orderkey", "o_totalprice", F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate")).alias("part"))
    key = F.col("o_orderkey")
    second = o.where(key % 4 == 0).select(key, (F.col("o_totalprice") + 1).alias("o_totalprice"), F.when(key % 5 != 0, (2020 + key % 3).cast("int")).alias("part"))
    for delivery in (first, second):
        S.upsert_parquet(spark, path, delivery, ["o_orderkey"], "part")
    return spark.read.parquet(path).select("o_orderkey", "o_totalprice", "part")


@query("grid_hourly", f"WITH {grid_sql('station')} SELECT series_id, ts, pm2_5 FROM grid", ["pm2_5"])
def _(spark, d):
    return gridded(spark, d, "station").select("series_id", "ts", "pm2_5")


@query("grid_hourly_per_series", f"""WITH {panel_sql('station')},
span AS (SELECT series_id, min(ts) AS lo, max(ts) AS hi FROM panel GROUP BY 1),
axis AS (SELECT series_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM span)
SELECT a.series_id, a.ts, p.pm2_5 FROM axis a LEFT JOIN panel p ON p.series_id = a.series_id AND p.ts = a.ts""", ["pm2_5"])
def _(spark, d):
    panel = hourly_panel(spark, d, "station").select("series_id", "ts", "pm2_5")
    return H.hourly_grid(panel, per_series=True)


@query("filter_lookback", f"""WITH {panel_sql()}, now AS (SELECT max(ts)::DATE AS d FROM panel)
SELECT series_id, ts, pm2_5 FROM panel, now WHERE ts::DATE BETWEEN d - 14 AND d - 1""", ["pm2_5"])
def _(spark, d):
    """Collection range: the 14 days before the latest day."""
    from hazegrid.plans.attach import attach

    panel = hourly_panel(spark, d).select("series_id", "ts", "pm2_5")
    tagged = attach(panel, panel.agg(F.to_date(F.max("ts")).alias("_d")), [])
    return tagged.where(H.in_lookback(F.to_date("ts"), F.col("_d"), 14)).drop("_d")


FEEDS = ("click", "view", "error", "purchase", "signup")


def _first_of(column: str) -> str:
    return f"coalesce({', '.join(f"max(CASE WHEN series_id = '{s}' THEN {column} END)" for s in FEEDS)})"


@query("src_priority_merge", f"""WITH {panel_sql()}
SELECT ts, {_first_of('so2')} AS so2, {_first_of('pm2_5')} AS pm2_5,
  min(CASE series_id {' '.join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(FEEDS))} END) AS source_rank
FROM panel GROUP BY ts""", ["so2", "pm2_5"])
def _(spark, d):
    """All feeds in order of trust: per hour and column the first that has a value."""
    p = hourly_panel(spark, d)
    return S.priority_merge([p.where(F.col("series_id") == s) for s in FEEDS], ["ts"], ["so2", "pm2_5"])


_REVISED = """, latest AS (SELECT max(ts) AS hi FROM readings),
revised AS (SELECT city, ts, aqi + 1 AS aqi, pm25 FROM readings, latest WHERE ts >= hi - INTERVAL 7 DAY
  UNION ALL SELECT city, ts + INTERVAL 720 HOUR AS ts, aqi, pm25 FROM readings)"""


def _old_and_new(spark, d):
    """Stored readings; new delivery: the last week revised and a month of later hours."""
    from hazegrid.operators.serve import filter_last_days

    old = readings(spark, d).select("city", "ts", "aqi", "pm25")
    week = filter_last_days(old, 7).withColumn("aqi", F.col("aqi") + 1)
    return old, week.unionByName(old.withColumn("ts", F.col("ts") + F.expr("INTERVAL 720 HOURS")))


_KEEP = """SELECT city, ts, aqi, pm25 FROM (
  SELECT *, row_number() OVER (PARTITION BY city, ts ORDER BY src, aqi NULLS FIRST, pm25 NULLS FIRST) AS rn FROM (
    SELECT city, ts, aqi, pm25, {old} AS src FROM readings UNION ALL SELECT city, ts, aqi, pm25, {new} FROM revised))
WHERE rn = 1"""


@query("snk_upsert_latest", f"WITH {readings_sql()}{_REVISED} " + _KEEP.format(old=1, new=0), ["aqi", "pm25"])
def _(spark, d):
    old, new = _old_and_new(spark, d)
    return S.upsert_store(old, new, ["city", "ts"], keep="last")


@query("union_keep_first", f"WITH {readings_sql()}{_REVISED} " + _KEEP.format(old=0, new=1), ["aqi", "pm25"])
def _(spark, d):
    old, new = _old_and_new(spark, d)
    return S.union_pick([old, new], ["city", "ts"], "first")


@query("union_keep_last", f"WITH {readings_sql()}{_REVISED} " + _KEEP.format(old=1, new=0), ["aqi", "pm25"])
def _(spark, d):
    old, new = _old_and_new(spark, d)
    return S.union_pick([old, new], ["city", "ts"], "last")


@query("union_labeled", f"""WITH {readings_sql()}
SELECT city, ts, aqi, 'City ' || city AS city_label FROM readings""", ["aqi"])
def _(spark, d):
    """Every city's rows with its label, in one pass over the readings."""
    return labeled(readings(spark, d).select("city", "ts", "aqi"), "city", "City ")


@query("features_missing", """
SELECT 'c' || o_custkey AS owner, 'aqi_lag_' || (24 * l_linenumber) || 'h' AS feature
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
EXCEPT SELECT 'c' || o_custkey, 'aqi_lag_' || (24 * l_linenumber) || 'h'
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'""")
def _(spark, d):
    """Features each customer's rows call for, less those its returned rows provide."""
    rows = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag").join(
        table(spark, d, "orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    named = rows.select(F.concat(F.lit("c"), "o_custkey").alias("owner"), "l_returnflag",
                        F.concat(F.lit("aqi_lag_"), F.col("l_linenumber") * 24, F.lit("h")).alias("feature"))
    return S.missing_features(named, named.where(F.col("l_returnflag") == "R"), "owner", "feature")


@query("snap_tail72", f"""WITH {aqi_grid_sql('station')}
SELECT series_id, ts, aqi, pm2_5, temperature FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS rn FROM aqi_grid) WHERE rn <= 72""",
       ["aqi", "pm2_5", "temperature"])
def _(spark, d):
    return S.snapshot_tail(aqi_grid(spark, d, "station"), ["series_id"], ["aqi", "pm2_5", "temperature", "not_there"])


@query("summary_dataset", f"""WITH {readings_sql('station')}
SELECT count(*) AS total_records, count(DISTINCT city) AS cities,
  (SELECT string_agg(city, ',' ORDER BY city) FROM (SELECT DISTINCT city FROM readings)) AS city_names,
  min(ts) AS start_ts, max(ts) AS end_ts FROM readings""")
def _(spark, d):
    return S.dataset_summary(readings(spark, d, "station"))


@query("pred_export_wide", f"""WITH {persistence_sql()}
SELECT series_id, ts, {', '.join(f"max(CASE WHEN model = '{m}' THEN yhat END) AS {m}" for m in MODELS)}
FROM preds GROUP BY 1, 2""", MODELS)
def _(spark, d):
    return S.export_predictions(persistence(spark, d), MODELS, ["series_id", "ts"])


@query("pred_export_metadata", f"""WITH {persistence_sql()}
SELECT '{{"horizon_hours":24,"model_names":["persist_24h","persist_48h","persist_72h"],"prediction_count":'
  || (SELECT count(*) FROM (SELECT DISTINCT series_id, ts FROM preds))
  || ',"prediction_summary":{{"models_used":3,"ensemble_models":0,"individual_models":3}}}}' AS metadata""")
def _(spark, d):
    return S.export_metadata(persistence(spark, d), MODELS, [], 24)


@query("dedup_exact", """
SELECT DISTINCT event_type AS series_id, date_trunc('hour', ts) AS ts, floor(value)::BIGINT AS level FROM events""")
def _(spark, d):
    from hazegrid.operators.clean import dedup_rows

    ev = table(spark, d, "events", "event_type", "ts", "value")
    return dedup_rows(ev.select(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").alias("ts"),
                                F.floor("value").alias("level")))


@query("dedup_by_values", f"""WITH {panel_sql('station')}
SELECT min(ts) AS ts, arg_min(series_id, (ts, series_id)) AS series_id, pm10, temperature, wind_speed FROM panel
GROUP BY pm10, temperature, wind_speed""", ["pm10", "temperature", "wind_speed"])
def _(spark, d):
    """Duplicates on the value columns only, the earliest row kept."""
    from hazegrid.operators.clean import dedup_rows

    p = hourly_panel(spark, d, "station").select("series_id", "ts", "pm10", "temperature", "wind_speed")
    return dedup_rows(p, by_values=True)


@query("join_weather_air", f"""WITH {panel_sql()},
air AS (SELECT series_id, ts, pm2_5, so2 FROM panel WHERE so2 IS NOT NULL),
weather AS (SELECT series_id, ts, temperature, humidity FROM panel WHERE temperature > 12)
SELECT w.series_id, w.ts, temperature, humidity, pm2_5, so2 FROM weather w JOIN air a
  ON a.series_id = w.series_id AND a.ts = w.ts""", ["temperature", "humidity", "pm2_5", "so2"])
def _(spark, d):
    p = hourly_panel(spark, d)
    air = p.where(F.col("so2").isNotNull()).select("series_id", "ts", "pm2_5", "so2")
    weather = p.where(F.col("temperature") > 12).select("series_id", "ts", "temperature", "humidity")
    return H.join_sources(weather, air)




@query("join_bucketed", REGISTRY["join_weather_air"].sql)
def _(spark, d):
    """The same join of two sources that are stored in buckets of (series, hour)."""
    base = f"{scratch_dir(spark)}/buckets-{uuid.uuid4().hex}"
    p = hourly_panel(spark, d)
    for name, rows in (("air", p.where(F.col("so2").isNotNull()).select("series_id", "ts", "pm2_5", "so2")),
                       ("weather", p.where(F.col("temperature") > 12).select("series_id", "ts", "temperature", "humidity"))):
        S.write_bucketed(rows, f"hazegrid_{name}", f"{base}/{name}", buckets=8)
    return H.join_sources(spark.table("hazegrid_weather"), spark.table("hazegrid_air"))


@query("schema_aligned", f"WITH {panel_sql()} SELECT series_id, ts, pm2_5, so2 FROM panel", ["pm2_5", "so2"])
def _(spark, d):
    """Columns under other spellings, brought to the names and the columns a store knows."""
    p = hourly_panel(spark, d).select(F.col("series_id").alias("Series.ID"), F.col("ts").alias("TS"), F.col("pm2_5").alias("PM2.5"), F.col("so2").alias("SO2"), "humidity")
    named = S.normalize_columns(p, {"series_id": "series_id", "pm2_5": "pm2_5"})
    S.require_columns(named, ["series_id", "ts"])
    return S.align_schema(named, ["series_id", "ts", "pm2_5", "so2"])[0]
