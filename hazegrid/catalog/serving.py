"""Queries: serving tables, statistics, rankings, forecasts curves, alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazegrid import constants as K
from hazegrid.catalog.base import (
    REGISTRY_SQL, persistence, persistence_sql, query, readings, readings_sql, registry, stored, sql_bands, sql_strict, table,
)
from hazegrid.catalog.scalars import sql_best_model
from hazegrid.operators import evaluate as E
from hazegrid.operators import serve as V
from hazegrid.streaming import alerts as AL

R = readings_sql()
RS = readings_sql("station")


@query("locations_latest", f"""WITH {R} SELECT city, state, country, aqi AS current_aqi,
  strftime(ts, '%Y-%m-%d %H:%M') AS last_updated
FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY ts DESC) AS rn FROM readings) WHERE rn = 1""", ["current_aqi"])
def _(spark, d):
    return V.locations(readings(spark, d))


def _historical_sql(days: int) -> str:
    cols = ", ".join(
        f"coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY city ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
        f"first_value({c} IGNORE NULLS) OVER (PARTITION BY city ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}"
        for c in K.HISTORY_COLUMNS)
    return f"SELECT city, ts, {cols} FROM readings WHERE ts >= (SELECT max(ts) FROM readings) - INTERVAL {days} DAY"


@query("historical_city", f"WITH {R} SELECT * FROM ({_historical_sql(7)}) WHERE lower(city) = 'view'", K.HISTORY_COLUMNS)
def _(spark, d):
    return V.historical(readings(spark, d), "View", 7)


@query("historical_all_cities", f"WITH {RS} {_historical_sql(21)}", K.HISTORY_COLUMNS)
def _(spark, d):
    return V.historical(readings(spark, d, "station"), None, 21)


_OVERVIEW = f"""now AS (SELECT max(ts) AS hi FROM readings),
agg AS (SELECT city, arg_max_null(aqi, ts) AS current_aqi, max(ts) AS t,
    avg(CASE WHEN ts >= hi - INTERVAL 7 DAY THEN aqi END) AS w0,
    avg(CASE WHEN ts >= hi - INTERVAL 14 DAY AND ts < hi - INTERVAL 7 DAY THEN aqi END) AS o0
  FROM readings, now GROUP BY 1),
fill AS (SELECT city, current_aqi, t, coalesce(w0, current_aqi) AS w, coalesce(o0, w0, current_aqi) AS o FROM agg),
overview AS (SELECT city, current_aqi, {sql_strict('current_aqi')} AS current_risk_level, round(w, 2) AS weekly_avg,
  CASE WHEN w < o * 0.9e0 THEN 'improving' WHEN w > o * 1.1e0 THEN 'worsening' ELSE 'stable' END AS trend_direction,
  strftime(t, '%Y-%m-%d %H:%M') AS last_updated FROM fill)"""


@query("overview_city", f"WITH {R}, {_OVERVIEW} SELECT * FROM overview", ["current_aqi", "weekly_avg"])
def _(spark, d):
    return V.overview(readings(spark, d))


@query("overview_stations", f"WITH {RS}, {_OVERVIEW} SELECT * FROM overview", ["current_aqi", "weekly_avg"])
def _(spark, d):
    return V.overview(readings(spark, d, "station"))


@query("city_stats", f"""WITH {R}, dd AS (SELECT *, aqi - lag(aqi) OVER (PARTITION BY city ORDER BY ts) AS dv FROM readings),
h AS (SELECT city, avg(aqi) AS mean_aqi, max(aqi) AS max_aqi, min(aqi) AS min_aqi, stddev_samp(aqi) AS std_aqi,
  count_if(aqi > 100) AS hours_over_100, count_if(aqi > 150) AS hours_over_150, count_if(dv < 0) AS improving_steps,
  count_if(dv > 0) AS worsening_steps, avg(dv) AS mean_change FROM dd GROUP BY 1),
days AS (SELECT city, ts::DATE AS day, avg(aqi) AS m FROM readings GROUP BY 1, 2),
dc AS (SELECT city, count_if(m > 100) AS days_over_100, count_if(m > 150) AS days_over_150 FROM days GROUP BY 1)
SELECT h.*, days_over_100, days_over_150 FROM h JOIN dc USING (city)""",
       ["mean_aqi", "max_aqi", "min_aqi", "std_aqi", "mean_change"])
def _(spark, d):
    return V.city_stats(readings(spark, d), gap_free=True)


@query("daily_mean", f"WITH {RS} SELECT city, ts::DATE AS day, avg(aqi) AS daily_aqi FROM readings GROUP BY 1, 2", ["daily_aqi"])
def _(spark, d):
    return V.daily_mean(readings(spark, d, "station"))


@query("report_best_worst", f"""WITH {RS}, m AS (SELECT city, avg(aqi) AS m FROM readings GROUP BY 1 HAVING avg(aqi) IS NOT NULL)
SELECT (SELECT city FROM m ORDER BY m, city LIMIT 1) AS best_city, min(m) AS best_mean_aqi,
  (SELECT city FROM m ORDER BY m DESC, city LIMIT 1) AS worst_city, max(m) AS worst_mean_aqi, count(*) AS cities FROM m""",
       ["best_mean_aqi", "worst_mean_aqi"])
def _(spark, d):
    return V.report_insights(readings(spark, d, "station"))


_LATEST = """latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY ts DESC) AS rn FROM readings) WHERE rn = 1)"""


@query("quick_stats", f"""WITH {RS}, {_LATEST}
SELECT (SELECT city FROM latest WHERE aqi IS NOT NULL ORDER BY aqi, city LIMIT 1) AS best_city, min(aqi) AS best_aqi,
  (SELECT city FROM latest WHERE aqi IS NOT NULL ORDER BY aqi DESC, city LIMIT 1) AS worst_city, max(aqi) AS worst_aqi,
  count(*) AS cities_monitored FROM latest""", ["best_aqi", "worst_aqi"])
def _(spark, d):
    return V.quick_stats(readings(spark, d, "station"))


_RANK = """ranked AS (SELECT *, row_number() OVER (ORDER BY current_aqi NULLS LAST, city) AS rank FROM overview),
medals AS (SELECT *, CASE rank WHEN 1 THEN 'gold' WHEN 2 THEN 'silver' WHEN 3 THEN 'bronze' END AS medal,
  CASE rank WHEN 1 THEN 'Best Air Quality' WHEN 2 THEN 'Moderate Quality' WHEN 3 THEN 'Needs Attention' END AS title FROM ranked)"""


@query("city_ranking", f"WITH {RS}, {_OVERVIEW}, {_RANK} SELECT city, current_aqi, rank, medal, title FROM medals", ["current_aqi"])
def _(spark, d):
    o = V.overview(readings(spark, d, "station")).select("city", "current_aqi")
    return V.rank_cities(o)


def _coords(spark, d):
    """Coordinates per city, derived from its event keys."""
    ev = table(spark, d, "events", "event_type", "user_id", "event_id")
    return ev.groupBy(F.col("event_type").alias("city")).agg(
        (F.min("user_id") + F.count(F.lit(1)) % 90).cast("double").alias("lat"), (F.max("event_id") % 180).cast("double").alias("lon"))


_COORDS = """coords AS (SELECT event_type AS city, (min(user_id) + count(*) % 90)::DOUBLE AS lat, (max(event_id) % 180)::DOUBLE AS lon
  FROM events GROUP BY 1)"""


@query("city_map_rows", f"""WITH {R}, {_OVERVIEW}, {_COORDS}
SELECT city, current_aqi AS aqi, current_risk_level AS risk_level, weekly_avg, trend_direction AS trend, lat, lon
FROM overview LEFT JOIN coords USING (city)""", ["aqi", "weekly_avg", "lat", "lon"])
def _(spark, d):
    o = V.join_city_dim(V.overview(readings(spark, d)), _coords(spark, d))
    return o.select("city", F.col("current_aqi").alias("aqi"), F.col("current_risk_level").alias("risk_level"), "weekly_avg",
                    F.col("trend_direction").alias("trend"), "lat", "lon")


@query("city_compare", f"""WITH {R}, {_OVERVIEW}, {_RANK}, {_COORDS}
SELECT medals.*, {sql_strict('current_aqi', 3)} AS aqi_class, lat, lon FROM medals LEFT JOIN coords USING (city)""",
       ["current_aqi", "weekly_avg", "lat", "lon"])
def _(spark, d):
    return V.city_compare(readings(spark, d), _coords(spark, d))


# --- forecast curves -------------------------------------------------------------------------


def _latest_points(spark, d, kind="station"):
    """Latest reading per city with persistence forecasts (the values 24, 48, 72 hours back)."""
    from hazegrid.plans.blocks import halo_window

    r = readings(spark, d, kind).select("city", "ts", "aqi")
    lagged = halo_window(r, ["city"], lambda w: [F.lag("aqi", h).over(w).alias(f"p{h}") for h in K.HORIZONS], before=72, gap_free=True)
    return V.latest_per_city(lagged)


def _curve(spark, d, n=72):
    return V.forecast_hourly(_latest_points(spark, d), {h: f"p{h}" for h in K.HORIZONS}, n)


_CURVE = f"""lagged AS (SELECT city, ts, aqi, {', '.join(f'lag(aqi, {h}) OVER (PARTITION BY city ORDER BY ts) AS p{h}' for h in K.HORIZONS)},
  row_number() OVER (PARTITION BY city ORDER BY ts DESC) AS rn FROM readings),
pts AS (SELECT city, ts, x, y FROM (SELECT city, ts, unnest([0, 24, 48, 72]) AS x, unnest([aqi, p24, p48, p72]) AS y FROM lagged
  WHERE rn = 1) WHERE y IS NOT NULL),
hrs AS (SELECT city, max(ts) AS ts, unnest(generate_series(1, 72)) AS h FROM lagged WHERE rn = 1 GROUP BY city),
seg AS (SELECT hrs.city, hrs.ts, h, (SELECT max(x) FROM pts WHERE pts.city = hrs.city AND x <= h) AS ax,
  (SELECT min(x) FROM pts WHERE pts.city = hrs.city AND x >= h) AS bx FROM hrs),
val AS (SELECT seg.*, a.y AS ay, b.y AS b_y FROM seg LEFT JOIN pts a ON a.city = seg.city AND a.x = ax
  LEFT JOIN pts b ON b.city = seg.city AND b.x = bx),
curve AS (SELECT city, ts + h * INTERVAL 1 HOUR AS forecast_ts, h AS horizon_hours,
  round(CASE WHEN bx IS NULL OR ax = bx THEN ay ELSE ay + (b_y - ay) / (bx - ax) * (h - ax) END, 2) AS predicted_aqi FROM val)"""


@query("forecast_hourly_interp", f"WITH {RS}, {_CURVE} SELECT *, {sql_strict('predicted_aqi')} AS risk_level FROM curve",
       ["predicted_aqi"])
def _(spark, d):
    return _curve(spark, d)


@query("forecast_next6", f"""WITH {RS}, {_CURVE} SELECT city, forecast_ts, horizon_hours, floor(predicted_aqi)::BIGINT AS aqi_shown,
  {sql_bands('predicted_aqi', K.RISK_BANDS, 1)} AS label FROM curve WHERE horizon_hours <= 6""")
def _(spark, d):
    return V.next_hours(_curve(spark, d))


@query("forecast_worst_hour", f"""WITH {RS}, {_CURVE}
SELECT city, predicted_aqi, horizon_hours, forecast_ts, {sql_bands('predicted_aqi', K.RISK_BANDS, 1)} AS label,
  {sql_bands('predicted_aqi', K.RISK_BANDS, 2)} AS advice
FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY predicted_aqi DESC NULLS LAST, horizon_hours) AS rn FROM curve)
WHERE rn = 1""", ["predicted_aqi"])
def _(spark, d):
    return V.worst_hour(_curve(spark, d))


# --- registry --------------------------------------------------------------------------------


@query("registry_latest", f"""WITH {REGISTRY_SQL}
SELECT workspace, name, version, tag, description, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY workspace, name
  ORDER BY CASE tag WHEN 'production' THEN 0 WHEN 'latest' THEN 1 ELSE 2 END, version DESC) AS rn FROM registry) WHERE rn = 1""")
def _(spark, d):
    return E.latest_model_version(registry(spark, d), ["workspace", "name"])


@query("registry_summary", f"""WITH {REGISTRY_SQL},
feats AS (SELECT name, count(DISTINCT l_suppkey) AS features_count FROM lineitem JOIN registry ON l_orderkey = version GROUP BY 1),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY workspace, name
  ORDER BY CASE tag WHEN 'production' THEN 0 WHEN 'latest' THEN 1 ELSE 2 END, version DESC) AS rn FROM registry) WHERE rn = 1),
typed AS (SELECT *, {sql_best_model('description')} AS model_type FROM best)
SELECT workspace, name, regexp_extract(name, '(\\d+)h', 1)::INT AS horizon, version, model_type,
  CASE model_type {' '.join(f"WHEN '{m}' THEN '{f}'" for m, f in K.MODEL_FORMATS.items())} ELSE 'pkl' END AS model_format,
  coalesce(features_count, 0) AS features_count, updated_at FROM typed LEFT JOIN feats USING (name)""")
def _(spark, d):
    reg = registry(spark, d)
    li = table(spark, d, "lineitem", "l_orderkey", "l_suppkey")
    feats = li.join(reg, F.col("l_orderkey") == F.col("version")).select("name", F.col("l_suppkey").alias("feature"))
    return E.registry_summary(reg, feats, ["workspace", "name"])


# --- scores and metrics ------------------------------------------------------------------------


_SCORES = """scores AS (SELECT l_returnflag AS model, 'supp_' || l_suppkey AS feature, l_linenumber AS fold,
  sum(round(l_discount * 100)::BIGINT)::DOUBLE / 100 AS score FROM lineitem GROUP BY 1, 2, 3)"""


def _scores(spark, d):
    """Importance-like scores: discounts per return flag (scorer), supplier (feature), line (fold)."""
    li = table(spark, d, "lineitem", "l_returnflag", "l_suppkey", "l_linenumber", "l_discount")
    return li.groupBy(F.col("l_returnflag").alias("model"), F.concat(F.lit("supp_"), F.col("l_suppkey")).alias("feature"),
                      F.col("l_linenumber").alias("fold")).agg(
        (F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).cast("double") / 100).alias("score"))


@query("topk_features", f"""WITH {_SCORES}, t AS (SELECT model, feature, sum(score) AS score FROM scores GROUP BY 1, 2)
SELECT model, feature, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(score, 6) DESC, feature) AS rank FROM t)
WHERE rank <= 10""", ["score"])
def _(spark, d):
    total = _scores(spark, d).groupBy("model", "feature").agg(F.round(F.sum("score"), 6).alias("score"))
    return E.top_k_features(total, 10)


@query("hybrid_scores", f"""WITH {_SCORES}, t AS (SELECT feature, round((sum(CASE WHEN model <> 'R' THEN score ELSE 0 END) / 7
  + sum(CASE WHEN model = 'R' THEN score ELSE 0 END) / 7) / 2, 9) AS hybrid_score, count(*) AS times_chosen FROM scores
  GROUP BY 1)
SELECT * FROM t ORDER BY hybrid_score DESC, feature LIMIT 15""", ["hybrid_score"])
def _(spark, d):
    s = _scores(spark, d)
    mi, rf = s.where(F.col("model") != "R"), s.where(F.col("model") == "R")
    return E.hybrid_scores(mi, rf, 7, 15)


_METRIC_COLS = ["rmse", "mae", "r2", "mse", "mape", "std", "mean"]


def metrics_sql(by: str, source: str) -> str:
    return f"""SELECT {by}, count(CASE WHEN ok THEN 1 END) AS n, count(*) AS size,
  sqrt(avg(CASE WHEN ok THEN (y - yhat) * (y - yhat) END)) AS rmse, avg(CASE WHEN ok THEN abs(y - yhat) END) AS mae,
  CASE WHEN var_pop(CASE WHEN ok THEN y END) > 0 THEN 1 - avg(CASE WHEN ok THEN (y - yhat) * (y - yhat) END) / var_pop(CASE WHEN ok THEN y END)
    WHEN avg(CASE WHEN ok THEN (y - yhat) * (y - yhat) END) = 0 THEN 1 ELSE 0 END AS r2,
  avg(CASE WHEN ok THEN (y - yhat) * (y - yhat) END) AS mse,
  avg(CASE WHEN ok AND y <> 0 THEN abs((y - yhat) / y) END) * 100 AS mape,
  stddev_pop(CASE WHEN ok THEN yhat END) AS std, avg(CASE WHEN ok THEN yhat END) AS mean
FROM (SELECT *, y IS NOT NULL AND yhat IS NOT NULL AS ok FROM {source}) GROUP BY {by}"""


_TRAIN, _TEST, _STEP = 336, 168, 48
_FOLDED = f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY series_id, model ORDER BY ts) - 1 AS row_idx,
  count(*) OVER (PARTITION BY series_id, model) AS n_rows FROM preds),
folded AS (SELECT model, series_id, ts, y, yhat, fold, CASE WHEN row_idx < fold * {_STEP} + {_TRAIN} THEN 'train' ELSE 'test' END AS split
  FROM (SELECT *, unnest(generate_series(0, (n_rows - {_TRAIN + _TEST}) // {_STEP})) AS fold FROM numbered WHERE n_rows >= {_TRAIN + _TEST})
  WHERE row_idx >= fold * {_STEP} AND row_idx < fold * {_STEP} + {_TRAIN + _TEST})"""


def _folded(spark, d):
    from hazegrid.operators.folds import assign_folds

    return assign_folds(persistence(spark, d), _TRAIN, _TEST, _STEP, keys=("series_id", "model"))


@query("metrics_by_fold", f"WITH {persistence_sql()}, {_FOLDED} {metrics_sql('model, fold, split', 'folded')}", _METRIC_COLS)
def _(spark, d):
    return E.regression_metrics(_folded(spark, d), ["model", "fold", "split"])


_GEN = f"""m AS ({metrics_sql('model, fold, split', 'folded')}),
spread AS (SELECT model, stddev_pop(yhat) AS std_pred FROM folded WHERE split = 'test' AND y IS NOT NULL AND yhat IS NOT NULL GROUP BY 1),
g AS (SELECT model, {', '.join(f"avg(CASE WHEN split = '{s}' THEN {k} END) AS avg_{s}_{k}" for s in ('train', 'test') for k in E.METRICS)},
  avg(CASE WHEN split = 'train' THEN size END) AS avg_train_size, arg_max(size, fold) FILTER (split = 'train') AS final_train_size
  FROM m GROUP BY 1),
gen AS (SELECT g.*, std_pred, std_pred > 3 AS std_check_passed, CASE WHEN std_pred > 3 THEN 'Good' ELSE 'Poor' END AS prediction_quality
  FROM g JOIN spread USING (model))"""


@query("metrics_generalization", f"WITH {persistence_sql()}, {_FOLDED}, {_GEN} SELECT * FROM gen",
       ["std_pred", "avg_train_size", *[f"avg_{s}_{k}" for s in ("train", "test") for k in E.METRICS]])
def _(spark, d):
    return E.generalization(E.regression_metrics(_folded(spark, d), ["model", "fold", "split"]))


@query("best_model", f"""WITH {persistence_sql('station')}, m AS ({metrics_sql('series_id, model', 'preds')})
SELECT series_id, model AS best_model, r2 AS best_r2 FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY r2 DESC,
  model DESC) AS rn FROM m WHERE r2 IS NOT NULL) WHERE rn = 1""", ["best_r2"])
def _(spark, d):
    m = E.regression_metrics(persistence(spark, d, "station"), ["series_id", "model"])
    return E.best_model(m, ["series_id"], ["persist_72h", "persist_48h", "persist_24h"], "r2")


@query("pred_summary", f"""WITH {persistence_sql('station')}
SELECT model, avg(yhat) AS mean_prediction, quantile_cont(yhat, 0.5) AS median_prediction, stddev_pop(yhat) AS std_prediction,
  min(yhat) AS min_prediction, max(yhat) AS max_prediction, quantile_cont(yhat, 0.25) AS q25_prediction,
  quantile_cont(yhat, 0.75) AS q75_prediction, count(yhat) AS prediction_count,
  CASE WHEN model = 'persist_72h' THEN 'ensemble' ELSE 'individual' END AS model_type FROM preds GROUP BY 1""",
       [f"{k}_prediction" for k in ("mean", "median", "std", "min", "max", "q25", "q75")])
def _(spark, d):
    return E.prediction_summary(stored(persistence(spark, d, "station")), ["persist_72h"])


@query("ensemble_mean", f"""WITH {persistence_sql('station')}
SELECT 'blend' AS model, series_id, ts, avg(yhat) AS yhat, count(DISTINCT model) AS members FROM preds
WHERE model IN ('persist_24h', 'persist_72h') AND yhat IS NOT NULL GROUP BY 2, 3 HAVING count(DISTINCT model) >= 2""", ["yhat"])
def _(spark, d):
    return E.ensemble_mean(persistence(spark, d, "station"), ["persist_24h", "persist_72h"], "blend", ["series_id", "ts"], 2)


@query("sample_rows", f"""WITH {RS}
SELECT city, ts, aqi FROM readings ORDER BY md5(city || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '|42'), city, ts LIMIT 1000""", ["aqi"])
def _(spark, d):
    return V.sample_rows(readings(spark, d, "station").select("city", "ts", "aqi"), 1000, ["city", "ts"])


# --- alerts ------------------------------------------------------------------------------------


def _alert_case(field):
    arms = " ".join(
        f"WHEN aqi >= {r[0]} THEN {r[field] if field == 4 else repr(r[field])}" for r in K.ALERT_LEVELS)
    return f"(CASE {arms} END)"


_ALERTS = f"""alerts AS (SELECT city || '@' || strftime(ts, '%Y%m%d%H%M%S') AS id, city, ts, {_alert_case(1)} AS type,
  {_alert_case(2)} AS title, city || ': AQI ' || round_even(aqi, 0)::BIGINT || ' - ' || {_alert_case(3)} AS message,
  {_alert_case(4)} AS duration_minutes, false AS dismissed, true AS is_hazardous FROM readings WHERE aqi >= 150)"""


@query("alerts_emit", f"WITH {RS}, {_ALERTS} SELECT * FROM alerts")
def _(spark, d):
    return AL.hazard_alerts(readings(spark, d, "station"))


@query("alerts_active", f"""WITH {RS}, {_ALERTS}, now AS (SELECT median_ts + INTERVAL 9 MINUTE AS t FROM (
  SELECT min(ts) + (max(ts) - min(ts)) / 2 AS median_raw, date_trunc('hour', min(ts) + (max(ts) - min(ts)) / 2) AS median_ts FROM readings))
SELECT alerts.* FROM alerts, now WHERE ts <= t AND t < ts + duration_minutes * INTERVAL 1 MINUTE
  AND id NOT IN (SELECT id FROM alerts WHERE city = 'st3')""")
def _(spark, d):
    """Alerts showing nine minutes after the middle hour; those of one place are dismissed."""
    from hazegrid.plans.attach import attach

    r = readings(spark, d, "station")
    a = AL.hazard_alerts(r)
    mid = F.date_trunc("hour", F.timestamp_seconds((F.unix_seconds(F.min("ts")) + F.unix_seconds(F.max("ts"))) / 2))
    now = r.agg((mid + F.expr("INTERVAL 9 MINUTES")).alias("_t"))
    return AL.active_alerts(attach(a, now, []), F.col("_t"), a.where(F.col("city") == "st3")).drop("_t")


@query("alerts_last_check", f"""WITH {RS}, {_LATEST}
SELECT city, ts AS checked_ts, aqi AS aqi_value, coalesce(aqi >= 150, false) AS is_hazardous, aqi IS NULL AS data_unavailable
FROM latest""", ["aqi_value"])
def _(spark, d):
    return AL.last_check(readings(spark, d, "station"))
