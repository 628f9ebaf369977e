"""Queries: row windows and feature tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazegrid import constants as K
from hazegrid.catalog.base import (
    BASE, DAILY_SQL, aqi_grid, aqi_grid_sql, daily_region, grid_sql, gridded, hourly_panel, panel_sql, query, table,
    targets_grid, targets_sql,
)
from hazegrid.operators import clean as C
from hazegrid.operators import folds as FO
from hazegrid.operators import windows as W

OVER = "OVER (PARTITION BY series_id ORDER BY ts"


def roll(fn: str, c: str, n: int, lag: int = 0, full: bool = False) -> str:
    frame = f"{OVER} ROWS BETWEEN {lag + n - 1} PRECEDING AND {lag} PRECEDING)"
    if lag == 0:
        frame = f"{OVER} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) {frame} = {n} THEN {fn}({c}) {frame} END" if full else f"{fn}({c}) {frame}"


@query("roll_mean_24h", f"""WITH {grid_sql('station')}
SELECT series_id, ts, {roll('avg', 'pm2_5', 24)} AS pm2_5_24h, {roll('avg', 'pm10', 24)} AS pm10_24h,
  {roll('avg', 'humidity', 24)} AS humidity_24h FROM grid""", ["pm2_5_24h", "pm10_24h", "humidity_24h"])
def _(spark, d):
    g = gridded(spark, d, "station").select("series_id", "ts", "pm2_5", "pm10", "humidity")
    return W.rolling_mean(g, {f"{c}_24h": (c, 24) for c in ("pm2_5", "pm10", "humidity")}, gap_free=True).drop("pm2_5", "pm10", "humidity")


@query("roll_mean_8h", f"""WITH {grid_sql('station')}
SELECT series_id, ts, {roll('avg', 'co', 8)} AS co_8h, {roll('avg', 'o3', 8)} AS o3_8h FROM grid""", ["co_8h", "o3_8h"])
def _(spark, d):
    g = gridded(spark, d, "station").select("series_id", "ts", "co", "o3")
    return W.rolling_mean(g, {"co_8h": ("co", 8), "o3_8h": ("o3", 8)}, gap_free=True).drop("co", "o3")


@query("roll_mean_rows_with_gaps", f"""WITH {panel_sql('station')}
SELECT series_id, ts, {roll('avg', 'pm2_5', 24)} AS pm2_5_24 FROM panel""", ["pm2_5_24"])
def _(spark, d):
    """Row windows on an axis with gaps: positions are counted first."""
    p = hourly_panel(spark, d, "station").select("series_id", "ts", "pm2_5")
    return W.rolling_mean(p, {"pm2_5_24": ("pm2_5", 24)}, gap_free=False).drop("pm2_5")


@query("roll_mean_by_time", f"""WITH {panel_sql('station')}
SELECT series_id, ts, avg(pm2_5) {OVER} RANGE BETWEEN INTERVAL 23 HOUR PRECEDING AND CURRENT ROW) AS pm2_5_24h FROM panel""",
       ["pm2_5_24h"])
def _(spark, d):
    p = hourly_panel(spark, d, "station").select("series_id", "ts", "pm2_5")
    return W.rolling_mean_by_time(p, "pm2_5", 24, "pm2_5_24h").drop("pm2_5")


def _stat_query(stat: str, fn: str):
    names = [f"aqi_rolling_{stat}_{n}h_lag24h" for n in K.TARGET_ROLLS]

    @query(f"roll_{stat}_lagged", f"""WITH {aqi_grid_sql()}
SELECT series_id, ts, {', '.join(f"{roll(fn, 'aqi', n, 24, True)} AS {name}" for n, name in zip(K.TARGET_ROLLS, names))}
FROM aqi_grid""", names)
    def _(spark, d):
        g = aqi_grid(spark, d).select("series_id", "ts", "aqi")
        return W.rolling_stat(g, "aqi", K.TARGET_ROLLS, 24, stat, gap_free=True).drop("aqi")


_stat_query("std", "stddev_samp")
_stat_query("max", "max")


def _lag_sql(cols, horizon):
    return ", ".join(f"lag({c}, {horizon + o}) {OVER}) AS {c}_lag_{horizon + o}h" for c in cols for o in K.LAG_OFFSETS)


ALL_LAGGED = ("aqi", *K.POLLUTANTS, *K.WEATHER)


@query("feat_lags", f"WITH {aqi_grid_sql()} SELECT series_id, ts, {_lag_sql(ALL_LAGGED, 72)} FROM aqi_grid",
       [f"{c}_lag_{72 + o}h" for c in ALL_LAGGED for o in K.LAG_OFFSETS])
def _(spark, d):
    g = aqi_grid(spark, d).select("series_id", "ts", *ALL_LAGGED)
    return W.lag_features(g, ALL_LAGGED, 72, gap_free=True).drop(*ALL_LAGGED)


TARGETS = [f"aqi_{h}h" for h in K.HORIZONS]


@query("feat_targets", f"""WITH {targets_sql()}
SELECT series_id, ts, {', '.join(TARGETS)} FROM targets WHERE {' AND '.join(f'{t} IS NOT NULL' for t in TARGETS)}""", TARGETS)
def _(spark, d):
    return C.drop_null_targets(targets_grid(spark, d).select("series_id", "ts", *TARGETS), TARGETS)


CHANGES = [f"aqi_rate_change_{h}h_lag24h" for h in K.RATE_CHANGES]


def _change_sql(lag):
    return ", ".join(f"lag(aqi, {lag}) {OVER}) - lag(aqi, {lag + h}) {OVER}) AS aqi_rate_change_{h}h_lag{lag}h"
                     for h in K.RATE_CHANGES)


@query("feat_rate_change", f"WITH {aqi_grid_sql()} SELECT series_id, ts, {_change_sql(24)} FROM aqi_grid", CHANGES)
def _(spark, d):
    return W.rate_change(aqi_grid(spark, d).select("series_id", "ts", "aqi"), "aqi", 24, gap_free=True).drop("aqi")


@query("feat_diff", f"""WITH {panel_sql('station')}
SELECT series_id, ts, temperature - lag(temperature) {OVER}) AS temperature_change_1h, pm2_5 - lag(pm2_5) {OVER}) AS pm2_5_change
FROM panel""", ["temperature_change_1h", "pm2_5_change"])
def _(spark, d):
    p = hourly_panel(spark, d, "station").select("series_id", "ts", "temperature", "pm2_5")
    return W.diff1(p, {"temperature_change_1h": "temperature", "pm2_5_change": "pm2_5"}, gap_free=False).drop(
        "temperature", "pm2_5")


GAPS = ["pm2_5_24h", "pm2_5_lag_1h", "pm2_5_lag_25h", "next_24h"]


@query("windows_on_gaps", f"""WITH sparse AS (
  SELECT series_id, ts, pm2_5 FROM ({'WITH ' + panel_sql('station')} SELECT * FROM panel) WHERE hour(ts) % 5 <> 2)
SELECT series_id, ts, {roll('avg', 'pm2_5', 24)} AS pm2_5_24h, lag(pm2_5, 1) {OVER}) AS pm2_5_lag_1h,
  lag(pm2_5, 25) {OVER}) AS pm2_5_lag_25h, lead(pm2_5, 24) {OVER}) AS next_24h FROM sparse""", GAPS)
def _(spark, d):
    """Row windows with default arguments on an axis with gaps."""
    from hazegrid.plans.blocks import halo_window

    p = hourly_panel(spark, d, "station").select("series_id", "ts", "pm2_5").where(F.hour("ts") % 5 != 2)
    rolled = W.rolling_mean(p, {"pm2_5_24h": ("pm2_5", 24)})
    moved = halo_window(rolled, ["series_id"], lambda w: [F.lag("pm2_5", k).over(w).alias(f"pm2_5_lag_{k}h") for k in (1, 25)], before=25)
    return W.future_targets(moved, "pm2_5", [24]).withColumnRenamed("aqi_24h", "next_24h").drop("pm2_5")


@query("row_index", f"""WITH {panel_sql('station')}
SELECT series_id, ts, row_number() {OVER}) - 1 AS row_idx FROM panel""")
def _(spark, d):
    return W.row_index(hourly_panel(spark, d, "station").select("series_id", "ts"))


@query("row_index_events", """SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_idx FROM events""")
def _(spark, d):
    """Position in the whole table, sorted by ranges."""
    from hazegrid.plans.blocks import global_positions

    return global_positions(table(spark, d, "events", "event_id", "ts"), ["ts", "event_id"], "row_idx").select("event_id", "row_idx")


@query("drop_warmup", f"""WITH {panel_sql('station')}
SELECT series_id, ts, pm2_5 FROM (SELECT *, row_number() {OVER}) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM panel)
WHERE i >= least(168, n - 1)""", ["pm2_5"])
def _(spark, d):
    return W.drop_warmup(hourly_panel(spark, d, "station").select("series_id", "ts", "pm2_5"), 168)


@query("drop_warmup_by_names", f"""WITH {aqi_grid_sql()}
SELECT series_id, ts, aqi_lag_48h FROM (SELECT *, lag(aqi, 48) {OVER}) AS aqi_lag_48h, row_number() {OVER}) - 1 AS i,
  count(*) OVER (PARTITION BY series_id) AS n FROM aqi_grid) WHERE i >= least(48, n - 1)""", ["aqi_lag_48h"])
def _(spark, d):
    """Warm-up length read from the column names."""
    from hazegrid.plans.blocks import halo_window

    g = aqi_grid(spark, d).select("series_id", "ts", "aqi")
    lagged = halo_window(g, ["series_id"], lambda w: [F.lag("aqi", 48).over(w).alias("aqi_lag_48h")], before=48, gap_free=True)
    return W.drop_warmup(lagged.drop("aqi"))


@query("seq_windows", f"""WITH {grid_sql()}, filled AS (SELECT series_id, ts, coalesce(pm2_5, 0) AS a, coalesce(pm10, 0) AS b FROM grid),
w AS (SELECT series_id, ts, a AS label, count(*) {OVER} ROWS BETWEEN 72 PRECEDING AND 1 PRECEDING) AS n_steps,
  lag(a, 72) {OVER}) AS first_value, lag(b, 1) {OVER}) AS last_value,
  sum(a + b) {OVER} ROWS BETWEEN 72 PRECEDING AND 1 PRECEDING) AS total FROM filled)
SELECT * FROM w WHERE n_steps = 72""", ["label", "first_value", "last_value", "total"])
def _(spark, d):
    """72-step matrices; checked by their corner values and sums."""
    g = gridded(spark, d).select("series_id", "ts", F.coalesce("pm2_5", F.lit(0.0)).alias("a"), F.coalesce("pm10", F.lit(0.0)).alias("b"))
    s = W.make_sequences(g, ["a", "b"], "a", 72, gap_free=True)
    total = F.aggregate(F.flatten("sequence"), F.lit(0.0), lambda acc, x: acc + x)
    return s.select("series_id", "ts", "label", F.size("sequence").cast("bigint").alias("n_steps"),
                    F.col("sequence")[0][0].alias("first_value"), F.col("sequence")[71][1].alias("last_value"),
                    total.alias("total"))


def full_sql(horizon: int) -> tuple[str, list[str]]:
    cols = [(f"aqi_{h}h", f"lead(aqi, {h}) {OVER})") for h in K.HORIZONS]
    cols += [(f"{c}_lag_{horizon + o}h", f"lag({c}, {horizon + o}) {OVER})") for c in ALL_LAGGED for o in K.LAG_OFFSETS]
    for n in K.TARGET_ROLLS:
        cols.append((f"aqi_rolling_std_{n}h_lag{horizon}h", roll("stddev_samp", "aqi", n, horizon, True)))
        cols.append((f"aqi_rolling_max_{n}h_lag{horizon}h", roll("max", "aqi", n, horizon, True)))
    for c, sizes in K.POLLUTANT_ROLLS.items():
        cols += [(f"{c}_rolling_std_{n}h_lag{horizon}h", roll("stddev_samp", c, n, horizon, True)) for n in sizes]
    cols += [(f"aqi_rate_change_{h}h_lag{horizon}h", f"lag(aqi, {horizon}) {OVER}) - lag(aqi, {horizon + h}) {OVER})")
             for h in K.RATE_CHANGES]
    cols += [
        ("hour_sin", "sin(hour(ts) * 2 * pi() / 24)"), ("hour_cos", "cos(hour(ts) * 2 * pi() / 24)"),
        ("day_sin", "sin((isodow(ts) - 1) * 2 * pi() / 7)"), ("day_cos", "cos((isodow(ts) - 1) * 2 * pi() / 7)"),
        ("month_cos", "cos(month(ts) * 2 * pi() / 12)"),
        ("temp_humidity_interaction", "temperature * humidity / 100"),
        ("wind_u", "wind_speed * cos(radians(wind_direction))"), ("wind_v", "wind_speed * sin(radians(wind_direction))"),
        ("pm25_pm10_ratio", "pm2_5 / (pm10 + 1e-6)"),
    ]
    ints = """hour(ts) AS hour, isodow(ts) - 1 AS day_of_week, day(ts) AS day, isodow(ts) - 1 AS weekday, month(ts) AS month,
  quarter(ts) AS quarter, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend, (month(ts) % 12) // 3 + 1 AS season"""
    text = f"SELECT *, {', '.join(f'{x} AS {n}' for n, x in cols)}, {ints} FROM aqi_grid"
    return text, [*BASE, "pm2_5_24h", "aqi", *[n for n, _ in cols]]


def _full_query(horizon: int):
    sql, doubles = full_sql(horizon)

    @query(f"feat_full_{horizon}h", f"WITH {aqi_grid_sql()} {sql}", doubles)
    def _(spark, d):
        return W.full_feature_table(aqi_grid(spark, d), horizon, gap_free=True)


for _h in K.HORIZONS:
    _full_query(_h)


# --- folds ---------------------------------------------------------------------------------

TRAIN, TEST, STEP = 336, 168, 48

_IDX = f"SELECT series_id, ts, row_number() {OVER}) - 1 AS row_idx, count(*) OVER (PARTITION BY series_id) AS n FROM grid"


def folds_sql(source: str, train: int, test: int, step: int) -> str:
    return f"""sizes AS (SELECT series_id, count(*) AS n FROM {source} GROUP BY 1 HAVING count(*) >= {train + test}),
folds AS (SELECT series_id, unnest(generate_series(0, (n - {train + test}) // {step})) AS fold FROM sizes)"""


@query("folds_sliding", f"""WITH {DAILY_SQL}, {folds_sql('daily_grid', K.CV_TRAIN, K.CV_TEST, K.CV_STEP)}
SELECT series_id, fold, fold * {K.CV_STEP} AS train_start, fold * {K.CV_STEP} + {K.CV_TRAIN} AS train_end,
  fold * {K.CV_STEP} + {K.CV_TRAIN} AS test_start, fold * {K.CV_STEP} + {K.CV_TRAIN + K.CV_TEST} AS test_end FROM folds""")
def _(spark, d):
    return FO.sliding_folds(daily_region(spark, d))


@query("folds_assign", f"""WITH {grid_sql()}, {folds_sql('grid', TRAIN, TEST, STEP)}, idx AS ({_IDX})
SELECT idx.series_id, ts, row_idx, fold,
  CASE WHEN row_idx < fold * {STEP} + {TRAIN} THEN 'train' ELSE 'test' END AS split
FROM idx JOIN folds ON folds.series_id = idx.series_id AND row_idx >= fold * {STEP} AND row_idx < fold * {STEP} + {TRAIN + TEST}""")
def _(spark, d):
    return FO.assign_folds(gridded(spark, d).select("series_id", "ts"), TRAIN, TEST, STEP)


@query("folds_expanding", f"""WITH {panel_sql('station')}, sizes AS (SELECT series_id, count(*) AS n FROM panel GROUP BY 1),
f AS (SELECT series_id, n, unnest([0, 1, 2]) AS fold FROM sizes)
SELECT series_id, fold, n - (3 - fold) * (n // 4) AS train_end, n - (3 - fold) * (n // 4) AS test_start,
  n - (2 - fold) * (n // 4) AS test_end FROM f""")
def _(spark, d):
    return FO.expanding_folds(hourly_panel(spark, d, "station"))


@query("folds_expanding_rows", f"""WITH {panel_sql('station')}, idx AS ({_IDX.replace('FROM grid', 'FROM panel')}),
f AS (SELECT *, unnest([0, 1, 2]) AS fold FROM idx)
SELECT series_id, ts, row_idx, fold, CASE WHEN row_idx < n - (3 - fold) * (n // 4) THEN 'train' ELSE 'test' END AS split
FROM f WHERE row_idx < n - (2 - fold) * (n // 4)""")
def _(spark, d):
    return FO.assign_expanding(hourly_panel(spark, d, "station").select("series_id", "ts"))


@query("split_tail", f"""WITH {panel_sql('station')}, idx AS ({_IDX.replace('FROM grid', 'FROM panel')})
SELECT series_id, ts, row_idx, n > 100 AND row_idx >= n - greatest(floor(0.15 * n)::BIGINT, 50) AS is_validation FROM idx""")
def _(spark, d):
    return FO.holdout_tail(hourly_panel(spark, d, "station").select("series_id", "ts"))


@query("split_chrono", f"""WITH {panel_sql('station')}, idx AS ({_IDX.replace('FROM grid', 'FROM panel')})
SELECT series_id, ts, row_idx, CASE WHEN row_idx < floor(0.8 * n) THEN 'train' ELSE 'test' END AS split FROM idx""")
def _(spark, d):
    return FO.chrono_split(hourly_panel(spark, d, "station").select("series_id", "ts"))


@query("split_targets", f"WITH {targets_sql()} SELECT series_id, ts, {', '.join(TARGETS)} FROM targets", TARGETS)
def _(spark, d):
    """The targets' side of the split; the features' side never holds a target."""
    x, y = W.split_xy(targets_grid(spark, d))
    if any("aqi_" in c for c in x.columns):
        raise ValueError(f"targets among the features: {x.columns}")
    return y
