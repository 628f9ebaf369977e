"""Queries: cleaning and imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazegrid.catalog.base import (
    DAILY_SQL, aqi_grid, aqi_grid_sql, daily_region, grid_sql, gridded, query, readings,
    readings_sql, stored, table,
)
from hazegrid.operators import clean as C

COLS = ("pm2_5", "so2", "o3")
ST = grid_sql("station")


def _station(spark, d, *cols):
    return gridded(spark, d, "station").select("series_id", "ts", *cols)


@query("ffill_limit2", f"""WITH {ST} SELECT series_id, ts, {', '.join(
    f"last_value({c} IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS {c}" for c in COLS)}
FROM grid""", COLS)
def _(spark, d):
    return C.ffill(_station(spark, d, *COLS), COLS, limit=2, gap_free=True)


def _both_sql(src: str, cols, key="series_id", back_first=False):
    prev = "last_value({c} IGNORE NULLS) OVER (PARTITION BY " + key + " ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    nxt = "first_value({c} IGNORE NULLS) OVER (PARTITION BY " + key + " ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    a, b = (nxt, prev) if back_first else (prev, nxt)
    return f"SELECT {key}, ts, " + ", ".join(f"coalesce({a.format(c=c)}, {b.format(c=c)}) AS {c}" for c in cols) + f" FROM {src}"


@query("fill_both", f"WITH {ST} {_both_sql('grid', COLS)}", COLS)
def _(spark, d):
    return C.fill_both(_station(spark, d, *COLS), COLS, gap_free=True)


@query("ffill_unlimited", f"""WITH {ST} SELECT series_id, ts, {', '.join(
    f"last_value({c} IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}" for c in COLS)}
FROM grid""", COLS)
def _(spark, d):
    return C.ffill(_station(spark, d, *COLS), COLS, gap_free=True)


@query("bfill_limit3", f"""WITH {ST} SELECT series_id, ts, {', '.join(
    f"first_value({c} IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS {c}" for c in COLS)}
FROM grid""", COLS)
def _(spark, d):
    return C.bfill(_station(spark, d, *COLS), COLS, limit=3, gap_free=True)


def _near_sql(src: str, c: str) -> str:
    """Rows of ``src`` with value, position and time of the nearest non-null rows."""
    w = "(PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    f = "(PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return f"""(SELECT series_id, ts, v, rn,
    last_value(v IGNORE NULLS) OVER {w} AS pv, last_value(CASE WHEN v IS NOT NULL THEN rn END IGNORE NULLS) OVER {w} AS pr,
    last_value(CASE WHEN v IS NOT NULL THEN epoch(ts) END IGNORE NULLS) OVER {w} AS pt,
    first_value(v IGNORE NULLS) OVER {f} AS nv, first_value(CASE WHEN v IS NOT NULL THEN rn END IGNORE NULLS) OVER {f} AS nr,
    first_value(CASE WHEN v IS NOT NULL THEN epoch(ts) END IGNORE NULLS) OVER {f} AS nt
  FROM (SELECT series_id, ts, {c} AS v, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS rn FROM {src}))"""


def _interp_sql(src: str, c: str, limit: int = 6) -> str:
    return f"""SELECT series_id, ts, CASE WHEN v IS NOT NULL THEN v WHEN pv IS NULL OR rn - pr > {limit} THEN NULL
  WHEN nv IS NULL THEN pv ELSE pv + (nv - pv) * ((epoch(ts) - pt) / (nt - pt)) END AS {c} FROM {_near_sql(src, c)}"""


@query("interp_time", f"WITH {ST} {_interp_sql('grid', 'so2')}", ["so2"])
def _(spark, d):
    return C.interpolate_time(_station(spark, d, "so2"), ["so2"], gap_free=True)


@query("ffill_then_interp", f"""WITH {ST}, carried AS (
  SELECT series_id, ts, last_value(so2 IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND
  CURRENT ROW) AS so2 FROM grid) {_interp_sql('carried', 'so2')}""", ["so2"])
def _(spark, d):
    """The cleaning order of the pipeline: carry two rows, then interpolate six."""
    return C.interpolate_time(C.ffill(_station(spark, d, "so2"), ["so2"], limit=2, gap_free=True), ["so2"], gap_free=True)


@query("interp_linear_both", f"""WITH {ST} SELECT series_id, ts, CASE WHEN v IS NOT NULL THEN v WHEN pv IS NULL THEN nv
  WHEN nv IS NULL THEN pv ELSE pv + (nv - pv) * ((rn - pr)::DOUBLE / (nr - pr)::DOUBLE) END AS so2 FROM {_near_sql('grid', 'so2')}""",
       ["so2"])
def _(spark, d):
    return C.interpolate_both(_station(spark, d, "so2"), ["so2"], gap_free=True)


@query("interp_daily_orders", f"""WITH {DAILY_SQL}, holes AS (
  SELECT series_id, ts, CASE WHEN value > 200 THEN value END AS value FROM daily_grid) {_interp_sql('holes', 'value')}""",
       ["value"])
def _(spark, d):
    """Time interpolation on a long daily axis with artificial holes below 200."""
    g = daily_region(spark, d).withColumn("value", F.when(F.col("value") > 200, F.col("value")))
    return C.interpolate_time(g, ["value"], gap_free=False)


KNN = ("pm2_5", "pm10", "no2", "so2", "o3")


def _knn_sql() -> str:
    n = len(KNN)
    total = " + ".join(f"coalesce((h.{c} - d.{c}) * (h.{c} - d.{c}), 0)" for c in KNN)
    shared = " + ".join(f"(CASE WHEN h.{c} IS NOT NULL AND d.{c} IS NOT NULL THEN 1 ELSE 0 END)" for c in KNN)
    some = " OR ".join(f"{c} IS NOT NULL" for c in KNN)
    hole = " OR ".join(f"{c} IS NULL" for c in KNN)
    parts = []
    for c in KNN:
        parts.append(f"""near_{c} AS (SELECT series_id, hts AS ts, avg(v) AS v FROM (
    SELECT series_id, hts, {c}_d AS v, row_number() OVER (PARTITION BY series_id, hts ORDER BY dist, dts) AS rn
    FROM pairs WHERE {c}_h IS NULL AND {c}_d IS NOT NULL) WHERE rn <= 5 GROUP BY 1, 2)""")
    return f"""pairs AS (SELECT * FROM (
  SELECT h.series_id, h.ts AS hts, d.ts AS dts, sqrt(({total}) * {n} / nullif({shared}, 0)) AS dist,
    {', '.join(f'h.{c} AS {c}_h, d.{c} AS {c}_d' for c in KNN)}
  FROM (SELECT * FROM grid WHERE ({some}) AND ({hole})) h JOIN (SELECT * FROM grid WHERE {some}) d ON h.series_id = d.series_id)
  WHERE dist IS NOT NULL),
{', '.join(parts)},
means AS (SELECT series_id, {', '.join(f'avg({c}) AS m_{c}' for c in KNN)} FROM grid GROUP BY 1)
SELECT g.series_id, g.ts, {', '.join(f'coalesce(g.{c}, near_{c}.v, m_{c}) AS {c}' for c in KNN)}
FROM grid g JOIN means USING (series_id) {' '.join(f'LEFT JOIN near_{c} ON near_{c}.series_id = g.series_id AND near_{c}.ts = g.ts' for c in KNN)}"""


@query("impute_knn", f"WITH {ST}, {_knn_sql()}", KNN)
def _(spark, d):
    return C.impute_knn(stored(_station(spark, d, *KNN)), KNN, gap_free=True)


@query("impute_mode", """WITH counts AS (SELECT l_returnflag || l_linestatus || l_quantity::INT AS v, count(*) AS n FROM lineitem
  WHERE l_quantity > 10 GROUP BY 1), top AS (SELECT v FROM counts ORDER BY n DESC, v LIMIT 1)
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 10 THEN l_returnflag || l_linestatus || l_quantity::INT
  ELSE (SELECT v FROM top) END AS grade FROM lineitem""")
def _(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity")
    grade = F.when(F.col("l_quantity") > 10, F.concat("l_returnflag", "l_linestatus", F.col("l_quantity").cast("int").cast("string")))
    return C.impute_mode(li.select("l_orderkey", "l_linenumber", grade.alias("grade")), "grade")


@query("impute_mean", f"""WITH {ST} SELECT series_id, ts, {', '.join(
    f"coalesce({c}, avg({c}) OVER (PARTITION BY series_id)) AS {c}" for c in COLS)} FROM grid""", COLS)
def _(spark, d):
    return C.impute_mean(_station(spark, d, *COLS), COLS)


@query("impute_mean_pooled", f"""WITH {ST} SELECT series_id, ts, {', '.join(
    f"coalesce({c}, (SELECT avg({c}) FROM grid)) AS {c}" for c in COLS)} FROM grid""", COLS)
def _(spark, d):
    """Mean over all series together."""
    return C.impute_mean(_station(spark, d, *COLS), COLS, keys=[])


@query("impute_median", f"""WITH {ST}, q AS (SELECT series_id, {', '.join(
    f"quantile_cont({c}, 0.5) AS q_{c}" for c in COLS)} FROM grid GROUP BY 1)
SELECT series_id, ts, {', '.join(f"coalesce({c}, q_{c}) AS {c}" for c in COLS)} FROM grid JOIN q USING (series_id)""", COLS)
def _(spark, d):
    return C.impute_median(stored(_station(spark, d, *COLS)), COLS)


OUT = ("aqi", "pm10", "o3", "wind_speed")


def _bounds_sql(src, cols, lo, hi, k, target=None):
    out = []
    for c in cols:
        a, b = (0.05, 0.95) if c == target else (lo, hi)
        qa, qb = f"quantile_cont({c}, {a})", f"quantile_cont({c}, {b})"
        out.append(f"{qa} - {k} * ({qb} - {qa}) AS lo_{c}, {qb} + {k} * ({qb} - {qa}) AS hi_{c}")
    return f"bounds AS (SELECT series_id, {', '.join(out)} FROM {src} GROUP BY 1)"


@query("outlier_null_fill", f"""WITH {aqi_grid_sql()}, {_bounds_sql('aqi_grid', OUT, 0.25, 0.75, '3e0', 'aqi')},
nulled AS (SELECT series_id, ts, {', '.join(f"CASE WHEN {c} BETWEEN lo_{c} AND hi_{c} THEN {c} END AS {c}" for c in OUT)}
  FROM aqi_grid JOIN bounds USING (series_id))
{_both_sql('nulled', OUT, back_first=True)}""", OUT)
def _(spark, d):
    return C.outliers_to_null(stored(aqi_grid(spark, d).select("series_id", "ts", *OUT)), OUT, target="aqi", gap_free=True)


_CLICK_NULL = "CASE WHEN series_id <> 'click' THEN series_id END"


@query("outlier_null_key", f"""WITH {aqi_grid_sql()}, keyed AS (SELECT * REPLACE ({_CLICK_NULL} AS series_id) FROM aqi_grid),
{_bounds_sql('keyed', OUT, 0.25, 0.75, '3e0', 'aqi')},
nulled AS (SELECT k.series_id, ts, {', '.join(f"CASE WHEN {c} BETWEEN lo_{c} AND hi_{c} THEN {c} END AS {c}" for c in OUT)}
  FROM keyed k JOIN bounds b ON k.series_id IS NOT DISTINCT FROM b.series_id)
{_both_sql('nulled', OUT, back_first=True)}""", OUT)
def _(spark, d):
    """One series has no name: null is a key like any other."""
    named = aqi_grid(spark, d).withColumn("series_id", F.when(F.col("series_id") != "click", F.col("series_id")))
    return C.outliers_to_null(stored(named.select("series_id", "ts", *OUT)), OUT, target="aqi")


def _clip_sql(src, cols, lo, hi, k):
    return f"""{_bounds_sql(src, cols, lo, hi, k)}
SELECT series_id, ts, {', '.join(f"CASE WHEN {c} IS NOT NULL THEN greatest(least({c}, hi_{c}), lo_{c}) END AS {c}, coalesce({c} < lo_{c} OR {c} > hi_{c}, false) AS {c}_clipped" for c in cols)}
FROM {src} JOIN bounds USING (series_id)"""


CLIP = ("pm2_5", "pm10", "wind_speed")


@query("outlier_clip_iqr", f"WITH {ST}, {_clip_sql('grid', CLIP, 0.25, 0.75, '1.5e0')}", CLIP)
def _(spark, d):
    return C.clip_iqr(stored(_station(spark, d, *CLIP)), CLIP, flags=True)


@query("outlier_winsorize", f"WITH {ST}, {_clip_sql('grid', CLIP, 0.01, 0.99, '0e0')}", CLIP)
def _(spark, d):
    return C.winsorize(stored(_station(spark, d, *CLIP)), CLIP, flags=True)


@query("outlier_counts", f"""WITH {ST}, clipped AS (WITH {_clip_sql('grid', CLIP, 0.25, 0.75, '1.5e0')})
SELECT * FROM ({' UNION ALL '.join(f"SELECT '{c}' AS feature, count_if({c}_clipped) AS clipped FROM clipped" for c in CLIP)})
WHERE clipped > 0""")
def _(spark, d):
    return C.clipped_counts(C.clip_iqr(stored(_station(spark, d, *CLIP)), CLIP, flags=True), CLIP)


@query("anomaly_iqr", f"""WITH {readings_sql()}, b AS (SELECT city, quantile_cont(aqi, 0.25) AS q1, quantile_cont(aqi, 0.75) AS q3
  FROM readings GROUP BY 1)
SELECT city, ts, aqi FROM readings JOIN b USING (city) WHERE aqi < q1 - 1.5e0 * (q3 - q1) OR aqi > q3 + 1.5e0 * (q3 - q1)""",
       ["aqi"])
def _(spark, d):
    return C.iqr_anomalies(stored(readings(spark, d).select("city", "ts", "aqi")), "aqi", keys=["city"])


@query("anomaly_iqr_items", """WITH b AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1,
  quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem)
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem, b
WHERE l_extendedprice < q1 - 0.25e0 * (q3 - q1) OR l_extendedprice > q3 + 0.25e0 * (q3 - q1)""", ["l_extendedprice"])
def _(spark, d):
    """The same on the largest table, one pooled group."""
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice")
    return C.iqr_anomalies(li, "l_extendedprice", k=0.25, keys=[])




@query("narrow_columns", """SELECT l_orderkey::BIGINT AS l_orderkey, l_linenumber, l_extendedprice::FLOAT::DOUBLE AS l_extendedprice
FROM lineitem""", ["l_extendedprice"])
def _(spark, d):
    """Whole numbers as int and doubles as float, widened again only to be compared."""
    narrow = C.narrow_types(table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice"))
    if dict(narrow.dtypes)["l_orderkey"] != "int" or dict(narrow.dtypes)["l_extendedprice"] != "float":
        raise TypeError(f"not narrowed: {narrow.dtypes}")
    return narrow.select(F.col("l_orderkey").cast("bigint"), "l_linenumber", F.col("l_extendedprice").cast("double"))


_WHOLE = ("pm2_5", "pm10", "co")


@query("drop_incomplete_rows", f"""WITH {ST} SELECT series_id, ts, {', '.join(_WHOLE)} FROM grid
WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _WHOLE)}""", _WHOLE)
def _(spark, d):
    return C.drop_unfillable(_station(spark, d, *_WHOLE), rows=True)


@query("preprocess_report", f"""WITH {ST}, kept AS (SELECT pm2_5, pm10 FROM grid WHERE pm2_5 IS NOT NULL),
counts AS (SELECT pm2_5, pm10, count(*) AS n FROM kept GROUP BY ALL)
SELECT (SELECT count(*) FROM grid) AS rows_before, 5 AS columns_before, sum(n)::BIGINT AS rows_after, 2 AS columns_after, 1 AS removed_gaps,
  sum(CASE WHEN pm10 IS NULL THEN n ELSE 0 END)::BIGINT AS missing_values, sum(n - 1)::BIGINT AS duplicate_rows FROM counts""")
def _(spark, d):
    """Shapes, gaps and repeated values before and after a cleaning step."""
    before = stored(_station(spark, d, *_WHOLE))
    return C.preprocessing_report(before, before.where(F.col("pm2_5").isNotNull()).select("pm2_5", "pm10"), {"gaps": ["co"]})
