"""Queries: profiles, correlation, quality, leakage, mutual information."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from hazegrid.catalog.base import BASE, aqi_grid, aqi_grid_sql, grid_sql, gridded, query, stored, targets_grid, targets_sql
from hazegrid.functions.timefeat import calendar_features, interaction_features
from hazegrid.operators import profile as P

ST = grid_sql("station")


def each(cols, template: str, source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, {template.format(c=c)} FROM {source}" for c in cols)


@query("profile_nulls", f"""WITH {ST}, p AS ({each(BASE, "count_if({c} IS NULL) AS nulls, count(*) AS total", 'grid')})
SELECT feature, nulls, total, nulls / total AS null_pct, nulls / total > 0.8 AS mostly_missing, nulls / total < 0.5 AS kept FROM p""",
       ["null_pct"])
def _(spark, d):
    return P.null_profile(gridded(spark, d, "station"), BASE)


@query("profile_describe", f"WITH {ST} " + each(BASE, """count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std,
  min({c}) AS min, max({c}) AS max, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50,
  quantile_cont({c}, 0.75) AS q75""", "grid"), ["mean", "std", "min", "max", "q25", "q50", "q75"])
def _(spark, d):
    return P.describe(stored(gridded(spark, d, "station")), BASE)


@query("profile_items", " UNION ALL ".join(f"""SELECT '{c}' AS feature, count({c}) AS count, avg({c}) AS mean,
  stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50,
  quantile_cont({c}, 0.75) AS q75 FROM lineitem""" for c in ("l_quantity", "l_extendedprice", "l_discount")),
       ["mean", "std", "min", "max", "q25", "q50", "q75"])
def _(spark, d):
    """Description of the largest table's measures."""
    from hazegrid.catalog.base import table

    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    return P.describe(table(spark, d, "lineitem", *cols), cols)


@query("quality_issues", f"""WITH {ST}, t AS (SELECT so2 - 100 AS y, * FROM grid),
f AS (SELECT count(y) AS n, avg(y) AS m, stddev_samp(y) AS s, count_if(y < 0) AS neg, max(y) AS top,
  {' + '.join(f"(CASE WHEN count_if({c} IS NULL) / count(*) > 0.8 THEN 1 ELSE 0 END)" for c in BASE)} AS miss FROM t)
SELECT issue, value, m AS target_mean, s AS target_std, n AS target_count FROM (
  SELECT 'low_variance' AS issue, s AS value, * FROM f WHERE s < 1
  UNION ALL SELECT 'negative_values', neg, * FROM f WHERE neg > 0
  UNION ALL SELECT 'above_500', top, * FROM f WHERE top > 500
  UNION ALL SELECT 'features_over_80pct_missing', miss, * FROM f WHERE miss > 0)""", ["value", "target_mean", "target_std"])
def _(spark, d):
    t = gridded(spark, d, "station").withColumn("y", F.col("so2") - 100)
    return P.quality_issues(t, "y", BASE)


@query("var_profile", f"""WITH {aqi_grid_sql('station')}, w AS (SELECT *, 1e0 AS flat FROM aqi_grid),
v AS ({each((*BASE, 'aqi', 'flat'), "var_samp({c}) AS variance", 'w')})
SELECT feature, variance, (variance IS NULL OR variance < 1e-6) AND feature <> 'aqi' AS dropped FROM v""", ["variance"])
def _(spark, d):
    g = aqi_grid(spark, d, "station").withColumn("flat", F.lit(1.0))
    return P.variance_profile(g, (*BASE, "aqi", "flat"), protected=["aqi"])


def pairs_sql(cols, source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {cols.index(a)} AS i, {cols.index(b)} AS j, '{a}' AS feature_a, '{b}' AS feature_b, "
        f"abs(corr({a}, {b})) AS abs_corr FROM {source}" for a, b in combinations(cols, 2)
    )


NARROW = [*BASE, "aqi"]


@query("corr_pairs", f"WITH {aqi_grid_sql('station')} {pairs_sql(NARROW, 'aqi_grid')}", ["abs_corr"])
def _(spark, d):
    return P.corr_pairs(aqi_grid(spark, d, "station"), NARROW)


WIDE = [*BASE, "aqi", "pm2_5_24h", "hour", "day_of_week", "day", "temp_humidity_interaction", "wind_u", "wind_v", "pm25_pm10_ratio"]
WIDE_SQL = """wide AS (SELECT *, hour(ts) AS hour, isodow(ts) - 1 AS day_of_week, day(ts) AS day,
  temperature * humidity / 100 AS temp_humidity_interaction, wind_speed * cos(radians(wind_direction)) AS wind_u,
  wind_speed * sin(radians(wind_direction)) AS wind_v, pm2_5 / (pm10 + 1e-6) AS pm25_pm10_ratio FROM aqi_grid)"""


def _wide(spark, d):
    g = aqi_grid(spark, d, "station")
    return stored(g.select("*", *calendar_features(F.col("ts")), *interaction_features(g.columns)))


@query("corr_pairs_wide", f"WITH {aqi_grid_sql('station')}, {WIDE_SQL} {pairs_sql(WIDE, 'wide')}", ["abs_corr"])
def _(spark, d):
    """Many columns: partial sums per task instead of one generated aggregate per pair."""
    return P.corr_pairs(_wide(spark, d), WIDE)


@query("corr_prune_order", f"""WITH {aqi_grid_sql('station')}, {WIDE_SQL}, pairs AS ({pairs_sql(WIDE, 'wide')})
SELECT feature_b AS feature, min(j) AS ordinal, count(*) AS high_pairs FROM pairs
WHERE abs_corr > 0.6 AND feature_b <> 'aqi' GROUP BY 1""")
def _(spark, d):
    return P.prune_correlated(P.corr_pairs(_wide(spark, d), WIDE), 0.6, protected=["aqi"])


FEATS = [c for c in WIDE if c != "aqi"]


@query("corr_prune_target", f"""WITH {aqi_grid_sql('station')}, {WIDE_SQL}, pairs AS ({pairs_sql(FEATS, 'wide')}),
tc AS ({each(FEATS, "CASE WHEN var_samp({c}) > 1e-9 THEN abs(corr({c}, aqi)) ELSE 0 END AS r", 'wide')})
SELECT CASE WHEN b.r >= a.r THEN feature_a ELSE feature_b END AS feature, count(*) AS lost_pairs
FROM pairs JOIN tc a ON a.feature = feature_a JOIN tc b ON b.feature = feature_b WHERE abs_corr > 0.6 GROUP BY 1""")
def _(spark, d):
    w = _wide(spark, d)
    return P.prune_correlated_by_target(P.corr_pairs(w, FEATS), P.target_correlations(w, FEATS, "aqi"), 0.6)


@query("corr_target_top20", f"""WITH {aqi_grid_sql('station')}, {WIDE_SQL},
tc AS ({each(FEATS, "CASE WHEN var_samp({c}) > 1e-9 THEN abs(corr({c}, aqi)) ELSE 0 END AS abs_corr", 'wide')})
SELECT feature, abs_corr FROM tc WHERE abs_corr > 0 ORDER BY abs_corr DESC, feature LIMIT 20""", ["abs_corr"])
def _(spark, d):
    return P.top_target_correlations(_wide(spark, d), FEATS, "aqi")


LEAK = ["pm2_5", "pm2_5_24h", "temperature", "aqi_48h", "target_like"]


@query("leakage_check", f"""WITH {targets_sql()}, t AS (SELECT pm2_5, pm2_5_24h, temperature, aqi_48h, aqi_24h + pm10 / 1000 AS target_like,
  aqi_24h FROM targets), ok AS (SELECT * FROM t WHERE {' AND '.join(f'{c} IS NOT NULL' for c in [*LEAK, 'aqi_24h'])}),
r AS ({each(LEAK, "abs(corr({c}, aqi_24h)) AS abs_corr", 'ok')})
SELECT feature, abs_corr, abs_corr > 0.85 AS high_corr, regexp_matches(lower(feature), 'future|ahead|target') AS suspicious_name,
  (SELECT max(abs_corr) FROM r) AS max_corr, (SELECT avg(abs_corr) FROM r) AS mean_corr FROM r""",
       ["abs_corr", "max_corr", "mean_corr"])
def _(spark, d):
    t = targets_grid(spark, d).withColumn("target_like", F.col("aqi_24h") + F.col("pm10") / 1000)
    return P.leakage_check(t, LEAK, "aqi_24h")


MI = ["pm2_5", "pm10", "temperature", "wind_speed"]
BINS = 8


def _mi_sql() -> str:
    def bins(c):
        return " + ".join(f"(CASE WHEN {c} > (SELECT quantile_cont({c}, {i / BINS}) FROM aqi_grid) THEN 1 ELSE 0 END)" for i in range(1, BINS))

    binned = f"SELECT {', '.join(f'CASE WHEN {c} IS NOT NULL THEN {bins(c)} END AS {c}' for c in [*MI, 'aqi'])} FROM aqi_grid"
    joint = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {c} AS bx, aqi AS b_y, count(*) AS n FROM binned WHERE {c} IS NOT NULL AND aqi IS NOT NULL GROUP BY 1, 2, 3"
        for c in MI)
    return f"""binned AS ({binned}), joint AS ({joint}),
parts AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature) AS nn, sum(n) OVER (PARTITION BY feature, bx) AS nx,
  sum(n) OVER (PARTITION BY feature, b_y) AS ny FROM joint)
SELECT feature, greatest(sum(n / nn * ln(n * nn / (nx * ny))), 0) AS score FROM parts GROUP BY 1"""


@query("mi_binned", f"WITH {aqi_grid_sql('station')}, {_mi_sql()}", ["score"])
def _(spark, d):
    return P.mutual_info(stored(aqi_grid(spark, d, "station").select(*MI, "aqi")), MI, "aqi", BINS)
