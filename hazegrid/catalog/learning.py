"""Queries: feature selection, models, validation, scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazegrid import constants as K
from hazegrid.catalog.base import BASE, aqi_grid, aqi_grid_sql, hourly_panel, panel_sql, query, targets_grid, targets_sql
from hazegrid.functions.timefeat import cyclic_features, interaction_features
from hazegrid.operators import evaluate as E
from hazegrid.operators import extratrees as X
from hazegrid.operators import folds as FO
from hazegrid.operators import models as M
from hazegrid.operators import slidefit as SF
from hazegrid.operators.windows import rolling
from hazegrid.plans.blocks import halo_window
from hazegrid.session import checkpointed, scratch_dir

TRAIN, TEST, STEP = 336, 168, 48
LABEL = "aqi_24h"
FEATURES = ["aqi", *BASE, "aqi_lag_24h", "aqi_lag_48h", "aqi_rolling_std_24h", "hour_sin", "hour_cos", "day_sin", "day_cos",
            "temp_humidity_interaction", "wind_u", "wind_v", "pm25_pm10_ratio"]
RUN_MODELS = ("linear", "boost_symmetric", "boost_level", "boost_leafy", "random_forest", "extra_trees", "gradient_boosting", "decision_tree")
CORE = ["aqi", "pm2_5", "pm10", "temperature", "aqi_lag_24h", "hour_sin", "hour_cos"]

def training_table(spark, d, kind="city"):
    """Panel with a small set of lagged, cyclic and interaction features and the targets."""
    g = aqi_grid(spark, d, kind)
    wide = halo_window(
        g, ["series_id"],
        lambda w: [F.lag("aqi", 24).over(w).alias("aqi_lag_24h"), F.lag("aqi", 48).over(w).alias("aqi_lag_48h"),
                   rolling(w, F.stddev_samp, F.col("aqi"), 24).alias("aqi_rolling_std_24h"),
                   *[F.lead("aqi", h).over(w).alias(f"aqi_{h}h") for h in K.HORIZONS]],
        before=48, after=72, gap_free=True,
    )
    return checkpointed(wide.select("*", *cyclic_features(F.col("ts")), *interaction_features(g.columns)))


@query("rf_importance")
def _(spark, d):
    return M.rf_importance(training_table(spark, d), FEATURES, LABEL, 15)


@query("hybrid_select")
def _(spark, d):
    return M.hybrid_select(training_table(spark, d), CORE, LABEL, 5)


@query("selection_stages")
def _(spark, d):
    return M.selection_stages(training_table(spark, d), FEATURES, LABEL, K.FEATURES_KEPT[24])[0]




@query("cv_predictions")
def _(spark, d):
    return M.fit_eval_folds(training_table(spark, d), ("linear", "decision_tree"), FEATURES, LABEL, TRAIN, TEST, STEP)


@query("cv_ensemble")
def _(spark, d):
    """Extra trees, the line and their mean on every fold: scores per model, as in the choice of a model."""
    preds = M.fit_eval_folds(training_table(spark, d), ("linear", "extra_trees"), FEATURES, LABEL, TRAIN, TEST, STEP,
                             ensembles={"mean_of_both": ["linear", "extra_trees"]})
    return E.regression_metrics(preds, ["model", "fold", "split"])


@query("cv_prediction_rows", f"""WITH {targets_sql()}, idx AS (SELECT series_id, ts, aqi_24h AS y,
    row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM targets),
f AS (SELECT *, unnest(generate_series(0, (n - {TRAIN + TEST}) // {STEP})) AS fold FROM idx)
SELECT 'linear' AS model, fold, CASE WHEN i < fold * {STEP} + {TRAIN} THEN 'train' ELSE 'test' END AS split, series_id, ts, y,
  true AS predicted FROM f WHERE i >= fold * {STEP} AND i < fold * {STEP} + {TRAIN + TEST}""", ["y"])
def _(spark, d):
    """Which rows a validation run predicts: every row of every fold, once per model."""
    preds = M.fit_eval_folds(training_table(spark, d), ("linear",), CORE, LABEL, TRAIN, TEST, STEP)
    return preds.withColumn("predicted", F.col("yhat").isNotNull() & ~F.isnan("yhat")).drop("yhat")


def _line_rows(spark, d):
    """Hours of each city that have an index now and a day later."""
    return checkpointed(targets_grid(spark, d).select("series_id", "ts", "aqi", LABEL).na.drop())


LINES_SQL = f"""WITH {targets_sql()}, idx AS (SELECT series_id, ts, aqi AS x, aqi_24h AS y,
    row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n
  FROM targets WHERE aqi IS NOT NULL AND aqi_24h IS NOT NULL),
tagged AS (SELECT *, CASE WHEN i < fold * {STEP} + {TRAIN} THEN 'train' ELSE 'test' END AS split FROM (
    SELECT *, unnest(generate_series(0, (n - {TRAIN + TEST}) // {STEP})) AS fold FROM idx WHERE n >= {TRAIN + TEST})
  WHERE i >= fold * {STEP} AND i < fold * {STEP} + {TRAIN + TEST})"""


@query("fold_lines", f"""{LINES_SQL} SELECT series_id, fold::INT AS fold, count(*) AS n, regr_slope(y, x) AS slope,
  regr_intercept(y, x) AS intercept FROM tagged WHERE split = 'train' GROUP BY series_id, fold""", ["slope", "intercept"])
def _(spark, d):
    """Slope and intercept of every sliding fold of every city."""
    lines = SF.linear_folds(_line_rows(spark, d), ["aqi"], LABEL, TRAIN, TEST, STEP, pooled=False)
    return lines.select("series_id", "fold", "n", F.col("coefficients")[0].alias("slope"), "intercept")


@query("fold_lines_pooled", f"""{LINES_SQL} SELECT fold::INT AS fold, count(*) AS n, regr_slope(y, x) AS slope,
  regr_intercept(y, x) AS intercept FROM tagged WHERE split = 'train' GROUP BY fold""", ["slope", "intercept"])
def _(spark, d):
    lines = SF.linear_folds(_line_rows(spark, d), ["aqi"], LABEL, TRAIN, TEST, STEP)
    return lines.select("fold", "n", F.col("coefficients")[0].alias("slope"), "intercept")


@query("fold_line_scores", f"""{LINES_SQL}, lines AS (SELECT fold, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM tagged WHERE split = 'train' GROUP BY fold)
SELECT 'linear' AS model, fold::INT AS fold, split, count(*) AS n, sqrt(avg((y - a * x - b) ** 2)) AS rmse, avg(abs(y - a * x - b)) AS mae,
  1 - avg((y - a * x - b) ** 2) / var_pop(y) AS r2 FROM tagged JOIN lines USING (fold) GROUP BY fold, split""", ["rmse", "mae", "r2"])
def _(spark, d):
    """Scores of the pooled line on the training and test rows of every fold."""
    preds = SF.linear_fold_predictions(_line_rows(spark, d), ["aqi"], LABEL, TRAIN, TEST, STEP)
    return E.regression_metrics(preds, ["model", "fold", "split"]).select("model", "fold", "split", "n", "rmse", "mae", "r2")


def _scored(spark, d, name):
    """Fit on the first 80 % of each series, metrics on both parts."""
    t = training_table(spark, d).where(F.col(LABEL).isNotNull())
    split = FO.chrono_split(M.filled_features(t, FEATURES, LABEL), 0.8)
    if M.needs_validation(name):
        flagged = FO.holdout_tail(split.where(F.col("split") == "train").drop("row_idx"), 0.15, 50)
        train = checkpointed(flagged)
    else:
        train = checkpointed(split.where(F.col("split") == "train"))
    model = M.fit(train, name, FEATURES, LABEL)
    preds = model.transform(M.as_double(split, [*FEATURES, LABEL])).select(
        F.lit(name).alias("model"), "split", F.col(LABEL).alias("y"), "yhat")
    return E.regression_metrics(preds, ["model", "split"])


def _model_query(key, name):
    @query(key)
    def _(spark, d):
        return _scored(spark, d, name)


_model_query("model_dt", "decision_tree")
_model_query("model_rf", "random_forest")
_model_query("model_forest_nb", "forest_nobootstrap")
_model_query("model_gbt", "gradient_boosting")
_model_query("model_gbt_earlystop", "gbt_leafy")


_model_query("model_extra_trees", "extra_trees")
_model_query("model_boost_level", "boost_level")
_model_query("model_boost_leafy", "boost_leafy")
_model_query("model_boost_symmetric", "boost_symmetric")


ROOTS = X.Settings(trees=60, depth=1)
ROOT_FEATURES = ("aqi", "pm10", "temperature", "humidity")
_WIDE = " UNION ALL ".join(f"SELECT {i} AS j, '{c}' AS name, {c}::DOUBLE AS x, y FROM ok" for i, c in enumerate(ROOT_FEATURES))


@query("extra_trees_roots", f"""WITH {targets_sql()},
ok AS (SELECT *, floor(aqi_24h * {X.UNIT} + 0.5)::BIGINT AS y FROM targets
  WHERE aqi_24h IS NOT NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in ROOT_FEATURES)}),
wide AS ({_WIDE}), ranges AS (SELECT j, name, min(x) AS low, max(x) AS high FROM wide GROUP BY j, name HAVING min(x) < max(x)),
drawn AS (SELECT tree, j, name, low, high, md5('{ROOTS.seed}:' || tree || ':1:' || j) AS h FROM ranges, (SELECT unnest(range({ROOTS.trees})) AS tree)),
cuts AS (SELECT *, low + (('0x' || h[1:13])::BIGINT / {1 << 52}) * (high - low) AS cut FROM drawn
  QUALIFY row_number() OVER (PARTITION BY tree ORDER BY h[14:26]) <= {ROOTS.candidates(len(ROOT_FEATURES))}),
sides AS (SELECT tree, j, name, cut, count(*) AS n, sum(CASE WHEN x <= cut THEN 1 ELSE 0 END)::DOUBLE AS a,
    sum(CASE WHEN x <= cut THEN y ELSE 0 END)::DOUBLE / {X.UNIT} AS b, sum(y)::DOUBLE / {X.UNIT} AS s,
    (sum(y) - sum(CASE WHEN x <= cut THEN y ELSE 0 END))::DOUBLE / {X.UNIT} AS c FROM cuts JOIN wide USING (j, name) GROUP BY tree, j, name, cut),
won AS (SELECT *, b * b / a + c * c / (n - a) - s * s / n AS gain FROM sides WHERE a >= {ROOTS.min_leaf} AND n - a >= {ROOTS.min_leaf}
  QUALIFY row_number() OVER (PARTITION BY tree ORDER BY gain DESC, j) = 1)
SELECT tree::INT AS tree, n, name AS feature, cut, gain FROM won WHERE gain > 0""", ["cut", "gain"])
def _(spark, d):
    """First cut of every tree of a forest: keyed draws between least and greatest values, the best by variance."""
    t = targets_grid(spark, d).select(*ROOT_FEATURES, LABEL).na.drop()
    nodes = X.fit_extra_trees(t, ROOT_FEATURES, LABEL, ROOTS).nodes().where("node = 1 AND feature >= 0")
    names = F.array(*map(F.lit, ROOT_FEATURES))
    return nodes.select("tree", "n", names[F.col("feature")].alias("feature"), "cut", "gain")


@query("model_linear", f"""WITH {targets_sql('station')}, ok AS (SELECT * FROM targets WHERE aqi IS NOT NULL AND aqi_24h IS NOT NULL)
SELECT round(regr_slope(aqi_24h, aqi), 4) AS slope, round(regr_intercept(aqi_24h, aqi), 4) AS intercept, count(*) AS n FROM ok""",
       ["slope", "intercept"])
def _(spark, d):
    """One-feature least squares: slope and intercept."""
    t = targets_grid(spark, d, "station").select("series_id", "ts", "aqi", "aqi_24h").na.drop()
    t = checkpointed(t)
    line = M.fit(t, "linear", ["aqi"], "aqi_24h").stages[-1]
    return t.agg(F.count(F.lit(1)).alias("n")).select(
        F.round(F.lit(float(line.coefficients[0])), 4).alias("slope"), F.round(F.lit(float(line.intercept)), 4).alias("intercept"), "n")


@query("baseline_naive", f"""WITH {panel_sql('station')}, idx AS (SELECT series_id, ts, pm2_5,
    row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM panel),
m AS (SELECT avg(pm2_5) AS yhat FROM idx WHERE i < floor(0.8 * n))
SELECT 'naive_mean' AS model, count(*) AS n, sqrt(avg((pm2_5 - yhat) * (pm2_5 - yhat))) AS rmse,
  1 - avg((pm2_5 - yhat) * (pm2_5 - yhat)) / var_pop(pm2_5) AS r2 FROM idx, m WHERE i >= floor(0.8 * idx.n)""", ["rmse", "r2"])
def _(spark, d):
    split = FO.chrono_split(hourly_panel(spark, d, "station").select("series_id", "ts", "pm2_5"))
    return E.regression_metrics(M.naive_predictions(split, "pm2_5"), ["model"]).select("model", "n", "rmse", "r2")


@query("baseline_models")
def _(spark, d):
    return M.baseline_report(training_table(spark, d), CORE, LABEL)


@query("predict_batch")
def _(spark, d):
    t = training_table(spark, d)
    models = M.train_final(t, ("linear", "decision_tree", "extra_trees"), FEATURES, LABEL)
    return M.predict_batch(t, models, FEATURES, ensembles={"blend": ["linear", "decision_tree", "extra_trees"]})


@query("predict_batch_rows", f"""WITH {aqi_grid_sql()}
SELECT m AS model, series_id, ts, true AS predicted FROM aqi_grid, (VALUES ('linear'), ('decision_tree'), ('blend')) v(m)""")
def _(spark, d):
    """Which rows a batch scores: all of them, once per model and once for the blend."""
    t = training_table(spark, d)
    models = M.train_final(t, ("linear", "decision_tree"), CORE, LABEL)
    preds = M.predict_batch(t, models, CORE, ensembles={"blend": ["linear", "decision_tree"]})
    return preds.select("model", "series_id", "ts", F.col("yhat").isNotNull().alias("predicted"))


@query("model_importance")
def _(spark, d):
    t = training_table(spark, d)
    models = M.train_final(t, ("decision_tree", "extra_trees"), FEATURES, LABEL)
    parts = [M.importances(m, FEATURES, name, spark) for name, m in models.items()]
    return E.top_k_features(parts[0].unionByName(parts[1]), 5)


@query("train_run")
def _(spark, d):
    """Whole training run of one horizon, models saved and a registry row returned."""
    return M.run_training(training_table(spark, d), 24, FEATURES, RUN_MODELS, train=TRAIN, test=TEST,
                          step=STEP, model_path=f"{scratch_dir(spark)}/models_24h").drop("description")


@query("forecast_horizons")
def _(spark, d):
    """Latest row per city -> one forecast per horizon, each by the model that does best on the last fifth."""
    from hazegrid.sources.stores import snapshot_tail

    t = training_table(spark, d)
    models = {}
    for h in K.HORIZONS:
        label, names = f"aqi_{h}h", ("linear", "decision_tree")
        split = checkpointed(FO.chrono_split(M.filled_features(t.where(F.col(label).isNotNull()), FEATURES, label), 0.8))
        fitted = {n: M.fit(split.where("split = 'train'"), n, FEATURES, label) for n in names}
        preds = [m.transform(M.as_double(split, [*FEATURES, label])).select(F.lit(n).alias("model"), F.lit(0).alias("fold"), "split", F.col(label).alias("y"), "yhat") for n, m in fitted.items()]
        scores = E.generalization(E.regression_metrics(preds[0].unionByName(preds[1]), ["model", "fold", "split"]))
        best = E.best_model(scores, order=names).first().best_model
        models[h] = M.train_final(t, (best,), FEATURES, label)[best]
    latest = snapshot_tail(t, ["series_id"], FEATURES, 1)
    return M.forecast(latest, models, {h: FEATURES for h in K.HORIZONS})
