"""Model selection, validation and scoring with Spark ML.

Extra trees are grown by ``extratrees``, the three kinds of boosted trees of the single-machine pipeline by ``boost``;
``gbt_*`` are presets of Spark ML's ``GBTRegressor``. Fits run on the pooled rows of all series.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazegrid import constants as K
from hazegrid.operators import bagging as G
from hazegrid.operators import boost as B
from hazegrid.operators import evaluate as E
from hazegrid.operators import extratrees as X
from hazegrid.operators import folds as FO
from hazegrid.operators import profile as P
from hazegrid.operators import slidefit as SF
from hazegrid.operators.clean import clip_iqr, ffill, fill_both
from hazegrid.plans.attach import attach
from hazegrid.session import checkpointed

KEY = ("series_id",)
FITS_AT_ONCE = 4  # single trees of several folds, importances, and kinds of models are worked out side by side, since each has many short jobs
FOLDS_AT_ONCE = 16  # forests of so many folds are grown together (about 9 MB each at full settings)

# Tuned settings per model. A depth of 30 is the most that Spark ML grows.
PRESETS = {
    "linear": dict(kind="linear"),
    "decision_tree": dict(kind="tree", maxDepth=15, minInstancesPerNode=5),
    "random_forest": dict(kind="forest", numTrees=200, maxDepth=15, minInstancesPerNode=2),
    "forest_baseline": dict(kind="forest", numTrees=50, maxDepth=5),
    "forest_importance": dict(kind="forest", numTrees=100, maxDepth=30),
    "forest_nobootstrap": dict(kind="forest", numTrees=251, maxDepth=9, minInstancesPerNode=20, bootstrap=False,
                               featureSubsetStrategy="0.6449383229836702"),
    "extra_trees": dict(kind="extra", trees=251, depth=9, min_leaf=20, min_split=10, share=0.6449383229836702),
    "boost_symmetric": dict(kind="boost", way="symmetric", rounds=672, depth=7, rate=0.018212208878911028, l2=1.8344212761367933,
                            rows=0.6076978090537759),
    "boost_level": dict(kind="boost", way="level", rounds=738, depth=6, rate=0.050902082752918125, l1=3.623661367173843,
                        l2=2.3632955886312637, rows=0.728994202987864, features=0.7490071788934142),
    "boost_leafy": dict(kind="boost", way="leafy", rounds=500, depth=6, rate=0.05, l1=0.1, l2=0.1, rows=0.8, features=0.8, least=20),
    "gradient_boosting": dict(kind="gbt", maxIter=115, maxDepth=3, stepSize=0.1436659003499937, minInstancesPerNode=2),
    "gbt_deep_slow": dict(kind="gbt", maxIter=672, maxDepth=7, stepSize=0.018212208878911028,
                          subsamplingRate=0.6076978090537759, early=True),
    "gbt_deep": dict(kind="gbt", maxIter=738, maxDepth=6, stepSize=0.050902082752918125,
                     subsamplingRate=0.728994202987864, early=True),
    "gbt_leafy": dict(kind="gbt", maxIter=500, maxDepth=6, stepSize=0.05, subsamplingRate=0.8,
                      minInstancesPerNode=20, early=True),
}
ENSEMBLES = {"ensemble_mean3": ["boost_symmetric", "boost_level", "extra_trees"]}
SEED = 42


def estimator(name: str, features: Sequence[str], label: str, presets: Mapping | None = None, **override) -> Pipeline:
    """Imputer (medians of the rows it is fitted on) -> vector -> regressor."""
    spec = {**(presets or PRESETS)[name], **override}
    kind, early = spec.pop("kind"), spec.pop("early", False)
    io = dict(featuresCol="features", labelCol=label, predictionCol="yhat")
    if kind == "linear":
        model = LinearRegression(**io, **spec)
    else:
        cls = {"tree": DecisionTreeRegressor, "forest": RandomForestRegressor, "gbt": GBTRegressor}[kind]
        if early:
            spec["validationIndicatorCol"] = "is_validation"
        if kind == "forest":  # else every pass walks all rows through all trees and sends the trees with it
            spec["cacheNodeIds"] = True
        model = cls(**io, seed=SEED, **spec)
    filled = [f"_x{i}" for i in range(len(features))]
    return Pipeline(
        stages=[
            Imputer(inputCols=list(features), outputCols=filled, strategy="median"),
            VectorAssembler(inputCols=filled, outputCol="features", handleInvalid="keep"),
            model,
        ]
    )


def as_double(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) if c in cols else F.col(c) for c in df.columns])


def needs_validation(name: str, presets: Mapping | None = None) -> bool:
    spec = (presets or PRESETS)[name]
    return bool(spec.get("early")) or spec["kind"] == "boost"


def trees_of(name: str, presets: Mapping | None = None) -> X.Settings | None:
    """Settings of an extra-trees preset, None for other kinds."""
    spec = dict((presets or PRESETS)[name])
    return X.Settings(**spec, seed=SEED) if spec.pop("kind") == "extra" else None


def boosting_of(name: str, presets: Mapping | None = None) -> B.Boosting | None:
    spec = dict((presets or PRESETS)[name])
    return B.Boosting(**spec, seed=SEED) if spec.pop("kind") == "boost" else None


def fit(df: DataFrame, name: str, features: Sequence[str], label: str, presets: Mapping | None = None) -> PipelineModel | X.ExtraTrees | B.Boosted:
    """Fit on rows with a label; early-stopped models read ``is_validation``."""
    if boosting_of(name, presets):
        return B.fit_boosted(df, features, label, boosting_of(name, presets), validation="is_validation" if "is_validation" in df.columns else None)
    if trees_of(name, presets):
        return X.fit_extra_trees(df, features, label, trees_of(name, presets))
    extra = [F.col("is_validation")] if "is_validation" in df.columns else []
    rows = as_double(df.select(*features, label, *extra), [*features, label]).where(F.col(label).isNotNull())
    if (presets or PRESETS)[name]["kind"] == "forest":  # every part of the rows sends numbers for every open node
        rows = rows.repartition(df.sparkSession.sparkContext.defaultParallelism)
    return estimator(name, features, label, presets).fit(rows)


def side_by_side(spark: SparkSession, jobs: Sequence[Callable], at_once: int = FITS_AT_ONCE) -> list:
    """Results of the jobs in their order; up to ``at_once`` of them run at a time."""
    if at_once < 2 or len(jobs) < 2:
        return [job() for job in jobs]
    with ThreadPool(min(at_once, len(jobs))) as pool:
        return pool.map(lambda job: inheritable_thread_target(spark)(job)(), jobs, chunksize=1)


def importances(model: PipelineModel, features: Sequence[str], name: str, spark: SparkSession) -> DataFrame:
    """Feature importances (one row per feature column)."""
    if isinstance(model, (X.ExtraTrees, B.Boosted)):
        return model.importances(name)
    last = model.stages[-1]
    values = last.featureImportances if hasattr(last, "featureImportances") else None
    if values is None:
        return spark.createDataFrame([], "model string, feature string, score double")
    rows = [(name, f, float(v)) for f, v in zip(features, values.toArray())]
    return spark.createDataFrame(rows, "model string, feature string, score double")


def bagging_of(name: str, presets: Mapping | None = None) -> G.Bagging:
    """Settings of a forest preset as bagged trees whose nodes are not kept."""
    spec = dict((presets or PRESETS)[name])
    known = dict(numTrees="trees", maxDepth="depth", minInstancesPerNode="min_leaf", bootstrap="bootstrap")
    return G.Bagging(**{known[k]: v for k, v in spec.items() if k != "kind"}, seed=SEED)


def rf_importance(df: DataFrame, features: Sequence[str], label: str, k: int = 15, presets: Mapping | None = None) -> DataFrame:
    """Only the importances of the forest are kept; its nodes, about as many as drawn rows, never stand in the driver."""
    shares = G.importances(df, features, label, bagging_of("forest_importance", presets))
    rows = [("forest_importance", f, float(v)) for f, v in zip(features, shares)]
    return E.top_k_features(df.sparkSession.createDataFrame(rows, "model string, feature string, score double"), k)


def hybrid_select(df: DataFrame, features: Sequence[str], label: str, k: int, splits: int = 3,
                  keys: Sequence[str] = KEY, ts: str = "ts", presets: Mapping | None = None) -> DataFrame:
    """Mutual information and forest importance on expanding folds, averaged, best ``k``."""
    placed = checkpointed(FO.assign_expanding(df.where(F.col(label).isNotNull()), splits, keys, ts))
    train = placed.where(F.col("split") == "train")
    mi = E.top_k_features(P.mutual_info(train, features, label, by=["fold"]), k, ["fold"])
    rf = side_by_side(df.sparkSession, [
        lambda fold=fold: rf_importance(train.where(F.col("fold") == fold), features, label, k, presets)
        .select("feature", F.lit(fold).alias("fold"), "score")
        for fold in range(splits)
    ])
    return E.hybrid_scores(mi.select("feature", "fold", "score"), reduce(DataFrame.unionByName, rf), splits, k)


def selection_stages(df: DataFrame, features: Sequence[str], label: str, k: int, keys: Sequence[str] = KEY,
                     ts: str = "ts", presets: Mapping | None = None, min_rows: int = 100, min_null_share: float = 0.5,
                     threshold: float = 0.85) -> tuple[DataFrame, list[str]]:
    """Nulls < half -> variance -> clip -> correlation -> hybrid scores. Returns the number of
    features after each stage and the chosen names; only names and counts reach the driver."""
    spark, names = df.sparkSession, list(features)
    counts = [("initial", len(names))]

    def stop():
        return spark.createDataFrame(counts, "stage string, features int"), []

    nulls = P.null_profile(df, names).where(F.col("null_pct") < min_null_share).collect()
    names = [f for f in names if f in {r.feature for r in nulls}]
    counts.append(("missing_filter", len(names)))
    if not names:
        return stop()
    var = P.column_stats(df, names, variance=F.var_samp).where(F.col("variance") > 1e-6).collect()
    names = [f for f in names if f in {r.feature for r in var}]
    counts.append(("variance_filter", len(names)))
    if not names:
        return stop()
    clipped = checkpointed(clip_iqr(as_double(df.select(*keys, ts, label, *names), [label, *names]), names, keys=keys))
    if len(names) > 1:
        pairs = P.corr_pairs(fill_both(clipped, names, keys, ts), names)
        lost = P.prune_correlated_by_target(pairs, P.target_correlations(clipped, names, label), threshold).collect()
        names = [f for f in names if f not in {r.feature for r in lost}]
    counts.append(("correlation_filter", len(names)))
    if not names or clipped.where(F.col(label).isNotNull()).limit(min_rows).count() < min_rows:
        return stop()
    chosen = [r.feature for r in hybrid_select(clipped, names, label, k, keys=keys, ts=ts, presets=presets).collect()]
    counts.append(("selected", len(chosen)))
    return spark.createDataFrame(counts, "stage string, features int"), chosen


def filled_features(df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str] = KEY, ts: str = "ts",
                    fill_label: bool = False) -> DataFrame:
    """Features carried forward within each series; leading gaps stay null and take the medians
    of the training rows. Neither looks ahead. The label is left alone unless asked for."""
    cols = [*features, label] if fill_label else list(features)
    return ffill(as_double(df.select(*keys, ts, *features, label), [*features, label]), cols, None, keys, ts)


def fit_eval_folds(df: DataFrame, models: Sequence[str], features: Sequence[str], label: str, train: int = K.CV_TRAIN,
                   test: int = K.CV_TEST, step: int = K.CV_STEP, keys: Sequence[str] = KEY, ts: str = "ts",
                   presets: Mapping | None = None, ensembles: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Predictions of every model on every sliding fold, as one long table with ``split``.

    Linear models are fitted on all folds at once from block moments; leading gaps then take the fold's training
    means. Extra trees and boosted trees are grown for ``FOLDS_AT_ONCE`` folds together. For the others the fold-assigned rows are written
    once, and each fit reads its fold from there. ``ensembles`` average at least two of their members on the test rows.
    """
    filled = checkpointed(filled_features(df, features, label, keys, ts))
    lines = [name for name in models if (presets or PRESETS)[name]["kind"] == "linear"]
    out = [SF.linear_fold_predictions(filled, features, label, train, test, step, keys, ts, name=name) for name in lines]
    models = [name for name in models if name not in lines]
    forests = {name: trees_of(name, presets) for name in models if trees_of(name, presets)}
    boosted = {name: boosting_of(name, presets) for name in models if boosting_of(name, presets)}
    models = [name for name in models if name not in forests and name not in boosted]
    tagged = checkpointed(FO.assign_folds(filled, train, test, step, keys, ts))
    n_folds = tagged.agg(F.max("fold").alias("m")).first().m
    if n_folds is None:
        raise ValueError(f"not enough rows for one fold of {train} + {test}")
    size = max(int(0.15 * train), 50) if train > 100 else 0
    first = tagged.where(F.col("split") == "train").groupBy(*keys, "fold").agg(F.max("row_idx").alias("_top"))
    flagged = attach(tagged, first, [*keys, "fold"]).withColumn(
        "is_validation", (F.col("split") == "train") & (F.col("row_idx") > F.col("_top") - size)
    )
    spark, folds = df.sparkSession, [flagged.where(F.col("fold") == fold) for fold in range(n_folds + 1)]

    def predicted(model, part: DataFrame, name: str) -> DataFrame:
        return model.transform(part).select(F.lit(name).alias("model"), "fold", "split", *keys, ts, F.col(label).alias("y"), "yhat")

    def one(part: DataFrame, name: str) -> DataFrame:
        return predicted(fit(part.where(F.col("split") == "train"), name, features, label, presets), as_double(part, [*features, label]), name)

    def grown(name: str) -> list[DataFrame]:
        parts = []
        for start in range(0, n_folds + 1, FOLDS_AT_ONCE):
            part = flagged.where(F.col("fold").between(start, start + FOLDS_AT_ONCE - 1))
            rows = part.where(F.col("split") == "train")
            model = X.fit_extra_trees(rows, features, label, forests[name], group="fold") if name in forests else B.fit_boosted(
                rows, features, label, boosted[name], "fold", "is_validation")
            parts.append(predicted(model, part, name))
        return parts

    bagged = [name for name in models if (presets or PRESETS)[name]["kind"] == "forest"]  # of these the driver holds one at a time
    lanes = [lambda: side_by_side(spark, [lambda part=part, name=name: one(part, name) for part in folds for name in models if name not in bagged])]
    lanes += [lambda: [checkpointed(one(part, name)) for part in folds for name in bagged]]
    lanes += [lambda name=name: grown(name) for name in [*boosted, *forests]]
    for parts in side_by_side(spark, lanes):
        out += parts
    preds = checkpointed(reduce(DataFrame.unionByName, out))
    for name, members in (ensembles or {}).items():
        tests = preds.where(F.col("split") == "test")
        preds = preds.unionByName(E.ensemble_mean(tests, members, name, ["fold", "split", *keys, ts, "y"], 2).drop("members"))
    return preds


def train_final(df: DataFrame, models: Sequence[str], features: Sequence[str], label: str, keys: Sequence[str] = KEY,
                ts: str = "ts", presets: Mapping | None = None, fill: bool = True) -> dict[str, PipelineModel]:
    """Every model on all rows; early-stopped ones hold out the last fifth of each series."""
    base = filled_features(df, features, label, keys, ts) if fill else as_double(
        df.select(*keys, ts, *features, label), [*features, label])
    flagged = checkpointed(FO.holdout_tail(base, 0.2, 100, 0, keys, ts))
    bagged = [name for name in models if (presets or PRESETS)[name]["kind"] == "forest"]
    lanes = [[name] for name in models if name not in bagged] + [bagged]
    fitted = side_by_side(df.sparkSession, [lambda lane=lane: {name: fit(flagged, name, features, label, presets) for name in lane} for lane in lanes])
    by_name = {name: model for lane in fitted for name, model in lane.items()}
    return {name: by_name[name] for name in models}


def save_models(models: Mapping[str, PipelineModel], path: str) -> None:
    for name, model in models.items():
        if isinstance(model, (X.ExtraTrees, B.Boosted)):
            model.save(f"{path}/{name}")
        else:
            model.write().overwrite().save(f"{path}/{name}")


def load_models(path: str, names: Sequence[str], presets: Mapping | None = None) -> dict[str, PipelineModel | X.ExtraTrees | B.Boosted]:
    spark = SparkSession.getActiveSession()

    def one(name: str):
        if trees_of(name, presets):
            return X.ExtraTrees.load(spark, f"{path}/{name}")
        return B.Boosted.load(spark, f"{path}/{name}") if boosting_of(name, presets) else PipelineModel.load(f"{path}/{name}")

    return {name: one(name) for name in names}


def predict_batch(df: DataFrame, models: Mapping[str, PipelineModel], features: Sequence[str], keys: Sequence[str] = KEY,
                  ts: str = "ts", ensembles: Mapping[str, Sequence[str]] | None = None, fill: bool = True) -> DataFrame:
    """Long predictions of every model and of ensembles with at least two members present.
    Missing feature columns become null and take the training median; remaining gaps too."""
    have = [f for f in features if f in df.columns]
    if not have:
        raise ValueError("no required features found in new data")
    whole = df.select(*keys, ts, *[F.col(f).cast("double").alias(f) if f in have else F.lit(None).cast("double").alias(f)
                                   for f in features])
    base = checkpointed(ffill(whole, have, None, keys, ts) if fill else whole)  # as in training
    parts = [
        m.transform(base).select(F.lit(name).alias("model"), *keys, ts, "yhat") for name, m in models.items()
    ]
    preds = reduce(DataFrame.unionByName, parts)
    for name, members in (ensembles or {}).items():
        preds = preds.unionByName(E.ensemble_mean(reduce(DataFrame.unionByName, parts), members, name, [*keys, ts], 2).drop("members"))
    return preds


def baseline_report(df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str] = KEY, ts: str = "ts",
                    models: Sequence[str] = ("linear", "forest_baseline"), min_rows: int = 100,
                    presets: Mapping | None = None) -> DataFrame:
    """Chronological 80/20 on complete rows: r2 and rmse of each model and of the training mean."""
    clean = df.select(*keys, ts, *features, label).na.drop()
    split = checkpointed(FO.chrono_split(as_double(clean, [*features, label]), 0.8, keys, ts))
    if split.limit(min_rows).count() < min_rows:
        raise ValueError("not enough complete rows for a baseline")
    train, test = split.where(F.col("split") == "train"), split.where(F.col("split") == "test")
    parts = [naive_predictions(split, label)]
    for name in models:
        parts.append(fit(train, name, features, label, presets).transform(test).select(
            F.lit(name).alias("model"), F.col(label).alias("y"), "yhat"))
    metrics = E.regression_metrics(reduce(DataFrame.unionByName, parts), ["model"])
    facts = split.agg(
        F.avg(F.when(F.col("split") == "test", F.col(label))).alias("target_mean"),
        F.stddev_samp(F.when(F.col("split") == "test", F.col(label))).alias("target_std"),
        F.count_if(F.col("split") == "train").alias("train_size"),
        F.count_if(F.col("split") == "test").alias("test_size"),
    )
    return attach(metrics.select("model", "r2", "rmse"), facts, [])


def naive_predictions(split: DataFrame, label: str) -> DataFrame:
    """Test rows predicted by the mean of the training rows."""
    mean = split.where(F.col("split") == "train").agg(F.avg(label).alias("yhat"))
    return attach(split.where(F.col("split") == "test").select(F.lit("naive_mean").alias("model"), F.col(label).alias("y")), mean, [])


def baseline_row(df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str] = KEY, ts: str = "ts",
                 presets: Mapping | None = None) -> DataFrame:
    """The baseline report as one row of ``baseline_*``; too few complete rows give nulls and stop no run."""
    named = {"linear": "linear", "forest_baseline": "forest", "naive_mean": "naive"}
    try:
        report = baseline_report(df, features, label, keys, ts, presets={**PRESETS, **(presets or {})})
    except ValueError:
        report = df.sparkSession.createDataFrame([], "model string, r2 double, rmse double, target_mean double, target_std double, train_size long, test_size long")
    return report.agg(
        *[F.max(F.when(F.col("model") == m, F.col(c))).alias(f"baseline_{short}_{c}") for m, short in named.items() for c in ("r2", "rmse")],
        *[F.max(c).alias(f"baseline_{c}") for c in ("target_mean", "target_std", "train_size", "test_size")],
    )


def run_training(df: DataFrame, horizon: int, features: Sequence[str], models: Sequence[str], label: str | None = None,
                 train: int = K.CV_TRAIN, test: int = K.CV_TEST, step: int = K.CV_STEP, keys: Sequence[str] = KEY,
                 ts: str = "ts", presets: Mapping | None = None, max_features: int | None = None,
                 model_path: str | None = None, ensembles: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Quality -> selection -> leakage -> baseline -> folds -> final fit -> one registry row for the best model.

    Targets of the other horizons never become features. ``ensembles`` (by default ``ENSEMBLES``) are scored on the folds
    beside the models and may be the best; they have no scores on training rows. The row holds the baselines' scores too.
    """
    label = label or f"aqi_{horizon}h"
    ensembles = ENSEMBLES if ensembles is None else ensembles
    spark = df.sparkSession
    usable = [f for f in features if not f.startswith("aqi_") or not f[4:].rstrip("h").isdigit()]
    base = checkpointed(df.select(*keys, ts, *usable, label))
    issues = P.quality_issues(base, label, usable).count()
    stages, chosen = selection_stages(base, usable, label, max_features or K.FEATURES_KEPT[horizon], keys, ts, presets)
    if not chosen:
        raise ValueError("no feature passed the selection")
    suspects = P.leakage_check(base, chosen, label).where(F.col("high_corr") | F.col("suspicious_name")).count()
    baseline = baseline_row(base, chosen, label, keys, ts, presets)
    preds = fit_eval_folds(base, models, chosen, label, train, test, step, keys, ts, presets, ensembles)
    scores = checkpointed(E.generalization(E.regression_metrics(preds, ["model", "fold", "split"])))
    best = E.best_model(scores, order=[*models, *ensembles])
    finals = train_final(base, models, chosen, label, keys, ts, presets)
    if model_path:
        save_models(finals, model_path)
    sizes = ("avg_train_size", "final_train_size")  # the same for all models; an ensemble has its members'
    joined = attach(best.join(scores, F.col("best_model") == F.col("model")).drop(*sizes), scores.agg(*[F.max(c).alias(c) for c in sizes]), [])
    joined = attach(joined, baseline, [])
    return joined.select(
        F.lit(f"aqi_forecast_model_{horizon}h").alias("name"),
        F.concat(F.lit(f"The best model for {horizon}h is "), F.col("model")).alias("description"),
        F.col("model"),
        *[c for c in scores.columns if c not in ("model", "prediction_quality", "std_check_passed")],
        F.lit(train).alias("train_size"), F.lit(test).alias("test_size"), F.lit(step).alias("step_size"),
        F.lit(len(chosen)).alias("feature_count"), F.lit(issues).alias("quality_issues"), F.lit(suspects).alias("leakage_suspects"),
        *baseline.columns,
    )


def forecast(latest: DataFrame, models: Mapping[int, PipelineModel], features: Mapping[int, Sequence[str]],
             key: str = "series_id") -> DataFrame:
    """Latest feature row per series -> one forecast per horizon. Null or absent features take
    the default of their name; risk is judged on the unrounded value."""
    from hazegrid.functions.aqi import risk_level_strict
    from hazegrid.operators.clean import fill_defaults

    parts = []
    for h, model in sorted(models.items()):
        ready = as_double(fill_defaults(latest, features[h]), list(features[h]))
        parts.append(
            model.transform(ready).select(
                key, F.lit(h).alias("horizon_hours"), F.round("yhat", 2).alias("predicted_aqi"),
                risk_level_strict(F.col("yhat")).alias("risk_level"),
            )
        )
    return reduce(DataFrame.unionByName, parts)
