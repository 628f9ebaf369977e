"""Evaluation of predictions, rankings of models and features, the model registry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazegrid.functions.names import model_format, parse_best_model
from hazegrid.plans.attach import attach, join_null_safe
from hazegrid.plans.quantiles import exact_quantiles

METRICS = ("rmse", "mae", "r2", "mse", "mape")


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def regression_metrics(preds: DataFrame, by: Sequence[str], y: str = "y", yhat: str = "yhat") -> DataFrame:
    """mse, rmse, mae, r2, mape and the mean / population std of the predictions per group, over
    finite pairs, in one aggregation. Groups without any give inf and -inf."""
    a, p = F.col(y).cast("double"), F.col(yhat).cast("double")
    ok = _finite(a) & _finite(p)
    a, p = F.when(ok, a), F.when(ok, p)
    inf = F.lit(float("inf"))
    stats = preds.groupBy(*by).agg(
        F.count(a).alias("n"),
        F.count(F.lit(1)).alias("size"),
        F.avg((a - p) * (a - p)).alias("_mse"),
        F.avg(F.abs(a - p)).alias("_mae"),
        F.var_pop(a).alias("_var"),
        F.avg(F.when(a != 0, F.abs((a - p) / a))).alias("_mape"),
        F.stddev_pop(p).alias("_std"),
        F.avg(p).alias("_mean"),
    )
    r2 = F.when(F.col("_var") > 0, 1 - F.col("_mse") / F.col("_var")).when(F.col("_mse") == 0, 1.0).otherwise(0.0)
    none = F.col("n") == 0
    return stats.select(
        *by, "n", "size",
        F.when(none, inf).otherwise(F.sqrt("_mse")).alias("rmse"),
        F.when(none, inf).otherwise(F.col("_mae")).alias("mae"),
        F.when(none, -inf).otherwise(r2).alias("r2"),
        F.when(none, inf).otherwise(F.col("_mse")).alias("mse"),
        F.when(none, inf).otherwise(F.coalesce(F.col("_mape") * 100, inf)).alias("mape"),
        F.coalesce("_std", F.lit(0.0)).alias("std"),
        F.coalesce("_mean", F.lit(0.0)).alias("mean"),
    )


def generalization(fold_metrics: DataFrame, flat_below: float = 3.0) -> DataFrame:
    """Per model: mean fold metrics by split, spread of all test predictions (from the fold
    moments), sizes and the Good / Poor verdict. Input: one row per (model, fold, split)."""
    train, test = F.col("split") == "train", F.col("split") == "test"
    sizes = F.when(train, F.col("size"))
    n = F.sum(F.when(test, F.col("n")))
    total = F.sum(F.when(test, F.col("n") * F.col("mean")))
    square = F.sum(F.when(test, F.col("n") * (F.col("std") * F.col("std") + F.col("mean") * F.col("mean"))))
    out = fold_metrics.groupBy("model").agg(
        F.sqrt(F.greatest(F.try_divide(square, n) - F.try_divide(total, n) * F.try_divide(total, n), F.lit(0.0))).alias("std_pred"),
        *[F.avg(F.when(train, F.col(m))).alias(f"avg_train_{m}") for m in METRICS],
        *[F.avg(F.when(test, F.col(m))).alias(f"avg_test_{m}") for m in METRICS],
        F.avg(sizes).alias("avg_train_size"),
        F.max_by(sizes, F.when(train, F.col("fold"))).alias("final_train_size"),
    )
    good = F.col("std_pred") > flat_below
    return out.select(
        "*", good.alias("std_check_passed"), F.when(good, "Good").otherwise("Poor").alias("prediction_quality")
    )


def prediction_summary(preds: DataFrame, ensembles: Sequence[str] = ()) -> DataFrame:
    stats = preds.groupBy("model").agg(
        F.avg("yhat").alias("mean_prediction"),
        F.stddev_pop("yhat").alias("std_prediction"),
        F.min("yhat").alias("min_prediction"),
        F.max("yhat").alias("max_prediction"),
        F.count("yhat").alias("prediction_count"),
    )
    q = exact_quantiles(preds, ["model"], ["yhat"], [0.25, 0.5, 0.75]).select(
        "model", F.col("yhat")[0].alias("q25_prediction"), F.col("yhat")[1].alias("median_prediction"),
        F.col("yhat")[2].alias("q75_prediction"),
    )
    kind = F.when(F.col("model").isin(list(ensembles)), "ensemble").otherwise("individual")
    return join_null_safe(stats, q, ["model"], "inner").withColumn("model_type", kind).orderBy(F.col("mean_prediction").desc(), "model")


def ensemble_mean(preds: DataFrame, members: Sequence[str], name: str, by: Sequence[str], at_least: int = 1) -> DataFrame:
    """Average of the members that predicted a row, if at least ``at_least`` did."""
    return (
        preds.where(F.col("model").isin(list(members)) & F.col("yhat").isNotNull())
        .groupBy(*by)
        .agg(F.avg("yhat").alias("yhat"), F.count_distinct("model").alias("members"))
        .where(F.col("members") >= at_least)
        .select(F.lit(name).alias("model"), *by, "yhat", "members")
    )


def top_k_features(scores: DataFrame, k: int, by: Sequence[str] = ("model",), score: str = "score") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), "feature")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hybrid_scores(mi: DataFrame, rf: DataFrame, splits: int, k: int, by: Sequence[str] = ()) -> DataFrame:
    """(sum of fold scores / splits) of both scorers, averaged; a scorer that never chose a
    feature counts 0. Input: (by.., feature, fold, score)."""
    tagged = mi.select(*by, "feature", F.col("score").alias("mi"), F.lit(0.0).alias("rf")).unionByName(
        rf.select(*by, "feature", F.lit(0.0).alias("mi"), F.col("score").alias("rf"))
    )
    total = tagged.groupBy(*by, "feature").agg(
        ((F.sum("mi") / splits + F.sum("rf") / splits) / 2).alias("hybrid_score"), F.count(F.lit(1)).alias("times_chosen")
    )
    if by:
        return top_k_features(total, k, by, "hybrid_score")
    return total.orderBy(F.col("hybrid_score").desc(), "feature").limit(k)


def best_model(metrics: DataFrame, by: Sequence[str] = (), order: Sequence[str] = (), score: str = "avg_test_r2") -> DataFrame:
    """Model with the highest score per group; on ties the first in ``order`` (then by name)."""
    place = F.lit(len(order))
    for i, m in reversed(list(enumerate(order))):
        place = F.when(F.col("model") == m, i).otherwise(place)
    best = F.min(F.struct((-F.col(score)).alias("s"), place.alias("o"), F.col("model").alias("m")))
    return metrics.where(F.col(score).isNotNull()).groupBy(*by).agg(best.alias("b")).select(
        *by, F.col("b.m").alias("best_model"), (-F.col("b.s")).alias(f"best_{score}")
    )


def latest_model_version(registry: DataFrame, keys: Sequence[str] = ("name",)) -> DataFrame:
    """Per name the production-tagged version, else the latest-tagged, else the highest. The
    highest version wins within a tag; copies fold before the shuffle."""
    rest = [c for c in registry.columns if c not in (*keys, "version")]
    rank = F.when(F.col("tag") == "production", 0).when(F.col("tag") == "latest", 1).otherwise(2)
    best = F.min(F.struct(rank.alias("_r"), (-F.col("version")).alias("_v"), *rest))
    return registry.groupBy(*keys).agg(best.alias("_b")).select(
        *keys, (-F.col("_b._v")).alias("version"), *[F.col(f"_b.{c}") for c in rest]
    )


def registry_summary(registry: DataFrame, features: DataFrame, keys: Sequence[str] = ("name",)) -> DataFrame:
    """Served version per horizon with model type, file format and number of features."""
    served = latest_model_version(registry, keys)
    kind = parse_best_model(F.col("description"))
    counts = features.groupBy("name").agg(F.count_distinct("feature").alias("features_count"))
    horizon = F.regexp_extract("name", r"(\d+)h", 1).cast("int")
    return attach(served, counts, ["name"]).select(
        *keys, horizon.alias("horizon"), "version", kind.alias("model_type"), model_format(kind).alias("model_format"),
        F.coalesce("features_count", F.lit(0)).alias("features_count"), "updated_at",
    )
