"""Profiling of columns: nulls, distributions, variance, correlation, quality, leakage."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazegrid.functions.names import suspicious_name
from hazegrid.plans.attach import attach
from hazegrid.plans.quantiles import exact_quantiles
from hazegrid.session import checkpointed



def pearson(x: str, y: str) -> Column:
    """Pearson correlation over the complete pairs; null where either side is constant (the
    built-in ``corr`` divides by zero there)."""
    a = F.when(F.col(y).isNotNull(), F.col(x))
    b = F.when(F.col(x).isNotNull(), F.col(y))
    varied = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return F.when(varied, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def _long(stats: DataFrame, cols: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row of struct columns -> one row per column."""
    entry = [F.struct(F.lit(c).alias("feature"), *[F.col(c)[f].alias(f) for f in fields]) for c in cols]
    return stats.select(F.explode(F.array(*entry)).alias("r")).select("r.*")


def column_stats(df: DataFrame, cols: Sequence[str], **aggs) -> DataFrame:
    """``aggs``: field -> function of a column name giving an aggregate. One job for all columns."""
    wide = df.agg(*[F.struct(*[fn(c).alias(f) for f, fn in aggs.items()]).alias(c) for c in cols])
    return _long(wide, cols, list(aggs))


def null_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    stats = column_stats(
        df, cols, nulls=lambda c: F.count_if(F.col(c).isNull()), total=lambda c: F.count(F.lit(1))
    )
    pct = F.try_divide("nulls", "total")
    return stats.select(
        "feature", "nulls", "total", pct.alias("null_pct"),
        (pct > 0.8).alias("mostly_missing"), (pct < 0.5).alias("kept"),
    )


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    stats = column_stats(
        df, cols, count=F.count, mean=F.avg, std=F.stddev_samp,
        min=lambda c: F.min(c).cast("double"), max=lambda c: F.max(c).cast("double"),
    )
    q = exact_quantiles(df, [], cols, [0.25, 0.5, 0.75])
    entry = [
        F.struct(F.lit(c).alias("feature"), *[F.col(c)[i].alias(n) for i, n in enumerate(("q25", "q50", "q75"))])
        for c in cols
    ]
    quarts = q.select(F.explode(F.array(*entry)).alias("r")).select("r.*")
    return stats.join(quarts, "feature")


def quality_issues(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """Issue list of a training table: one aggregation, then one row per issue found."""
    t = F.col(target)
    facts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(t).alias("n"),
        F.avg(t).alias("mean"),
        F.stddev_samp(t).alias("std"),
        F.count_if(t < 0).alias("negatives"),
        F.max(t).cast("double").alias("top"),
        sum([(F.try_divide(F.count_if(F.col(f).isNull()), F.count(F.lit(1))) > 0.8).cast("int") for f in features], F.lit(0))
        .alias("missing_features"),
    )

    def issue(name: str, hit: Column, value: Column) -> Column:
        return F.when(hit, F.struct(F.lit(name).alias("issue"), value.cast("double").alias("value")))

    empty = F.col("n") == 0
    issues = F.array_compact(
        F.array(
            issue("no_valid_target", empty, F.col("n")),
            issue("low_variance", ~empty & (F.col("std") < 1), F.col("std")),
            issue("negative_values", ~empty & (F.col("negatives") > 0), F.col("negatives")),
            issue("above_500", ~empty & (F.col("top") > 500), F.col("top")),
            issue("no_features", ~empty & F.lit(not features), F.lit(0)),
            issue("features_over_80pct_missing", ~empty & (F.col("missing_features") > 0), F.col("missing_features")),
        )
    )
    return facts.select("mean", "std", "n", F.explode(issues).alias("i")).select(
        F.col("i.issue").alias("issue"), F.col("i.value").alias("value"),
        F.col("mean").alias("target_mean"), F.col("std").alias("target_std"), F.col("n").alias("target_count"),
    )


def variance_profile(df: DataFrame, cols: Sequence[str], threshold: float = 1e-6,
                     protected: Sequence[str] = ()) -> DataFrame:
    stats = column_stats(df, cols, variance=F.var_samp)
    low = F.col("variance").isNull() | (F.col("variance") < threshold)
    return stats.select("feature", "variance", (low & ~F.col("feature").isin(list(protected))).alias("dropped"))


def drop_low_variance(df: DataFrame, cols: Sequence[str], threshold: float = 1e-6,
                      protected: Sequence[str] = ()) -> DataFrame:
    """Schema decision: the list of dropped names (bounded by the columns) reaches the driver."""
    gone = [r.feature for r in variance_profile(df, cols, threshold, protected).where("dropped").collect()]
    return df.drop(*gone)


# --- correlation ------------------------------------------------------------------------


def corr_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Absolute pairwise-complete Pearson correlation of every column pair, ``i`` < ``j`` being
    the column positions; NaN counts as missing, and null stands where either side is constant.

    Each task folds its rows into pair sums (columns squared in size, whatever its rows);
    the sums are added up. Values are shifted by the column means first, for precision."""
    cols = list(cols)
    n = len(cols)
    centre = df.agg(*[F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None))).alias(c) for c in cols]).first()
    shift = np.array([centre[c] if centre[c] is not None else 0.0 for c in cols], dtype=float)
    a, b = np.triu_indices(n, 1)
    added = ("n", "sx", "sy", "sxx", "syy", "sxy")

    def fold(batches):
        import pandas as pd

        sums, low, high = np.zeros((6, n, n)), np.full((n, n), np.inf), np.full((n, n), -np.inf)
        for pdf in batches:
            x = pdf[cols].to_numpy(dtype=float) - shift
            ok = ~np.isnan(x)
            for k in range(n):  # least and greatest value of every column where column k has one
                both = ok & ok[:, [k]]
                low[:, k] = np.minimum(low[:, k], np.where(both, x, np.inf).min(axis=0, initial=np.inf))
                high[:, k] = np.maximum(high[:, k], np.where(both, x, -np.inf).max(axis=0, initial=-np.inf))
            x = np.where(ok, x, 0.0)
            m, sq = ok.astype(float), x * x
            cross = x.T @ m
            square = sq.T @ m
            sums += np.stack([m.T @ m, cross, cross.T, square, square.T, x.T @ x])
        picked = np.concatenate([sums[:, a, b], [low[a, b], high[a, b], low.T[a, b], high.T[a, b]]])
        yield pd.DataFrame({"i": a.astype("int32"), "j": b.astype("int32"),
                            **{name: picked[k] for k, name in enumerate((*added, "lx", "hx", "ly", "hy"))}})

    schema = "i int, j int, " + ", ".join(f"{c} double" for c in (*added, "lx", "hx", "ly", "hy"))
    slim = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    total = slim.mapInPandas(fold, schema).groupBy("i", "j").agg(
        *[F.sum(c).alias(c) for c in added], *[F.min(c).alias(c) for c in ("lx", "ly")], *[F.max(c).alias(c) for c in ("hx", "hy")]
    )
    vx = F.col("sxx") - F.try_divide(F.col("sx") * F.col("sx"), F.col("n"))
    vy = F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), F.col("n"))
    r = F.try_divide(F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), F.col("n")), F.sqrt(vx) * F.sqrt(vy))
    names = F.array(*[F.lit(c) for c in cols])
    return total.select(
        "i", "j", names[F.col("i")].alias("feature_a"), names[F.col("j")].alias("feature_b"),
        F.when((F.col("lx") < F.col("hx")) & (F.col("ly") < F.col("hy")), F.abs(r)).alias("abs_corr"),
    )


def prune_correlated(pairs: DataFrame, threshold: float = 0.85, protected: Sequence[str] = ()) -> DataFrame:
    """Columns that correlate above the threshold with any earlier column."""
    return (
        pairs.where((F.col("abs_corr") > threshold) & ~F.col("feature_b").isin(list(protected)))
        .groupBy(F.col("feature_b").alias("feature"))
        .agg(F.min("j").alias("ordinal"), F.count(F.lit(1)).alias("high_pairs"))
    )


def prune_correlated_by_target(pairs: DataFrame, target_corr: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Of each high pair the column less correlated with the target goes; on ties the earlier
    one. ``target_corr``: (feature, abs_corr). All pairs are judged at once, nothing cascades."""
    a = target_corr.select(F.col("feature").alias("feature_a"), F.col("abs_corr").alias("ta"))
    b = target_corr.select(F.col("feature").alias("feature_b"), F.col("abs_corr").alias("tb"))
    high = pairs.where(F.col("abs_corr") > threshold).join(a, "feature_a", "left").join(b, "feature_b", "left")
    loser = F.when(F.col("tb") >= F.col("ta"), F.col("feature_a")).otherwise(F.col("feature_b"))
    return high.select(loser.alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("lost_pairs"))


def target_correlations(df: DataFrame, features: Sequence[str], target: str, min_variance: float = 1e-9) -> DataFrame:
    """Absolute correlation of each feature with the target; 0 for (near) constant features."""
    stats = column_stats(df, features, corr=lambda c: pearson(c, target), variance=F.var_samp)
    return stats.select(
        "feature", F.when(F.col("variance") > min_variance, F.abs("corr")).otherwise(F.lit(0.0)).alias("abs_corr")
    )


def top_target_correlations(df: DataFrame, features: Sequence[str], target: str, k: int = 20) -> DataFrame:
    scored = target_correlations(df, features, target).where(F.col("abs_corr") > 0)
    return scored.orderBy(F.col("abs_corr").desc(), "feature").limit(k)


def leakage_check(df: DataFrame, features: Sequence[str], target: str, threshold: float = 0.85) -> DataFrame:
    """Per feature: correlation over the rows complete in all of them, and whether it or its
    name looks like leakage; with the largest and mean correlation."""
    complete = df.select(*features, target).na.drop()
    stats = column_stats(complete, features, abs_corr=lambda c: F.abs(pearson(c, target)))
    overall = stats.agg(F.max("abs_corr").alias("max_corr"), F.avg("abs_corr").alias("mean_corr"))
    return attach(
        stats.select("feature", "abs_corr", (F.col("abs_corr") > threshold).alias("high_corr"),
                     suspicious_name(F.col("feature")).alias("suspicious_name")),
        overall, [],
    )


def mutual_info(df: DataFrame, features: Sequence[str], target: str, bins: int = 8, by: Sequence[str] = ()) -> DataFrame:
    """Mutual information (nats) between each feature and the target on quantile bins, per ``by``
    group (e.g. fold) in one go.

    Bin edges are exact quantiles; a value belongs to the number of inner edges below it.
    Counts per (feature, bin, bin) are the only thing shuffled.
    """
    by, cols = list(by), [*features, target]
    slim = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols])
    edges = checkpointed(exact_quantiles(slim, by, cols, [i / bins for i in range(1, bins)]))

    def bin_of(x, inner):
        return F.when(x.isNotNull(), F.size(F.filter(inner, lambda e: x > e)))

    y = attach(slim, edges.select(*by, F.col(target).alias("_e")), by)
    x = (
        y.select(*by, *features, bin_of(F.col(target), F.col("_e")).alias("_by"))
        .where(F.col("_by").isNotNull())
        .unpivot([*by, "_by"], list(features), "feature", "x")
        .where(F.col("x").isNotNull())
    )
    inner = edges.select(*by, F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("e")) for f in features])))
    joint = (
        attach(x, inner, [*by, "feature"])
        .groupBy(*by, "feature", bin_of(F.col("x"), F.col("e")).alias("_bx"), "_by")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    whole = [*by, "feature"]  # at most bins x bins rows each

    def total(*extra):
        return F.sum("n").over(Window.partitionBy(*whole, *extra))

    sums = joint.select(*whole, "n", "_bx", "_by", total().alias("nn")).select(
        *whole, "n", "nn", total("_bx").alias("nx"), total("_by").alias("ny"))
    part = F.col("n") / F.col("nn") * F.log(F.col("n") * F.col("nn") / (F.col("nx") * F.col("ny")))
    return sums.groupBy(*whole).agg(F.greatest(F.sum(part), F.lit(0.0)).alias("score"))
