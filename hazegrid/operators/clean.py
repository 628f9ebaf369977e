"""Cleaning and imputation of an hourly panel keyed by (series_id, ts).

Statistics (fences, means, medians, donors) are taken per series: one series here is the one
frame a single-station pipeline works on. Pass ``keys=[]`` to pool all series.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazegrid.plans.attach import attach, join_null_safe, keeps_names
from hazegrid.plans.blocks import DEFAULT_BLOCK_ROWS, POS, dense_axis, halo_window, neighbours
from hazegrid.plans.quantiles import exact_quantiles

KEY = ("series_id",)


def dedup_rows(df: DataFrame, cols: Sequence[str] | None = None, by_values: bool = False) -> DataFrame:
    """Exact duplicates dropped. ``by_values`` ignores the key and time columns, as a
    single-station frame with the time on its index does."""
    if by_values:
        cols = [c for c in df.columns if c not in ("series_id", "ts")]
        rest = [c for c in df.columns if c not in cols]
        first = F.min(F.struct(*[F.col(c) for c in reversed(rest)]))
        return df.groupBy(*cols).agg(first.alias("_k")).select(*[F.col(f"_k.{c}") for c in rest], *cols).select(*df.columns)
    return df.dropDuplicates(list(cols) if cols else None)


@keeps_names
def ffill(df: DataFrame, cols: Sequence[str], limit: int | None = None, keys: Sequence[str] = KEY,
          ts: str = "ts", gap_free: bool = False) -> DataFrame:
    """Carry the last value forward, at most ``limit`` rows."""
    return _carry(df, cols, limit, keys, ts, gap_free, forward=True)


@keeps_names
def bfill(df: DataFrame, cols: Sequence[str], limit: int | None = None, keys: Sequence[str] = KEY,
          ts: str = "ts", gap_free: bool = False) -> DataFrame:
    return _carry(df, cols, limit, keys, ts, gap_free, forward=False)


def _carry(df, cols, limit, keys, ts, gap_free, forward):
    side = "prev" if forward else "next"
    if limit is None:
        near = neighbours(df, keys, cols, ts, gap_free)
        return near.select(*[F.col(f"_{side}_{c}.v").alias(c) if c in cols else F.col(c) for c in df.columns])

    def exprs(w):
        frame = w.rowsBetween(-limit, 0) if forward else w.rowsBetween(0, limit)
        pick = F.last if forward else F.first
        return [pick(c, True).over(frame).alias(f"_f_{c}") for c in cols]

    wide = halo_window(df, keys, exprs, limit if forward else 0, 0 if forward else limit, ts, gap_free)
    return wide.select(*[F.col(f"_f_{c}").alias(c) if c in cols else F.col(c) for c in df.columns])


def fill_both(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = KEY, ts: str = "ts",
              gap_free: bool = False, backward_first: bool = False) -> DataFrame:
    """Forward then backward fill (or the reverse) in one pass."""
    near = neighbours(df, keys, cols, ts, gap_free)
    a, b = ("next", "prev") if backward_first else ("prev", "next")
    return near.select(
        *[F.coalesce(F.col(f"_{a}_{c}.v"), F.col(f"_{b}_{c}.v")).alias(c) if c in cols else F.col(c)
          for c in df.columns]
    )


@keeps_names
def interpolate_time(df: DataFrame, cols: Sequence[str], limit: int = 6, keys: Sequence[str] = KEY,
                     ts: str = "ts", gap_free: bool = False) -> DataFrame:
    """Time-weighted linear interpolation of the first ``limit`` nulls of each gap. A trailing
    gap repeats the last value up to the limit; a leading gap stays null."""
    near = neighbours(df, keys, cols, ts, gap_free)
    t = F.unix_micros(F.col(ts))

    def value(c: str) -> Column:
        p, n = F.col(f"_prev_{c}"), F.col(f"_next_{c}")
        share = (t - p["t"]).cast("double") / (n["t"] - p["t"]).cast("double")
        return (
            F.when(F.col(c).isNotNull(), F.col(c))
            .when(p.isNull() | (F.col(POS) - p["pos"] > limit), None)
            .when(n.isNull(), p["v"])
            .otherwise(p["v"] + (n["v"] - p["v"]) * share)
        )

    return near.select(*[value(c).alias(c) if c in cols else F.col(c) for c in df.columns])


@keeps_names
def interpolate_both(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = KEY, ts: str = "ts",
                     gap_free: bool = False) -> DataFrame:
    """Linear in row number, no limit, edges repeat the nearest value."""
    near = neighbours(df, keys, cols, ts, gap_free)

    def value(c: str) -> Column:
        p, n = F.col(f"_prev_{c}"), F.col(f"_next_{c}")
        share = (F.col(POS) - p["pos"]).cast("double") / (n["pos"] - p["pos"]).cast("double")
        return (
            F.when(F.col(c).isNotNull(), F.col(c))
            .when(p.isNull(), n["v"])
            .when(n.isNull(), p["v"])
            .otherwise(p["v"] + (n["v"] - p["v"]) * share)
        )

    return near.select(*[value(c).alias(c) if c in cols else F.col(c) for c in df.columns])


# --- nearest donors --------------------------------------------------------------------


@keeps_names
def impute_knn(df: DataFrame, cols: Sequence[str], k: int = 5, keys: Sequence[str] = KEY, ts: str = "ts",
               gap_free: bool = False, chunk: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Mean of the ``k`` nearest rows of the same series that have the missing column.

    Distance: Euclidean over the columns both rows have, scaled by sqrt(all / shared); the
    earlier donor wins ties; the series mean where no donor shares a column. Every row of the
    series is a candidate: rows with holes and donors meet chunk by chunk, each meeting keeps
    its ``k`` best, and the partial lists are merged. No task sees more than two chunks.
    """
    cols, keys = list(cols), list(keys)
    placed = dense_axis(df, keys, ts, gap_free)
    slim = placed.select(*keys, POS, *[F.col(c).cast("double").alias(c) for c in cols])
    chunked = slim.withColumn("_chunk", F.floor(F.col(POS) / chunk))
    n_missing = sum([F.col(c).isNull().cast("int") for c in cols], F.lit(0))
    holes = chunked.where((n_missing > 0) & (n_missing < len(cols)))
    donors = chunked.where(n_missing < len(cols))

    def chunk_list(rows, name):
        return rows.groupBy(*keys).agg(F.collect_set("_chunk").alias(name))

    h = attach(holes.withColumnRenamed("_chunk", "_hc"), chunk_list(donors, "_l"), keys).select(
        *keys, "_hc", F.explode("_l").alias("_dc"), POS, *cols
    )
    d = attach(donors.withColumnRenamed("_chunk", "_dc"), chunk_list(holes, "_l"), keys).select(
        *keys, F.explode("_l").alias("_hc"), "_dc", POS, *cols
    )
    key_fields = [df.schema[c] for c in keys]
    out = T.StructType(
        [*key_fields, T.StructField(POS, T.LongType()), T.StructField("name", T.StringType()),
         T.StructField("dist", T.DoubleType()), T.StructField("donor", T.LongType()),
         T.StructField("v", T.DoubleType())]
    )
    meet = [*keys, "_hc", "_dc"]
    d = d.toDF(*d.columns)  # fresh column ids: both sides come from the same rows
    near = h.groupBy(*meet).cogroup(d.groupBy(*meet)).applyInPandas(_nearest(keys, cols, k), out)
    w = Window.partitionBy(*keys, POS, "name").orderBy("dist", "donor")
    best = (
        near.withColumn("_rn", F.row_number().over(w))
        .where(F.col("_rn") <= k)
        .groupBy(*keys, POS)
        .agg(*[F.avg(F.when(F.col("name") == c, F.col("v"))).alias(f"_k_{c}") for c in cols])
    )
    means = slim.groupBy(*keys).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])
    joined = attach(join_null_safe(placed, best, [*keys, POS]), means, keys)
    return joined.select(
        *[F.coalesce(F.col(c), F.col(f"_k_{c}"), F.col(f"_m_{c}")).alias(c) if c in cols else F.col(c)
          for c in df.columns]
    )


def _nearest(keys: list[str], cols: list[str], k: int):
    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = [*keys, POS, "name", "dist", "donor", "v"]
        if left.empty or right.empty:
            return pd.DataFrame(columns=names)
        right = right.sort_values(POS)
        x, y = left[cols].to_numpy(float), right[cols].to_numpy(float)
        total = np.zeros((len(x), len(y)))
        shared = np.zeros((len(x), len(y)))
        for j in range(len(cols)):
            gap = x[:, j][:, None] - y[:, j][None, :]
            both = ~np.isnan(gap)
            total += np.where(both, gap * gap, 0.0)
            shared += both
        with np.errstate(divide="ignore", invalid="ignore"):
            dist = np.sqrt(total * len(cols) / shared)
        donor_pos = right[POS].to_numpy()
        parts = []
        for j, name in enumerate(cols):
            rows = np.flatnonzero(np.isnan(x[:, j]))
            cand = np.flatnonzero(~np.isnan(y[:, j]))
            if not len(rows) or not len(cand):
                continue
            sub = dist[np.ix_(rows, cand)]
            order = np.argsort(sub, axis=1, kind="stable")[:, :k]  # NaN sorts last
            picked = np.take_along_axis(sub, order, axis=1)
            r, c = np.nonzero(~np.isnan(picked))
            at = cand[order[r, c]]
            part = {key: left[key].to_numpy()[rows[r]] for key in keys}
            part.update({POS: left[POS].to_numpy()[rows[r]], "name": name, "dist": picked[r, c],
                         "donor": donor_pos[at], "v": y[at, j]})
            parts.append(pd.DataFrame(part))
        return pd.concat(parts)[names] if parts else pd.DataFrame(columns=names)

    return meet


# --- constants per series ----------------------------------------------------------------


@keeps_names
def impute_mode(df: DataFrame, col: str, keys: Sequence[str] = ()) -> DataFrame:
    """Most frequent value, the smallest on ties. Counted per value first, so no task holds
    the values of a group."""
    counts = df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_n"))
    mode = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(col).alias("v")))["v"].alias("_mode"))
    return attach(df, mode, keys).withColumn(col, F.coalesce(col, "_mode")).drop("_mode")


@keeps_names
def impute_mean(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = KEY) -> DataFrame:
    means = df.groupBy(*keys).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])
    return _fill_from(df, attach(df, means, keys), cols)


@keeps_names
def impute_median(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = KEY) -> DataFrame:
    q = exact_quantiles(df, keys, cols, [0.5])
    medians = q.select(*keys, *[F.col(c)[0].alias(f"_m_{c}") for c in cols])
    return _fill_from(df, attach(df, medians, keys), cols)


def _fill_from(df, joined, cols):
    return joined.select(*[F.coalesce(F.col(c), F.col(f"_m_{c}")).alias(c) if c in cols else F.col(c) for c in df.columns])


# --- outliers ---------------------------------------------------------------------------


def fences(df: DataFrame, cols: Sequence[str], low: float, high: float, k: float,
           keys: Sequence[str] = KEY) -> DataFrame:
    """``_lo_<c>`` / ``_hi_<c>`` = quantile(low) - k*range, quantile(high) + k*range."""
    q = exact_quantiles(df, keys, cols, [low, high])
    out = []
    for c in cols:
        a, b = F.col(c)[0], F.col(c)[1]
        out += [(a - k * (b - a)).alias(f"_lo_{c}"), (b + k * (b - a)).alias(f"_hi_{c}")]
    return q.select(*keys, *out)


@keeps_names
def outliers_to_null(df: DataFrame, cols: Sequence[str], target: str | None = None, k: float = 3.0,
                     keys: Sequence[str] = KEY, ts: str = "ts", gap_free: bool = False) -> DataFrame:
    """Values outside the 3-range fences become null, then backward and forward fill. Fences
    start at the quartiles, for the target at the 5th and 95th percentile."""
    q = exact_quantiles(df, keys, cols, [0.05, 0.25, 0.75, 0.95])
    bounds = []
    for c in cols:
        a, b = (F.col(c)[0], F.col(c)[3]) if c == target else (F.col(c)[1], F.col(c)[2])
        bounds += [(a - k * (b - a)).alias(f"_lo_{c}"), (b + k * (b - a)).alias(f"_hi_{c}")]
    joined = attach(df, q.select(*keys, *bounds), keys)
    nulled = joined.select(
        *[F.when(F.col(c).between(F.col(f"_lo_{c}"), F.col(f"_hi_{c}")), F.col(c)).alias(c) if c in cols else F.col(c)
          for c in df.columns]
    )
    return fill_both(nulled, cols, keys, ts, gap_free, backward_first=True)


def clip_to(df: DataFrame, bounds: DataFrame, cols: Sequence[str], keys: Sequence[str] = KEY,
            flags: bool = False) -> DataFrame:
    joined = attach(df, bounds, keys)

    def clipped(c):
        return F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), F.col(f"_hi_{c}")), F.col(f"_lo_{c}"))).alias(c)

    def flag(c):
        outside = (F.col(c) < F.col(f"_lo_{c}")) | (F.col(c) > F.col(f"_hi_{c}"))
        return F.coalesce(outside, F.lit(False)).alias(f"{c}_clipped")

    return joined.select(
        *[clipped(c) if c in cols else F.col(c) for c in df.columns], *([flag(c) for c in cols] if flags else [])
    )


@keeps_names
def clip_iqr(df: DataFrame, cols: Sequence[str], k: float = 1.5, keys: Sequence[str] = KEY,
             flags: bool = False) -> DataFrame:
    return clip_to(df, fences(df, cols, 0.25, 0.75, k, keys), cols, keys, flags)


@keeps_names
def winsorize(df: DataFrame, cols: Sequence[str], p: float = 0.01, keys: Sequence[str] = KEY,
              flags: bool = False) -> DataFrame:
    return clip_to(df, fences(df, cols, p, 1 - p, 0.0, keys), cols, keys, flags)


def clipped_counts(flagged: DataFrame, cols: Sequence[str]) -> DataFrame:
    """How many values were outside, per column, from the flags of the clipping pass."""
    sums = flagged.agg(*[F.count_if(F.col(f"{c}_clipped")).alias(c) for c in cols])
    return sums.unpivot([], list(cols), "feature", "clipped").where(F.col("clipped") > 0)


@keeps_names
def iqr_anomalies(df: DataFrame, col: str, k: float = 1.5, keys: Sequence[str] = KEY) -> DataFrame:
    """Rows outside the fences."""
    joined = attach(df, fences(df, [col], 0.25, 0.75, k, keys), keys)
    return joined.where((F.col(col) < F.col(f"_lo_{col}")) | (F.col(col) > F.col(f"_hi_{col}"))).select(*df.columns)


# --- whole-column decisions ----------------------------------------------------------------


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Text or numbers -> double; bad, missing and infinite values -> 0."""
    def number(c):
        v = F.expr(f"try_cast(`{c}` AS double)")
        return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), F.lit(0.0)).otherwise(v).alias(c)

    return df.select(*[number(c) if c in cols else F.col(c) for c in df.columns])


def narrow_types(df: DataFrame) -> DataFrame:
    """double -> float, bigint -> int."""
    narrower = {"double": "float", "bigint": "int"}
    return df.select(*[F.col(c).cast(narrower[t]).alias(c) if t in narrower else F.col(c) for c, t in df.dtypes])


def drop_unfillable(df: DataFrame, rows: bool = False) -> DataFrame:
    """Drop columns (or rows) that still hold nulls."""
    if rows:
        return df.na.drop()
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if not counts[c]])


def drop_null_targets(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(targets))


def fill_defaults(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Null (or absent) features get the default of their name."""
    from hazegrid.functions.names import default_for

    have = set(df.columns)
    kept = [F.col(c) for c in df.columns if c not in features]
    return df.select(
        *kept,
        *[(F.coalesce(F.col(f).cast("double"), F.lit(default_for(f))) if f in have else F.lit(default_for(f))).alias(f)
          for f in features],
    )


def preprocessing_report(before: DataFrame, after: DataFrame, removed: dict[str, Sequence[str]]) -> DataFrame:
    """Shapes, removed features, remaining nulls and duplicate rows."""
    n_after = after.groupBy(*after.columns).agg(F.count(F.lit(1)).alias("_n"))
    nulls = sum([F.col(c).isNull().cast("int") for c in after.columns], F.lit(0))
    facts = n_after.agg(
        F.sum("_n").alias("rows_after"),
        F.sum(F.col("_n") - 1).alias("duplicate_rows"),
        F.sum(nulls * F.col("_n")).alias("missing_values"),
    )
    return attach(facts, before.agg(F.count(F.lit(1)).alias("rows_before")), []).select(
        "rows_before",
        F.lit(len(before.columns)).alias("columns_before"),
        "rows_after",
        F.lit(len(after.columns)).alias("columns_after"),
        *[F.lit(len(v)).alias(f"removed_{k}") for k, v in removed.items()],
        "missing_values",
        "duplicate_rows",
    )
