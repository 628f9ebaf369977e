"""Row-window features of a panel; see ``plans.blocks`` for how they are partitioned."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazegrid import constants as K
from hazegrid.functions.names import max_window_of
from hazegrid.functions.timefeat import calendar_features, cyclic_features, interaction_features
from hazegrid.plans.attach import attach, keeps_names
from hazegrid.plans.blocks import grid_index, halo_window, row_positions

KEY = ("series_id",)


def rolling(w, fn, col: Column, n: int, lag: int = 0, min_periods: int | None = None) -> Column:
    """``fn`` over the ``n`` rows ending ``lag`` rows back; null with fewer than ``min_periods``
    (default ``n``) values."""
    frame = w.rowsBetween(-(lag + n - 1), -lag)
    need = n if min_periods is None else min_periods
    value = fn(col).over(frame)
    return value if need <= 1 else F.when(F.count(col).over(frame) >= need, value)


@keeps_names
def rolling_mean(df: DataFrame, windows: Mapping[str, tuple[str, int]], min_periods: int = 1,
                 keys: Sequence[str] = KEY, ts: str = "ts", gap_free: bool = False) -> DataFrame:
    """``windows``: output name -> (column, rows)."""
    reach = max(n for _, n in windows.values()) - 1
    return halo_window(
        df, keys,
        lambda w: [rolling(w, F.avg, F.col(c), n, 0, min_periods).alias(out) for out, (c, n) in windows.items()],
        before=reach, ts=ts, gap_free=gap_free,
    )


def rolling_mean_by_time(df: DataFrame, col: str, hours: int, out: str, keys: Sequence[str] = KEY,
                         ts: str = "ts") -> DataFrame:
    """Mean of the last ``hours`` hours by clock time, for axes with gaps. Blocks of the clock
    replace blocks of rows; the halo is the window length."""
    step = 24 * max(hours, 24)
    placed = df.withColumn("_h", grid_index(ts)).withColumn("_block", F.floor(F.col("_h") / step))
    late = F.pmod(F.col("_h"), F.lit(step)) >= step - hours
    spread = placed.withColumn(
        "_to", F.explode(F.array_compact(F.array(F.col("_block"), F.when(late, F.col("_block") + 1))))
    )
    from pyspark.sql import Window

    w = Window.partitionBy(*keys, "_to").orderBy("_h").rangeBetween(-(hours - 1), 0)
    return (
        spread.withColumn(out, F.avg(col).over(w)).where(F.col("_to") == F.col("_block")).drop("_h", "_block", "_to")
    )


def rolling_stat(df: DataFrame, col: str, sizes: Sequence[int], lag: int, stat: str,
                 keys: Sequence[str] = KEY, ts: str = "ts", gap_free: bool = False) -> DataFrame:
    """Lagged rolling sample std or max; null when any value of the frame is missing."""
    fn = {"std": F.stddev_samp, "max": F.max}[stat]
    return halo_window(
        df, keys,
        lambda w: [rolling(w, fn, F.col(col), n, lag).alias(f"{col}_rolling_{stat}_{n}h_lag{lag}h") for n in sizes],
        before=lag + max(sizes) - 1, ts=ts, gap_free=gap_free,
    )


def lag_columns(w, cols: Sequence[str], min_lag: int) -> list[Column]:
    return [
        F.lag(c, min_lag + o).over(w).alias(f"{c}_lag_{min_lag + o}h") for c in cols for o in K.LAG_OFFSETS
    ]


@keeps_names
def lag_features(df: DataFrame, cols: Sequence[str], min_lag: int = 72, keys: Sequence[str] = KEY,
                 ts: str = "ts", gap_free: bool = False) -> DataFrame:
    return halo_window(df, keys, lambda w: lag_columns(w, cols, min_lag), before=min_lag + max(K.LAG_OFFSETS),
                       ts=ts, gap_free=gap_free)


def target_columns(w, target: str, horizons: Sequence[int], prefix: str = "aqi") -> list[Column]:
    return [F.lead(target, h).over(w).alias(f"{prefix}_{h}h") for h in horizons]


@keeps_names
def future_targets(df: DataFrame, target: str = "aqi", horizons: Sequence[int] = K.HORIZONS,
                   keys: Sequence[str] = KEY, ts: str = "ts", gap_free: bool = False) -> DataFrame:
    return halo_window(df, keys, lambda w: target_columns(w, target, horizons), after=max(horizons),
                       ts=ts, gap_free=gap_free)


def change_columns(w, target: str, lag: int, spans: Sequence[int]) -> list[Column]:
    return [
        (F.lag(target, lag).over(w) - F.lag(target, lag + h).over(w)).alias(f"{target}_rate_change_{h}h_lag{lag}h")
        for h in spans
    ]


@keeps_names
def rate_change(df: DataFrame, target: str, lag: int, spans: Sequence[int] = K.RATE_CHANGES,
                keys: Sequence[str] = KEY, ts: str = "ts", gap_free: bool = False) -> DataFrame:
    return halo_window(df, keys, lambda w: change_columns(w, target, lag, spans), before=lag + max(spans),
                       ts=ts, gap_free=gap_free)


@keeps_names
def diff1(df: DataFrame, cols: Mapping[str, str], keys: Sequence[str] = KEY, ts: str = "ts",
          gap_free: bool = False) -> DataFrame:
    """``cols``: output name -> column; difference to the row before."""
    return halo_window(df, keys, lambda w: [(F.col(c) - F.lag(c).over(w)).alias(out) for out, c in cols.items()],
                       before=1, ts=ts, gap_free=gap_free)


@keeps_names
def row_index(df: DataFrame, keys: Sequence[str] = KEY, ts: str = "ts", out: str = "row_idx") -> DataFrame:
    """0-based position per series in time order."""
    return row_positions(df, keys, [F.col(ts)], F.floor(grid_index(ts) / 2048), out)


@keeps_names
def drop_warmup(df: DataFrame, n: int | None = None, keys: Sequence[str] = KEY, ts: str = "ts") -> DataFrame:
    """Drop the first ``n`` rows of each series (default: largest window in the column names),
    but keep at least the last one."""
    n = max_window_of(df.columns) if n is None else n
    if n == 0:
        return df
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cnt"))
    placed = attach(row_index(df, keys, ts, "_idx"), counts, keys)
    return placed.where(F.col("_idx") >= F.least(F.lit(n), F.col("_cnt") - 1)).drop("_idx", "_cnt")


def make_sequences(df: DataFrame, features: Sequence[str], label: str, steps: int = 72,
                   keys: Sequence[str] = KEY, ts: str = "ts", gap_free: bool = False) -> DataFrame:
    """The ``steps`` feature rows before each row as a matrix, the row's own label beside it.
    Rows without a full history are left out."""
    vec = F.array(*[F.col(c).cast("double") for c in features])
    wide = halo_window(df, keys, lambda w: [F.collect_list(vec).over(w.rowsBetween(-steps, -1)).alias("sequence")],
                       before=steps, ts=ts, gap_free=gap_free)
    return wide.where(F.size("sequence") == steps).select(*keys, ts, "sequence", F.col(label).alias("label"))


def full_feature_table(df: DataFrame, horizon: int, target: str = "aqi", keys: Sequence[str] = KEY,
                       ts: str = "ts", gap_free: bool = False) -> DataFrame:
    """All generated features of one horizon: targets, calendar, lags, rolling statistics,
    changes and interactions. All window features share one Window node and one exchange."""
    have = df.columns
    lagged = [c for c in (target, *K.POLLUTANTS, *K.WEATHER) if c in have]

    def windows(w):
        out = target_columns(w, target, K.HORIZONS) + lag_columns(w, lagged, horizon)
        for n in K.TARGET_ROLLS:
            out.append(rolling(w, F.stddev_samp, F.col(target), n, horizon).alias(f"{target}_rolling_std_{n}h_lag{horizon}h"))
            out.append(rolling(w, F.max, F.col(target), n, horizon).alias(f"{target}_rolling_max_{n}h_lag{horizon}h"))
        for c, sizes in K.POLLUTANT_ROLLS.items():
            if c in have:
                out += [rolling(w, F.stddev_samp, F.col(c), n, horizon).alias(f"{c}_rolling_std_{n}h_lag{horizon}h")
                        for n in sizes]
        return out + change_columns(w, target, horizon, K.RATE_CHANGES)

    reach = horizon + max(max(K.LAG_OFFSETS), max(K.TARGET_ROLLS) - 1, max(K.RATE_CHANGES))
    wide = halo_window(df, keys, windows, before=reach, after=max(K.HORIZONS), ts=ts, gap_free=gap_free)
    t = F.col(ts)
    return wide.select("*", *calendar_features(t), *cyclic_features(t), *interaction_features(have))


def feature_columns(df: DataFrame, target: str = "aqi", keys: Sequence[str] = KEY, ts: str = "ts") -> list[str]:
    """Features: everything but keys, time, the target and the ``aqi_`` columns."""
    return [c for c in df.columns if c not in (*keys, ts, target) and "aqi_" not in c]


def split_xy(df: DataFrame, target: str = "aqi", keys: Sequence[str] = KEY, ts: str = "ts"):
    y = [f"aqi_{h}h" for h in K.HORIZONS]
    return (df.select(*keys, ts, *feature_columns(df, target, keys, ts)),
            df.select(*keys, ts, *[c for c in y if c in df.columns]))
