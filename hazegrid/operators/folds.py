"""Time-ordered splits. A fold is arithmetic on the row position, never a range join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid import constants as K
from hazegrid.operators.windows import row_index
from hazegrid.plans.attach import attach, keeps_names

KEY = ("series_id",)


def _sizes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).cast("bigint").alias("_n"))


@keeps_names
def indexed(df: DataFrame, keys: Sequence[str] = KEY, ts: str = "ts") -> DataFrame:
    """Rows with ``row_idx`` and the series length ``_n``."""
    return attach(row_index(df, keys, ts), _sizes(df, keys), keys)


def sliding_folds(df: DataFrame, train: int = K.CV_TRAIN, test: int = K.CV_TEST, step: int = K.CV_STEP,
                  keys: Sequence[str] = KEY) -> DataFrame:
    """Fold table: every window that fits into the series."""
    fits = _sizes(df, keys).where(F.col("_n") >= train + test)
    start = F.posexplode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - (train + test), F.lit(step).cast("bigint")))
    return fits.select(*keys, start.alias("fold", "train_start")).select(
        *keys, "fold", "train_start",
        (F.col("train_start") + train).alias("train_end"),
        (F.col("train_start") + train).alias("test_start"),
        (F.col("train_start") + train + test).alias("test_end"),
    )


@keeps_names
def assign_folds(df: DataFrame, train: int = K.CV_TRAIN, test: int = K.CV_TEST, step: int = K.CV_STEP,
                 keys: Sequence[str] = KEY, ts: str = "ts") -> DataFrame:
    """Each row once per fold it takes part in, with ``split`` = train / test."""
    placed = indexed(df, keys, ts).where(F.col("_n") >= train + test)
    last = F.floor((F.col("_n") - (train + test)) / step)

    def folds(lo_offset: int, hi_offset: int):
        """Folds whose [start + lo_offset, start + hi_offset) holds the row."""
        first = F.greatest(F.lit(0), F.ceil((F.col("row_idx") - hi_offset + 1) / step))
        final = F.least(last, F.floor((F.col("row_idx") - lo_offset) / step))
        return F.when(first <= final, F.sequence(first.cast("bigint"), final.cast("bigint"))).otherwise(
            F.array().cast("array<bigint>")
        )

    def tagged(seq, name):
        return F.transform(seq, lambda f: F.struct(f.cast("int").alias("fold"), F.lit(name).alias("split")))

    both = F.concat(tagged(folds(0, train), "train"), tagged(folds(train, train + test), "test"))
    return placed.select(*df.columns, "row_idx", F.explode(both).alias("_f")).select(
        *df.columns, "row_idx", F.col("_f.fold").alias("fold"), F.col("_f.split").alias("split")
    )


def expanding_folds(df: DataFrame, splits: int = 3, keys: Sequence[str] = KEY) -> DataFrame:
    """Expanding train, test blocks of n // (splits + 1) rows at the end."""
    size = F.floor(F.col("_n") / (splits + 1))
    fold = F.explode(F.sequence(F.lit(0), F.lit(splits - 1)))
    start = F.col("_n") - (F.lit(splits) - F.col("fold")) * size
    return _sizes(df, keys).select(*keys, "_n", fold.alias("fold")).select(
        *keys, "fold", start.cast("bigint").alias("train_end"), start.cast("bigint").alias("test_start"),
        (start + size).cast("bigint").alias("test_end"),
    )


@keeps_names
def assign_expanding(df: DataFrame, splits: int = 3, keys: Sequence[str] = KEY, ts: str = "ts") -> DataFrame:
    placed = indexed(df, keys, ts)
    size = F.floor(F.col("_n") / (splits + 1))
    entries = []
    for f in range(splits):
        start = F.col("_n") - (splits - f) * size
        split = F.when(F.col("row_idx") < start, "train").when(F.col("row_idx") < start + size, "test")
        entries.append(F.when(split.isNotNull(), F.struct(F.lit(f).alias("fold"), split.alias("split"))))
    return placed.select(*df.columns, "row_idx", F.explode(F.array_compact(F.array(*entries))).alias("_f")).select(
        *df.columns, "row_idx", F.col("_f.fold").alias("fold"), F.col("_f.split").alias("split")
    )


@keeps_names
def holdout_tail(df: DataFrame, fraction: float = 0.15, minimum: int = 50, above: int = 100,
                 keys: Sequence[str] = KEY, ts: str = "ts", out: str = "is_validation") -> DataFrame:
    """Flag the last max(int(fraction * n), minimum) rows of each series longer than ``above``."""
    size = F.greatest(F.floor(F.lit(fraction) * F.col("_n")), F.lit(minimum))
    placed = indexed(df, keys, ts)
    return placed.withColumn(out, (F.col("_n") > above) & (F.col("row_idx") >= F.col("_n") - size)).drop("_n")


@keeps_names
def chrono_split(df: DataFrame, fraction: float = 0.8, keys: Sequence[str] = KEY, ts: str = "ts") -> DataFrame:
    placed = indexed(df, keys, ts)
    return placed.withColumn(
        "split", F.when(F.col("row_idx") < F.floor(F.lit(fraction) * F.col("_n")), "train").otherwise("test")
    ).drop("_n")
