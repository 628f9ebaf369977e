"""Least squares on every sliding fold at once.

Neighbouring folds share most of their rows. The rows are therefore cut into blocks that every fold consists of, each
block is reduced to its sums and cross products (once, in the tasks that read the rows), and running
sums over the blocks of a series give the moments of any fold by one subtraction. The normal equations of
all folds are then solved side by side. The rows are passed over once, whatever the number of folds, and only
columns-squared numbers per block are shuffled.

A gap in a feature takes the mean of the fold's own training rows. That, too, comes out of the moments: a column
with gaps stands in them with zeros and, beside it, its gaps stand as a column of ones; a fill is a multiple of the latter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hazegrid import constants as K
from hazegrid.operators import folds as FO
from hazegrid.plans.attach import attach

KEY = ("series_id",)
TOLERANCE = 1e-10  # a direction of less relative variance counts as constant
FIT = "struct<n:bigint,intercept:double,coefficients:array<double>,fills:array<double>>"


def _solve(gram: np.ndarray, shift: np.ndarray, gaps: list[int]) -> tuple[int, float, list[float], list[float]] | None:
    """Moments of [1, features, gaps, label], shifted by ``shift`` -> rows, intercept, coefficients, fills."""
    p, n = len(shift) - 1, gram[0, 0]
    if n < 1:
        return None
    known = np.full(p, n)
    known[gaps] -= gram[0, 1 + p:1 + p + len(gaps)]
    fill = np.divide(gram[0, 1:1 + p], known, out=np.zeros(p), where=known > 0)
    turn = np.zeros((len(gram), p + 2))
    turn[np.arange(p + 1), np.arange(p + 1)] = turn[-1, -1] = 1
    for k, j in enumerate(gaps):
        turn[1 + p + k, 1 + j] = fill[j]
    whole = turn.T @ gram @ turn
    mean = whole[0, 1:] / n
    spread = whole[1:, 1:] - n * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(spread)[:p], 0.0))
    level = np.sqrt(np.maximum(np.diag(whole)[1:1 + p], 1e-300))
    alive = scale > TOLERANCE * level
    scale = np.where(alive, scale, 1.0)
    a = np.where(np.outer(alive, alive), spread[:p, :p] / np.outer(scale, scale), 0.0)
    b = np.where(alive, spread[:p, p] / scale, 0.0)
    slope = np.linalg.pinv(a, rcond=TOLERANCE, hermitian=True) @ b / scale
    line = mean[p] + shift[p] - slope @ (mean[:p] + shift[:p])
    return int(round(n)), float(line), slope.tolist(), (fill + shift[:p]).tolist()


def block_moments(df: DataFrame, features: Sequence[str], label: str, shift: Sequence[float], gaps: Sequence[int], keys: Sequence[str],
                  size: str = "_n", block: str = "_b") -> DataFrame:
    """(keys, size, block, pos, value): the upper triangle of the cross products of [1, features, gaps, label] for each
    block of each series, rows without a label counting nothing. Tasks send one row of numbers per block that they hold rows of."""
    names, cols = [*keys, size, block], [*features, label]
    width = len(cols) + 1 + len(gaps)
    upper = np.triu_indices(width)
    shift_, gaps_ = np.array(shift, dtype=float), list(gaps)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def fold(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            out = []
            x = pdf[cols].to_numpy(dtype=float) - shift_
            missing = np.isnan(x)
            v = np.where(missing, 0.0, x)
            v = np.column_stack([np.ones(len(v)), v[:, :-1], missing[:, gaps_].astype(float), v[:, -1]])
            v[missing[:, -1]] = 0.0
            for key, rows in pdf.groupby(names, dropna=False, sort=False).indices.items():
                part = v[rows]
                out.append((pdf.iloc[rows[0]][names].tolist(), (part.T @ part)[upper]))
            if out:
                yield pd.DataFrame({**{c: pd.Series([k[i] for k, _ in out], dtype=pdf[c].dtype) for i, c in enumerate(names)}, "_g": [g for _, g in out]})

    slim = df.select(*names, *[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)).alias(c) for c in cols])
    parts = slim.mapInPandas(fold, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", _g array<double>")
    return parts.select(*names, F.posexplode("_g").alias("pos", "value"))


def linear_folds(df: DataFrame, features: Sequence[str], label: str, train: int = K.CV_TRAIN, test: int = K.CV_TEST, step: int = K.CV_STEP,
                 keys: Sequence[str] = KEY, ts: str = "ts", pooled: bool = True) -> DataFrame:
    """Least squares of ``label`` on ``features`` for every sliding fold: fold, n, intercept, coefficients and
    fills (in the order of ``features``), for all series together or, if not ``pooled``, for each of its own.

    Folds are those of ``sliding_folds``: a series takes part in fold f if the fold fits into it. Training rows without a label
    do not count; a feature that is constant in a fold has the coefficient 0; collinear features share theirs (least norm)."""
    spark = df.sparkSession
    size = math.gcd(train, step)
    placed = FO.indexed(df.select(*keys, ts, *features, label), keys, ts).where(F.col("_n") >= train + test)
    placed = placed.withColumn("_b", F.floor(F.col("row_idx") / size).cast("bigint"))
    value = {c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)) for c in (*features, label)}
    facts = df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(value.values())], *[F.count_if(v.isNull()).alias(f"g{i}") for i, v in enumerate(value.values())]).first()
    shift = [facts[f"m{i}"] or 0.0 for i in range(len(value))]
    gaps = [i for i in range(len(features)) if facts[f"g{i}"]]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    moments = block_moments(placed, features, label, shift, gaps, keys)
    # hashed by (series, number) so that sums and running sums need no further exchange, and a long series still spreads
    blocks = moments.repartition(tasks, *keys, "pos").groupBy(*keys, "_n", "_b", "pos").agg(F.sum("value").alias("value"))
    along = Window.partitionBy(*keys, "pos").orderBy("_b")
    upto = F.sum("value").over(along.rowsBetween(Window.unboundedPreceding, 0))
    width = train // size
    run = blocks.withColumn("_upto", upto).withColumn("_total", F.col("_upto") - F.coalesce(F.lag("_upto", width).over(along), F.lit(0.0)))
    start = (F.col("_b") + 1) * size - train
    ends = run.where((start >= 0) & (start % step == 0) & (start + train + test <= F.col("_n"))).withColumn("fold", (start / step).cast("int"))
    by = [] if pooled else list(keys)
    sums = ends.groupBy(*by, "fold", "pos").agg(F.sum("_total").alias("value"))
    whole = sums.groupBy(*by, "fold").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("g")).select(*by, "fold", F.col("g.value").alias("g"))
    order, places = len(features) + 2 + len(gaps), np.array(shift)

    @F.arrow_udf(FIT)
    def solved(column: pa.Array) -> pa.Array:
        upper, out = np.triu_indices(order), []
        for g in column.to_pylist():
            gram = np.zeros((order, order))
            gram[upper] = g
            gram = gram + np.triu(gram, 1).T
            fit = _solve(gram, places, gaps)
            out.append(None if fit is None else dict(zip(("n", "intercept", "coefficients", "fills"), fit)))
        kind = pa.struct([("n", pa.int64()), ("intercept", pa.float64()), ("coefficients", pa.list_(pa.float64())), ("fills", pa.list_(pa.float64()))])
        return pa.array(out, kind)

    return whole.select(*by, "fold", solved("g").alias("fit")).where(F.col("fit").isNotNull()).select(*by, "fold", "fit.*")


def on_line(features: Sequence[str], intercept: str = "intercept", coefficients: str = "coefficients", fills: str = "fills") -> Column:
    """The fitted value of a row that carries its fold's line."""
    terms = [F.col(coefficients)[i] * F.coalesce(F.nanvl(F.col(f"`{f}`").cast("double"), F.lit(None)), F.col(fills)[i]) for i, f in enumerate(features)]
    return reduce(lambda a, b: a + b, terms, F.col(intercept))


def linear_fold_predictions(df: DataFrame, features: Sequence[str], label: str, train: int = K.CV_TRAIN, test: int = K.CV_TEST, step: int = K.CV_STEP,
                            keys: Sequence[str] = KEY, ts: str = "ts", pooled: bool = True, name: str = "linear") -> DataFrame:
    """model, fold, split, keys, ts, y, yhat for every row of every fold, as ``fit_eval_folds`` gives them."""
    lines = linear_folds(df, features, label, train, test, step, keys, ts, pooled)
    tagged = FO.assign_folds(df.select(*keys, ts, *features, label), train, test, step, keys, ts)
    fitted = attach(tagged, lines, ["fold"] if pooled else [*keys, "fold"], "inner")
    return fitted.select(F.lit(name).alias("model"), "fold", "split", *keys, ts, F.col(f"`{label}`").cast("double").alias("y"), on_line(features).alias("yhat"))
