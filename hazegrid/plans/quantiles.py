"""Exact linear-interpolation quantiles without gathering a group.

Spark's ``percentile`` keeps every distinct value of a group in one task. Here a fixed-size
sketch brackets each wanted rank, a second scan counts the rows below the bracket and the
few values inside it, and the two order statistics around the rank are read from those counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazegrid.plans.attach import attach, join_null_safe
from hazegrid.plans.blocks import BLOCK

ACCURACY = 10_000
SLACK = 2.0 / ACCURACY
SMALL_GROUP = 20_000  # below this the whole group is its own bracket (SLACK would be < 4 ranks)
SUB = 512


def exact_quantiles(df: DataFrame, keys: Sequence[str], cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """One row per key: for each column ``c`` an array ``c`` of quantiles in the order of ``probs``."""
    edges = [max(0.0, p - SLACK) for p in probs] + [min(1.0, p + SLACK) for p in probs]
    m = len(probs)
    bounds = df.groupBy(*keys).agg(
        *[
            F.struct(
                F.count(c).alias("n"),
                F.min(c).cast("double").alias("lo"),
                F.max(c).cast("double").alias("hi"),
                F.percentile_approx(F.col(c).cast("double"), edges, ACCURACY).alias("e"),
            ).alias(f"_b_{c}")
            for c in cols
        ]
    )
    # Long form from here on: one row per (row, column, wanted rank). The plan stays the same size
    # however many columns are asked for, and every value under its bracket collapses into one
    # counted row in the partial aggregation.
    limits = bounds.select(
        *keys, F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"_b_{c}").alias("b")) for c in cols]))
    ).select(*keys, "name", "b.*")
    cells = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        list(keys), list(cols), "name", "v"
    )
    small = F.col("n") < SMALL_GROUP
    placed = (
        attach(cells.where(F.col("v").isNotNull()), limits, [*keys, "name"])
        .select(*keys, "name", "v", "n", "lo", "hi", "e", F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("i", "p"))
        .select(
            *keys, "name", "i", ((F.col("n") - 1) * F.col("p")).alias("rank"), "v",
            F.when(small, F.col("lo")).otherwise(F.col("e")[F.col("i")]).alias("lo"),
            F.when(small, F.col("hi")).otherwise(F.col("e")[F.col("i") + m]).alias("hi"),
        )
        .where(F.col("v") <= F.col("hi"))
    )
    inside_bracket = F.col("v") >= F.col("lo")
    sub = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * SUB)).otherwise(0)
    counts = (
        placed.select(
            *keys, "name", "i", "rank",
            F.when(inside_bracket, F.col("v")).alias("v"),
            F.when(inside_bracket, sub).otherwise(-1).cast("bigint").alias(BLOCK),
        )
        .groupBy(*keys, "name", "i", "rank", BLOCK, "v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    group = [*keys, "name", "i"]
    per_block = counts.groupBy(*group, BLOCK).agg(F.sum("n").alias("_n"))
    before = Window.partitionBy(*group).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select(*group, BLOCK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*group, BLOCK).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = join_null_safe(counts, offsets, [*group, BLOCK], "inner").withColumn("_cum", F.col("_off") + F.sum("n").over(inside))
    lo_rank, hi_rank = F.floor("rank"), F.ceil("rank")
    found = ranked.groupBy(*group).agg(
        F.min(F.when(F.col("_cum") > lo_rank, F.col("v"))).alias("a"),
        F.min(F.when(F.col("_cum") > hi_rank, F.col("v"))).alias("b"),
        F.first(F.col("rank") - lo_rank).alias("frac"),
    ).withColumn("q", F.col("a") + (F.col("b") - F.col("a")) * F.col("frac"))
    return found.groupBy(*keys).agg(
        *[
            F.array(*[F.max(F.when((F.col("name") == c) & (F.col("i") == i), F.col("q"))) for i in range(m)]).alias(c)
            for c in cols
        ]
    )
