"""Ordered work on series of any length.

A plain ``Window.partitionBy(series).orderBy(ts)`` sends one whole series to one task, so a
station that holds a third of the rows becomes the job. Everything ordered in this package
goes through the three shapes below instead. All of them partition by *(series, block of the
axis)* and carry only small per-block summaries across blocks:

* ``row_positions``  - dense row number per series from per-block counts,
* ``halo_window``    - bounded frames (lag, lead, rolling): each block gets copies of the few
                       rows just outside it, so every frame is complete inside one block,
* ``neighbours``     - nearest non-null row before / after, at any distance.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazegrid.plans.attach import join_null_safe
from hazegrid.session import checkpointed

HOUR = 3600
BLOCK = "_block"
POS = "_pos"
DEFAULT_BLOCK_ROWS = 2048


def grid_index(ts: str = "ts", step_seconds: int = HOUR) -> Column:
    """Absolute step number of a timestamp; on a gap-free axis it is a dense row position."""
    return F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / F.lit(step_seconds)).cast("bigint")


def block_of(pos: Column, rows: int = DEFAULT_BLOCK_ROWS) -> Column:
    return F.floor(pos / F.lit(rows)).cast("bigint")


def row_positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    bucket: Column,
    out: str = POS,
) -> DataFrame:
    """Add the 0-based row number per ``keys`` in ``order``.

    ``bucket`` must grow with ``order`` (a time block, a value range). Rows are numbered inside
    (keys, bucket) and shifted by the counts of the earlier buckets; only the counts are ever
    gathered per key. Join and window share one exchange on (keys, bucket).
    """
    b = "_bucket"
    tagged = df.withColumn(b, bucket)
    counts = tagged.groupBy(*keys, b).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy(F.col(b).asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.select(
        *[F.col(k).alias(f"_o_{k}") for k in keys],
        F.col(b).alias("_o_b"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"),
    )
    match = F.col(b).eqNullSafe(F.col("_o_b"))
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    inside = Window.partitionBy(*keys, b).orderBy(*order)
    return (
        tagged.join(offsets, match, "left")
        .withColumn(out, (F.row_number().over(inside) - 1 + F.col("_offset")).cast("bigint"))
        .drop(b, "_offset", "_o_b", *[f"_o_{k}" for k in keys])
    )


def global_positions(df: DataFrame, order: Sequence[str | Column], out: str = POS) -> DataFrame:
    """Add the 0-based row number over the whole table in ``order``, without one task that sees all.

    The rows are range-partitioned and stored with the number of their part; the parts are counted,
    and the counts, one number per part, shift the numbers inside the parts.
    """
    part = "_part"
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(df.repartitionByRange(tasks, *order).withColumn(part, F.spark_partition_id()))
    sizes = sorted((r[0], r[1]) for r in ranged.groupBy(part).count().collect())
    before, offsets = 0, []
    for p, n in sizes:
        offsets.append((p, before))
        before += n
    starts = df.sparkSession.createDataFrame(offsets, "_at_part int, _offset long")
    inside = Window.partitionBy(part).orderBy(*order)
    placed = ranged.withColumn(out, F.row_number().over(inside)).join(F.broadcast(starts), F.col(part) == F.col("_at_part"))
    return placed.withColumn(out, (F.col(out) - 1 + F.col("_offset")).cast("bigint")).drop(part, "_at_part", "_offset")


def dense_axis(df: DataFrame, keys: Sequence[str], ts: str, gap_free: bool, step_seconds: int = HOUR) -> DataFrame:
    """Add ``_pos``: the step number on a gap-free axis, else the counted row number."""
    if gap_free:
        return df.withColumn(POS, grid_index(ts, step_seconds))
    return row_positions(
        df, keys, [F.col(ts).asc_nulls_first()], F.floor(grid_index(ts, step_seconds) / DEFAULT_BLOCK_ROWS)
    )


def halo_window(
    df: DataFrame,
    keys: Sequence[str],
    exprs: Callable[[Window], list[Column]],
    before: int = 0,
    after: int = 0,
    ts: str = "ts",
    gap_free: bool = False,
    step_seconds: int = HOUR,
) -> DataFrame:
    """Append window expressions whose frames reach at most ``before`` / ``after`` rows.

    Rows are hashed once on (keys, block). Only rows within ``before`` of a block's end or
    ``after`` of its start are copied into the neighbouring block, at most a quarter of all.
    """
    rows = max(DEFAULT_BLOCK_ROWS, 4 * (before + after))
    if gap_free:
        pos = grid_index(ts, step_seconds)
    else:
        df = dense_axis(df, keys, ts, False, step_seconds)
        pos = F.col(POS)
    block, inside = block_of(pos, rows), F.pmod(pos, F.lit(rows))
    copies = [block]
    if before:
        copies.append(F.when(inside >= rows - before, block + 1))
    if after:
        copies.append(F.when(inside < after, block - 1))
    kept = [F.col(c) for c in df.columns if c != POS]
    spread = df.select(*kept, pos.alias(POS), block.alias(BLOCK), F.explode(F.array_compact(F.array(*copies))).alias("_to"))
    w = Window.partitionBy(*keys, "_to").orderBy(POS)
    return spread.select("*", *exprs(w)).where(F.col("_to") == F.col(BLOCK)).drop("_to", BLOCK, POS)


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    cols: Sequence[str],
    ts: str = "ts",
    gap_free: bool = False,
    step_seconds: int = HOUR,
    block_rows: int | None = None,
) -> DataFrame:
    """Add ``_prev_<c>`` / ``_next_<c>``: struct(v, pos, t) of the nearest non-null row at or
    before / at or after each row; keeps ``_pos``.

    Per-block first and last non-null rows (one partial aggregation) are carried over the
    short list of blocks, then joined back on (keys, block), which the in-block window reuses.
    """
    names = df.columns
    block_rows = block_rows or DEFAULT_BLOCK_ROWS
    if gap_free:
        pos = grid_index(ts, step_seconds)
        placed = df.select("*", pos.alias(POS), block_of(pos, block_rows).alias(BLOCK))
    else:
        dense = dense_axis(df, keys, ts, False, step_seconds)
        placed = dense.select("*", block_of(F.col(POS), block_rows).alias(BLOCK))

    def point(c: str) -> Column:
        return F.when(
            F.col(c).isNotNull(),
            F.struct(F.col(c).alias("v"), F.col(POS).alias("pos"), F.unix_micros(F.col(ts)).alias("t")),
        )

    # Plain values, not structs, in the aggregation buffers: that keeps it a hash aggregation.
    def edge(c: str, side: str) -> list[Column]:
        here = F.when(F.col(c).isNotNull(), F.col(POS))
        at, pick = (F.max, F.max_by) if side == "last" else (F.min, F.min_by)
        return [
            at(here).alias(f"_{side}p_{c}"), pick(F.col(c), here).alias(f"_{side}v_{c}"),
            pick(F.unix_micros(F.col(ts)), here).alias(f"_{side}t_{c}"),
        ]

    def packed(c: str, side: str) -> Column:
        fields = [F.col(f"_{side}{x}_{c}").alias(name) for x, name in (("v", "v"), ("p", "pos"), ("t", "t"))]
        return F.when(F.col(f"_{side}p_{c}").isNotNull(), F.struct(*fields))

    edges = [a for c in cols for a in (*edge(c, "last"), *edge(c, "first"))]
    summary = placed.groupBy(*keys, BLOCK).agg(*edges).select(
        *keys, BLOCK,
        *[packed(c, "last").alias(f"_l_{c}") for c in cols], *[packed(c, "first").alias(f"_f_{c}") for c in cols],
    )
    over_blocks = Window.partitionBy(*keys).orderBy(BLOCK)
    carried = summary.select(
        *keys,
        BLOCK,
        *[F.last(f"_l_{c}", True).over(over_blocks.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_l_{c}")
          for c in cols],
        *[F.first(f"_f_{c}", True).over(over_blocks.rowsBetween(1, Window.unboundedFollowing)).alias(f"_f_{c}")
          for c in cols],
    )
    w = Window.partitionBy(*keys, BLOCK).orderBy(POS)
    up_to_here = w.rowsBetween(Window.unboundedPreceding, 0)
    # Going backwards keeps the "next" frame growing too, which Spark evaluates in one pass.
    from_here = Window.partitionBy(*keys, BLOCK).orderBy(F.col(POS).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return (
        join_null_safe(placed, carried, [*keys, BLOCK])
        .select(
            *names,
            POS,
            *[F.coalesce(F.last(point(c), True).over(up_to_here), F.col(f"_l_{c}")).alias(f"_prev_{c}") for c in cols],
            *[F.coalesce(F.last(point(c), True).over(from_here), F.col(f"_f_{c}")).alias(f"_next_{c}") for c in cols],
        )
    )
