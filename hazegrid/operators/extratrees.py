"""Extra trees: forests whose cut points are drawn at random, grown level by level by Spark aggregations.

All trees (and the forests of all groups, such as validation folds) grow together. A level takes two passes over the
rows: the first finds the least and greatest value of each feature in each open node, between which every candidate
feature gets one cut point; the second counts rows and labels on both sides of these cuts, and the cut that takes away most
variance is kept. In a pass each task folds its rows into numbers per tree, node and feature; those of one tree meet in
one task, which settles its nodes. What is sent and what reaches the driver has the size of the forest, whatever the rows.

Draws are keyed: cut points and candidate features follow from MD5 of seed, tree, node and feature. Labels are
summed as integers of 2**-20. So a forest depends on the rows and the seed only, not on how they are partitioned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazegrid.session import checkpointed

UNIT = 1 << 20  # labels count in parts of this
SLICE = 8192  # rows of a group that a task looks at together
_NODES = "grp int, tree int, node int, n long, total long, feature int, cut double, gain double"


@dataclass
class Settings:
    trees: int = 251
    depth: int = 9
    min_leaf: int = 20
    min_split: int = 10
    share: float = 0.6449383229836702  # of the features, candidates at a node
    seed: int = 42

    def candidates(self, features: int) -> int:
        return max(1, int(self.share * features))


def draw(seed: int, tree: int, node: int, feature: int) -> tuple[float, int]:
    """Where between least and greatest value the cut lies, and the feature's rank among the candidates of the node."""
    digest = hashlib.md5(f"{seed}:{tree}:{node}:{feature}".encode()).hexdigest()
    return int(digest[:13], 16) / (1 << 52), int(digest[13:26], 16)


class Forest:
    """Nodes by group and tree in heap order (root 1): ``feature`` -1 at leaves, ``cut``, ``value``."""

    def __init__(self, settings: Settings, features: int, groups: Sequence[int]):
        size = 2 << settings.depth
        self.settings, self.features, self.groups = settings, features, list(groups)
        shape = (len(self.groups), settings.trees, size)
        self.feature, self.cut = np.full(shape, -1, dtype=np.int16), np.zeros(shape)
        self.value, self.n, self.gain = np.zeros(shape), np.zeros(shape, dtype=np.int64), np.zeros(shape)

    def descend(self, group: int, x: np.ndarray, levels: int) -> np.ndarray:
        """Node of each row (first axis) in each tree after at most ``levels`` steps."""
        out = np.ones((self.settings.trees, len(x)), dtype=np.int64)
        values, start, number = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1], np.arange(self.feature.shape[2])
        for node, feature, cut in zip(out, self.feature[group], self.cut[group]):
            inner = feature >= 0  # at a leaf no value is beyond the cut, and the next node is the leaf itself
            column, beyond, below = np.maximum(feature, 0).astype(np.int64), np.where(inner, cut, np.inf), np.where(inner, 2 * number, number)
            for _ in range(levels):
                right = values.take(start + column.take(node)) > beyond.take(node)
                node[:] = below.take(node) + right
        return out.T

    def predict(self, group: int, x: np.ndarray) -> np.ndarray:
        node = self.descend(group, x, self.settings.depth)
        return self.value[group, np.arange(self.settings.trees), node].mean(axis=1)

    def rows(self) -> list[tuple]:
        g, t, i = np.nonzero(self.n)
        return [(self.groups[a], int(b), int(c), int(self.n[a, b, c]), int(round(self.value[a, b, c] * self.n[a, b, c] * UNIT)), int(self.feature[a, b, c]),
                 float(self.cut[a, b, c]), float(self.gain[a, b, c])) for a, b, c in zip(g, t, i)]

    @classmethod
    def of_rows(cls, rows: Sequence, settings: Settings, features: int) -> Forest:
        out = cls(settings, features, sorted({r.grp for r in rows}))
        at = {g: i for i, g in enumerate(out.groups)}
        for r in rows:
            k = at[r.grp], r.tree, r.node
            out.feature[k], out.cut[k], out.n[k], out.value[k], out.gain[k] = r.feature, r.cut, r.n, r.total / r.n / UNIT, r.gain
        return out


def _by_node(node: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of one tree that are in a node from ``first`` on, node after node; where each node's rows begin, and its place."""
    place = node - first
    small = place.astype(np.int16) if first <= 1 << 14 else place  # 16 bits are sorted by radix
    order = np.argsort(small, kind="stable")
    order = order[np.searchsorted(small, 0, sorter=order):]
    sorted_ = place[order]
    edge = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(order) else np.zeros(0, dtype=np.int64)
    return order, edge, sorted_[edge]


def _ranges(x: np.ndarray, y: np.ndarray, node: np.ndarray, first: int, low: np.ndarray, high: np.ndarray, cuts) -> None:
    """Fold rows into least and greatest values [tree, node, feature] of the nodes from ``first`` on."""
    columns = np.ascontiguousarray(x.T)
    for t in range(node.shape[1]):
        order, edge, at = _by_node(node[:, t], first)
        if len(edge):
            part = columns.take(order, axis=1)
            low[t, at] = np.minimum(low[t, at], np.minimum.reduceat(part, edge, axis=1).T)
            high[t, at] = np.maximum(high[t, at], np.maximum.reduceat(part, edge, axis=1).T)


def _sides(x: np.ndarray, y: np.ndarray, node: np.ndarray, first: int, count: np.ndarray, total: np.ndarray, cuts: np.ndarray) -> None:
    """Fold rows into rows and labels left of each cut [tree, node, feature], the last feature being all rows."""
    columns, p = np.ascontiguousarray(x.T), x.shape[1]
    for t in range(node.shape[1]):
        order, edge, at = _by_node(node[:, t], first)
        if not len(edge):
            continue
        left = np.ones((p + 1, len(order)), dtype=bool)
        sizes = np.diff(np.r_[edge, len(order)])
        np.less_equal(columns.take(order, axis=1), np.repeat(cuts[t, at].T, sizes, axis=1), out=left[:p])
        ends = edge + sizes - 1
        for sums, part in ((count, left), (total, left * y[order])):
            upto = np.cumsum(part, axis=1, dtype=np.int64).take(ends, axis=1)
            upto[:, 1:] -= upto[:, :-1].copy()
            sums[t, at] += upto.T


def _pass(rows: DataFrame, forest: Forest, level: int, cuts: np.ndarray | None, features: int) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """One pass over the rows (grp, y, x): for each group and tree two arrays [node, feature], merged over all tasks."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((forest, cuts))
    first, width, trees = 1 << level, 1 << level, forest.settings.trees
    columns, kind = (features, float) if cuts is None else (features + 1, np.int64)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown, cut = shared.value
        place = {g: i for i, g in enumerate(grown.groups)}
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def add(g: int) -> None:
            x, y = (np.concatenate(v) for v in zip(*waiting.pop(g)))
            if g not in held:
                if cut is None:
                    held[g] = np.full((trees, width, features), np.inf), np.full((trees, width, features), -np.inf)
                else:
                    held[g] = np.zeros((trees, width, features + 1), dtype=np.int64), np.zeros((trees, width, features + 1), dtype=np.int64)
            for i in range(0, len(x), SLICE):
                some = slice(i, i + SLICE)
                node = grown.descend(place[g], x[some], level)
                (_ranges if cut is None else _sides)(x[some], y[some], node, first, *held[g], None if cut is None else cut[place[g]])

        for b in batches:
            group = b.column("grp").to_numpy()
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, features)
            y = b.column("y").to_numpy()
            for g in np.unique(group):
                mine = group == g
                waiting.setdefault(g, []).append((x[mine], y[mine]))
                if sum(len(v) for _, v in waiting[g]) >= SLICE:
                    add(g)
        for g in list(waiting):
            add(g)
        for g, (a, c) in held.items():
            some = a[:, :, 0] <= c[:, :, 0] if cut is None else a[:, :, -1] > 0
            at = [np.flatnonzero(s).astype(np.int32) for s in some]  # nodes without rows are not sent
            yield pa.RecordBatch.from_arrays(
                [pa.array([g] * trees, pa.int32()), pa.array(range(trees), pa.int32()), *[pa.array([v.tobytes() for v in part], pa.binary()) for part in (
                    at, [v[k] for v, k in zip(a, at)], [v[k] for v, k in zip(c, at)])]],
                ["grp", "tree", "at", "a", "b"])

    def dense(parts: Sequence[tuple[bytes, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes with rows, and both arrays [node, feature] over all parts."""
        if cuts is None:
            (one, other), (low, high) = (np.minimum, np.maximum), (np.inf, -np.inf)
        else:
            (one, other), (low, high) = (np.add, np.add), (0, 0)
        a, b = np.full((width, columns), low, dtype=kind), np.full((width, columns), high, dtype=kind)
        met = np.zeros(width, dtype=bool)
        for at, x, y in parts:
            k = np.frombuffer(at, dtype=np.int32)
            a[k] = one(a[k], np.frombuffer(x, dtype=kind).reshape(-1, columns))
            b[k] = other(b[k], np.frombuffer(y, dtype=kind).reshape(-1, columns))
            met[k] = True
        return np.flatnonzero(met).astype(np.int32), a, b

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        at, a, b = dense(list(zip(*[table.column(c).to_pylist() for c in ("at", "a", "b")])))
        return pa.table({"grp": pa.array([key[0].as_py()], pa.int32()), "tree": pa.array([key[1].as_py()], pa.int32()),
                         **{c: pa.array([v.tobytes()], pa.binary()) for c, v in (("at", at), ("a", a[at]), ("b", b[at]))}})

    schema = "grp int, tree int, at binary, a binary, b binary"
    merged = rows.mapInArrow(fold, schema).groupBy("grp", "tree").applyInArrow(merge, schema)
    return {(r["grp"], r["tree"]): dense([(r["at"], r["a"], r["b"])])[1:] for r in merged.toArrow().to_pylist()}


def grow(rows: DataFrame, features: int, settings: Settings, groups: Sequence[int]) -> Forest:
    """Forests of the stored ``rows`` (grp int, y long in units, x array<double> without gaps), one per group."""
    forest = Forest(settings, features, groups)
    take = settings.candidates(features)
    for level in range(settings.depth + 1):
        first, width = 1 << level, 1 << level
        cuts = np.full((len(forest.groups), settings.trees, width, features), -np.inf)
        drawn = np.zeros(cuts.shape, dtype=bool)
        if level < settings.depth:
            ranges = _pass(rows, forest, level, None, features)
            for (g, t), (low, high) in ranges.items():
                i = forest.groups.index(g)
                for node in np.flatnonzero(np.isfinite(low[:, 0])):
                    open_ = np.flatnonzero(low[node] < high[node])
                    draws = [draw(settings.seed, t, first + int(node), int(f)) for f in open_]
                    for k in sorted(range(len(open_)), key=lambda k: draws[k][1])[:take]:
                        f = open_[k]
                        at = low[node, f] + draws[k][0] * (high[node, f] - low[node, f])
                        cuts[i, t, node, f] = at if at < high[node, f] else low[node, f]
                        drawn[i, t, node, f] = True
        settled = True
        for (g, t), (count, total) in _pass(rows, forest, level, cuts, features).items():
            i = forest.groups.index(g)
            n, s = count[:, -1], total[:, -1]
            some = np.flatnonzero(n)
            at = first + some
            forest.n[i, t, at], forest.value[i, t, at] = n[some], s[some] / n[some] / UNIT
            gain = gains(count[:, :-1], total[:, :-1], n[:, None], s[:, None], settings.min_leaf)
            gain[~drawn[i, t] | (n < settings.min_split)[:, None]] = 0.0
            best = gain.argmax(axis=1)
            good = np.flatnonzero(gain[np.arange(width), best] > 0)
            forest.feature[i, t, first + good], forest.cut[i, t, first + good] = best[good], cuts[i, t, good, best[good]]
            forest.gain[i, t, first + good] = gain[good, best[good]]
            settled &= not len(good)
        if settled:
            break
    return forest


def gains(left: np.ndarray, left_sum: np.ndarray, n: np.ndarray, s: np.ndarray, least: int) -> np.ndarray:
    """Squared error that each cut takes away, in labels; 0 where a side would have fewer than ``least`` rows."""
    a, b, right, right_sum = left.astype(float), left_sum / UNIT, (n - left).astype(float), (s - left_sum) / UNIT
    ok = (left >= least) & (n - left >= least)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = b * b / a + right_sum * right_sum / right - (s / UNIT) * (s / UNIT) / n
    return np.where(ok, np.maximum(gain, 0.0), 0.0)


def _vector(features: Sequence[str], fills: Sequence[str]) -> Column:
    return F.array(*[F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)), F.col(m), F.lit(0.0)) for c, m in zip(features, fills)])


class ExtraTrees:
    """A fitted forest (or one per group): ``nodes`` and ``fills`` are small tables, ``transform`` adds ``yhat``."""

    def __init__(self, spark: SparkSession, features: Sequence[str], forest: Forest, fills: dict[int, list[float]], group: str | None):
        self.spark, self.features, self.forest, self.fills, self.group = spark, list(features), forest, fills, group

    def nodes(self) -> DataFrame:
        """grp, tree, node (heap order, root 1), n, total (labels in units of 2**-20), feature (-1: leaf), cut, gain."""
        return self.spark.createDataFrame(self.forest.rows(), _NODES)

    def importances(self, name: str = "extra_trees") -> DataFrame:
        """model, feature, score: the share of each feature in what the cuts of each tree take away, averaged."""
        f = self.forest
        per_tree = np.stack([np.where(f.feature == j, f.gain, 0.0).sum(axis=2) for j in range(f.features)], axis=-1)
        whole = per_tree.sum(axis=-1, keepdims=True)
        share = np.divide(per_tree, whole, out=np.zeros_like(per_tree), where=whole > 0).mean(axis=(0, 1))
        return self.spark.createDataFrame([(name, c, float(v)) for c, v in zip(self.features, share)], "model string, feature string, score double")

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``yhat``, in the columns' own order; rows of a group without a forest have none."""
        shared = self.spark.sparkContext.broadcast((self.forest, self.fills))
        features, group = self.features, self.group

        @F.arrow_udf("double")
        def yhat(which: pa.Array, x: pa.Array) -> pa.Array:
            forest, fills = shared.value
            g = which.fill_null(-1).to_numpy(zero_copy_only=False)
            v = np.asarray(x.flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(-1, len(features))
            out = np.full(len(g), np.nan)
            for i, name in enumerate(forest.groups):
                mine = np.flatnonzero(g == name)
                for a in range(0, len(mine), SLICE):
                    some = mine[a:a + SLICE]
                    part = v[some]
                    out[some] = forest.predict(i, np.where(np.isnan(part), fills[name], part))
            return pa.array(out, from_pandas=True)

        missing = F.lit(float("nan"))
        vector = F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), missing) if c in df.columns else missing for c in features])
        return df.withColumn("yhat", yhat(F.col(group).cast("int") if group else F.lit(0), vector))

    def save(self, path: str) -> None:
        self.nodes().write.mode("overwrite").parquet(f"{path}/nodes")
        s = self.forest.settings
        facts = [(g, self.fills[g], self.features, self.group, s.trees, s.depth, s.min_leaf, s.min_split, s.share, s.seed) for g in self.forest.groups]
        self.spark.createDataFrame(facts, "grp int, fills array<double>, features array<string>, by string, trees int, depth int, min_leaf int, min_split int, share double, seed long"
                                   ).write.mode("overwrite").parquet(f"{path}/facts")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ExtraTrees:
        facts = spark.read.parquet(f"{path}/facts").collect()
        r = facts[0]
        settings = Settings(r.trees, r.depth, r.min_leaf, r.min_split, r.share, r.seed)
        forest = Forest.of_rows(spark.read.parquet(f"{path}/nodes").collect(), settings, len(r.features))
        return cls(spark, r.features, forest, {x.grp: list(x.fills) for x in facts}, r.by)


def fit_extra_trees(df: DataFrame, features: Sequence[str], label: str, settings: Settings | None = None, group: str | None = None) -> ExtraTrees:
    """One forest, or one for each value of the integer column ``group``, all grown together. Gaps take the median of
    the group's rows (to 1 part in 10,000 of the ranks), or 0 where a feature has no value; rows without a label or group do not count."""
    spark, settings = df.sparkSession, settings or Settings()
    which = F.col(group).cast("int") if group else F.lit(0)
    value = {c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)) for c in features}
    rows = checkpointed(df.select(which.alias("grp"), *[v.alias(f"_f{i}") for i, v in enumerate(value.values())], F.nanvl(F.col(f"`{label}`").cast("double"), F.lit(None)).alias("_y"))
                        .where(F.col("_y").isNotNull() & F.col("grp").isNotNull()))
    middle = [F.percentile_approx(f"_f{i}", 0.5, 10_000).alias(f"_m{i}") for i in range(len(features))]
    medians = {r.grp: [r[f"_m{i}"] if r[f"_m{i}"] is not None else 0.0 for i in range(len(features))] for r in rows.groupBy("grp").agg(*middle).collect()}
    if not medians:
        raise ValueError("no rows to fit on")
    table = spark.createDataFrame([(g, *m) for g, m in medians.items()], "_g int, " + ", ".join(f"_m{i} double" for i in range(len(features))))
    x = _vector([f"_f{i}" for i in range(len(features))], [f"_m{i}" for i in range(len(features))])
    ready = checkpointed(rows.join(F.broadcast(table), F.col("grp") == F.col("_g")).select("grp", F.floor(F.col("_y") * UNIT + 0.5).cast("bigint").alias("y"), x.alias("x"))
                         .repartition(spark.sparkContext.defaultParallelism))  # every part of the rows sends numbers for every open node
    return ExtraTrees(spark, features, grow(ready, len(features), settings, sorted(medians)), medians, group)
