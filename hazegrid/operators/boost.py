"""Gradient boosting on binned features, grown by Spark aggregations, in three ways.

``level``: every node of a level is split by its own best cut (second-order gain with L1 and L2 shrinkage). ``leafy``: leaves are
split best first until there are ``leaves`` of them; since a node's cut depends on its own rows only, the passes go level by
level all the same and a queue picks from what they found. ``symmetric``: one cut for all nodes of a level, and ordered
boosting: a row's residual comes from a model that was fitted on rows before it in a keyed order (rows nested by powers of
two), so that no leaf value a row meets holds its own label (the cuts are chosen from all rows).

A pass sums residuals and rows by node, feature and bin in each task; only the smaller child of a node is counted, the other is
parent minus child. What is sent has the size of a tree's histograms. Groups (validation folds) are boosted side by side in the
same passes, each with its own trees and its own early stop. Residuals are summed as integers of 2**-20 and draws are keyed by
hashes, so the trees depend on rows, seed and settings only.

A missing value has a bin of its own and goes to the side where it helps. Fitted margins are written once in
``REFRESH`` rounds (``REFRESH_MANY`` beyond ``MANY_ROWS`` rows); in between, tasks add the few trees since. The trees are the same.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazegrid.operators.extratrees import draw
from hazegrid.session import checkpointed

UNIT = 1 << 20
REFRESH = 24  # rounds, and for many rows, of which a round's walk costs more than the writing:
REFRESH_MANY, MANY_ROWS = 4, 100_000
ROWS_PER_TASK = 200_000
PREFIXES = 6  # ordered boosting: models on 1/64, 1/32, ... of the rows


@dataclass
class Boosting:
    way: str = "level"  # level, leafy or symmetric
    rounds: int = 100
    depth: int = 6
    rate: float = 0.1
    l1: float = 0.0
    l2: float = 1.0
    rows: float = 1.0  # share drawn for each tree
    features: float = 1.0  # likewise
    least: int = 1  # rows in a leaf
    leaves: int = 31  # of a leafy tree
    patience: int = 50  # rounds without a better validation error
    bins: int = 128
    seed: int = 42


@dataclass
class Tree:
    """Heap order, root 1: ``feature`` -1 at leaves; rows of bin <= ``cut`` go left, missing ones if ``missing_left``. ``value``
    [model, node]: the models of ordered boosting, the last fitted on all rows."""

    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int, models: int) -> Tree:
        size = 2 << depth
        return cls(np.full(size, -1, dtype=np.int16), np.zeros(size, dtype=np.int16), np.zeros(size, dtype=bool), np.zeros((models, size)))

    def leaf(self, x: np.ndarray, missing: int, levels: int) -> np.ndarray:
        node, row = np.ones(len(x), dtype=np.int64), np.arange(len(x))
        for _ in range(levels):
            f = self.feature[node]
            b = x[row, np.maximum(f, 0)]
            right = np.where(b == missing, ~self.missing_left[node], b > self.cut[node])
            node = np.where(f >= 0, 2 * node + right, node)
        return node


def shrunk(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def gains(hist: np.ndarray, s: Boosting) -> tuple[np.ndarray, np.ndarray]:
    """hist [node, feature, bin, (residuals, rows)], the last bin being the missing -> gain of each cut [node, feature, bin],
    and whether the missing go left. A cut needs ``least`` rows on both sides."""
    g, h = hist[..., 0] / UNIT, hist[..., 1].astype(float)
    lost_g, lost_h = g[..., -1:], h[..., -1:]
    left_g, left_h = np.cumsum(g[..., :-1], axis=-1), np.cumsum(h[..., :-1], axis=-1)
    all_g, all_h = left_g[..., -1:] + lost_g, left_h[..., -1:] + lost_h

    def worth(a: np.ndarray, n: np.ndarray) -> np.ndarray:
        return shrunk(a, s.l1) ** 2 / np.maximum(n + s.l2, 1e-12)

    whole = worth(all_g, all_h)
    best = np.full((2, *left_g.shape), -1.0)
    for k, (a, n) in enumerate(((left_g, left_h), (left_g + lost_g, left_h + lost_h))):
        ok = (n >= s.least) & (all_h - n >= s.least)
        best[k] = np.where(ok, worth(a, n) + worth(all_g - a, all_h - n) - whole, -1.0)
    to_left = best[1] > best[0]
    return np.maximum(best[0], best[1]), to_left


def drawn_features(s: Boosting, features: int, round_: int) -> np.ndarray:
    take = max(1, int(s.features * features))
    order = sorted(range(features), key=lambda f: draw(s.seed, round_, 0, f)[1])
    return np.sort(np.array(order[:take]))


def drawn_rows(key: np.ndarray, s: Boosting, round_: int) -> np.ndarray:
    """Whether a row counts in this round, from its hash."""
    x = key.view(np.uint64) ^ np.uint64((round_ * 0x9E3779B97F4A7C15 + s.seed) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) >> np.uint64(11) < np.uint64(int(s.rows * (1 << 53)))


def prefix_of(key: np.ndarray) -> np.ndarray:
    """The first of the nested row sets (0: 1/64 of the rows, ..., ``PREFIXES``: all) that holds a row."""
    u = (key.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - PREFIXES)
    return np.array([int(v).bit_length() for v in range(1 << PREFIXES)])[u.astype(np.int64)]


class _Group:
    """A group's boosting so far."""

    def __init__(self, start: float):
        self.start, self.trees, self.recent = start, [], []
        self.best, self.best_rounds, self.done = np.inf, 0, False
        self.tree: Tree | None = None
        self.count: list[int] = []  # nodes of this level whose rows are counted
        self.hist: np.ndarray | None = None


def _margins(stored: np.ndarray, x: np.ndarray, trees: Sequence[Tree], s: Boosting) -> np.ndarray:
    out = stored.copy()
    for t in trees:
        out += t.value[:, t.leaf(x, s.bins, s.depth)].T
    return out


def _own_margin(margin: np.ndarray, key: np.ndarray, start: float) -> np.ndarray:
    """The margin a row's residual is taken from: of the model before the first that holds it; the start alone where there is none."""
    if margin.shape[1] == 1:
        return margin[:, 0]
    first = prefix_of(key)
    return np.where(first > 0, margin[np.arange(len(key)), np.maximum(first - 1, 0)], start)


LAYOUT = {"grp": "<i4", "y": "<f8", "val": "?", "key": "<i8", "x": "u1", "m": "<f8"}
BLOCKS = ", ".join(f"{c} binary" for c in LAYOUT)


def _packed(**columns: np.ndarray) -> pa.RecordBatch:
    """Rows as one record of six byte strings: reading and handing on a record for each row would take longer than the sums."""
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(columns[c], dtype=kind).tobytes()], pa.binary()) for c, kind in LAYOUT.items()], list(LAYOUT))


def _blocks(batches: Iterator[pa.RecordBatch], features: int, models: int) -> Iterator[tuple[np.ndarray, ...]]:
    """grp, x, y, key, val, margin of each packed block."""
    for b in batches:
        for r in b.to_pylist():
            v = {c: np.frombuffer(r[c], dtype=kind) for c, kind in LAYOUT.items()}
            yield v["grp"], v["x"].reshape(-1, features).astype(np.int64), v["y"], v["key"], v["val"], v["m"].reshape(-1, models)


def _pass(rows: DataFrame, groups: dict[int, _Group], s: Boosting, features: int, models: int, round_: int, level: int | None) -> dict[int, tuple[np.ndarray, float, int]]:
    """Sums over all rows: for each open group its histograms of the counted nodes of ``level`` [node, feature, bin, 2] (or, without a level, residuals and
    rows of each model and leaf), and the squared error and number of its validation rows."""
    open_ = {g: (v.start, v.recent, v.tree, list(v.count)) for g, v in groups.items() if not v.done}
    shared = rows.sparkSession.sparkContext.broadcast(open_)
    used = drawn_features(s, features, round_)
    size = 2 << s.depth

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for grp, x_, y_, key_, val_, margin_ in _blocks(batches, features, models):
            for g in map(int, np.unique(grp)):
                if g not in shared.value:
                    continue
                start, recent, tree, count = shared.value[g]
                if g not in held:
                    held[g] = [np.zeros((models, size, 2) if level is None else (len(count), len(used), s.bins + 1, 2), dtype=np.int64), 0.0, 0]
                mine = grp == g
                x, y, key, val = x_[mine], y_[mine], key_[mine], val_[mine]
                margin = _margins(margin_[mine], x, recent, s)
                if level == 0:
                    held[g][1] += float(((y - margin[:, -1])[val] ** 2).sum())
                    held[g][2] += int(val.sum())
                train = ~val & drawn_rows(key, s, round_) if level is not None else ~val
                x, y, key, margin = x[train], y[train], key[train], margin[train]
                if level is None:
                    leaf, first = tree.leaf(x, s.bins, s.depth), prefix_of(key)
                    for j in range(models):
                        inside = first <= j if models > 1 else np.ones(len(x), dtype=bool)
                        units = np.floor((y[inside] - margin[inside, j]) * UNIT + 0.5)
                        held[g][0][j, :, 0] += np.bincount(leaf[inside], units, size).astype(np.int64)
                        held[g][0][j, :, 1] += np.bincount(leaf[inside], minlength=size)
                    continue
                units = np.floor((y - _own_margin(margin, key, start)) * UNIT + 0.5)
                place = np.full(2 << s.depth, -1)
                place[count] = np.arange(len(count))
                at = place[tree.leaf(x, s.bins, level)]
                here = at >= 0
                at, units, x = at[here], units[here], x[here]
                for k, f in enumerate(used):
                    cell = at * (s.bins + 1) + x[:, f]
                    n = len(count) * (s.bins + 1)
                    held[g][0][:, k, :, 0] += np.bincount(cell, units, n).astype(np.int64).reshape(len(count), -1)
                    held[g][0][:, k, :, 1] += np.bincount(cell, minlength=n).reshape(len(count), -1)
        for g, (sums, error, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([sums.tobytes()], pa.binary()), pa.array([error]), pa.array([n], pa.int64())], ["grp", "sums", "error", "n"])

    schema = "grp int, sums binary, error double, n long"
    parts = rows.mapInArrow(fold, schema)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(v, dtype=np.int64) for v in table.column("sums").to_pylist()]
        order = np.argsort(table.column("error").to_numpy())
        return pa.table({"grp": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([np.sum(blobs, axis=0).tobytes()], pa.binary()),
                         "error": pa.array([float(table.column("error").to_numpy()[order].sum())]), "n": pa.array([int(table.column("n").to_numpy().sum())], pa.int64())})

    if rows.rdd.getNumPartitions() > 8:  # few parts of bounded size are added up right here
        parts = parts.groupBy("grp").applyInArrow(merge, schema)
    out: dict[int, tuple[np.ndarray, float, int]] = {}
    for r in parts.toArrow().to_pylist():
        g = r["grp"]
        shape = (models, size, 2) if level is None else (len(open_[g][3]), len(used), s.bins + 1, 2)
        sums = np.frombuffer(r["sums"], dtype=np.int64).reshape(shape)
        old = out.get(g, (0, 0.0, 0))
        out[g] = (old[0] + sums, old[1] + r["error"], old[2] + r["n"])
    return out


def _settle(v: _Group, found: np.ndarray, s: Boosting, used: np.ndarray, level: int, gain: np.ndarray) -> None:
    """Cut the nodes of a level: ``found`` has the counted ones; their siblings are parent minus child."""
    first = 1 << level
    hist = np.zeros((first, *found.shape[1:]), dtype=np.int64)
    at = {node: i for i, node in enumerate(v.count)}
    for node in range(first, 2 * first):
        if node in at:
            hist[node - first] = found[at[node]]
        elif level and (node ^ 1) in at:
            hist[node - first] = v.hist[node // 2 - first // 2] - found[at[node ^ 1]]
    worth, to_left = gains(hist, s)
    flat = worth.reshape(first, -1)
    if s.way == "symmetric":
        alike = np.where(flat > 0, flat, 0.0).sum(axis=0)
        pick = np.full(first, int(alike.argmax()))
        good = np.arange(first) if alike.max() > 1e-9 else np.zeros(0, dtype=int)
    else:
        pick = flat.argmax(axis=1)
        good = np.flatnonzero(flat[np.arange(first), pick] > 1e-9)
    count = []
    for i in good:
        k, cut = divmod(int(pick[i]), s.bins)
        node, left_missing = first + i, bool(to_left[i, k, cut])
        v.tree.feature[node], v.tree.cut[node], v.tree.missing_left[node] = used[k], cut, left_missing
        gain[node] = flat[i, pick[i]]
        sums = hist[i, k]
        left = sums[:cut + 1].sum(axis=0) + (sums[-1] if left_missing else 0)
        right = sums.sum(axis=0) - left
        for child, (g, n) in ((2 * node, left), (2 * node + 1, right)):
            v.tree.value[-1, child] = s.rate * float(shrunk(g / UNIT, s.l1)) / max(float(n) + s.l2, 1e-12)
        count.append(2 * node if left[1] <= right[1] else 2 * node + 1)
    if level == 0:
        g, n = hist[0, 0].sum(axis=0)
        v.tree.value[-1, 1] = s.rate * float(shrunk(g / UNIT, s.l1)) / max(float(n) + s.l2, 1e-12)
    v.count, v.hist = count, hist


def best_first(tree: Tree, gain: np.ndarray, leaves: int) -> None:
    """Keep only the cuts that best-first growth to ``leaves`` leaves makes."""
    queue, n, kept = [(-gain[1], 1)] if tree.feature[1] >= 0 else [], 1, set()
    while queue and n < leaves:
        _, node = heapq.heappop(queue)
        kept.add(node)
        n += 1
        for child in (2 * node, 2 * node + 1):
            if child < len(gain) and tree.feature[child] >= 0:
                heapq.heappush(queue, (-gain[child], child))
    for node in np.flatnonzero(tree.feature >= 0):
        if int(node) not in kept:
            tree.feature[node] = -1


class Boosted:
    """Fitted trees for each group; ``transform`` adds ``yhat``."""

    def __init__(self, spark: SparkSession, features: Sequence[str], cuts: list[np.ndarray], trees: dict[int, tuple[float, list[Tree]]], s: Boosting, group: str | None):
        self.spark, self.features, self.cuts, self.trees, self.settings, self.group = spark, list(features), cuts, trees, s, group

    def transform(self, df: DataFrame) -> DataFrame:
        shared = self.spark.sparkContext.broadcast((self.cuts, self.trees))
        s, width, group = self.settings, len(self.features), self.group

        @F.arrow_udf("double")
        def yhat(which: pa.Array, x: pa.Array) -> pa.Array:
            cuts, trees = shared.value
            g = which.fill_null(-1).to_numpy(zero_copy_only=False)
            v = binned(np.asarray(x.flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(-1, width), cuts, s.bins)
            out = np.full(len(g), np.nan)
            for name, (start, grown) in trees.items():
                mine = np.flatnonzero(g == name)
                total = np.full(len(mine), start)
                for t in grown:
                    total += t.value[-1, t.leaf(v[mine], s.bins, s.depth)]
                out[mine] = total
            return pa.array(out, from_pandas=True)

        missing = F.lit(float("nan"))
        vector = F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), missing) if c in df.columns else missing for c in self.features])
        return df.withColumn("yhat", yhat(F.col(group).cast("int") if group else F.lit(0), vector))

    def cut_table(self) -> DataFrame:
        """grp, tree, node, feature, cut (greatest value that goes left), missing_left of every cut."""
        rows = [(g, i, int(n), self.features[t.feature[n]], float(self.cuts[t.feature[n]][t.cut[n]]) if t.cut[n] < len(self.cuts[t.feature[n]]) else None, bool(t.missing_left[n]))
                for g, (_, grown) in self.trees.items() for i, t in enumerate(grown) for n in np.flatnonzero(t.feature >= 0)]
        return self.spark.createDataFrame(rows, "grp int, tree int, node int, feature string, cut double, missing_left boolean")

    def sizes(self) -> dict[int, int]:
        return {g: len(t) for g, (_, t) in self.trees.items()}

    def importances(self, name: str = "boosted") -> DataFrame:
        """model, feature, score: each feature's share of the cuts."""
        n = np.zeros(len(self.features))
        for _, grown in self.trees.values():
            for t in grown:
                n += np.bincount(t.feature[t.feature >= 0], minlength=len(n))
        return self.spark.createDataFrame([(name, f, float(v)) for f, v in zip(self.features, n / max(n.sum(), 1.0))], "model string, feature string, score double")

    def save(self, path: str) -> None:
        facts = [(self.features, [c.tolist() for c in self.cuts], self.group, json.dumps(asdict(self.settings)), {int(g): start for g, (start, _) in self.trees.items()})]
        self.spark.createDataFrame(facts, "features array<string>, cuts array<array<double>>, by string, settings string, starts map<int,double>").write.mode("overwrite").parquet(f"{path}/facts")
        rows = [(int(g), i, t.feature.tolist(), t.cut.tolist(), t.missing_left.tolist(), t.value[-1].tolist()) for g, (_, grown) in self.trees.items() for i, t in enumerate(grown)]
        self.spark.createDataFrame(rows, "grp int, tree int, feature array<int>, cut array<int>, missing_left array<boolean>, value array<double>").write.mode("overwrite").parquet(f"{path}/trees")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Boosted:
        """A saved model; it predicts, with the values fitted on all rows."""
        r = spark.read.parquet(f"{path}/facts").first()
        trees: dict[int, tuple[float, list[Tree]]] = {g: (start, []) for g, start in r.starts.items()}
        for t in spark.read.parquet(f"{path}/trees").orderBy("grp", "tree").collect():
            trees[t.grp][1].append(Tree(np.array(t.feature, dtype=np.int16), np.array(t.cut, dtype=np.int16), np.array(t.missing_left), np.array([t.value])))
        return cls(spark, r.features, [np.array(c) for c in r.cuts], trees, Boosting(**json.loads(r.settings)), r.by)


def binned(x: np.ndarray, cuts: Sequence[np.ndarray], missing: int) -> np.ndarray:
    out = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T)], axis=1).astype(np.int64)
    out[np.isnan(x)] = missing
    return out


def fit_boosted(df: DataFrame, features: Sequence[str], label: str, settings: Boosting | None = None, group: str | None = None, validation: str | None = None) -> Boosted:
    """Boosted trees for the rows with a label (for each value of ``group``). Rows flagged in ``validation`` only decide where a group stops."""
    spark, s, p = df.sparkSession, settings or Boosting(), len(features)
    models = PREFIXES + 1 if s.way == "symmetric" else 1
    which = F.col(group).cast("int") if group else F.lit(0)
    value = [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)) for c in features]
    flag = F.coalesce(F.col(validation).cast("boolean"), F.lit(False)) if validation else F.lit(False)
    rows = df.select(which.alias("grp"), F.nanvl(F.col(f"`{label}`").cast("double"), F.lit(None)).alias("y"), flag.alias("val"), *[v.alias(f"_{i}") for i, v in enumerate(value)])
    rows = rows.where(F.col("y").isNotNull() & F.col("grp").isNotNull()).withColumn("key", F.xxhash64("grp", "y", *[f"_{i}" for i in range(p)]))
    rows = checkpointed(rows)
    shares = [i / s.bins for i in range(1, s.bins)]
    found = rows.where(~F.col("val")).agg(*[F.percentile_approx(f"_{i}", shares, 10_000).alias(f"_{i}") for i in range(p)]).first()
    cuts = [np.unique(np.array(found[f"_{i}"] if found[f"_{i}"] is not None else [], dtype=float)) for i in range(p)]
    sums = rows.where(~F.col("val")).groupBy("grp").agg(F.sum(F.floor(F.col("y") * UNIT + 0.5).cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")).collect()
    groups = {r.grp: _Group(int(r.s) / r.n / UNIT) for r in sums}
    if not groups:
        raise ValueError("no rows to fit on")
    starts = {g: v.start for g, v in groups.items()}

    def ready(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(f"_{i}").fill_null(float("nan")).to_numpy(zero_copy_only=False) for i in range(p)], axis=1).astype(float)
            codes = binned(x, cuts, s.bins).astype(np.uint8)
            grp = b.column("grp").to_numpy()
            margin = np.repeat(np.array([starts.get(g, 0.0) for g in grp.tolist()]), models)
            yield _packed(grp=grp, y=b.column("y").to_numpy(), val=b.column("val").to_numpy(zero_copy_only=False), key=b.column("key").to_numpy(), x=codes, m=margin)

    n_rows = rows.count()
    tasks, refresh_every = max(1, -(-n_rows // ROWS_PER_TASK)), REFRESH if n_rows <= MANY_ROWS else REFRESH_MANY
    table = checkpointed(rows.repartition(tasks, "key").mapInArrow(ready, BLOCKS))

    def refresh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grp, x, y, key, val, margin in _blocks(batches, p, models):
            new = margin.copy()
            for g in map(int, np.unique(grp)):
                if g in recent.value:
                    mine = grp == g
                    new[mine] = _margins(margin[mine], x[mine], recent.value[g], s)
            yield _packed(grp=grp, y=y, val=val, key=key, x=x, m=new)

    for round_ in range(s.rounds + 1):  # the last only validates
        live = [v for v in groups.values() if not v.done]
        if not live:
            break
        used, gain = drawn_features(s, p, round_), {g: np.zeros(2 << s.depth) for g in groups}
        for v in live:
            v.tree, v.count, v.hist = Tree.empty(s.depth, models), [1], None
        for level in range(s.depth):
            for g, (sums_, error, n) in _pass(table, groups, s, p, models, round_, level).items():
                v = groups[g]
                if level == 0 and n:
                    if error / n < v.best:
                        v.best, v.best_rounds = error / n, round_
                    v.done = round_ - v.best_rounds >= s.patience
                elif level == 0:
                    v.best_rounds = round_
                if round_ == s.rounds:
                    v.done = True
                elif not v.done:
                    _settle(v, sums_, s, used, level, gain[g])
            if round_ == s.rounds or not any(v.count for v in live if not v.done):
                break
        live = [(g, v) for g, v in groups.items() if not v.done]
        for g, v in live:
            if s.way == "leafy":
                best_first(v.tree, gain[g], s.leaves)
        if s.way == "symmetric" and live:
            for g, (sums_, _, _) in _pass(table, groups, s, p, models, round_, None).items():
                groups[g].tree.value = s.rate * shrunk(sums_[..., 0] / UNIT, s.l1) / np.maximum(sums_[..., 1] + s.l2, 1e-12)
        for _, v in live:
            v.trees.append(v.tree)
            v.recent.append(v.tree)
        if (round_ + 1) % refresh_every == 0:
            recent = spark.sparkContext.broadcast({g: v.recent for g, v in groups.items()})
            table = checkpointed(table.mapInArrow(refresh, BLOCKS))
            for v in groups.values():
                v.recent = []
    return Boosted(spark, features, cuts, {g: (v.start, v.trees[:v.best_rounds]) for g, v in groups.items()}, s, group)
