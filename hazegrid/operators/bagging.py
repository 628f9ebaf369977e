"""Feature importances of bagged regression trees of any depth.

Trees start level by level: tasks fold their rows into numbers per open node, candidate feature and bin, those of one
tree meet in one task, and the best cuts reach the driver. A node of at most ``SMALL`` rows is not cut that way, since
numbers for it from every part would outweigh its rows: its rows are sent to one task, which grows the rest below it.
So each row is sent once per tree, the passes follow the few large nodes, and no forest stands in the driver.

Features are cut into at most 32 bins at their quantiles, and a third of them are candidates at a node, as in Spark ML.
Draws are keyed: a row's weight in a tree follows from all its columns (so give it those that tell rows apart), candidates
from tree and node. Labels are summed as integers of 2**-20. Partitioning does not matter
beyond rounding.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid.operators.extratrees import UNIT
from hazegrid.session import checkpointed

SMALL = 1 << 15  # drawn rows of a node that one task finishes
NUMBERS = 1 << 21  # counts (of large nodes of some trees) that a task holds in one pass
SLICE = 1 << 14  # rows that a task looks at together
GRID = 1024  # quantiles looked up to find the bins
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])


@dataclass
class Bagging:
    trees: int = 100
    depth: int = 30
    min_leaf: int = 1
    bins: int = 32
    share: float = 1 / 3  # of the features, candidates at a node
    bootstrap: bool = True
    seed: int = 42

    def candidates(self, features: int) -> int:
        return min(features, max(1, math.ceil(self.share * features)))


def mixed(*parts) -> np.ndarray:
    """64 bits that follow from the parts (integers or arrays that broadcast)."""
    h = np.zeros(1, dtype=np.uint64)
    for v in parts:
        h = (h ^ np.asarray(v).astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(31))
    return h


def weights(s: Bagging, tree: int, ids: np.ndarray) -> np.ndarray:
    """How often each row is drawn for the tree."""
    if not s.bootstrap:
        return np.ones(len(ids), dtype=np.uint8)
    u = (mixed(s.seed, 1, tree, ids) >> np.uint64(11)) * 2.0**-53
    return np.searchsorted(POISSON, u, side="right").astype(np.uint8)


def drawn_features(s: Bagging, tree: int, nodes: np.ndarray, features: int) -> np.ndarray:
    """Candidate features of each node (heap order, root 1)."""
    take = s.candidates(features)
    rank = mixed(s.seed, 2, tree, np.asarray(nodes)[:, None], np.arange(features)[None, :])
    return np.argsort(rank, axis=1, kind="stable")[:, :take]


def gains(nl, sl, n, total, least: int) -> np.ndarray:
    """Squared error that a cut takes away, in labels; 0 where a side is too small or nothing but rounding is taken."""
    nr = n - nl
    with np.errstate(divide="ignore", invalid="ignore"):
        sides = (sl / UNIT) ** 2 / nl + ((total - sl) / UNIT) ** 2 / nr
        gain = sides - (total / UNIT) ** 2 / n
    return np.where((nl >= least) & (nr >= least) & (gain > 1e-13 * sides), gain, 0.0)


class Top:
    """Large nodes of one tree: ``feature`` -1 where rows stay, ``cut`` (bins up to it go left), ``left`` (right is the
    next), heap number, and ``state``: open, small (finished by one task) or done."""

    OPEN, LITTLE, DONE = 0, 1, 2

    def __init__(self, n: int, s: Bagging):
        self.s = s
        self.feature, self.cut, self.left, self.heap, self.state, self.depth = [], [], [], [], [], 0
        self.add(1, n)

    def add(self, heap: int, n: int) -> None:
        deep = heap.bit_length() - 1 >= self.s.depth or n < 2 * self.s.min_leaf
        for held, v in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.heap, heap),
                        (self.state, Top.DONE if deep else Top.LITTLE if n <= SMALL else Top.OPEN)):
            held.append(v)
        self.depth = max(self.depth, heap.bit_length() - 1)

    def split(self, node: int, feature: int, cut: int, n_left: int, n_right: int) -> None:
        self.feature[node], self.cut[node], self.left[node], self.state[node] = feature, cut, len(self.feature), Top.DONE
        self.add(2 * self.heap[node], n_left)
        self.add(2 * self.heap[node] + 1, n_right)

    def nodes(self, state: int) -> np.ndarray:
        return np.flatnonzero(np.array(self.state) == state)

    def descend(self, x: np.ndarray) -> np.ndarray:
        """Node of each row of bins."""
        at, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        feature, cut, left = np.array(self.feature), np.array(self.cut), np.array(self.left)
        for _ in range(self.depth):
            f = feature[at]
            at = np.where(f >= 0, left[at] + (x[rows, np.maximum(f, 0)] > cut[at]), at)
        return at


def finish(x: np.ndarray, w: np.ndarray, y: np.ndarray, tree: int, root: int, s: Bagging) -> np.ndarray:
    """Grow all that is below one node from its rows (bins, times drawn, label); what each feature's cuts take away."""
    features = x.shape[1]
    out, ids, depth = np.zeros(features), np.array([root], dtype=np.int64), root.bit_length() - 1
    w, y, place = w.astype(np.int64), y.astype(np.int64), np.zeros(len(x), dtype=np.int32)
    while len(ids) and depth < s.depth:  # rows are sorted by place, which has a row for each id
        edge = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        drawn, wy, rows = drawn_features(s, tree, ids, features), w * y, np.arange(len(x))
        n, total = np.add.reduceat(w, edge), np.add.reduceat(wy, edge)
        n_before, total_before = np.cumsum(n) - n, np.cumsum(total) - total
        best, feature, cut = np.zeros(len(ids)), np.full(len(ids), -1), np.zeros(len(ids), dtype=np.int64)
        for j in range(drawn.shape[1]):
            key = place * np.int32(256) + x[rows, drawn[place, j]]
            order = np.argsort(key)
            key = key[order]
            last = np.flatnonzero(key[1:] != key[:-1])  # of each bin in its node
            last = last[key[last] >> 8 == key[last + 1] >> 8]
            if not len(last):
                continue
            at = key[last] >> 8
            gain = gains(np.cumsum(w[order])[last] - n_before[at], np.cumsum(wy[order])[last] - total_before[at], n[at], total[at], s.min_leaf)
            start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            top = np.maximum.reduceat(gain, start)
            hit = np.flatnonzero(gain == np.repeat(top, np.diff(np.r_[start, len(at)])))
            hit = hit[np.r_[True, at[hit][1:] != at[hit][:-1]]]  # the first of equals
            hit = hit[gain[hit] > best[at[hit]]]
            best[at[hit]], feature[at[hit]], cut[at[hit]] = gain[hit], drawn[at[hit], j], key[last[hit]] & 255
        good = np.flatnonzero(feature >= 0)
        out += np.bincount(feature[good], best[good], minlength=features)
        number = np.full(len(ids), -1)
        number[good] = 2 * np.arange(len(good))
        stay = np.flatnonzero(number[place] >= 0)
        where = place[stay]
        child = number[where] + (x[stay, feature[where]] > cut[where])
        ids = np.stack([2 * ids[good], 2 * ids[good] + 1], axis=1).ravel()
        enough = np.bincount(child, w[stay], minlength=len(ids)) >= 2 * s.min_leaf
        kept = enough[child]
        stay, child, ids = stay[kept], (np.cumsum(enough) - 1)[child[kept]], ids[enough]
        order = np.argsort(child, kind="stable")
        x, w, y, place, depth = x[stay[order]], w[stay[order]], y[stay[order]], child[order].astype(np.int32), depth + 1
    return out


def _arrays(b: pa.RecordBatch, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(b.column("x").to_pylist()), dtype=np.uint8).reshape(-1, features)
    return b.column("id").to_numpy(), x, b.column("y").to_numpy()


def _slices(batches: Iterator[pa.RecordBatch], features: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for b in batches:
        for i in range(0, b.num_rows, SLICE):
            yield _arrays(b.slice(i, SLICE), features)


def _count(rows: DataFrame, tops: dict[int, Top], features: int, s: Bagging) -> DataFrame:
    """Best cut of each open node of the given trees: tree, node, feature, cut, gain, n_left, n_right."""
    shared, take = rows.sparkSession.sparkContext.broadcast(tops), s.candidates(features)

    def drawn_at(tree: int, top: Top) -> tuple[np.ndarray, np.ndarray]:
        nodes = top.nodes(Top.OPEN)
        return nodes, drawn_features(s, tree, np.array(top.heap)[nodes], features)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = {t: (top, *drawn_at(t, top)) for t, top in shared.value.items()}
        held = {t: np.zeros((2, len(nodes) * take * s.bins), dtype=np.int64) for t, (_, nodes, _) in trees.items()}
        for ids, x, y in _slices(batches, features):
            for t, (top, nodes, drawn) in trees.items():
                number = np.full(len(top.state), -1)
                number[nodes] = np.arange(len(nodes))
                w, place = weights(s, t, ids), number[top.descend(x)]
                r = np.flatnonzero((w > 0) & (place >= 0))
                for j in range(take):
                    key = (place[r] * take + j) * s.bins + x[r, drawn[place[r], j]]
                    for side, v in zip(held[t], (w[r], w[r] * y[r])):
                        side += np.bincount(key, v, minlength=len(side)).astype(np.int64)
        for t, (n, total) in held.items():
            if n.any():
                yield pa.RecordBatch.from_pydict({"tree": pa.array([t], pa.int32()), "n": [n.tobytes()], "total": [total.tobytes()]})

    def settle(key: tuple, table: pa.Table) -> pa.Table:
        tree = key[0].as_py()
        nodes, drawn = drawn_at(tree, shared.value[tree])
        n, total = (sum(np.frombuffer(v, dtype=np.int64) for v in table.column(c).to_pylist()).reshape(len(nodes), take, s.bins) for c in ("n", "total"))
        whole = n[:, :1].sum(axis=2, keepdims=True), total[:, :1].sum(axis=2, keepdims=True)
        left = n.cumsum(axis=2)
        gain = gains(left, total.cumsum(axis=2), *whole, s.min_leaf).reshape(len(nodes), -1)
        at, every = gain.argmax(axis=1), np.arange(len(nodes))
        n_left = left.reshape(len(nodes), -1)[every, at]
        return pa.table({"tree": pa.array([tree] * len(nodes), pa.int32()), "node": nodes.astype(np.int32), "feature": drawn[every, at // s.bins].astype(np.int32),
                         "cut": (at % s.bins).astype(np.int32), "gain": gain[every, at], "n_left": n_left, "n_right": whole[0].ravel() - n_left})

    return (rows.mapInArrow(fold, "tree int, n binary, total binary").groupBy("tree")
            .applyInArrow(settle, "tree int, node int, feature int, cut int, gain double, n_left long, n_right long"))


def _finished(rows: DataFrame, n_rows: int, tops: dict[int, Top], features: int, s: Bagging) -> DataFrame:
    """tree, feature, gain: what the cuts below all small nodes take away."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(tops)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = {t: (top, np.array(top.state) == Top.LITTLE, np.array(top.heap)) for t, top in shared.value.items()}
        for ids, x, y in _slices(batches, features):
            for t, (top, little, heap) in trees.items():
                w, at = weights(s, t, ids), top.descend(x)
                r = np.flatnonzero((w > 0) & little[at])
                if not len(r):
                    continue
                r = r[np.argsort(at[r], kind="stable")]
                node = at[r]
                edge = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
                parts = [r[a:b] for a, b in zip(edge, np.r_[edge[1:], len(r)])]
                yield pa.RecordBatch.from_pydict({"tree": pa.array([t] * len(parts), pa.int32()), "node": pa.array(heap[node[edge]], pa.int64()),
                                                  "x": [x[p].tobytes() for p in parts], "w": [w[p].tobytes() for p in parts], "y": [y[p].tobytes() for p in parts]})

    def grow(key: tuple, table: pa.Table) -> pa.Table:
        x, w, y = (np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=kind) for c, kind in (("x", np.uint8), ("w", np.uint8), ("y", np.int64)))
        gain = finish(x.reshape(-1, features), w, y, key[0].as_py(), key[1].as_py(), s)
        used = np.flatnonzero(gain)
        return pa.table({"tree": pa.array([key[0].as_py()] * len(used), pa.int32()), "node": pa.array([key[1].as_py()] * len(used), pa.int64()),
                         "feature": used.astype(np.int32), "gain": gain[used]})

    tasks = max(4 * spark.sparkContext.defaultParallelism, n_rows * s.trees * (features + 9) >> 26)
    sent = rows.mapInArrow(send, "tree int, node long, x binary, w binary, y binary").repartition(tasks, "tree", "node")
    return sent.groupBy("tree", "node").applyInArrow(grow, "tree int, node long, feature int, gain double")


def binned(df: DataFrame, features: Sequence[str], label: str, s: Bagging) -> DataFrame:
    """Stored rows (id, x: one byte per feature, y in units): gaps take the median; rows without a label do not count."""
    spark, p = df.sparkSession, range(len(features))
    told = [F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    value = [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)) for c in features]
    rows = checkpointed(df.select(F.xxhash64(*told).alias("id"), *[v.alias(f"_f{i}") for i, v in enumerate(value)],
                                  F.nanvl(F.col(f"`{label}`").cast("double"), F.lit(None)).alias("_y")).where(F.col("_y").isNotNull()))
    middle = rows.agg(*[F.percentile_approx(f"_f{i}", 0.5, 10_000).alias(f"_m{i}") for i in p]).first()
    full = rows.select("id", "_y", *[F.coalesce(F.col(f"_f{i}"), F.lit(middle[i]), F.lit(0.0)).alias(f"_f{i}") for i in p])
    grid = F.split(F.lit(",".join(str(k / GRID) for k in range(1, GRID))), ",").cast("array<double>")  # one literal, not one for each
    marks = full.agg(*[F.percentile_approx(f"_f{i}", grid, 10_000).alias(f"_q{i}") for i in p], *[F.max(f"_f{i}").alias(f"_h{i}") for i in p]).first()
    edges = []
    for i in p:
        marked = np.array(marks[f"_q{i}"] or [0.0])
        each = np.unique(marked[marked < (marks[f"_h{i}"] or 0.0)])
        edges.append(each if len(each) < s.bins else np.unique(marked[np.arange(1, s.bins) * GRID // s.bins - 1]))

    def to_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([np.searchsorted(edges[i], b.column(f"_f{i}").to_numpy(), side="left") for i in p], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([v.tobytes() for v in x], pa.binary()), b.column("y")], ["id", "x", "y"])

    parts = spark.sparkContext.defaultParallelism  # every part of the rows sends numbers for every open node
    ready = full.withColumn("y", F.floor(F.col("_y") * UNIT + 0.5).cast("bigint")).repartition(parts)
    return checkpointed(ready.mapInArrow(to_bins, "id long, x binary, y long"))


def importances(df: DataFrame, features: Sequence[str], label: str, settings: Bagging | None = None) -> np.ndarray:
    """The share of each feature in what the cuts of a tree take away, averaged over the trees that have cuts."""
    s, p = settings or Bagging(), len(features)
    rows = binned(df, features, label, s)
    n_rows, gained = rows.count(), np.zeros((s.trees, p))
    tops = {t: Top(n_rows, s) for t in range(s.trees)}
    while waiting := [t for t in tops if len(tops[t].nodes(Top.OPEN))]:
        some, room = {}, NUMBERS // (s.candidates(p) * s.bins)
        for t in waiting:
            room -= len(tops[t].nodes(Top.OPEN))
            if some and room < 0:
                break
            some[t] = tops[t]
        for r in _count(rows, some, p, s).orderBy("tree", "node").collect():
            if r.gain > 0:
                gained[r.tree, r.feature] += r.gain
                tops[r.tree].split(r.node, r.feature, r.cut, r.n_left, r.n_right)
            else:
                tops[r.tree].state[r.node] = Top.DONE
    for r in _finished(rows, n_rows, tops, p, s).groupBy("tree", "feature").agg(F.sum("gain").alias("gain")).collect():
        gained[r.tree, r.feature] += r.gain
    whole = gained.sum(axis=1, keepdims=True)
    shares = np.divide(gained, whole, out=np.zeros_like(gained), where=whole > 0).sum(axis=0)
    return shares / shares.sum() if shares.any() else shares
