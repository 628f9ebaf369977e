import numpy as np
import pytest

from hazegrid.operators import extratrees as X

FEATURES = ["a", "b", "c", "same"]
SMALL = X.Settings(trees=5, depth=4, min_leaf=6, min_split=10, share=0.6, seed=3)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(420):
        a, b, c = rng.normal(), rng.integers(0, 4), rng.uniform(-1, 1)
        y = (3.0 if a > 0.4 else 0.0) + b + rng.normal() * 0.1
        rows.append((i % 2, float(a), float(b) if rng.random() > 0.1 else None, float(c), 2.0, float(y) if i % 17 else None))
    return spark.createDataFrame(rows, "fold int, a double, b double, c double, same double, y double"), rows


def brute(rows, settings):
    """A forest grown node by node: {(tree, node): (n, feature, cut, mean)}."""
    x = np.array([[np.nan if v is None else v for v in r[1:5]] for r in rows if r[5] is not None])
    y = np.floor(np.array([r[5] for r in rows if r[5] is not None]) * X.UNIT + 0.5)
    for j in range(x.shape[1]):
        known = np.sort(x[~np.isnan(x[:, j]), j])
        x[np.isnan(x[:, j]), j] = known[(len(known) + 1) // 2 - 1]
    out = {}

    def grow(tree, node, at, depth):
        n, s = len(at), y[at].sum()
        best = (0.0, -1, 0.0)
        if depth < settings.depth and n >= settings.min_split:
            drawn = []
            for j in range(x.shape[1]):
                low, high = x[at, j].min(), x[at, j].max()
                if low < high:
                    u, rank = X.draw(settings.seed, tree, node, j)
                    cut = low + u * (high - low)
                    drawn.append((rank, j, cut if cut < high else low))
            for _, j, cut in sorted(sorted(drawn)[:settings.candidates(x.shape[1])], key=lambda d: d[1]):
                left = at[x[at, j] <= cut]
                if min(len(left), n - len(left)) >= settings.min_leaf:
                    b, c = y[left].sum() / X.UNIT, (s - y[left].sum()) / X.UNIT
                    gain = b * b / len(left) + c * c / (n - len(left)) - (s / X.UNIT) ** 2 / n
                    best = max(best, (gain, -j, cut), key=lambda v: (v[0], v[1])) if gain > best[0] else best
        gain, j, cut = best
        j = -j if gain > 0 else -1
        out[tree, node] = (n, j, cut if gain > 0 else 0.0, s / n / X.UNIT)
        if j >= 0:
            grow(tree, 2 * node, at[x[at, j] <= cut], depth + 1)
            grow(tree, 2 * node + 1, at[x[at, j] > cut], depth + 1)

    for t in range(settings.trees):
        grow(t, 1, np.arange(len(y)), 0)
    return out, x, y / X.UNIT


def found(model, group):
    return {(r.tree, r.node): (r.n, r.feature, r.cut, r.total / r.n / X.UNIT) for r in model.nodes().where(f"grp = {group}").collect()}


def test_equals_brute_force_for_every_group(table):
    df, rows = table
    model = X.fit_extra_trees(df, FEATURES, "y", SMALL, group="fold")
    for g in (0, 1):
        want, x, y = brute([r for r in rows if r[0] == g], SMALL)
        got = found(model, g)
        assert set(got) == set(want) and len(want) > 30
        for k in want:
            assert got[k][:2] == want[k][:2] and got[k][2:] == pytest.approx(want[k][2:], abs=1e-9)


def test_partitioning_does_not_matter(table):
    df, _ = table
    one = X.fit_extra_trees(df.coalesce(1), FEATURES, "y", SMALL)
    many = X.fit_extra_trees(df.repartition(7), FEATURES, "y", SMALL)
    assert found(one, 0) == found(many, 0)


def test_learns_saves_and_ranks(spark, table, tmp_path):
    df, rows = table
    model = X.fit_extra_trees(df, FEATURES, "y", X.Settings(trees=30, depth=6, min_leaf=5))
    model.save(str(tmp_path / "forest"))
    again = X.ExtraTrees.load(spark, str(tmp_path / "forest"))
    for m in (model, again):
        got = [(r.y, r.yhat) for r in m.transform(df.where("y IS NOT NULL")).collect()]
        y, p = map(np.array, zip(*got))
        assert 1 - ((y - p) ** 2).mean() / y.var() > 0.8
    scores = {r.feature: r.score for r in model.importances().collect()}
    assert scores["a"] > scores["c"] and scores["same"] == 0 and sum(scores.values()) == pytest.approx(1)
    assert model.transform(df.drop("c")).where("yhat IS NULL").count() == 0


def test_no_rows(table):
    with pytest.raises(ValueError):
        X.fit_extra_trees(table[0].where("y > 1e9"), FEATURES, "y", SMALL)


def test_parts_are_bounded_and_send_only_nodes_with_rows(spark, monkeypatch):
    df = spark.range(400).selectExpr("cast(id % 2 as int) AS g", "cast(id as double) AS a", "cast(id % 13 as double) AS b", "cast(id * id % 31 as double) AS y")
    settings = X.Settings(trees=3, depth=4, min_leaf=40, min_split=2)
    grow, seen = X.grow, []
    monkeypatch.setattr(X, "grow", lambda rows, *a: (seen.append(rows), grow(rows, *a))[1])
    nodes = [sorted(map(tuple, X.fit_extra_trees(df.repartition(60), ["a", "b"], "y", settings, "g").nodes().collect()))]
    assert seen[0].rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(X, "SLICE", 7)
    nodes.append(sorted(map(tuple, X.fit_extra_trees(df.repartition(1), ["a", "b"], "y", settings, "g").nodes().collect())))
    assert nodes[0] == nodes[1]
    order, edge, at = X._by_node(np.array([3, 9, 8, 9, 1]), 8)
    assert (order.tolist(), edge.tolist(), at.tolist()) == ([2, 1, 3], [0, 1], [0, 1])
