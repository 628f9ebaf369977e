import numpy as np
import pytest
from pyspark.sql import functions as F

from hazegrid.operators import bagging as G
from hazegrid.operators import models as M

FEATURES = ["a", "b", "c", "same", "none"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(240):
        a, b, c = rng.normal(), rng.integers(0, 4), rng.uniform(-1, 1)
        y = (3.0 if a > 0.4 else 0.0) + b + rng.normal() * 0.1
        rows.append((i, float(a), float(b) if rng.random() > 0.1 else None, float(c) if i % 30 else float("nan"), 2.0, None, float(y) if i % 17 else None))
    return spark.createDataFrame(rows, "id int, a double, b double, c double, same double, none double, y double")


def brute(rows, s, p):
    """Importances of trees grown node by node from the binned rows."""
    ids, y = np.array([r.id for r in rows]), np.array([r.y for r in rows])
    x = np.array([list(r.x) for r in rows])
    out = np.zeros((s.trees, p))

    def grow(t, node, at, w):
        depth, n, total = node.bit_length() - 1, w[at].sum(), (w[at] * y[at]).sum()
        best = (0.0, -1, 0)
        if depth >= s.depth:
            return
        for f in G.drawn_features(s, t, np.array([node]), p)[0]:
            for cut in np.unique(x[at, f])[:-1]:
                left = at[x[at, f] <= cut]
                gain = float(G.gains(w[left].sum(), (w[left] * y[left]).sum(), n, total, s.min_leaf))
                best = (gain, f, cut) if gain > best[0] else best
        gain, f, cut = best
        if f >= 0:
            out[t, f] += gain
            grow(t, 2 * node, at[x[at, f] <= cut], w)
            grow(t, 2 * node + 1, at[x[at, f] > cut], w)

    for t in range(s.trees):
        w = G.weights(s, t, ids).astype(np.int64)
        grow(t, 1, np.flatnonzero(w), w)
    share = (out / np.maximum(out.sum(axis=1, keepdims=True), 1e-300)).sum(axis=0)
    return share / share.sum()


@pytest.mark.parametrize("s", [G.Bagging(trees=3, depth=30), G.Bagging(trees=3, depth=3, min_leaf=7, share=0.7), G.Bagging(trees=2, share=1.0, bootstrap=False)])
def test_forest_equals_one_grown_node_by_node(table, monkeypatch, s):
    want = brute(G.binned(table, FEATURES, "y", s).collect(), s, len(FEATURES))
    # no node is counted over the parts, some are (of all trees together, or tree by tree), or all
    for small, numbers in ((1 << 15, 1 << 21), (90, 1 << 21), *([(90, 300), (0, 1 << 21)] if s.depth < 9 else [])):
        monkeypatch.setattr(G, "SMALL", small)
        monkeypatch.setattr(G, "NUMBERS", numbers)
        assert G.importances(table, FEATURES, "y", s) == pytest.approx(want, abs=1e-9)
    assert min(want[:2]) > want[2] and want[3] == want[4] == 0


def test_importances_do_not_follow_the_parts_of_the_rows(table):
    got = [{r.feature: r.score for r in M.rf_importance(table.repartition(n, "a"), FEATURES[:3], "y").collect()} for n in (1, 7)]
    assert got[0] == pytest.approx(got[1], abs=1e-9) and sum(got[0].values()) == pytest.approx(1.0)


def test_bins_keep_few_values_apart_and_cut_many_by_quantiles(spark):
    df = spark.range(5000).select("id", (F.col("id") % 32).cast("double").alias("few"), F.col("id").cast("double").alias("many"), F.col("id").cast("double").alias("y"))
    got = G.binned(df, ["few", "many"], "y", G.Bagging()).collect()
    assert {(r.x[0], (r.y // G.UNIT) % 32) for r in got} == {(k, k) for k in range(32)}
    sizes = np.bincount([r.x[1] for r in got])
    assert len(sizes) == 32 and sizes.min() > 100 and sizes.max() < 220


def test_a_label_without_spread_has_no_importance(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("a"), F.lit(1.5).alias("y"))
    assert [r.score for r in M.rf_importance(df, ["a"], "y").collect()] == [0.0]
    assert G.importances(df.where("false"), ["a"], "y").tolist() == [0.0]


def test_draws_are_poisson_and_differ_by_tree():
    ids = np.arange(100_000)
    one, two = G.weights(G.Bagging(), 0, ids), G.weights(G.Bagging(), 1, ids)
    assert one.mean() == pytest.approx(1.0, abs=0.02) and (one == 0).mean() == pytest.approx(np.exp(-1), abs=0.01)
    assert abs(np.corrcoef(one, two)[0, 1]) < 0.02
    seen = np.bincount(G.drawn_features(G.Bagging(), 3, np.arange(1, 3001), 9).ravel(), minlength=9)
    assert seen.sum() == 9000 and seen.min() > 850
