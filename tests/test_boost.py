import numpy as np
import pytest

from hazegrid.operators import boost as B

FEATURES = ["a", "b", "c"]
BASE = dict(rounds=3, depth=3, rate=0.3, l1=0.5, l2=1.5, rows=0.8, features=0.7, least=4, bins=16, leaves=5)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        a, b, c = rng.normal(), rng.integers(0, 5), rng.uniform(-1, 1)
        y = (2.0 if a > 0.3 else 0.0) + (b if c > 0 else -b) * 0.5 + rng.normal() * 0.2
        rows.append((i % 2, float(a), float(b) if rng.random() > 0.15 else None, float(c), float(y) if i % 19 else None, i % 5 == 0))
    return spark.createDataFrame(rows, "fold int, a double, b double, c double, y double, val boolean")


def sides(node, x, feature, cut, missing, missing_left):
    b = x[node, feature]
    left = (b <= cut) & (b != missing) | (b == missing) & missing_left
    return node[left], node[~left]


def brute(x, y, key, start, s):
    """Boosting with loops over nodes and cuts, rows counted anew at every node: [{node: (feature, cut, value)}] per tree."""
    margin, trees = np.full(len(y), start), []
    for r in range(s.rounds):
        used = B.drawn_features(s, x.shape[1], r)
        res = np.floor((y - margin) * B.UNIT + 0.5) / B.UNIT
        drawn = np.flatnonzero(B.drawn_rows(key, s, r))
        rows, cuts, gain = {1: drawn}, {}, {}

        def worth(at):
            return float(B.shrunk(res[at].sum(), s.l1)) ** 2 / (len(at) + s.l2)

        for level in range(s.depth):
            for node in [n for n in rows if n >> level == 1]:
                best = (1e-9, None)
                for f in used:
                    for cut in range(s.bins):
                        for to_left in (False, True):
                            left, right = sides(rows[node], x, f, cut, s.bins, to_left)
                            if min(len(left), len(right)) >= s.least:
                                g = worth(left) + worth(right) - worth(rows[node])
                                if g > best[0] + 1e-12:
                                    best = (g, (f, cut, to_left))
                if best[1]:
                    gain[node], cuts[node] = best
                    rows[2 * node], rows[2 * node + 1] = sides(rows[node], x, *cuts[node][:2], s.bins, cuts[node][2])
        kept = set(cuts)
        if s.way == "leafy":
            kept, n = set(), 1
            while n < s.leaves and (free := [k for k in cuts if k not in kept and (k == 1 or k // 2 in kept)]):
                kept.add(max(free, key=gain.get))
                n += 1
        leaf = {1: np.arange(len(y))}
        out = {}
        for node in sorted(kept):
            leaf[2 * node], leaf[2 * node + 1] = sides(leaf.pop(node), x, *cuts[node][:2], s.bins, cuts[node][2])
            out[node] = cuts[node][:2]
        for node, at in leaf.items():
            v = s.rate * float(B.shrunk(res[rows[node]].sum(), s.l1)) / (len(rows[node]) + s.l2)
            margin[at] += v
        trees.append(out)
    return trees, margin


@pytest.mark.parametrize("way", ["level", "leafy"])
def test_equals_brute_force(spark, table, way):
    s = B.Boosting(way=way, **BASE)
    model = B.fit_boosted(table, FEATURES, "y", s, group="fold", validation=None)
    raw = table.where("y IS NOT NULL")
    from pyspark.sql import functions as F

    rows = raw.select("fold", *FEATURES, "y", F.xxhash64(F.col("fold"), "y", *FEATURES).alias("key")).collect()
    for g in (0, 1):
        mine = [r for r in rows if r.fold == g]
        x = B.binned(np.array([[np.nan if r[f] is None else r[f] for f in FEATURES] for r in mine]), model.cuts, s.bins)
        y, key = np.array([r.y for r in mine]), np.array([r.key for r in mine])
        start = np.floor(y * B.UNIT + 0.5).sum() / len(y) / B.UNIT
        want, margin = brute(x, y, key, start, s)
        got = [{int(n): (int(t.feature[n]), int(t.cut[n])) for n in np.flatnonzero(t.feature >= 0)} for t in model.trees[g][1]]
        assert got == want
        fitted = {(r.y, r.a): r.yhat for r in model.transform(raw.where(f"fold = {g}")).collect()}
        assert [fitted[r.y, r.a] for r in mine] == pytest.approx(margin.tolist(), abs=1e-9)
        if way == "leafy":
            assert all(len(t) <= s.leaves - 1 for t in got)


def test_partitioning_does_not_matter(table, monkeypatch):
    s = B.Boosting(**BASE)
    one = B.fit_boosted(table.coalesce(1), FEATURES, "y", s).cut_table().collect()
    monkeypatch.setattr(B, "ROWS_PER_TASK", 20)
    monkeypatch.setattr(B, "REFRESH", 2)
    many = B.fit_boosted(table.repartition(5), FEATURES, "y", s).cut_table().collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many)) and one


def test_subtraction_equals_a_recount(table):
    """Siblings by subtraction have the counts that counting them would give: the leaves' rows add up to the node's."""
    s = B.Boosting(rounds=1, depth=3, bins=16)
    model = B.fit_boosted(table, FEATURES, "y", s)
    tree = model.trees[0][1][0]
    rows = table.where("y IS NOT NULL").collect()
    x = B.binned(np.array([[np.nan if r[f] is None else r[f] for f in FEATURES] for r in rows]), model.cuts, s.bins)
    y, leaf = np.array([r.y for r in rows]), tree.leaf(x, s.bins, s.depth)
    start = model.trees[0][0]
    for node in np.unique(leaf):
        at = leaf == node
        assert tree.value[0, node] == pytest.approx(s.rate * (y[at] - start).sum() / (at.sum() + s.l2), abs=1e-4)


def test_symmetric_trees_share_cuts(table):
    s = B.Boosting(way="symmetric", rounds=60, depth=3, rate=0.3, bins=16, patience=5)
    model = B.fit_boosted(table, FEATURES, "y", s, group="fold", validation="val")
    for _, trees in model.trees.values():
        assert 0 < len(trees) <= 60
        for t in trees:
            for level in range(s.depth):
                nodes = range(1 << level, 2 << level)
                assert len({(int(t.feature[n]), int(t.cut[n])) for n in nodes}) == 1
    got = [(r.y, r.yhat) for r in model.transform(table.where("y IS NOT NULL AND val")).collect()]
    y, p = map(np.array, zip(*got))
    assert 1 - ((y - p) ** 2).mean() / y.var() > 0.5


@pytest.mark.parametrize("way", ["level", "symmetric"])
def test_stops_when_validation_gets_worse(table, way):
    """Labels that the features say nothing about: a group stops at its own best round, not at the last."""
    from pyspark.sql import functions as F

    noise = table.where("y IS NOT NULL").withColumn("y", F.pmod(F.xxhash64("a", "c"), F.lit(1000)).cast("double"))
    model = B.fit_boosted(noise, FEATURES, "y", B.Boosting(way=way, rounds=40, depth=3, rate=0.9, bins=16, patience=3), group="fold", validation="val")
    assert all(len(trees) < 40 for _, trees in model.trees.values())


def test_ordered_residuals_do_not_see_their_label(spark):
    """On labels that are noise, the margins that residuals are taken from hold little of a row's own label: leaf values
    none of it, only the shape of the trees, which is chosen from all rows."""
    rng = np.random.default_rng(9)
    rows = [(float(rng.normal()), float(rng.normal()), float(rng.normal())) for _ in range(1200)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    from pyspark.sql import functions as F

    own = {}
    for way in ("symmetric", "level"):
        s = B.Boosting(way=way, rounds=12, depth=4, rate=0.4, l2=0.1, bins=32)
        model = B.fit_boosted(df, ["a", "b"], "y", s)
        data = df.select("a", "b", "y", F.xxhash64(F.lit(0), "y", "a", "b").alias("key")).collect()
        x = B.binned(np.array([[r.a, r.b] for r in data]), model.cuts, s.bins)
        start, trees = model.trees[0]
        margin = B._margins(np.full((len(x), trees[0].value.shape[0]), start), x, trees, s)
        m = B._own_margin(margin, np.array([r.key for r in data]), start)
        own[way] = np.corrcoef(m, [r.y for r in data])[0, 1]
    assert own["level"] > 0.4 and abs(own["symmetric"]) < 0.2


def test_no_rows(table):
    with pytest.raises(ValueError):
        B.fit_boosted(table.where("y > 1e9"), FEATURES, "y")


def test_rows_are_held_in_blocks_and_many_rows_change_no_tree(spark, monkeypatch):
    """A task hands on a block of rows as one record; how often margins are written does not matter."""
    block = B._packed(grp=np.array([0, 3]), y=np.array([1.5, -2.0]), val=np.array([True, False]), key=np.array([-5, 7]), x=np.array([[1, 2], [3, 128]]), m=np.array([[0.5], [0.25]]))
    assert block.num_rows == 1
    grp, x, y, key, val, m = next(B._blocks(iter([block]), 2, 1))
    assert (grp.tolist(), x.tolist(), y.tolist(), key.tolist(), val.tolist(), m.tolist()) == ([0, 3], [[1, 2], [3, 128]], [1.5, -2.0], [-5, 7], [True, False], [[0.5], [0.25]])
    df = spark.range(400).selectExpr("cast(id % 2 as int) AS f", "cast(id * 37 % 101 as double) AS a", "cast(id * 53 % 89 as double) AS b", "cast(id * 37 % 101 + id * 53 % 89 % 7 as double) AS y")
    s = B.Boosting(rounds=6, depth=2, rate=0.3, rows=0.8)
    few = sorted(map(tuple, B.fit_boosted(df, ["a", "b"], "y", s, "f").cut_table().collect()))
    monkeypatch.setattr(B, "MANY_ROWS", 10)
    monkeypatch.setattr(B, "REFRESH_MANY", 1)
    assert few and sorted(map(tuple, B.fit_boosted(df, ["a", "b"], "y", s, "f").cut_table().collect())) == few
