"""Block plans against brute force, with blocks so small that every frame crosses borders."""

import random

import numpy as np
import pandas as pd
import pytest
from conftest import T0, column
from pyspark.sql import functions as F

from hazegrid.operators import clean as C
from hazegrid.operators import windows as W
from hazegrid.plans import quantiles as Q
from hazegrid.plans.attach import attach
from hazegrid.plans.blocks import halo_window, row_positions


def holes(n, seed, share=0.6):
    r = random.Random(seed)
    return [None if r.random() < share else round(r.uniform(0, 100), 2) for _ in range(n)]


def near(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g is None) == (w is None or w != w), (got, want)
        if g is not None:
            assert g == pytest.approx(w)


@pytest.fixture
def two(hourly):
    a, b = holes(61, 1), holes(37, 2, 0.9)
    return hourly(a=a, b=b), {"a": a, "b": b}


def series(values):
    idx = pd.date_range("2024-01-01", periods=len(values), freq="h")
    return pd.Series([np.nan if v is None else v for v in values], index=idx)


def test_unlimited_fill(two, small_blocks):
    df, raw = two
    for name, vs in raw.items():
        s = series(vs)
        near(column(C.ffill(df, ["x"]), series=name), list(s.ffill()))
        near(column(C.bfill(df, ["x"]), series=name), list(s.bfill()))
        near(column(C.fill_both(df, ["x"]), series=name), list(s.ffill().bfill()))


def test_limited_fill(two, small_blocks):
    df, raw = two
    for name, vs in raw.items():
        s = series(vs)
        near(column(C.ffill(df, ["x"], limit=2), series=name), list(s.ffill(limit=2)))
        near(column(C.bfill(df, ["x"], limit=3), series=name), list(s.bfill(limit=3)))


def test_interpolation(two, small_blocks):
    df, raw = two
    for name, vs in raw.items():
        s = series(vs)
        near(column(C.interpolate_time(df, ["x"]), series=name), list(s.interpolate(method="time", limit=6)))
        near(column(C.interpolate_both(df, ["x"]), series=name),
             list(s.interpolate(method="linear", limit_direction="both")))


def test_rolling_lag_lead(two, small_blocks):
    df, raw = two
    wide = halo_window(
        df, ["series_id"],
        lambda w: [F.lag("x", 7).over(w).alias("lag"), F.lead("x", 9).over(w).alias("lead"),
                   W.rolling(w, F.avg, F.col("x"), 6, 0, 1).alias("mean"), W.rolling(w, F.max, F.col("x"), 2, 4).alias("top")],
        before=7, after=9)
    assert wide.count() == df.count()
    for name, vs in raw.items():
        s = series(vs)
        near(column(wide, "lag", name), list(s.shift(7)))
        near(column(wide, "lead", name), list(s.shift(-9)))
        near(column(wide, "mean", name), list(s.rolling(6, min_periods=1).mean()))
        near(column(wide, "top", name), list(s.shift(4).rolling(2).max()))


def test_rows_with_gaps(hourly, small_blocks):
    """On an irregular axis windows count rows, not hours."""
    vs = [v or 1.0 for v in holes(40, 5, 0.0)]
    hours = sorted(random.Random(3).sample(range(400), 40))
    df = hourly(hours=hours, a=vs)
    got = column(W.rolling_mean(df, {"m": ("x", 4)}, gap_free=False), "m")
    near(got, list(pd.Series(vs).rolling(4, min_periods=1).mean()))
    assert column(W.row_index(df), "row_idx") == list(range(40))


def test_rolling_by_time(hourly):
    hours = sorted(random.Random(4).sample(range(3000), 300))
    vs = holes(300, 6, 0.2)
    df = hourly(hours=hours, a=vs)
    s = pd.Series([np.nan if v is None else v for v in vs], index=pd.Timestamp("2024-01-01") + pd.to_timedelta(hours, unit="h"))
    near(column(W.rolling_mean_by_time(df, "x", 24, "m"), "m"), list(s.rolling("24h", min_periods=1).mean()))


def test_positions_without_keys(spark):
    xs = [random.Random(1).uniform(0, 50) for _ in range(200)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = row_positions(df, [], ["x"], F.floor("x"), "p").orderBy("p").collect()
    assert [r.p for r in got] == list(range(200)) and [r.x for r in got] == sorted(xs)


def test_positions_keep_null_buckets(spark):
    df = spark.createDataFrame([(None,), (3.0,), (1.0,)], "x double")
    got = row_positions(df, [], [F.col("x").asc_nulls_first()], F.floor("x"), "p").orderBy("p").collect()
    assert [r.x for r in got] == [None, 1.0, 3.0]


@pytest.mark.parametrize("tight", [False, True])
def test_quantiles(spark, monkeypatch, tight):
    """Exact with the whole group as bracket and with narrow sketch brackets."""
    if tight:
        monkeypatch.setattr(Q, "SMALL_GROUP", 10)
        monkeypatch.setattr(Q, "ACCURACY", 200)
        monkeypatch.setattr(Q, "SLACK", 2.0 / 200)
    r = np.random.default_rng(0)
    rows = [("a", float(v), float(i % 7)) for i, v in enumerate(r.lognormal(0, 2, 3000))]
    rows += [("b", float(v), None) for v in np.repeat([1.0, 2.0, 2.0, 9.0], 500)]
    df = spark.createDataFrame(rows, "k string, x double, y double").repartition(5)
    probs = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
    got = {g.k: g for g in Q.exact_quantiles(df, ["k"], ["x", "y"], probs).collect()}
    for k in "ab":
        xs = [v for key, v, _ in rows if key == k]
        assert got[k].x == pytest.approx(list(np.quantile(xs, probs)))
    assert got["a"].y == pytest.approx(list(np.quantile([y for k, _, y in rows if k == "a"], probs)))
    assert all(q is None for q in got["b"].y or [None])
    pooled = Q.exact_quantiles(df, [], ["x"], [0.5]).first().x
    assert pooled == pytest.approx([np.median([v for _, v, _ in rows])])


def test_attach_both_ways(spark, monkeypatch):
    df = spark.createDataFrame([(i % 3, i) for i in range(30)], "k int, v int")
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k int, name string")
    want = sorted((r.k, r.v, r.name) for r in attach(df, small, ["k"]).collect()), 30
    import hazegrid.plans.attach as attach_module

    monkeypatch.setattr(attach_module, "BROADCAST_BYTES", 0)
    salted = attach(df, small, ["k"])
    key = lambda t: (t[0], t[1])
    assert sorted(((r.k, r.v, r.name) for r in salted.collect()), key=key) == sorted(want[0], key=key)
    assert "_salt" not in salted.columns


def brute_knn(vs, k):
    """Nearest donors by the definition, on a (rows x columns) array with NaN."""
    out, means = vs.copy(), np.nanmean(vs, axis=0)
    for i in range(len(vs)):
        for j in range(vs.shape[1]):
            if not np.isnan(vs[i, j]):
                continue
            cand = []
            for d in range(len(vs)):
                both = ~np.isnan(vs[i]) & ~np.isnan(vs[d])
                if not np.isnan(vs[d, j]) and both.any():
                    gap = np.sqrt(((vs[i] - vs[d])[both] ** 2).sum() * vs.shape[1] / both.sum())
                    cand.append((gap, d))
            out[i, j] = np.mean([vs[d, j] for _, d in sorted(cand)[:k]]) if cand else means[j]
    return out


@pytest.mark.parametrize("chunk", [7, 1000])
def test_knn(spark, chunk):
    import datetime as dt

    r = np.random.default_rng(3)
    vs = np.round(r.normal(50, 20, (60, 3)), 1)
    vs[r.random((60, 3)) < 0.35] = np.nan
    vs[5] = np.nan
    rows = [("s", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), *[None if np.isnan(x) else float(x) for x in v])
            for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp, a double, b double, c double")
    got = C.impute_knn(df, ["a", "b", "c"], 4, chunk=chunk).orderBy("ts").select("a", "b", "c").collect()
    assert np.allclose(np.array([list(g) for g in got], dtype=float), brute_knn(vs, 4))


def test_gram_equals_corr(spark):
    from hazegrid.operators import profile as P

    r = np.random.default_rng(1)
    m = r.normal(1e4, 3, (500, 4))
    m[:, 3] = m[:, 0] * 2 + r.normal(0, 0.1, 500)
    m[r.random((500, 4)) < 0.2] = np.nan
    names = list("abcd")
    df = spark.createDataFrame(pd.DataFrame(m, columns=names)).select(
        *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in names], F.lit(1.0).alias("flat"))
    want = pd.DataFrame(m, columns=names).corr().abs()
    got = {(g.feature_a, g.feature_b): g.abs_corr for g in P.corr_pairs(df, [*names, "flat"]).collect()}
    assert len(got) == 10
    for (a, b), v in got.items():
        if b == "flat":
            assert v is None
        else:
            assert v == pytest.approx(want.loc[a, b], abs=1e-9)


def test_corr_does_not_depend_on_width_or_scale(spark):
    """Tiny values, NaN cells and further columns leave a pair's correlation as it is."""
    from hazegrid.operators import profile as P

    r = np.random.default_rng(2)
    m = r.normal(0, 1, (300, 20))
    m[:, 1] = m[:, 0] + r.normal(0, 0.5, 300)
    m[:, :3] *= 1e-7
    m[r.random((300, 20)) < 0.1] = np.nan
    names = [f"c{i}" for i in range(20)]
    df = spark.createDataFrame(pd.DataFrame(m, columns=names))
    want = pd.DataFrame(m, columns=names).corr().abs()
    for width in (3, 20):
        for g in P.corr_pairs(df, names[:width]).collect():
            assert g.abs_corr == pytest.approx(want.loc[g.feature_a, g.feature_b], abs=1e-9)


def exchanges(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.count("Exchange hashpartitioning"), text.count("Window ["), "Exchange SinglePartition" in text


def test_full_table_is_one_window_and_one_exchange(spark, hourly):
    df = hourly(a=[1.0] * 10).select("series_id", "ts", F.col("x").alias("aqi"), *[F.col("x").alias(c) for c in ("pm2_5", "pm10", "co")])
    n_exchange, n_window, single = exchanges(W.full_feature_table(df, 24, gap_free=True))
    assert (n_exchange, n_window, single) == (1, 1, False)


def test_no_plain_series_window(spark, hourly):
    """No row-level window may be partitioned by the series alone."""
    df = hourly(a=[1.0] * 10)
    for out in (C.ffill(df, ["x"], 2), W.rolling_mean(df, {"m": ("x", 24)}), W.lag_features(df, ["x"], 24)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "_to#" in plan and "Exchange SinglePartition" not in plan


def test_columns_of_the_caller_keep_their_names(spark):
    """Columns called as operators call theirs come back unharmed, and can be worked on themselves."""
    rows = [(name, (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i)).to_pydatetime(), None if i % 3 == 0 else float(i), 1.0 * i, 2.0, 3, 4, "k") for name in ("a", None) for i in range(12)]
    schema = "series_id string, ts timestamp, x double, _m_x double, _lo_x double, _n int, _idx int, _k_ string"
    df = spark.createDataFrame(rows, schema)
    kept = ["_m_x", "_lo_x", "_n", "_idx", "_k_"]
    before = sorted(map(str, df.select("series_id", "ts", *kept).collect()))
    for out in (C.impute_mean(df, ["x"]), C.impute_median(df, ["x"]), C.impute_mode(df, "x", ["series_id"]), C.clip_iqr(df, ["x"]), C.winsorize(df, ["x"]), C.ffill(df, ["x"], 2),
                C.interpolate_both(df, ["x"]), C.impute_knn(df, ["x", "_m_x"]), C.outliers_to_null(df, ["x"]), W.row_index(df)):
        assert out.columns[:len(df.columns)] == df.columns
        assert sorted(map(str, out.select("series_id", "ts", *kept).collect())) == before
    filled = C.impute_mean(df.withColumn("_m_x", F.when(F.col("_m_x") > 3, F.col("_m_x"))), ["_m_x"])
    assert filled.where("_m_x IS NULL").count() == 0 and filled.select(F.max("_m_x")).first()[0] == 11
    assert W.drop_warmup(df, 10).count() == 4
    assert "_m_x_clipped" in C.clip_iqr(df, ["_m_x"], flags=True).columns


def test_series_without_a_name(spark):
    from hazegrid.operators.evaluate import prediction_summary
    from hazegrid.operators.serve import city_stats
    from hazegrid.sources.hourly import hourly_grid

    hours = [(pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i)).to_pydatetime() for i in range(8)]
    rows = [(n, h, float(i), None if i == 3 else 2.0 * i) for n in ("a", None) for i, h in enumerate(hours) if i != 5]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp, x double, y double")
    grid = hourly_grid(df)
    assert grid.count() == 16 and grid.where("x IS NULL").count() == 2
    full = C.impute_knn(grid, ["x", "y"], k=2).where("hour(ts) = 3").collect()
    assert len(full) == 2 and {r.y for r in full} == {6.0}
    stats = city_stats(df.select(F.col("series_id").alias("city"), "ts", F.col("x").alias("aqi")))
    assert stats.count() == 2 and len({(r.mean_aqi, r.days_over_100) for r in stats.collect()}) == 1
    preds = df.select(F.col("series_id").alias("model"), F.col("x").alias("yhat"))
    assert sorted(r.prediction_count for r in prediction_summary(preds).collect()) == [7, 7]


def test_bucketed_stores_join_without_exchange(spark, tmp_path):
    from hazegrid.sources.hourly import join_sources
    from hazegrid.sources.stores import write_bucketed

    rows = [(f"s{i % 5}" if i % 11 else None, T0 + pd.Timedelta(hours=i // 5).to_pytimedelta(), float(i)) for i in range(400)]
    left = spark.createDataFrame(rows, "series_id string, ts timestamp, a double")
    right = spark.createDataFrame(rows[100:], "series_id string, ts timestamp, b double")
    write_bucketed(left, "test_left", str(tmp_path / "left"), buckets=4)
    write_bucketed(right, "test_right", str(tmp_path / "right"), buckets=4)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        joined = join_sources(spark.table("test_left"), spark.table("test_right"))
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert sorted(map(str, joined.collect())) == sorted(map(str, join_sources(left, right).collect()))
        sums = spark.table("test_left").groupBy("series_id", "ts").count()
        assert "Exchange" not in sums._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE test_left")
        spark.sql("DROP TABLE test_right")
