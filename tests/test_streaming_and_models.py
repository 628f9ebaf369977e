import datetime as dt
import random

import pytest
from conftest import T0
from pyspark.sql import functions as F

from hazegrid.operators import evaluate as E
from hazegrid.operators import models as M
from hazegrid.streaming import alerts as AL
from hazegrid.streaming import flows as S

SCHEMA = "city string, ts timestamp, aqi double"


def land(spark, folder, rows, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


@pytest.fixture
def landed(spark, tmp_path):
    r = random.Random(0)
    rows = [("c%d" % r.randrange(3), T0 + dt.timedelta(minutes=r.randrange(3000)), float(r.randrange(0, 400))) for _ in range(400)]
    folder = tmp_path / "in"
    land(spark, folder, rows, "a")
    return folder, spark.createDataFrame(rows, SCHEMA), tmp_path


def run(spark, df, base, name):
    S.start_append(df, str(base / name), str(base / (name + "-state"))).awaitTermination()
    return spark.read.parquet(str(base / name))


def as_set(df):
    return {tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()}


def test_tumbling_and_sliding_equal_batch(spark, landed):
    folder, batch, base = landed
    stream = S.stream_ingest(spark, str(folder), SCHEMA)
    closed = F.lit(batch.agg(F.max("ts")).first()[0] - dt.timedelta(hours=2))
    got = as_set(run(spark, S.hourly_means(stream, ["city"], "aqi"), base, "tumbling"))
    want = S.hourly_means(batch, ["city"], "aqi")
    assert got == as_set(want.where(F.col("window_start") + F.expr("INTERVAL 1 HOUR") <= closed))
    got = as_set(run(spark, S.sliding_means(stream, ["city"], "aqi", 8), base, "sliding"))
    assert got == as_set(S.sliding_means(batch, ["city"], "aqi", 8).where(F.col("window_end") <= closed))


def test_dedup_and_alerts(spark, landed):
    folder, batch, base = landed
    stream = S.stream_ingest(spark, str(folder), SCHEMA)
    keys = run(spark, S.stream_dedup(stream, ["city", "ts"]), base, "dedup").select("city", "ts")
    assert as_set(keys) == as_set(batch.select("city", "ts").distinct()) and keys.count() == keys.distinct().count()
    assert as_set(run(spark, S.stream_alerts(stream), base, "alerts")) == as_set(AL.hazard_alerts(batch))


def test_upsert_stream_resumes(spark, tmp_path):
    folder, store, state = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "state")
    for hour, value in ((0, 1.0), (0, 2.0), (30, 3.0)):
        land(spark, folder, [("A", T0 + dt.timedelta(hours=hour), value)], "x")
        stream = S.stream_ingest(spark, str(folder), SCHEMA).withColumn("day", F.to_date("ts").cast("string"))
        S.start_upsert(stream, store, state, ["city", "ts", "day"], "day").awaitTermination()
    got = spark.read.parquet(store).collect()
    assert sorted((r.ts.day, r.aqi) for r in got) == [(1, 2.0), (2, 3.0)]


def test_keep_last_equals_a_union_and_resumes(spark, tmp_path):
    """Deliveries of the same hours in several files, restarted after each: the newest version of each key stays."""
    r = random.Random(3)
    schema, sent = "city string, ts timestamp, version long, aqi double", []
    for part in range(4):
        rows = [(r.choice(["a", "b", None]), T0 + dt.timedelta(minutes=60 * r.randrange(30) + 7), part * 1000 + i, float(r.randrange(400)) if i % 7 else None) for i in range(60)]
        if part == 3:  # an older version that arrives last, and far-off times that close all hours
            rows += [(c, t, v - 5000, -1.0) for c, t, v, _ in sent[:20]] + [("end", T0 + dt.timedelta(days=9), 9999, 0.0)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        sent += rows
        stream = S.stream_ingest(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
        S.start_append(S.keep_last(stream, ["city", "ts"], ["version"], late="60 hours"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    ordered = spark.createDataFrame(sorted(sent, key=lambda x: x[2]), schema)
    want = S.keep_last(ordered, ["city", "ts"], ["version"]).where("version != 9999")
    assert as_set(got) == as_set(want) and got.count() == want.count()
    best = {}
    for c, t, v, a in sent:
        best[c, t] = max(best.get((c, t), (-1e9, None)), (v, a), key=lambda x: x[0])
    assert {(x.city, x.ts): (x.version, x.aqi) for x in got.collect()} == {k: v for k, v in best.items() if k[0] != "end"}


def test_shown_alerts_on_streams(spark, tmp_path):
    """Early, late, double and missing dismissals, sent in a later batch than their alerts; equal to the batch result."""
    readings = [("c%d" % i, T0 + dt.timedelta(minutes=20 * i), 310.0 if i % 2 else 160.0) for i in range(40)]
    alerts = AL.hazard_alerts(spark.createDataFrame(readings, SCHEMA))
    ids = [(a.id, a.ts) for a in alerts.collect()]
    after = {0: [3], 1: [5, 9], 2: [45], 3: [-5], 4: [12]}  # minutes behind the alert; those of 10 minutes do not see the 12
    sent = [(i, t + dt.timedelta(minutes=m)) for k, (i, t) in enumerate(ids) for m in after.get(k % 6, [])]
    land(spark, tmp_path / "alerts", readings[:20], "a")
    kind = "id string, dismissed_ts timestamp"
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def go():
        left = AL.hazard_alerts(S.stream_ingest(spark, str(tmp_path / "alerts"), SCHEMA))
        right = S.stream_ingest(spark, str(tmp_path / "gone"), kind, ts="dismissed_ts")
        S.start_append(S.shown_alerts(left, right), out, state).awaitTermination()

    spark.createDataFrame(sent[:1], kind).write.parquet(str(tmp_path / "gone"))
    go()
    land(spark, tmp_path / "alerts", [*readings[20:], ("far", T0 + dt.timedelta(days=3), 200.0)], "b")
    spark.createDataFrame([*sent[1:], ("nobody", T0 + dt.timedelta(days=3))], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "gone"))
    go()
    got = {r.id: r.shown_until for r in spark.read.parquet(out).where("city != 'far'").collect()}
    want = {r.id: r.shown_until for r in S.shown_alerts(alerts, spark.createDataFrame(sent, kind)).collect()}
    assert got == want and len(got) == 40
    plain = {}
    for i, t in ids:
        stop = next(a.duration_minutes for a in alerts.where(F.col("id") == i).collect())
        times = sorted(x for j, x in sent if j == i and x >= t)
        plain[i] = min([t + dt.timedelta(minutes=stop), *times[:1]])
    assert want == plain
    now = T0 + dt.timedelta(minutes=200)
    assert {r.id for r in S.active_at(spark.read.parquet(out), F.lit(now)).collect()} == {i for i, t in ids if t <= now < plain[i]}


def test_alert_levels_and_expiry(spark):
    rows = [("A", T0 + dt.timedelta(minutes=m), v) for m, v in ((0, 301.0), (1, 300.5), (2, 200.0), (3, 150.0), (4, 149.9))]
    alerts = AL.hazard_alerts(spark.createDataFrame(rows, SCHEMA)).orderBy("ts")
    got = alerts.collect()
    assert [(r.type, r.duration_minutes) for r in got] == [("error", 30), ("error", 20), ("warning", 15), ("warning", 10)]
    assert got[1].message == "A: AQI 300 - Health emergency for all! Avoid outdoor activities."
    at = lambda m: F.lit(T0 + dt.timedelta(minutes=m))
    assert AL.active_alerts(alerts, at(12)).count() == 4
    assert AL.active_alerts(alerts, at(13)).count() == 3  # shown strictly less than its minutes
    assert AL.active_alerts(alerts, at(12), alerts.limit(1)).count() == 3
    check = AL.last_check(spark.createDataFrame([*rows, ("B", T0, None)], SCHEMA))
    assert {r.city: (r.is_hazardous, r.data_unavailable) for r in check.collect()} == {"A": (False, False), "B": (False, True)}


@pytest.fixture(scope="module")
def trend(spark):
    r = random.Random(1)
    rows = []
    for s in ("a", "b"):
        for i in range(260):
            x = r.uniform(0, 10)
            rows.append((s, T0 + dt.timedelta(hours=i), x, None if i % 9 == 0 else r.uniform(0, 1), 3 * x + 2))
    return spark.createDataFrame(rows, "series_id string, ts timestamp, x double, z double, y double")


QUICK = {**M.PRESETS, "forest_importance": dict(kind="forest", numTrees=5, maxDepth=4),
         "boost_level": dict(kind="boost", way="level", rounds=4, depth=3, rate=0.3), "boost_leafy": dict(kind="boost", way="leafy", rounds=4, depth=3, rate=0.3),
         "extra_trees": dict(kind="extra", trees=4, depth=4, min_leaf=5), "gbt_leafy": dict(kind="gbt", maxIter=5, maxDepth=3, early=True)}


def test_validation_covers_every_fold_row(trend):
    preds = M.fit_eval_folds(trend, ("linear", "gbt_leafy", "extra_trees", "boost_level"), ["x", "z"], "y", 120, 60, 40, presets=QUICK,
                             ensembles={"pair": ["gbt_leafy", "extra_trees"], "alone": ["linear", "absent"]})
    assert preds.count() == 4 * 2 * 3 * 180 + 2 * 3 * 60
    means = {(r.series_id, r.fold, r.ts): [] for r in preds.where("model = 'pair'").collect()}
    for r in preds.where("split = 'test' AND model IN ('gbt_leafy', 'extra_trees')").collect():
        means[r.series_id, r.fold, r.ts].append(r.yhat)
    assert all(r.yhat == pytest.approx(sum(means[r.series_id, r.fold, r.ts]) / 2) for r in preds.where("model = 'pair'").collect())
    scores = {r.model: r for r in E.generalization(E.regression_metrics(preds, ["model", "fold", "split"])).collect()}
    assert scores["linear"].avg_test_r2 == pytest.approx(1.0, abs=1e-6) and scores["linear"].prediction_quality == "Good"
    assert scores["gbt_leafy"].avg_test_r2 > 0.5


def test_training_run_and_reload(spark, trend, tmp_path):
    row = M.run_training(trend.withColumnRenamed("y", "aqi_24h"), 24, ["x", "z", "aqi_48h"][:2], ("linear", "extra_trees", "boost_leafy"),
                         train=120, test=60, step=40, presets=QUICK, max_features=2, model_path=str(tmp_path)).first()
    assert row.model == "linear" and row.description == "The best model for 24h is linear" and row.feature_count >= 1
    models = M.load_models(str(tmp_path), ["linear", "extra_trees", "boost_leafy"], QUICK)
    features = ["x", "z"][: row.feature_count]
    preds = M.predict_batch(trend, models, ["x"] if row.feature_count == 1 else ["x", "z"],
                            ensembles={"both": ["linear", "extra_trees"], "alone": ["linear", "absent"]})
    assert features and {r.model for r in preds.select("model").distinct().collect()} == {"linear", "extra_trees", "boost_leafy", "both"}
    assert preds.count() == 4 * trend.count()


def test_training_run_scores_baselines_and_ensembles(spark, trend, monkeypatch):
    """The run compares with a line, a forest and the mean on the last fifth; ensembles are candidates, here made the best."""
    seen = []

    def pair_wins(scores, order):
        seen.append(({r.model for r in scores.collect()}, list(order)))
        return spark.createDataFrame([("pair",)], "best_model string")

    monkeypatch.setattr(M.E, "best_model", pair_wins)
    row = M.run_training(trend.withColumnRenamed("y", "aqi_24h"), 24, ["x"], ("extra_trees", "boost_leafy"), train=120, test=60, step=40, presets=QUICK,
                         max_features=1, ensembles={"pair": ["extra_trees", "boost_leafy"], "alone": ["extra_trees", "absent"]}).first()
    assert seen == [({"extra_trees", "boost_leafy", "pair"}, ["extra_trees", "boost_leafy", "pair", "alone"])]
    assert row.model == "pair" and row.avg_test_rmse > 0 and row.avg_train_rmse is None and (row.avg_train_size, row.final_train_size) == (240.0, 240)
    assert row.baseline_linear_r2 == pytest.approx(1.0) and row.baseline_linear_rmse == pytest.approx(0.0, abs=1e-6)
    assert row.baseline_naive_r2 <= 0 < row.baseline_forest_r2 <= 1 and row.baseline_forest_rmse < row.baseline_naive_rmse
    assert (row.baseline_train_size, row.baseline_test_size) == (416, 104) and row.baseline_target_std > 0


def test_too_few_complete_rows_for_a_baseline_stop_no_run(spark, trend):
    row = M.baseline_row(trend.where("hour(ts) < 2").withColumn("z", F.lit(None).cast("double")), ["x", "z"], "y").first()
    assert len(row) == 10 and set(row) == {None}


def test_the_registered_run_fits_every_model_of_its_ensembles():
    from hazegrid.catalog.learning import RUN_MODELS

    kinds = {"boost_symmetric", "boost_level", "boost_leafy", "random_forest", "extra_trees", "gradient_boosting", "decision_tree"}
    assert kinds <= set(RUN_MODELS) and {m for members in M.ENSEMBLES.values() for m in members} <= set(RUN_MODELS)


def test_final_models_are_fitted_side_by_side_forests_one_at_a_time(trend, monkeypatch):
    import threading

    met, busy, seen = threading.Barrier(2, timeout=60), threading.Lock(), []
    forests = {**QUICK, "f1": dict(kind="forest", numTrees=2, maxDepth=2), "f2": dict(kind="forest", numTrees=3, maxDepth=2)}

    def fit(rows, name, *a):
        if name in ("f1", "f2"):
            assert busy.acquire(blocking=False)
            seen.append(name)
            busy.release()
        else:
            met.wait()
        return name

    monkeypatch.setattr(M, "fit", fit)
    order = ["f2", "linear", "f1", "decision_tree"]
    assert list(M.train_final(trend, order, ["x"], "y", presets=forests).items()) == [(n, n) for n in order] and seen == ["f2", "f1"]


def test_hybrid_selection_finds_the_signal(trend):
    got = M.hybrid_select(trend, ["x", "z"], "y", 1, presets=QUICK).collect()
    assert [r.feature for r in got] == ["x"]


def test_forecast_uses_defaults_and_unrounded_risk(spark, trend):
    model = M.train_final(trend, ("linear",), ["x"], "y")["linear"]
    latest = spark.createDataFrame([("a", 16.1666)], "series_id string, x double")
    got = M.forecast(latest, {24: model}, {24: ["x"]}).first()
    assert got.predicted_aqi == pytest.approx(50.5) and got.risk_level == "Hazardous"
    missing = M.forecast(latest.drop("x"), {24: model}, {24: ["x"]}).first()
    assert missing.predicted_aqi == pytest.approx(2.0)


def test_missing_feature_columns(trend):
    models = M.train_final(trend, ("linear",), ["x", "z"], "y")
    assert M.predict_batch(trend.drop("z"), models, ["x", "z"]).where("yhat is not null").count() == trend.count()
    with pytest.raises(ValueError):
        M.predict_batch(trend.drop("x", "z"), models, ["x", "z"])


def test_forests_keep_node_ids_and_cut_the_rows_by_cores(spark, monkeypatch):
    assert all(M.estimator(name, ["a"], "y").getStages()[-1].getCacheNodeIds() for name in ("random_forest", "forest_importance"))
    seen = []

    class Stub:
        def fit(self, rows):
            seen.append((rows.rdd.getNumPartitions(), rows.count()))

    monkeypatch.setattr(M, "estimator", lambda *a, **k: Stub())
    df = spark.range(300).selectExpr("cast(id as double) AS a", "cast(id % 7 as double) AS y")
    for parts in (1, 60):
        M.fit(df.repartition(parts), "forest_importance", ["a"], "y")
    assert seen == [(spark.sparkContext.defaultParallelism, 300)] * 2


def test_fits_run_side_by_side_in_order(spark, monkeypatch):
    import threading

    together = threading.Barrier(3, timeout=60)
    assert M.side_by_side(spark, [lambda i=i: (together.wait(), spark.range(i).count())[1] for i in range(3)]) == [0, 1, 2]
    met, seen = threading.Barrier(2, timeout=60), []
    fit = M.fit
    monkeypatch.setattr(M, "fit", lambda *a: (met.wait(), seen.append(a[1]), fit(*a))[2])
    rows = spark.range(80).selectExpr("'s' AS series_id", "timestamp_seconds(3600 * id) AS ts", "cast(id as double) AS x", "cast(id as double) AS y")
    preds = M.fit_eval_folds(rows, ["decision_tree"], ["x"], "y", 40, 20, 20)
    assert seen == ["decision_tree"] * 2 and {(r.fold, r["count"]) for r in preds.groupBy("fold").count().collect()} == {(0, 60), (1, 60)}
