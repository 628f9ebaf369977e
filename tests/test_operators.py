import datetime as dt

import pytest
from conftest import T0, column
from pyspark.sql import functions as F

from hazegrid.operators import clean as C
from hazegrid.operators import evaluate as E
from hazegrid.operators import folds as FO
from hazegrid.operators import profile as P
from hazegrid.operators import serve as V
from hazegrid.operators import windows as W
from hazegrid.sources import hourly as H
from hazegrid.sources import stores as S


# --- cleaning -----------------------------------------------------------------------------


def test_fill_and_interpolation_edges(hourly):
    ten = [None] * 10
    assert column(C.ffill(hourly(a=[1, *[None] * 5, 9]), ["x"], 2)) == [1, 1, 1, None, None, None, 9]
    assert column(C.interpolate_time(hourly(a=[1, *ten, 12]), ["x"])) == pytest.approx([1, 2, 3, 4, 5, 6, 7, *[None] * 4, 12])
    assert column(C.interpolate_time(hourly(a=[1, 2, *ten]), ["x"])) == [1, 2, *[2] * 6, *[None] * 4]
    uneven = hourly(hours=[0, 1, 2, 5, 6], a=[None, 1, None, None, 5])
    assert column(C.interpolate_time(uneven, ["x"], gap_free=False)) == pytest.approx([None, 1, 1.8, 4.2, 5])
    both = C.interpolate_time(C.ffill(hourly(a=[1, *ten, 12]), ["x"], 2), ["x"])
    step = 11 / 9
    assert column(both) == pytest.approx([1, 1, 1, *[1 + step * i for i in range(1, 7)], None, None, 12])
    assert column(C.interpolate_both(hourly(a=[None, 1, None, 3, None]), ["x"])) == [1, 1, 2, 3, 3]


def test_mode_breaks_ties_downward(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    assert sorted(r.c for r in C.impute_mode(df, "c").collect()) == ["a", "a", "a", "b", "b"]


def test_coerce_and_narrow(spark):
    df = spark.createDataFrame([("1.5",), ("bad",), (None,), ("NaN",), ("-Infinity",)], "v string")
    assert [r.v for r in C.coerce_numeric(df, ["v"]).collect()] == [1.5, 0, 0, 0, 0]
    assert dict(C.narrow_types(spark.range(1).withColumn("d", F.lit(1.0))).dtypes) == {"id": "int", "d": "float"}


def test_outliers(hourly):
    vs = [10, 11, 12, 13, 14, 15, 16, 17, 500, 12]
    assert column(C.outliers_to_null(hourly(a=vs), ["x"]))[8] == 12
    clipped = column(C.clip_iqr(hourly(a=vs), ["x"]))
    assert clipped[8] < 30 and clipped[:8] == vs[:8]
    assert [r.x for r in C.iqr_anomalies(hourly(a=vs), "x").collect()] == [500]


def test_dedup_by_values_keeps_first(hourly):
    df = hourly(a=[1, 1, 2])
    assert C.dedup_rows(df.union(df)).count() == 3
    assert [(r.ts, r.x) for r in C.dedup_rows(df, by_values=True).orderBy("ts").collect()] == [
        (T0, 1), (T0 + dt.timedelta(hours=2), 2)]


def test_drop_unfillable_and_report(spark):
    df = spark.createDataFrame([(1, None), (1, None), (3, 4)], "a int, b int")
    assert C.drop_unfillable(df).columns == ["a"]
    assert C.drop_unfillable(df, rows=True).count() == 1
    report = C.preprocessing_report(df, df.drop("b"), {"low_variance": ["b"]}).first()
    assert (report.rows_before, report.rows_after, report.duplicate_rows, report.missing_values, report.removed_low_variance) == (3, 3, 1, 0, 1)


# --- windows and folds ----------------------------------------------------------------------


def test_rolling_edges(hourly):
    df = hourly(a=[1, 2, None, 4, 5])
    assert column(W.rolling_mean(df, {"m": ("x", 3)}), "m") == [1, 1.5, 1.5, 3, 4.5]
    assert column(W.rolling_stat(df, "x", [3], 0, "std"), "x_rolling_std_3h_lag0h") == [None] * 5


def test_warmup_keeps_last_row(hourly):
    assert column(W.drop_warmup(hourly(a=[1, 2, 3]), 10)) == [3]
    assert column(W.drop_warmup(hourly(a=[1, 2, 3]), 1)) == [2, 3]


def test_sequences(hourly):
    got = W.make_sequences(hourly(a=range(6)), ["x"], "x", 4).orderBy("ts").collect()
    assert [(r.sequence, r.label) for r in got] == [([[0], [1], [2], [3]], 4), ([[1], [2], [3], [4]], 5)]


def test_full_table_column_count(hourly):
    cols = ["aqi", "pm2_5", "pm10", "co", "no2", "so2", "o3", "temperature", "humidity", "wind_speed", "wind_direction"]
    df = hourly(a=[1.0] * 5).select("series_id", "ts", *[F.col("x").alias(c) for c in cols])
    wide = W.full_feature_table(df, 24)
    assert len(wide.columns) - len(df.columns) == 3 + 66 + 6 + 10 + 3 + 8 + 5 + 4
    x, y = W.split_xy(wide)
    assert y.columns == ["series_id", "ts", "aqi_24h", "aqi_48h", "aqi_72h"]
    assert not any("aqi_" in c for c in x.columns) and "aqi" not in x.columns


def test_fold_table_and_assignment_agree(hourly):
    df = hourly(a=range(50), b=range(20))
    table = FO.sliding_folds(df, 20, 10, 7).collect()
    assert {(r.series_id, r.fold, r.train_start) for r in table} == {("a", i, 7 * i) for i in range(3)}
    rows = FO.assign_folds(df, 20, 10, 7).collect()
    for f in table:
        mine = [r for r in rows if r.series_id == f.series_id and r.fold == f.fold]
        assert sorted(r.row_idx for r in mine if r.split == "train") == list(range(f.train_start, f.train_end))
        assert sorted(r.row_idx for r in mine if r.split == "test") == list(range(f.test_start, f.test_end))
    assert len(rows) == 3 * 30


def test_expanding_and_tail(hourly):
    df = hourly(a=range(10))
    got = [(r.fold, r.train_end, r.test_end) for r in FO.expanding_folds(df).orderBy("fold").collect()]
    assert got == [(0, 4, 6), (1, 6, 8), (2, 8, 10)]
    tail = FO.holdout_tail(df, 0.2, 3, 5).where("is_validation")
    assert sorted(r.row_idx for r in tail.collect()) == [7, 8, 9]
    assert FO.holdout_tail(df).where("is_validation").count() == 0
    assert FO.chrono_split(df).where("split = 'train'").count() == 8


# --- profile -------------------------------------------------------------------------------


def test_pairwise_complete_corr(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 7.0), (None, 8.0)], "a double, b double")
    assert P.corr_pairs(df, ["a", "b"]).first().abs_corr == pytest.approx(0.9933992677987827)


def test_prune_rules(spark):
    pairs = spark.createDataFrame(
        [(0, 1, "a", "b", 0.9), (0, 2, "a", "c", 0.2), (1, 2, "b", "c", 0.95)],
        "i int, j int, feature_a string, feature_b string, abs_corr double")
    assert {r.feature for r in P.prune_correlated(pairs).collect()} == {"b", "c"}
    assert {r.feature for r in P.prune_correlated(pairs, protected=["c"]).collect()} == {"b"}
    target = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", 0.1)], "feature string, abs_corr double")
    assert {r.feature for r in P.prune_correlated_by_target(pairs, target).collect()} == {"a", "c"}


def test_quality(spark):
    rows = [(600.0, None), (-1.0, None), (50.0, 1.0), (None, None), (2.0, None), (3.0, None)]
    df = spark.createDataFrame(rows, "y double, f double")
    got = {r.issue: r.value for r in P.quality_issues(df, "y", ["f"]).collect()}
    assert got == {"negative_values": 1, "above_500": 600, "features_over_80pct_missing": 1}
    empty = spark.createDataFrame([(None, 1.0)], "y double, f double")
    assert [r.issue for r in P.quality_issues(empty, "y", ["f"]).collect()] == ["no_valid_target"]
    assert P.drop_low_variance(df.withColumn("flat", F.lit(1.0)), ["y", "flat"]).columns == ["y", "f"]


# --- evaluation ---------------------------------------------------------------------------


def test_metrics_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("m", 1.0, 2.0), ("m", 3.0, 2.0), ("m", nan, 1.0), ("m", 0.0, 1.0), ("none", nan, 1.0), ("flat", 2.0, 2.0)]
    got = {r.model: r for r in E.regression_metrics(spark.createDataFrame(rows, "model string, y double, yhat double"), ["model"]).collect()}
    assert got["m"].n == 3 and got["m"].mse == pytest.approx(1.0) and got["m"].mape == pytest.approx(100 * (1 + 1 / 3) / 2)
    assert (got["none"].rmse, got["none"].r2, got["none"].mape, got["none"].std) == (inf, -inf, inf, 0)
    assert got["flat"].r2 == 1.0


def test_best_model_prefers_listed_order(spark):
    m = spark.createDataFrame([("x", 0.5), ("y", 0.5), ("z", 0.1)], "model string, avg_test_r2 double")
    assert E.best_model(m, order=["y", "x"]).first().best_model == "y"


def test_registry_precedence(spark):
    rows = [("m", 1, "production"), ("m", 9, None), ("m", 5, "latest"), ("k", 3, None), ("k", 4, None)]
    reg = spark.createDataFrame(rows, "name string, version bigint, tag string").withColumn("description", F.lit("d"))
    assert {r.name: r.version for r in E.latest_model_version(reg).collect()} == {"m": 1, "k": 4}


def test_ensemble_needs_members(spark):
    rows = [("a", 1, 2.0), ("b", 1, 4.0), ("a", 2, 7.0), ("c", 2, 9.0)]
    p = spark.createDataFrame(rows, "model string, ts int, yhat double")
    assert [(r.ts, r.yhat) for r in E.ensemble_mean(p, ["a", "b"], "e", ["ts"], 2).collect()] == [(1, 3.0)]


# --- serving ------------------------------------------------------------------------------


def city_frame(spark, **series):
    rows = [(c, T0 + dt.timedelta(hours=i), None if v is None else float(v)) for c, vs in series.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "city string, ts timestamp, aqi double")


def test_overview_falls_back(spark):
    o = V.overview(city_frame(spark, A=[10, 20], B=[50.5, None])).collect()
    got = {r.city: r for r in o}
    assert (got["A"].current_aqi, got["A"].weekly_avg, got["A"].trend_direction) == (20, 15, "stable")
    assert got["B"].current_aqi is None and got["B"].current_risk_level == "Hazardous"
    assert got["A"].last_updated == "2024-01-01 01:00"


def test_rank_and_quick(spark):
    df = city_frame(spark, A=[30], B=[10], C=[20], D=[None])
    ranked = {r.city: (r["rank"], r.medal) for r in V.rank_cities(V.overview(df)).collect()}
    assert ranked == {"B": (1, "gold"), "C": (2, "silver"), "A": (3, "bronze"), "D": (4, None)}
    q = V.quick_stats(df).first()
    assert (q.best_city, q.worst_city, q.cities_monitored) == ("B", "A", 4)


def test_filters(spark):
    df = city_frame(spark, Karlstad=range(60))
    assert V.filter_city(df, "KARLSTAD").count() == 60
    with pytest.raises(LookupError):
        V.filter_city(df, "nowhere", must_exist=True)
    with pytest.raises(ValueError):
        V.filter_last_days(df, 22)
    assert V.filter_last_days(df, 1).count() == 25
    assert V.filter_last_days(df, 1, F.lit(T0 + dt.timedelta(days=2))).count() == 36
    with pytest.raises(ValueError):
        V.historical(df, "Karlstad")


def test_hourly_curve(spark):
    df = city_frame(spark, A=[0]).withColumn("p24", F.lit(24.0)).withColumn("p48", F.lit(None).cast("double")).withColumn("p72", F.lit(0.0))
    got = {r.horizon_hours: r.predicted_aqi for r in V.forecast_hourly(df, {24: "p24", 48: "p48", 72: "p72"}).collect()}
    assert got[1] == 1 and got[24] == 24 and got[48] == 12 and got[72] == 0
    short = {r.horizon_hours: r.predicted_aqi for r in V.forecast_hourly(df, {24: "p24"}, 72).collect()}
    assert short[72] == 24
    with pytest.raises(ValueError):
        V.forecast_hourly(df, {24: "p24"}, 73)
    worst = V.worst_hour(V.forecast_hourly(df, {24: "p24", 72: "p72"})).first()
    assert (worst.horizon_hours, worst.label) == (24, "Excellent")


def curves_with_gaps(spark):
    """A city without a current value, one without any point, and one whose only point is the current value."""
    df = spark.createDataFrame([("late", dt.datetime(2024, 1, 1), None, 10.0, None, 40.0), ("none", dt.datetime(2024, 1, 1), None, None, None, None),
                                ("flat", dt.datetime(2024, 1, 1), 7.0, None, None, None)], "city string, ts timestamp, aqi double, p24 double, p48 double, p72 double")
    return V.forecast_hourly(df, {24: "p24", 48: "p48", 72: "p72"})


def test_forecast_hourly_without_a_current_value(spark):
    got = {(r.city, r.horizon_hours): r for r in curves_with_gaps(spark).collect()}
    assert len(got) == 3 * 72
    assert [got["late", h].predicted_aqi for h in (1, 23, 24, 48, 72)] == [None, None, 10, 25, 40]
    assert {got["none", h].predicted_aqi for h in range(1, 73)} == {None} and {got["flat", h].predicted_aqi for h in range(1, 73)} == {7}
    assert got["late", 1].risk_level == "Hazardous"  # as every null index


def test_next_hours_without_a_current_value(spark):
    got = sorted((r.city, r.horizon_hours, r.aqi_shown, r.label) for r in V.next_hours(curves_with_gaps(spark)).collect())
    assert got == sorted([(c, h, *v) for c, v in (("late", (None, None)), ("none", (None, None)), ("flat", (7, "Excellent"))) for h in range(1, 7)])


def test_worst_hour_counts_known_hours_first(spark):
    got = {r.city: (r.predicted_aqi, r.horizon_hours) for r in V.worst_hour(curves_with_gaps(spark)).collect()}
    assert got == {"late": (40, 72), "none": (None, 1), "flat": (7, 1)}


def test_forecast_next6_of_silent_stations(spark, tmp_path):
    """The registered query on events of a station that goes on, one silent for its last 30 hours, and one heard once."""
    import duckdb
    from check_queries import rows_of

    from hazegrid.catalog import load_all

    heard = [(5, h) for h in range(100)] + [(25, h) for h in range(70)] + [(45, 0)]
    rows = [(i, T0 + dt.timedelta(hours=h), user, "view", 10.0 + h % 20) for i, (user, h) in enumerate(heard)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    q = load_all()["forecast_next6"]
    got = q.run(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(q.sql)
    names = [c[0] for c in want.description]
    shown = sorted((r.city, r.horizon_hours, r.aqi_shown is None, r.label is None) for r in got.collect())
    assert shown == [(c, h, c != "st0", c != "st0") for c in ("st0", "st1", "st2") for h in range(1, 7)]
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(names, want.fetchall())


def test_minmax_inverse(spark):
    df = spark.createDataFrame([(2.0,), (4.0,), (None,)], "x double")
    got = V.minmax_scale(df, ["x"]).withColumn("back", V.minmax_inverse(F.col("x"), F.lit(2.0), F.lit(4.0))).collect()
    assert [(r.x, r.back) for r in got] == [(0, 2), (1, 4), (None, None)]


# --- sources ------------------------------------------------------------------------------


def test_explode_is_left_closed(spark):
    df = spark.createDataFrame([("s", 0, 10800, 3600, [1.0, None, 3.0]), ("e", 5, 5, 3600, [])],
                               "series_id string, start bigint, end bigint, interval_s int, pm10 array<double>")
    got = H.explode_hourly_response(df, ["pm10"]).orderBy("ts").collect()
    assert [(r.ts.hour, r.pm10) for r in got] == [(0, 1), (1, None), (2, 3)]


def test_grid(hourly):
    df = hourly(hours=[0, 30], a=[1, 2]).union(hourly(hours=[5], b=[7]))
    g = H.hourly_grid(df)
    assert g.count() == 62 and column(g, series="b")[5] == 7
    assert H.hourly_grid(df, per_series=True).count() == 32


def test_lookback():
    assert H.lookback_range(dt.date(2024, 4, 2), 92) == (dt.date(2024, 1, 1), dt.date(2024, 4, 1))


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = [("2024-01-02 03:04:05", "A", "1.5"), ("2024-01-02", "A", "x"), ("soon", "B", ""), ("01/02/2024", "B", "2")]
    S.write_csv(spark.createDataFrame(rows, "timestamp string, city string, aqi string"), path)
    got = S.read_readings_csv(spark, path, ["aqi"]).collect()
    assert sorted((str(r.timestamp), r.city, r.aqi) for r in got) == [
        ("2024-01-02 00:00:00", "A", None), ("2024-01-02 00:00:00", "B", 2.0), ("2024-01-02 03:04:05", "A", 1.5), ("None", "B", None)]


def test_upsert_rewrites_only_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "store")
    first = spark.createDataFrame([("a", 1, "d1"), ("b", 1, "d2")], "k string, v int, day string")
    S.upsert_parquet(spark, path, first, ["k", "day"], "day")
    untouched = {f: (tmp_path / "store" / "day=d2").stat().st_mtime_ns for f in ["d2"]}
    S.upsert_parquet(spark, path, spark.createDataFrame([("a", 2, "d1"), ("c", 3, "d1")], "k string, v int, day string"), ["k", "day"], "day")
    assert sorted((r.k, r.v, r.day) for r in spark.read.parquet(path).collect()) == [("a", 2, "d1"), ("b", 1, "d2"), ("c", 3, "d1")]
    assert (tmp_path / "store" / "day=d2").stat().st_mtime_ns == untouched["d2"]


def test_union_pick(spark):
    a = spark.createDataFrame([("k", 1)], "k string, v int")
    b = spark.createDataFrame([("k", 2), ("j", 3)], "k string, v int")
    assert {r.k: r.v for r in S.union_pick([a, b], ["k"], "first").collect()} == {"k": 1, "j": 3}
    assert {r.k: r.v for r in S.union_pick([a, b], ["k"], "last").collect()} == {"k": 2, "j": 3}
    assert S.union_pick([a, b], ["absent"]).count() == 3


def test_schema_helpers(spark):
    df = spark.createDataFrame([("2024-01-01", "soon", 5.0)], "`Event.Date` string, time_note string, AQI double")
    low = S.normalize_columns(df)
    assert low.columns == ["event_date", "time_note", "aqi"]
    assert S.discover_roles(low) == {"time": "event_date", "target": "aqi"}
    kept, dropped = S.align_schema(df, ["aqi", "event_date"])
    assert kept.columns == ["event_date", "aqi"] and dropped == ["time_note"]
    assert S.common_columns(low, kept) == ["event_date", "aqi"]
    with pytest.raises(ValueError):
        S.require_columns(df, ["pm10"])


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,)], "x double")
    assert [r.x for r in S.nan_to_null(df).collect()] == [None, None, 1.0]


def test_priority_merge(spark):
    a = spark.createDataFrame([(1, None, 5.0)], "k int, x double, y double")
    b = spark.createDataFrame([(1, 2.0, 6.0), (2, 3.0, None)], "k int, x double, y double")
    got = {r.k: (r.x, r.y, r.source_rank) for r in S.priority_merge([a, b], ["k"], ["x", "y"]).collect()}
    assert got == {1: (2.0, 5.0, 0), 2: (3.0, None, 1)}


def test_labels(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "c string")
    assert sorted((r.c or "", r.code) for r in S.encode_label(df, "c", "code").collect()) == [("", 0), ("a", 1), ("b", 2), ("b", 2)]
