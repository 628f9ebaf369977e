import datetime as dt

import pytest
from pyspark.sql import functions as F

from hazegrid import constants as K
from hazegrid.functions import aqi as A
from hazegrid.functions import names as N
from hazegrid.functions import timefeat as TF


def values(spark, xs, expr):
    df = spark.createDataFrame([(i, None if x is None else float(x)) for i, x in enumerate(xs)], "i int, x double")
    return [r.y for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_strict_bands_have_gaps(spark):
    got = values(spark, [50, 50.5, 51, 100.5, -1, 301, None], A.risk_level_strict)
    assert got == ["Good", "Hazardous", "Moderate", "Hazardous", "Hazardous", "Hazardous", "Hazardous"]


def test_contiguous_bands(spark):
    assert values(spark, [50, 50.5, 100.5, 301, None], A.risk_band) == [
        "Excellent", "Moderate", "Unhealthy for Sensitive Groups", "Hazardous", None]
    assert values(spark, [2, 4, 6, 7], A.risk_score_severity) == ["success", "warning", "error", "error"]


def test_breakpoints_and_unit_guard(spark):
    aqi = lambda c: A.epa_aqi(c, "pm2_5", "ug/m3")
    assert values(spark, [12.0, 12.05, 12.1, 500.4, 600, None], aqi) == [50, None, 51, 500, None, None]
    assert values(spark, [12.05], lambda c: A.epa_aqi(c, "pm2_5", "ug/m3", truncate=True)) == [50]
    assert values(spark, [3.0], lambda c: A.epa_aqi(c, "co", "ppb")) == [None]
    assert values(spark, [3.0], lambda c: A.epa_aqi(c, "lead", "ug/m3")) == [None]
    assert values(spark, [float("nan")], aqi) == [None]


@pytest.mark.parametrize("pollutant", list(K.BREAKPOINTS))
def test_range_join_equals_case_chain(spark, pollutant):
    xs = [b for band in K.BREAKPOINTS[pollutant] for b in band[:2]] + [0.5, 12.05, 9999.0, None]
    df = spark.createDataFrame([(i, None if x is None else float(x)) for i, x in enumerate(xs)], "i int, x double")
    chain = {r.i: r.y for r in df.select("i", A.epa_aqi(F.col("x"), pollutant, K.TABLE_UNIT[pollutant]).alias("y")).collect()}
    joined = {r.i: r.aqi for r in A.join_breakpoints(df, "x", pollutant).collect()}
    assert len(joined) == len(xs)
    assert joined == pytest.approx(chain, nan_ok=True)


def test_overall_and_dominant(spark):
    df = spark.createDataFrame([(None, 40.0, 55.0), (None, None, None), (7.0, 7.0, 1.0)], "a double, b double, c double")
    subs = {n: F.col(n) for n in "abc"}
    got = df.select(A.overall_aqi(list(subs.values())).alias("m"), A.dominant_pollutant(subs).alias("d")).collect()
    assert [(r.m, r.d) for r in got] == [(55.0, "c"), (None, None), (7.0, "a")]


def test_season_and_weekday(spark):
    rows = [(dt.datetime(2023, m, 1),) for m in range(1, 13)]
    df = spark.createDataFrame(rows, "ts timestamp")
    got = df.select("ts", *TF.calendar_features(F.col("ts"))).orderBy("ts").collect()
    assert [r.season for r in got] == [1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 4, 1]
    assert [r.day_of_week for r in got] == [dt.datetime(2023, m, 1).weekday() for m in range(1, 13)]


def test_names(spark):
    text = ["aqi_rolling_std_24h_lag72h", "hour", "pm10_lag_168h"]
    df = spark.createDataFrame([(t,) for t in text], "n string")
    assert [r.w for r in df.select(N.max_window(F.col("n")).alias("w")).collect()] == [72, 0, 168]
    assert N.max_window_of(text) == 168 and N.max_window_of([]) == 0
    wanted = {"AQI_x": 50.0, "temp": 25.0, "humidity": 60.0, "wind_u": 5.0, "so2_lag": 10.0, "quarter": 0.0}
    df = spark.createDataFrame([(n,) for n in wanted], "n string")
    assert {r.n: r.v for r in df.select("n", N.default_value(F.col("n")).alias("v")).collect()} == wanted
    assert {n: N.default_for(n) for n in wanted} == wanted


def test_best_model_text(spark):
    cases = {
        "The best model for 24h is extratrees": "ExtraTrees",
        "BEST MODEL: catboost (v2)": "CatBoost",
        "Model: Prophet": "Prophet",
        "nothing here": None,
    }
    df = spark.createDataFrame([(d,) for d in cases] + [(None,)], "d string")
    got = {r.d: r.m for r in df.select("d", N.parse_best_model(F.col("d")).alias("m")).collect()}
    assert got == {**cases, None: None}
    assert [r.f for r in df.limit(1).select(N.model_format(F.lit("CatBoost")).alias("f")).collect()] == ["cbm"]


def test_trend(spark):
    assert values(spark, [89, 91, 111], lambda c: A.trend_direction(c, F.lit(100.0))) == ["improving", "stable", "worsening"]
    assert values(spark, [28.01 / 24.45], lambda c: A.to_ppb(c, "co")) == [pytest.approx(1.0)]
    assert values(spark, [10], A.to_kmh) == [36.0]


def test_recommendations_keep_every_row(spark):
    df = spark.createDataFrame([(10.0,), (100.0,), (150.5,), (900.0,)], "aqi double")
    got = A.join_recommendations(df, "aqi")
    assert got.count() == 16
    assert {r.title for r in got.where("aqi = 900").collect()} == {"Stay Indoors", "Masks", "Air Purifiers", "Health"}
