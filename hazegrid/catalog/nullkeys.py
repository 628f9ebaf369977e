"""Queries over panels in which one series, city or model has no name: null is a key like any other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid.catalog.base import REGISTRY, gridded, hourly_panel, persistence, query, readings, stored
from hazegrid.catalog.cleaning import KNN
from hazegrid.operators import clean as C
from hazegrid.operators import evaluate as E
from hazegrid.operators import serve as V
from hazegrid.sources import hourly as H


def _nameless(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.withColumn(key, F.nullif(F.col(key), F.lit(name)))


def _sql(of: str, key: str, name: str) -> str:
    """The answer to the query ``of``, the key called ``name`` having none."""
    return f"SELECT * REPLACE (nullif({key}, '{name}') AS {key}) FROM ({REGISTRY[of].sql}) AS named"


@query("grid_hourly_null", _sql("grid_hourly", "series_id", "st1"))
def _(spark, d):
    return H.hourly_grid(_nameless(hourly_panel(spark, d, "station"), "series_id", "st1")).select("series_id", "ts", "pm2_5")


@query("city_stats_null", _sql("city_stats", "city", "click"))
def _(spark, d):
    return V.city_stats(_nameless(readings(spark, d), "city", "click"), gap_free=True)


@query("pred_summary_null", _sql("pred_summary", "model", "persist_24h"))
def _(spark, d):
    return E.prediction_summary(stored(_nameless(persistence(spark, d, "station"), "model", "persist_24h")), ["persist_72h"])


@query("impute_knn_null", _sql("impute_knn", "series_id", "st1"))
def _(spark, d):
    grid = _nameless(gridded(spark, d, "station").select("series_id", "ts", *KNN), "series_id", "st1")
    return C.impute_knn(stored(grid), KNN, gap_free=True)
