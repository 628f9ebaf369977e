"""Structured Streaming twins of the hourly refresh, smoothing, dedup and alerting."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hazegrid import constants as K
from hazegrid.sources.stores import pick_by_key, pick_latest, upsert_parquet
from hazegrid.streaming.alerts import hazard_alerts, last_check, unavailable_alerts


def stream_ingest(spark: SparkSession, path: str, schema: StructType | str, ts: str = "ts",
                  files_per_trigger: int = 100) -> DataFrame:
    """Files landing in a folder as a stream; the event time becomes a timestamp."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return raw.withColumn(ts, F.col(ts).cast("timestamp"))


def stream_dedup(df: DataFrame, keys: Sequence[str], ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """First arrival per key; state is dropped once the watermark has passed."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str = "ts", every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Last row per key and stretch of ``every`` (per key and instant if ``ts`` is a key): greatest in ``order``, equal ones
    by their other columns, nulls least.

    On a stream a stretch is given out once, when the watermark has closed it, so a repeated delivery within ``late``
    replaces an earlier one whatever the order of arrival; state holds one row per key and open stretch."""
    base = df.withWatermark(ts, late) if df.isStreaming else df
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*[F.col(f"`{c}`") for c in (*order, *(c for c in rest if c not in order))])
    stretch = [] if ts in keys else [F.window(F.col(ts), every).alias("_w")]
    last = base.groupBy(*[F.col(f"`{k}`") for k in keys], *stretch).agg(F.max(ranked).alias("_r"))
    return last.select(*[F.col(f"`{c}`") if c in keys else F.col(f"_r.`{c}`") for c in df.columns])


def shown_alerts(alerts: DataFrame, dismissals: DataFrame, ts: str = "ts", dismissed_ts: str = "dismissed_ts", late: str = "1 hour",
                 longest: str | None = None) -> DataFrame:
    """Alerts with ``shown_until``: the end of their minutes, or their first dismissal before it.

    On streams a left outer join in time: a dismissal (id, ``dismissed_ts``) meets its alert only within ``longest`` (by default
    the longest time any alert is shown), so state is kept no longer than that and the allowed lateness. An alert comes out when it
    is dismissed, or when the watermark has passed its time. Dismissals before the alert or behind its time do nothing."""
    longest = longest or f"{max(row[4] for row in K.ALERT_LEVELS)} minutes"
    gone = dismissals.select(F.col("id").alias("_id"), F.col(dismissed_ts).alias("_at"))
    raised = alerts
    if alerts.isStreaming:
        # a dismissal sent twice counts once; an alert joins at most one
        gone = gone.withWatermark("_at", late).dropDuplicatesWithinWatermark(["_id"])
        raised = alerts.withWatermark(ts, late)
    else:
        first = alerts.join(gone, (F.col("id") == F.col("_id")) & (F.col("_at") >= F.col(ts))).groupBy("_id").agg(F.min("_at").alias("_at"))
        gone = first
    near = (F.col("id") == F.col("_id")) & (F.col("_at") >= F.col(ts)) & (F.col("_at") <= F.col(ts) + F.expr(f"INTERVAL {longest}"))
    end = F.col(ts) + F.make_dt_interval(mins=F.col("duration_minutes"))
    return raised.join(gone, near, "left").select(*[F.col(f"`{c}`") for c in alerts.columns], F.least(end, F.col("_at")).alias("shown_until"))


def active_at(shown: DataFrame, as_of, ts: str = "ts") -> DataFrame:
    """Alerts on display at an instant."""
    return shown.where((F.col(ts) <= as_of) & (as_of < F.col("shown_until")))


def hourly_means(df: DataFrame, by: Sequence[str], value: str, ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """Tumbling one-hour mean per series; on a stream, rows later than the watermark are dropped."""
    base = df.withWatermark(ts, late) if df.isStreaming else df
    return base.groupBy(*by, F.window(ts, "1 hour").alias("_w")).agg(
        F.avg(value).alias("mean_value"), F.count(value).alias("n")
    ).select(*by, F.col("_w.start").alias("window_start"), "mean_value", "n")


def sliding_means(df: DataFrame, by: Sequence[str], value: str, hours: int = 24, ts: str = "ts",
                  late: str = "2 hours") -> DataFrame:
    """Mean of the last ``hours`` hours, every hour.

    A row belongs to ``hours`` windows, so on a table the hour sums are built first and only
    they are spread over the windows. A stream does the same with two chained aggregations.
    """
    base = df.withWatermark(ts, late) if df.isStreaming else df
    per_hour = base.groupBy(*by, F.window(ts, "1 hour").alias("_h")).agg(
        F.sum(value).alias("_s"), F.count(value).alias("_n")
    )
    if df.isStreaming:
        timed = per_hour.select(*by, F.window_time("_h").alias("_t"), "_s", "_n")
    else:
        timed = per_hour.select(*by, F.col("_h.start").alias("_t"), "_s", "_n")
    return timed.groupBy(*by, F.window("_t", f"{hours} hours", "1 hour").alias("_w")).agg(
        F.try_divide(F.sum("_s"), F.sum("_n")).alias("mean_value"), F.sum("_n").alias("n")
    ).select(*by, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "mean_value", "n")


def stream_alerts(df: DataFrame, place: str = "city", ts: str = "ts", aqi: str = "aqi") -> DataFrame:
    return hazard_alerts(df, place, ts, aqi)


def upsert_each_batch(path: str, keys: Sequence[str], partition: str, keep: str = "last", order: Sequence[str] = ()) -> Callable:
    """``foreachBatch`` sink that upserts into a partitioned store. Writing the same batch twice
    gives the same store, so a restart after a lost executor is safe. With ``order`` (the event time,
    say) a row that arrives late never replaces a newer one, in its batch or in the store."""

    def write(batch: DataFrame, batch_id: int) -> None:
        one = pick_latest(batch, keys, order) if order else pick_by_key(batch, keys, [F.lit(0)])
        upsert_parquet(batch.sparkSession, path, one, keys, partition, keep, order)

    return write


def start_upsert(df: DataFrame, path: str, checkpoint: str, keys: Sequence[str], partition: str, keep: str = "last",
                 order: Sequence[str] = ()):
    return (
        df.writeStream.foreachBatch(upsert_each_batch(path, keys, partition, keep, order))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def poll_each_batch(path: str, place: str = "city", ts: str = "ts", aqi: str = "aqi") -> Callable:
    """``foreachBatch`` sink of a poll: ``checks`` holds the last check of every place, whatever the
    order of arrival; ``alerts/batch=N`` holds the alerts of a batch, hazards and missing values, and is
    overwritten if the batch runs again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        polled = batch.select(place, ts, aqi)
        checks = last_check(polled, place, ts, aqi)
        upsert_parquet(batch.sparkSession, f"{path}/checks", checks.withColumn("part", F.pmod(F.crc32(F.col(place)), F.lit(16)).cast("int")),
                       [place], "part", order=["checked_ts"])
        alerts = hazard_alerts(polled, place, ts, aqi).unionByName(unavailable_alerts(polled, place, ts, aqi))
        alerts.write.mode("overwrite").parquet(f"{path}/alerts/batch={batch_id}")

    return write


def start_polling(df: DataFrame, path: str, checkpoint: str, place: str = "city", ts: str = "ts", aqi: str = "aqi"):
    return (
        df.writeStream.foreachBatch(poll_each_batch(path, place, ts, aqi)).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def start_append(df: DataFrame, path: str, checkpoint: str):
    """Append stream to parquet, until all landed input is processed."""
    return (
        df.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
