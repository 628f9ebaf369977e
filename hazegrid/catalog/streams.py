"""Queries: Structured Streaming runs over the event files, and their batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hazegrid.catalog.base import query, table
from hazegrid.session import scratch_dir
from hazegrid.streaming import flows as S


def _cents(df):
    """Values in whole cents: their sums are exact in every order."""
    return df.select("ts", "event_type", F.round(F.col("value") * 100).alias("value"))


def _batch(spark, d):
    return _cents(table(spark, d, "events", "ts", "event_type", "value").withColumn("ts", F.col("ts").cast("timestamp")))


def _stream(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return S.stream_ingest(spark, f"{d}/events*.parquet", schema)


def _run(spark, df):
    """Run a stream to the end of its input and read what it appended."""
    base = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    S.start_append(df, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out")


_TUMBLE = """SELECT event_type, date_trunc('hour', ts) AS window_start, avg(round(value * 100)) AS mean_value, count(value) AS n
FROM events GROUP BY 1, 2"""


@query("win_tumbling", _TUMBLE, ["mean_value"])
def _(spark, d):
    return S.hourly_means(_batch(spark, d), ["event_type"], "value")


@query("stream_tumbling", f"""WITH w AS ({_TUMBLE})
SELECT * FROM w WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""", ["mean_value"])
def _(spark, d):
    """Windows the watermark (two hours behind the latest event) has closed."""
    return _run(spark, S.hourly_means(_cents(_stream(spark, d)), ["event_type"], "value"))


_SLIDE = """SELECT event_type, w AS window_start, w + INTERVAL 24 HOUR AS window_end, sum(round(value * 100)) / count(value) AS mean_value,
  count(value) AS n FROM (SELECT *, unnest(generate_series(date_trunc('hour', ts) - INTERVAL 23 HOUR, date_trunc('hour', ts),
  INTERVAL 1 HOUR)) AS w FROM events) GROUP BY 1, 2"""


@query("win_sliding", _SLIDE, ["mean_value"])
def _(spark, d):
    return S.sliding_means(_batch(spark, d), ["event_type"], "value", 24)


@query("stream_sliding", f"""WITH w AS ({_SLIDE})
SELECT * FROM w WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""", ["mean_value"])
def _(spark, d):
    return _run(spark, S.sliding_means(_cents(_stream(spark, d)), ["event_type"], "value", 24))


@query("stream_dedup", "SELECT DISTINCT event_type, date_trunc('hour', ts) AS hour FROM events")
def _(spark, d):
    """One arrival per (type, hour): which event arrives first does not matter for the keys."""
    timed = _stream(spark, d).select("event_type", "ts", F.date_trunc("hour", "ts").alias("hour"))
    return _run(spark, S.stream_dedup(timed, ["event_type", "hour"])).select("event_type", "hour")


@query("stream_alerts", """SELECT event_type AS city, ts, value >= 300 AS top_level FROM events WHERE value >= 150""")
def _(spark, d):
    s = _stream(spark, d).select(F.col("event_type").alias("city"), "ts", F.col("value").alias("aqi"))
    return _run(spark, S.stream_alerts(s)).select("city", "ts", (F.col("duration_minutes") >= 20).alias("top_level"))


_LATEST = """SELECT event_type, day, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts FROM (
  SELECT *, ts::DATE AS day FROM events) GROUP BY 1, 2"""


def _upserted(spark, stream):
    base = f"{scratch_dir(spark)}/upsert-{uuid.uuid4().hex}"
    s = stream.select("event_id", "event_type", "ts", "value", F.to_date("ts").alias("day"))
    S.start_upsert(s, f"{base}/store", f"{base}/state", ["event_type", "day"], "day", order=["ts", "event_id"]).awaitTermination()
    return spark.read.parquet(f"{base}/store").select("event_type", "day", "value", "ts")


@query("stream_upsert", _LATEST, ["value"])
def _(spark, d):
    """Latest event per (type, day), kept up to date batch by batch in a partitioned store."""
    return _upserted(spark, _stream(spark, d))


@query("stream_upsert_late", _LATEST, ["value"])
def _(spark, d):
    """The same from four files, a batch each, that land newest first: every later batch is late."""
    landed = f"{scratch_dir(spark)}/landed-{uuid.uuid4().hex}"
    ev = spark.read.parquet(f"{d}/events.parquet")
    quarter = F.floor((F.day("ts") - 1) / 8)
    for q in (3, 2, 1, 0):
        ev.where(quarter == q).coalesce(1).write.mode("append").parquet(landed)
    return _upserted(spark, S.stream_ingest(spark, landed, ev.schema, files_per_trigger=1))


_POLLS = "polls AS (SELECT event_type AS city, ts, CASE WHEN event_id % 7 <> 0 THEN value END AS aqi FROM events)"


def _polled(spark, d):
    """Four files, a batch each, that land newest first; every seventh poll brings no value."""
    base = f"{scratch_dir(spark)}/poll-{uuid.uuid4().hex}"
    ev = spark.read.parquet(f"{d}/events.parquet")
    for q in (3, 2, 1, 0):
        ev.where(F.floor((F.day("ts") - 1) / 8) == q).coalesce(1).write.mode("append").parquet(f"{base}/landed")
    s = S.stream_ingest(spark, f"{base}/landed", ev.schema, files_per_trigger=1)
    polls = s.select(F.col("event_type").alias("city"), "ts", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("aqi"))
    S.start_polling(polls, f"{base}/out", f"{base}/state").awaitTermination()
    return f"{base}/out"


@query("stream_poll", f"""WITH {_POLLS}
SELECT city, max(ts) AS checked_ts, arg_max_null(aqi, ts) AS aqi_value, coalesce(arg_max_null(aqi, ts) >= 150, false) AS is_hazardous,
  arg_max_null(aqi, ts) IS NULL AS data_unavailable FROM polls GROUP BY city""", ["aqi_value"])
def _(spark, d):
    """The last check of every place after all batches."""
    return spark.read.parquet(f"{_polled(spark, d)}/checks").drop("part")


@query("stream_poll_alerts", f"""WITH {_POLLS}
SELECT city, ts, CASE WHEN aqi IS NULL THEN 'Data Unavailable' ELSE 'hazard' END AS kind FROM polls WHERE aqi IS NULL OR aqi >= 150""")
def _(spark, d):
    """Every alert of the poll: hazards, and polls without a value."""
    alerts = spark.read.parquet(f"{_polled(spark, d)}/alerts")
    return alerts.select("city", "ts", F.when(F.col("type") == "warning", F.when(~F.col("is_hazardous"), F.col("title"))).alias("t"), "is_hazardous").select(
        "city", "ts", F.coalesce("t", F.lit("hazard")).alias("kind"))


_HOURS = "SELECT event_type, date_trunc('hour', ts) AS hour, arg_max(event_id, (event_id % 97, ts, event_id)) AS event_id FROM events GROUP BY 1, 2"


def _revised(df):
    """Events as revisions of the value of their hour; the newest revision is not the latest arrival."""
    return df.select("event_type", F.date_trunc("hour", "ts").alias("hour"), (F.col("event_id") % 97).alias("revision"), "ts", "event_id")


@query("dedup_keep_last", _HOURS)
def _(spark, d):
    return S.keep_last(_revised(_timed(spark, d)), ["event_type", "hour"], ["revision"]).select("event_type", "hour", "event_id")


@query("stream_keep_last", f"""WITH h AS ({_HOURS}) SELECT * FROM h
WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""")
def _(spark, d):
    """The last revision of every hour that the watermark has closed."""
    return _run(spark, S.keep_last(_revised(_stream(spark, d)), ["event_type", "hour"], ["revision"])).select("event_type", "hour", "event_id")


def _timed(spark, d):
    return table(spark, d, "events", "ts", "event_type", "event_id", "value").withColumn("ts", F.col("ts").cast("timestamp"))


_SHOWN = """levels AS (SELECT event_id, event_type AS city, ts, CASE WHEN value >= 301 THEN 30 WHEN value >= 300 THEN 20 WHEN value >= 200 THEN 15 ELSE 10 END AS m
  FROM events WHERE value >= 150),
shown AS (SELECT city, ts, event_id, CASE event_id % 3 WHEN 0 THEN least(ts + m * INTERVAL 1 MINUTE, ts + INTERVAL 7 MINUTE)
  ELSE ts + m * INTERVAL 1 MINUTE END AS shown_until FROM levels)"""


def _alerts_of(df):
    """Alerts of events, and dismissals: of every third after 7 minutes, twice; of others after 45 minutes, too late."""
    raised = S.hazard_alerts(df.select(F.col("event_type").alias("city"), "ts", F.col("value").alias("aqi"), "event_id").where("value >= 150"), extra=["event_id"])
    alerts = raised.withColumn("id", F.concat_ws("#", "id", "event_id"))
    minutes = F.explode(F.when(F.col("event_id") % 3 == 0, F.array(F.lit(7), F.lit(7))).when(F.col("event_id") % 3 == 1, F.array(F.lit(45))))
    dismissals = alerts.select("id", "ts", minutes.alias("m")).select("id", (F.col("ts") + F.make_dt_interval(mins=F.col("m"))).alias("dismissed_ts"))
    return alerts, dismissals


@query("alerts_shown", f"WITH {_SHOWN} SELECT * FROM shown")
def _(spark, d):
    return S.shown_alerts(*_alerts_of(_timed(spark, d))).select("city", "ts", "event_id", "shown_until")


def _shown_stream(spark, d):
    alerts, dismissals = _alerts_of(_stream(spark, d))
    shown = _run(spark, S.shown_alerts(alerts, dismissals)).select("city", "ts", "event_id", "shown_until")
    return shown, spark.read.parquet(f"{d}/events.parquet").agg(F.max("ts")).first()[0]


@query("stream_shown", f"WITH {_SHOWN} SELECT * FROM shown WHERE ts <= (SELECT max(ts) FROM events) - INTERVAL 3 HOUR")
def _(spark, d):
    """Alerts joined with their dismissals as both streams go on; those of the last hours may still wait for one."""
    shown, newest = _shown_stream(spark, d)
    return shown.where(F.col("ts") <= F.lit(newest) - F.expr("INTERVAL 3 HOURS"))


@query("stream_active", f"""WITH {_SHOWN}, t AS (SELECT max(ts) AS now FROM shown WHERE ts <= (SELECT max(ts) FROM events) - INTERVAL 3 HOUR)
SELECT shown.* FROM shown, t WHERE ts <= now AND now < shown_until""")
def _(spark, d):
    """What is on display when the last alert that is settled is raised."""
    shown, newest = _shown_stream(spark, d)
    settled = shown.where(F.col("ts") <= F.lit(newest) - F.expr("INTERVAL 3 HOURS"))
    now = settled.agg(F.max("ts")).first()[0]
    return S.active_at(settled, F.lit(now))
