"""Reading and writing tables: stores, CSV readings, upserts, snapshots, exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazegrid.plans.blocks import global_positions

# Text layouts accepted for the reading timestamps.
TIMESTAMP_LAYOUTS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "MM/dd/yyyy HH:mm",
    "MM/dd/yyyy",
)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and +-Inf become null, as the analytics below treat null as "missing"."""
    inf = float("inf")
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c) & (F.abs(c) < F.lit(inf)), c).alias(f.name)
        out.append(c)
    return df.select(*out)


def read_store(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return nan_to_null(df.select(*columns) if columns else df)


def parse_mixed_timestamp(text: Column, layouts: Sequence[str] = TIMESTAMP_LAYOUTS) -> Column:
    """First layout that parses; anything else is null."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(layout)) for layout in layouts])


def read_readings_csv(
    spark: SparkSession, path: str, numeric: Sequence[str], text: Sequence[str] = ("city", "state", "country")
) -> DataFrame:
    """CSV readings with a header; bad numbers and timestamps become null, no row is lost."""
    header = spark.read.option("header", True).csv(path).columns
    raw = _by_header(spark, path, header)
    typed = [parse_mixed_timestamp(F.trim("timestamp")).alias("timestamp")]
    for c in header:
        if c in numeric:
            typed.append(F.expr(f"try_cast(`{c}` AS double)").alias(c))
        elif c in text or c != "timestamp":
            typed.append(F.col(c))
    return nan_to_null(raw.select(*typed))


def _by_header(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """CSV files that hold the same columns in any order: each file is read by its own header line."""
    columns = [f"_c{i}" for i in range(len(names))]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    lines = spark.read.schema(schema).option("mode", "PERMISSIVE").csv(path)
    lines = lines.select(F.array(*columns).alias("_v"), F.col("_metadata.file_path").alias("_f"))
    is_header = F.array_sort(F.transform("_v", lambda x: F.coalesce(x, F.lit("")))) == F.array(*[F.lit(c) for c in sorted(names)])
    headers = lines.where(is_header).select(F.col("_f").alias("_hf"), F.col("_v").alias("_h")).distinct()
    rows = lines.where(~is_header).join(headers, F.col("_f") == F.col("_hf"))
    return rows.select(*[F.get("_v", (F.array_position("_h", c) - 1).cast("int")).alias(c) for c in names])


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, keys: Sequence[str] = ("series_id", "ts"), buckets: int = 64) -> None:
    """Store as a table of ``buckets`` files, hashed and sorted by ``keys``. Stores with the same keys and number of buckets
    are joined on those keys, and aggregated by them, without a shuffle or a sort; a delivery goes into its own table or a rewrite.

    One file per bucket: rows are hashed once here as the table hashes them. A hot series spreads, since the time is a key too."""
    parted = df.repartition(buckets, *keys)
    parted.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).mode("overwrite").format("parquet").saveAsTable(table)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def pick_by_key(df: DataFrame, keys: Sequence[str], rank: Sequence[Column]) -> DataFrame:
    """One row per key: the one with the smallest ``rank``; full-row order breaks ties.

    An aggregation rather than a window, so thousands of copies of one key shrink to one row
    before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.min(F.struct(*[r.alias(f"_r{i}") for i, r in enumerate(rank)], *[F.col(c) for c in rest]))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, *[F.col(f"_b.{c}") for c in rest]).select(*df.columns)


def union_pick(frames: Sequence[DataFrame], keys: Sequence[str], keep: str = "first") -> DataFrame:
    """Stack frames and keep the first (or last) frame's row per key."""
    if not all(set(keys) <= set(f.columns) for f in frames):
        return union_all(frames)
    order = range(len(frames)) if keep == "first" else range(len(frames), 0, -1)
    tagged = [f.withColumn("_src", F.lit(i)) for i, f in zip(order, frames)]
    return pick_by_key(union_all(tagged), keys, [F.col("_src")]).drop("_src")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def upsert_store(existing: DataFrame, new: DataFrame, keys: Sequence[str], keep: str = "last") -> DataFrame:
    """Existing rows with ``new`` rows inserted by primary key."""
    return union_pick([existing, new], keys, keep)


def pick_latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the one that is greatest in ``order``; the full row breaks ties."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max(F.struct(*[F.col(c).alias(f"_r{i}") for i, c in enumerate(order)], *[F.col(c) for c in rest]))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, *[F.col(f"_b.{c}") for c in rest]).select(*df.columns)


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def upsert_parquet(
    spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str], partition: str, keep: str = "last",
    order: Sequence[str] = (),
) -> None:
    """Upsert into a partitioned parquet store: only the partitions that ``new`` touches, and those
    that hold older rows of its keys, are read and rewritten. Null is a partition like any other.

    With ``order`` the row that is greatest in it stays, wherever it comes from, so deliveries may
    arrive late; otherwise ``keep`` decides between stored and delivered rows.
    """
    from hazegrid.plans.attach import join_null_safe
    from hazegrid.session import checkpointed

    pick = (lambda rows: pick_latest(rows, keys, order)) if order else (lambda rows: pick_by_key(rows, keys, [F.lit(0)]))
    fs, root = _file_system(spark, path)
    if not fs.exists(root):  # first write
        write_parquet(pick(new), path, [partition])
        return
    stored = spark.read.parquet(path)
    stored = stored.select(*[F.col(c).cast(new.schema[c].dataType).alias(c) for c in new.columns])
    touched = new.select(partition)
    if partition not in keys:  # a key may have moved from another partition
        touched = touched.union(join_null_safe(stored.select(*keys, partition), new.select(*keys).distinct(), keys, "left_semi").select(partition))
    touched = checkpointed(touched.distinct())
    # two joins rather than a null-safe one, so that Spark can prune the store's partitions
    old = stored.join(touched, partition, "left_semi")
    if not touched.where(F.col(partition).isNull()).isEmpty():
        old = old.unionByName(stored.where(F.col(partition).isNull()))
    both = old.unionByName(new) if order else None
    merged = checkpointed(pick(both) if order else upsert_store(old, new, keys, keep))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    left = touched.join(merged.select(F.col(partition).alias("_p")).distinct(), F.col(partition).eqNullSafe(F.col("_p")), "left_anti")
    for row in left.collect():  # partitions whose last row has moved away
        value = "__HIVE_DEFAULT_PARTITION__" if row[0] is None else str(row[0])
        escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(path, f"{partition}={escaped}"), True)


def snapshot_tail(
    df: DataFrame, keys: Sequence[str], features: Sequence[str], n: int = 72, ts: str = "ts"
) -> DataFrame:
    """Latest ``n`` rows per key with the listed features that exist. The rank limit is applied
    on the map side too, so at most ``n`` rows per key and task are shuffled."""
    present = [f for f in features if f in df.columns]
    if not present:
        raise ValueError("none of the requested features exists")
    w = Window.partitionBy(*keys).orderBy(F.col(ts).desc())
    return (
        df.select(*keys, ts, *present)
        .withColumn("_rn", F.row_number().over(w))
        .where(F.col("_rn") <= n)
        .drop("_rn")
    )


def dataset_summary(df: DataFrame, city: str = "city", ts: str = "ts") -> DataFrame:
    """Row count, cities and time range. Cities are made distinct first, so the collected list
    holds one entry per city."""
    per_city = df.groupBy(city).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    return per_city.agg(
        F.sum("n").alias("total_records"),
        F.count(city).alias("cities"),
        F.array_join(F.array_sort(F.collect_list(city)), ",").alias("city_names"),
        F.min("lo").alias("start_ts"),
        F.max("hi").alias("end_ts"),
    )


def export_predictions(preds: DataFrame, models: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Long predictions -> one column per model."""
    return preds.groupBy(*keys).pivot("model", list(models)).agg(F.max("yhat"))


def export_metadata(preds: DataFrame, models: Sequence[str], ensembles: Sequence[str], horizon: int) -> DataFrame:
    """Facts about an export as one JSON document."""
    return preds.agg(F.count_distinct("series_id", "ts").alias("n")).select(
        F.to_json(
            F.struct(
                F.lit(horizon).alias("horizon_hours"),
                F.array(*[F.lit(m) for m in models]).alias("model_names"),
                F.col("n").alias("prediction_count"),
                F.struct(
                    F.lit(len(models)).alias("models_used"),
                    F.lit(len([m for m in models if m in ensembles])).alias("ensemble_models"),
                    F.lit(len([m for m in models if m not in ensembles])).alias("individual_models"),
                ).alias("prediction_summary"),
            )
        ).alias("metadata")
    )


def priority_merge(sources: Sequence[DataFrame], keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Per key and column, the value of the first source that has one, and the source that won
    the first column. Each source may hold many copies; partial aggregation folds them."""
    stacked = union_all([s.select(*keys, *values).withColumn("_p", F.lit(i)) for i, s in enumerate(sources)])

    def first_present(c):
        return F.min(F.when(F.col(c).isNotNull(), F.struct("_p", F.col(c).alias("v"))))

    return stacked.groupBy(*keys).agg(
        *[first_present(c)["v"].alias(c) for c in values],
        F.min("_p").alias("source_rank"),
    )


def align_schema(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Keep the (lower-cased) columns a target schema knows; report the others."""
    lowered = normalize_columns(df)
    known = set(columns)
    return (
        lowered.select(*[c for c in lowered.columns if c in known]),
        [c for c in lowered.columns if c not in known],
    )


def normalize_columns(df: DataFrame, rename: dict[str, str] | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    names = [c.lower().replace(".", "_") for c in df.columns]
    names = [(rename or {}).get(c, c) for c in names]
    out = df.toDF(*names)
    return out.select(*[c for c in keep if c in names]) if keep else out


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Missing columns in data: {missing}")
    return df


def discover_roles(df: DataFrame) -> dict[str, str | None]:
    """Time column: first whose name has "date"/"time" and whose values all parse; target:
    first whose name has "aqi". One aggregation checks all candidates."""
    candidates = [c for c in df.columns if "date" in c.lower() or "time" in c.lower()]
    time_col = None
    if candidates:
        kinds = dict(df.dtypes)
        checks = []
        for c in candidates:
            if kinds[c] == "string":
                ok = parse_mixed_timestamp(F.col(c)).isNotNull() | F.col(c).isNull()
            else:
                ok = F.lit(True)
            checks.append(F.min(ok.cast("int")).alias(c))
        row = df.agg(*checks).first()
        time_col = next((c for c in candidates if row[c] in (1, None)), None)
    return {"time": time_col, "target": next((c for c in df.columns if "aqi" in c.lower()), None)}


def common_columns(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c in set(b.columns)]


def missing_features(needed: DataFrame, present: DataFrame, group: str, feature: str) -> DataFrame:
    """Feature names needed but not present, per group (catalog tables, set difference)."""
    return needed.select(group, feature).subtract(present.select(group, feature))


def encode_label(df: DataFrame, col: str, out: str) -> DataFrame:
    """0-based code of each distinct value in sorted order (null counts as text "None")."""
    from hazegrid.plans.attach import attach

    text = F.coalesce(F.col(col).cast("string"), F.lit("None"))
    tagged = df.withColumn("_label", text)
    return attach(tagged, global_positions(tagged.select("_label").distinct(), ["_label"], out), ["_label"]).drop("_label")
