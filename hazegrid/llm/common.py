"""Shared pieces: words, scratch tables, joins of checked size, sums along a global order."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazegrid.session import scratch_dir

WORD_GAP = r"[\x20\x09-\x0D]+"  # what separates words; bytes.split() uses the same six characters
BROADCAST_ROWS = 200_000  # a table is broadcast up to so many rows and ...
BROADCAST_BYTES = 16 << 20  # ... so many bytes of its measured content
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once as parquet in the shared folder and read it again: cuts the lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The names, with underscores added until ``df`` has no column called so (whatever the case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def fits_broadcast(table: DataFrame) -> bool:
    """Measured, not estimated: rows, and bytes of every value written out as text."""
    values = [F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string")), F.lit(0)) + 16 for f in table.schema.fields]
    n, size = table.agg(F.count(F.lit(1)), F.sum(sum(values[1:], values[0]))).first()
    return n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES


def join_measured(left: DataFrame, table: DataFrame, on: Sequence[tuple[str, str]], how: str = "left") -> DataFrame:
    """Join a stored per-key ``table`` to rows whose keys may be hot; ``on`` pairs the column names
    of both sides, which must not clash, null equal to null. A small table is broadcast; for a larger one
    both sides are shuffled, and adaptive execution splits the rows of a hot key over several tasks
    (``table`` has one row per key, so only the left side can be hot)."""
    meet = [F.col(f"`{a}`").eqNullSafe(F.col(f"`{b}`")) for a, b in on]
    cond = meet[0]
    for c in meet[1:]:
        cond &= c
    return left.join(F.broadcast(table) if fits_broadcast(table) else table, cond, how)


def running_sums(df: DataFrame, order: Sequence[Column], value: str, before: str, name: str, tasks: int) -> DataFrame:
    """``before``: the sum of the long column ``value`` over all rows that come earlier in ``order``.

    Rows are range-partitioned by ``order`` and sorted; each task adds up its own part, and the
    totals of the parts (one number per task) are added afterwards. No task sees more than its
    range. Rows equal in ``order`` stand in one task, in no particular sequence.
    """
    part, local = "_part", "_local"
    schema = T.StructType([*df.schema.fields, T.StructField(part, T.LongType()), T.StructField(local, T.LongType())])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        done = 0
        for b in batches:
            v = np.asarray(b.column(value).fill_null(0), dtype=np.int64)
            upto = np.cumsum(v) + done
            done = int(upto[-1]) if len(v) else done
            where = np.full(len(v), TaskContext.get().partitionId(), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(where), pa.array(upto - v)], [*b.schema.names, part, local])

    parts = stored(df.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(add_up, schema), name)
    totals = {r[0]: r[1] for r in parts.groupBy(part).agg(F.max(F.col(local) + F.coalesce(F.col(value), F.lit(0)))).collect()}
    offsets, done = [], 0
    for p in sorted(totals):
        offsets.append((p, done))
        done += totals[p]
    start = df.sparkSession.createDataFrame(offsets, "_at long, _start long")
    return (parts.join(F.broadcast(start), F.col(part) == F.col("_at"))
            .withColumn(before, F.col(local) + F.col("_start")).drop(part, local, "_at", "_start"))


def in_batches(fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Apply ``fn`` to each Arrow batch of a task."""
    return lambda batches: (fn(b) for b in batches)


def open_store(folder: str):
    """(file system, path) of a shared folder, from any executor: local, S3, GCS, HDFS or Azure URI."""
    import re

    from pyarrow import fs

    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]+:", folder):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))
    return fs.LocalFileSystem(), folder


def attempt_name(prefix: str, suffix: str) -> tuple[int, str]:
    """(partition, file name) for what this task attempt writes. An attempt that is lost leaves a
    file that no manifest names; its successor writes another."""
    from pyspark import TaskContext

    task = TaskContext.get()
    return task.partitionId(), f"{prefix}-{task.partitionId():06d}-{task.taskAttemptId()}{suffix}"
