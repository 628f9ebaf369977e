"""Session helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "hazegrid") -> SparkSession:
    """Session for tests and the local bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("HAZEGRID_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir``; only where the session names none
    (tests on one machine) a scratch folder is set.
    """
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        _set_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the checkpoint folder of the application."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        _set_checkpoint_dir(spark)
    return sc.getCheckpointDir()


def _set_checkpoint_dir(spark: SparkSession) -> None:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="hazegrid-ckpt-")  # one machine, as in tests
    spark.sparkContext.setCheckpointDir(folder)
