"""A session for tests and the benchmark; a cluster brings its own."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, name: str = "docloom", **options: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    settings = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **options,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in `spark.checkpoint.dir`.

    Where it is unset, a temporary folder stands in on a single machine (tests)
    and is removed at exit; on a cluster that is an error, as executors would
    write to disks of their own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named:
            if (sc.master or "").split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="docloom-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir().rstrip("/")


def reliable(df: DataFrame) -> DataFrame:
    """df from a checkpoint in the shared folder: the same rows in the same partitions, whatever executors are lost later."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
