"""Session helpers: opening a session, reading tables, and cutting lineage durably."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def open_session(name: str = "quire", cpus: str | int = "*", **conf: str) -> SparkSession:
    """A local session for development; on a cluster pass your own session to the operators."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One Parquet table (a file or a folder) of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A new, unique folder below the shared checkpoint folder.

    ``spark.checkpoint.dir`` decides when the session has it (all executors see that folder);
    only where it is unset and the session is local, as in tests, a folder of this machine is taken.
    """
    context = spark.sparkContext
    base = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quire-checkpoint-")
        context.setCheckpointDir(base)
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/quire-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` below the checkpoint folder and read it back.

    The plan behind it ends here: iterations stay short, several readers share one computation,
    and the rows outlive any executor.
    """
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores.

    For scans whose work a row is much more than its bytes. A table of many files has partitions enough and
    is left alone; only what a few row groups would put into a few tasks is dealt out.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df
