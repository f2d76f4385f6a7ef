"""Structured Streaming over event files: windowed counts, idempotent replay, throttling with state.

``run`` drains what is there (``availableNow``) into Parquet below the shared scratch folder; with a checkpoint
folder of its own a stream resumes where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.session import scratch_dir


def source(spark: SparkSession, path: str, files_per_trigger: int = 4) -> DataFrame:
    """Event files of a folder or glob as a stream; the schema is that of the files there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run(stream: DataFrame, folder: str | None = None, mode: str = "append") -> DataFrame:
    """Drain a stream into Parquet and read the result."""
    spark = stream.sparkSession
    folder = folder or scratch_dir(spark)
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def run_batches(stream: DataFrame, handle, folder: str | None = None, mode: str = "append") -> None:
    """Drain a stream through ``handle(batch, number)``; a replayed batch has the same number."""
    folder = folder or scratch_dir(stream.sparkSession)
    stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def latest_states(stream: DataFrame, key: str, at: str, order: str, value: str, folder: str | None = None) -> DataFrame:
    """(key, value, n): the last value of each key. The state store holds each key's last row; a batch writes the
    keys that it changes, under its own number, and of a key's rows the one with most events counts."""
    spark = stream.sparkSession
    folder = folder or scratch_dir(spark)
    last = stream.groupBy(key).agg(F.max(F.struct(at, order, value)).alias("s"), F.count("*").alias("n")).select(key, F.col(f"s.{value}").alias(value), "n")

    def changed(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changes/{number}")

    run_batches(last, changed, folder, "update")
    rows = spark.read.schema(last.schema).parquet(f"{folder}/changes/*")
    return rows.groupBy(key).agg(F.max_by(value, "n").alias(value), F.max("n").alias("n"))


def windowed(stream: DataFrame, at: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts per window of ``width``; windows close ``late`` after the newest event."""
    counts = stream.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), *keys, "n")


def throttle(stream: DataFrame, key: str, at: str, seconds: float) -> DataFrame:
    """Leading-edge throttle per key with the last accepted time as state; events should come in time order."""

    def accept(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for pdf in frames:
            keep = []
            for micros in pdf.sort_values([at, "event_id"])[at].map(lambda t: int(t.value // 1000)):
                ok = last is None or micros - last >= seconds * 1e6
                keep.append(ok)
                last = micros if ok else last
            yield pdf.sort_values([at, "event_id"])[keep]
        if last is not None:
            state.update((last,))

    return stream.groupBy(key).applyInPandasWithState(accept, stream.schema, "last long", "append", GroupStateTimeout.NoTimeout)
