"""Durable jobs as a log of events: states, attempts, retries, and the leading-edge throttle of a watcher."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def job_states(events: DataFrame, job: str, kind: str, at: str, order: str) -> DataFrame:
    """(job, status, attempts, first_started_at, finished_at, n_events) of each job from its event log.

    ``kind`` holds start, progress, success, failure or cancel; the last event by (``at``, ``order``) decides.
    """
    last = F.struct(F.col(at), F.col(order))
    status = F.when(F.col("last") == "start", "running").when(F.col("last") == "progress", "running").when(F.col("last") == "success", "succeeded").when(F.col("last") == "failure", "failed").when(F.col("last") == "cancel", "canceled").otherwise("queued")
    found = events.groupBy(job).agg(F.max_by(kind, last).alias("last"), F.count_if(F.col(kind) == "start").alias("attempts"), F.min(F.when(F.col(kind) == "start", F.col(at))).alias("first_started_at"), F.max(F.when(F.col(kind).isin("success", "failure", "cancel"), F.col(at))).alias("last_end"), F.count("*").alias("n_events"))
    return found.select(job, status.alias("status"), "attempts", "first_started_at", F.when(status.isin("succeeded", "failed", "canceled"), F.col("last_end")).alias("finished_at"), "n_events")


def progress(done: Column, total: Column) -> Column:
    """Share done, at most 1, 0 without a total."""
    return F.when((total > 0) & done.isNotNull(), F.least(F.lit(1.0), done / total)).otherwise(0.0)


def sessions(events: DataFrame, key: str, at: str, gap_seconds: int) -> DataFrame:
    """``events`` with ``session_no``: a new session begins after a pause of more than ``gap_seconds``."""
    w = Window.partitionBy(key).orderBy(at, "event_id")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    pause = (micros(F.col(at)) - micros(F.lag(at).over(w))) / 1e6
    return events.withColumn("session_no", F.sum((F.coalesce(pause > gap_seconds, F.lit(True))).cast("int")).over(w))


def throttled(events: DataFrame, key: str, at: str, seconds: float) -> DataFrame:
    """Events accepted by a leading-edge throttle: one is dropped if its key was accepted less than ``seconds``
    before; dropped events do not extend the pause. A key's events are handled in order in one task, so the key
    must be a path or the like, not a hot constant."""

    def accept(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([at, "event_id"], kind="stable")
        keep, last = [], None
        for t in pdf[at]:
            ok = last is None or (t - last).total_seconds() >= seconds
            keep.append(ok)
            last = t if ok else last
        return pdf[keep]

    return events.groupBy(key).applyInPandas(accept, events.schema)
