"""Jobs as keyed state: the batch view of their events, expiry, poll intervals, and the same state kept by a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import shared_dir
from ..sources.tables import load

#: What an event makes of a job; hours after which an ended job expires.
STATUS = {"signup": "queued", "click": "running", "view": "repairing", "purchase": "ready", "error": "failed"}
ENDED, HOURS = ("ready", "failed"), 6
#: Milliseconds between polls by status and seconds since the start.
QUEUED, RUNNING, REPAIRING = 1200, 5000, 2500
BY_ELAPSED = ((240, 5000), (120, 3500), (45, 2500))
DEFAULT = 1500


def status_of(event: Column) -> Column:
    out = F.lit("queued")
    for word, status in STATUS.items():
        out = F.when(event == word, F.lit(status)).otherwise(out)
    return out


def job_events(events: DataFrame) -> DataFrame:
    """(job_id, event_id, ts, status, size)"""
    return events.select(F.col("user_id").alias("job_id"), "event_id", "ts", status_of(F.col("event_type")).alias("status"), "value")


def latest(jobs: DataFrame) -> DataFrame:
    """The last event of each job by time and event: an aggregate, so only one row of each job per task moves."""
    return jobs.groupBy("job_id").agg(F.max(F.struct("ts", "event_id", "status")).alias("m"), F.min("ts").alias("created_at"), F.count("*").alias("n_events")).select("job_id", "created_at", F.col("m.ts").alias("updated_at"), F.col("m.status").alias("status"), "n_events")


def poll_interval(status: Column, elapsed: Column) -> Column:
    """Milliseconds until a client should ask again; 0 for a job that has ended."""
    out = F.when(status.isin(*ENDED), 0).when(status == "queued", QUEUED).when(status == "running", RUNNING)
    for least, ms in BY_ELAPSED[:2]:
        out = out.when(elapsed >= least, ms)
    return out.when((elapsed >= BY_ELAPSED[2][0]) | (status == "repairing"), REPAIRING).otherwise(DEFAULT)


def q39_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each job's last state and whether it has expired: ended, and last touched before the cut; active ones never do.

    The cut is six hours before the last event of all.
    """
    jobs = latest(job_events(load(spark, sf_dir, "events")))
    now = jobs.agg(F.max("updated_at").alias("now"))
    rows = jobs.join(F.broadcast(now), F.lit(True))
    expired = F.col("status").isin(*ENDED) & (F.col("updated_at") < F.col("now") - F.expr(f"INTERVAL {HOURS} HOURS"))
    return rows.select("job_id", "status", "n_events", F.unix_timestamp("updated_at").alias("updated_s"), expired.alias("expired"))


def q40_poll_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = job_events(load(spark, sf_dir, "events"))
    w = Window.partitionBy("job_id").orderBy("ts", "event_id")
    rows = jobs.select("status", (F.unix_timestamp("ts") - F.unix_timestamp(F.coalesce(F.lag("ts").over(w), F.col("ts")))).alias("elapsed"))
    return rows.select("status", poll_interval(F.col("status"), F.col("elapsed") % 400).alias("poll_ms")).groupBy("status", "poll_ms").agg(F.count("*").alias("n"))


_STATE = "job_id long, status string, updated_s long, n_events long"


def _update(key, frames, state: GroupState):
    """The newest event wins whatever the order of arrival; state is (seconds, event, status, events)."""
    import pandas as pd

    seconds, event, status, n = state.get if state.exists else (-1, -1, "queued", 0)
    for pdf in frames:
        n += len(pdf)
        newest = pdf[pdf["seconds"] == pdf["seconds"].max()]
        last = newest.loc[newest["event_id"].idxmax()]
        if (last["seconds"], last["event_id"]) > (seconds, event):
            seconds, event, status = int(last["seconds"]), int(last["event_id"]), str(last["status"])
    state.update((seconds, event, status, n))
    yield pd.DataFrame({"job_id": [key[0]], "status": [status], "updated_s": [seconds], "n_events": [n]})


def stream_states(events: DataFrame) -> DataFrame:
    """Streamed job states, a row per job and batch that touched it.  Takes streamed events."""
    rows = job_events(events).select("job_id", "event_id", F.unix_timestamp("ts").alias("seconds"), "status")
    return rows.groupBy("job_id").applyInPandasWithState(_update, _STATE, "seconds long, event_id long, status string, n long", "update", GroupStateTimeout.NoTimeout)


def q41_streamed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events through the stream, as far as they are there; the last state of each job.  As q39, but expiry."""
    folder = f"{shared_dir(spark)}/jobs-{uuid.uuid4().hex[:12]}"
    schema = load(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet" if _is_folder(spark, f"{sf_dir}/events.parquet") else f"{sf_dir}/[e]vents.parquet")
    write = lambda batch, k: batch.withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(f"{folder}/out/batch={k}-of")
    query = stream_states(events).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    out = spark.read.schema(f"{_STATE}, batch int").parquet(f"{folder}/out/*")
    return out.groupBy("job_id").agg(F.max(F.struct("batch", "status", "updated_s", "n_events")).alias("m")).select("job_id", "m.status", "m.updated_s", "m.n_events")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def q50_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: events and failures per hour window and status, as a watermarked stream would close them."""
    e = job_events(load(spark, sf_dir, "events"))
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "status").agg(F.count("*").alias("n")).select(F.unix_timestamp(F.col("w.start")).alias("start_s"), "status", "n")


QUERIES = {q.__name__: q for q in (q39_job_states, q40_poll_intervals, q41_streamed_jobs, q50_event_windows)}

_J = """WITH j AS (SELECT user_id AS job_id, event_id, ts, CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'repairing' WHEN 'purchase' THEN 'ready' WHEN 'error' THEN 'failed' ELSE 'queued' END AS status FROM events),
l AS (SELECT job_id, count(*) AS n_events, max(ts) AS updated_at, arg_max(status, (ts, event_id)) AS status FROM j GROUP BY job_id)
"""
SQL = {
    "q39_job_states": _J + "SELECT job_id, status, n_events, epoch(date_trunc('second', updated_at))::bigint AS updated_s, status IN ('ready', 'failed') AND updated_at < (SELECT max(updated_at) FROM l) - INTERVAL 6 HOURS AS expired FROM l",
    "q40_poll_intervals": _J + """, e AS (SELECT status, (epoch(date_trunc('second', ts))::bigint - epoch(date_trunc('second', coalesce(lag(ts) OVER (PARTITION BY job_id ORDER BY ts, event_id), ts)))::bigint) % 400 AS elapsed FROM j)
SELECT status, (CASE WHEN status IN ('ready', 'failed') THEN 0 WHEN status = 'queued' THEN 1200 WHEN status = 'running' THEN 5000 WHEN elapsed >= 240 THEN 5000 WHEN elapsed >= 120 THEN 3500 WHEN elapsed >= 45 OR status = 'repairing' THEN 2500 ELSE 1500 END)::int AS poll_ms, count(*) AS n FROM e GROUP BY 1, 2""",
    "q41_streamed_jobs": _J + "SELECT job_id, status, epoch(date_trunc('second', updated_at))::bigint AS updated_s, n_events FROM l",
    "q50_event_windows": _J + "SELECT epoch(date_trunc('hour', ts))::bigint AS start_s, status, count(*) AS n FROM j GROUP BY 1, 2",
}
