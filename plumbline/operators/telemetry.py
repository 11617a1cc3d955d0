"""Job telemetry (M) over an event log, in batch. The streaming forms are in plumbline.streaming.jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.numbers import rounded

c = F.col
LIVE = ("queued", "running")
#: What an event turns a job into; retries only count for jobs that failed or were cancelled.
BECOMES = {"enqueue": "queued", "start": "running", "finish": "done", "fail": "failed", "cancel": "cancelled"}
STALE_S, ALIVE_S = 900, 120
# States of a drawing, worst first, and causes of a failed job by what its error says.
STATUS_ORDER = ("failed", "needs_review", "reading", "queued", "not_read", "ready")
CAUSES = (("file missing", "^the file is no longer at"), ("model offline", "^the vision model is unavailable"), ("stopped twice", "worker stopped twice"), ("cancelled", "cancel"))


def dedupe_requests(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """M1: requests (seq, owner, drawing_path, page) that aren't queued or running yet, each once."""
    key = ["owner", "drawing_path", "page"]
    w = Window.partitionBy(*key).orderBy("seq")
    first = requests.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
    return first.join(jobs.where(c("state").isin(*LIVE)).select(*key).distinct(), key, "left_anti")


def latest_by_drawing(jobs: DataFrame) -> DataFrame:
    """M2: the newest job of each (drawing_path, page); of equal times the later in order wins."""
    best = F.max_by(F.struct(*[F.col(x) for x in jobs.columns if x not in ("drawing_path", "page")]), F.struct("created_at", "position", "job_id"))
    return jobs.groupBy("drawing_path", "page").agg(best.alias("j")).select("drawing_path", "page", "j.*")


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def job_summary(jobs: DataFrame, now: Column) -> DataFrame:
    """M3: by owner: jobs in each state, per cent done, mean seconds of finished uncached jobs, time left, and whether a worker lives."""
    n = {s: F.count_if(c("state") == s) for s in ("queued", "running", "done", "failed", "cancelled")}
    timed = (c("state") == "done") & (c("elapsed_s") > 0) & ~c("from_cache")
    g = jobs.groupBy("owner").agg(
        *[x.alias(s) for s, x in n.items()],
        F.coalesce(F.sum(F.when(c("state") == "running", c("progress_pct") / 100)), F.lit(0.0)).alias("part"),
        F.sum(F.when(timed, c("elapsed_s"))).alias("t"), F.count_if(timed).alias("nt"),
        F.coalesce(F.max((c("state") == "running") & (seconds(now) - seconds(c("heartbeat_at")) < ALIVE_S)), F.lit(False)).alias("worker_alive"),
    )
    return summary_rows(g)


def summary_rows(g: DataFrame) -> DataFrame:
    """M3: the summary from counters by owner: part is the running jobs' share done, t and nt the seconds and number of timed jobs."""
    all_jobs = c("queued") + c("running") + c("done") + c("failed")
    mean = F.when(c("nt") > 0, c("t") / c("nt"))
    states = ("queued", "running", "done", "failed", "cancelled")
    return g.select("owner", *states, F.when(all_jobs > 0, rounded(100 * (c("done") + c("failed") + c("part")) / all_jobs, 1)).otherwise(0.0).alias("percent"), rounded(mean, 1).alias("mean_s"), rounded(mean * (c("queued") + c("running")), 1).alias("eta_s"), "worker_alive")


def stale_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    """M4: running jobs without a heartbeat for STALE_S seconds: failed if they were requeued before, else requeued."""
    old = jobs.where((c("state") == "running") & (seconds(now) - seconds(c("heartbeat_at")) > STALE_S))
    return old.select("job_id", F.when(c("requeues") >= 1, "failed").otherwise("requeued").alias("becomes"))


def drawing_status(drawings: DataFrame, latest: DataFrame, saved: DataFrame, attention: DataFrame) -> DataFrame:
    """M5: what to show for each drawing. Work in motion wins, then failure, then the saved reading; cancelled is no news."""
    out = drawings.join(latest.select("drawing_path", "state"), "drawing_path", "left").join(saved.select("drawing_path", F.lit(True).alias("saved")).distinct(), "drawing_path", "left").join(attention.select("drawing_path", "needs_attention"), "drawing_path", "left")
    status = F.when(c("state") == "running", "reading").when(c("state") == "queued", "queued").when(c("state") == "failed", "failed").when(c("saved") & (F.coalesce("needs_attention", F.lit(0)) > 0), "needs_review").when(c("saved"), "ready").otherwise("not_read")
    return out.select("drawing_path", status.alias("status"))


def status_tally(statuses: DataFrame) -> DataFrame:
    """M6: drawings in each state with its rank, worst first; states without drawings have no row."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STATUS_ORDER]), c("status")).cast("int")
    return statuses.groupBy("status").agg(F.count("*").alias("n")).withColumn("rank", rank)


def cause(error: Column) -> Column:
    """Why a job failed, in one of five words; empty without an error."""
    low = F.lower(F.trim(F.coalesce(error, F.lit(""))))
    out = F.when(low == "", "")
    for name, pattern in CAUSES:
        out = out.when(F.rlike(low, F.lit(pattern)), name)
    return out.otherwise("unreadable")


def queue_report(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M7: totals by owner (done, failed, cached, seconds of model time), and a row for each finished job with its cause."""
    totals = jobs.groupBy("owner").agg(F.count_if(c("state") == "done").alias("done"), F.count_if(c("state") == "failed").alias("failed"), F.count_if((c("state") == "done") & c("from_cache")).alias("cached"), rounded(F.coalesce(F.sum(F.when(~c("from_cache"), c("elapsed_s"))), F.lit(0.0)), 2).alias("model_s"))
    rows = jobs.where(c("state").isin("done", "failed")).select("job_id", "owner", "state", cause(c("error")).alias("cause"))
    return totals, rows


def saved_reading(files: DataFrame, jobs: DataFrame, store: DataFrame) -> DataFrame:
    """M8: (drawing_path, fingerprint) of the reading that still counts: that of the newest done job if the file is unchanged, else that under the default profile; none without either in the store.

    files: (drawing_path, content_sha, default_fingerprint); jobs carry the content_sha they read.
    """
    done = latest_by_drawing(jobs.where("state = 'done'").select("drawing_path", "page", "created_at", "position", "job_id", "fingerprint", "content_sha"))
    one = done.groupBy("drawing_path").agg(F.max_by(F.struct("fingerprint", "content_sha"), F.struct("created_at", "position", "job_id")).alias("d"))
    out = files.join(one, "drawing_path", "left")
    fp = F.when(c("d.content_sha") == c("content_sha"), c("d.fingerprint")).otherwise(c("default_fingerprint"))
    return out.select("drawing_path", fp.alias("fingerprint")).join(store.select("fingerprint").distinct(), "fingerprint", "left_semi")


def cache_hits(requests: DataFrame, store: DataFrame) -> DataFrame:
    """Requests, those served from the store (fingerprint there and not forced), and their share."""
    hit = requests.join(store.select("fingerprint").distinct().withColumn("there", F.lit(True)), "fingerprint", "left")
    served = F.count_if(F.coalesce(c("there"), F.lit(False)) & ~c("forced"))
    return hit.agg(F.count("*").alias("n"), served.alias("served"), rounded(served / F.greatest(F.count("*"), F.lit(1)), 4).alias("share"))


def fold_job_state(events: DataFrame) -> DataFrame:
    """The current row of each job from its events (event_id, ts, job_id, event, progress_pct, from_cache, error) in order of time.

    A retry counts only for failed and cancelled jobs and starts afresh; heartbeats are held within 0 to 100, and one without a percentage leaves it. A retry takes effect
    exactly if the last event that changes the state was a failure or a cancellation. One sorted pass marks those and finds the
    start that an end belongs to; every column is then the newest of its own events, which combine before the shuffle. No job's events are gathered.
    """
    e = events.select("job_id", c("ts").cast("timestamp").alias("ts"), "event_id", "event", "progress_pct", "from_cache", "error")
    w = Window.partitionBy("job_id").orderBy("ts", "event_id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    ev = c("event")
    moving = ev.isin("enqueue", "start", "finish", "fail", "cancel", "retry")
    e = e.withColumn("before", F.last(F.when(moving, ev), ignorenulls=True).over(before))
    e = e.withColumn("retried", (ev == "retry") & F.coalesce(c("before").isin("fail", "cancel"), F.lit(False)))
    e = e.withColumn("begun", F.last(F.when((ev == "start") | c("retried"), F.struct(F.when(ev == "start", c("ts")).alias("at"))), ignorenulls=True).over(before)["at"])
    when, again, null = F.struct("ts", "event_id"), c("retried"), F.lit(None)
    newest = lambda value, cond: F.max_by(F.struct(value.alias("v")), F.when(cond, when))["v"]
    state = F.when(again, "queued").otherwise(F.create_map(*[F.lit(x) for kv in BECOMES.items() for x in kv])[ev])
    pct = F.when(ev == "heartbeat", F.greatest(F.least(c("progress_pct"), F.lit(100.0)), F.lit(0.0))).when(ev == "finish", 100.0).otherwise(0.0)
    ended = ev.isin("finish", "fail") & c("begun").isNotNull()
    out = e.groupBy("job_id").agg(
        F.coalesce(newest(state, ev.isin(*BECOMES) | again), F.lit("none")).alias("state"),
        F.coalesce(newest(pct, ev.isin("enqueue", "start", "finish") | ((ev == "heartbeat") & c("progress_pct").isNotNull()) | again), F.lit(0.0)).alias("progress_pct"),
        newest(F.when(ev == "start", c("ts")), (ev == "start") | again).alias("started_at"),
        newest(F.when(~again, c("ts")), ev.isin("start", "heartbeat") | again).alias("heartbeat_at"),
        newest(F.when(ended, (F.unix_micros("ts") - F.unix_micros("begun")) / 1e6).otherwise(null.cast("double")), ended | again).alias("elapsed_s"),
        F.coalesce(newest(F.when(ev == "fail", F.substring(F.coalesce(c("error"), F.lit("")), 1, 2000)).otherwise(""), (ev == "fail") | again), F.lit("")).alias("error"),
        F.coalesce(newest(F.when(ev == "finish", F.coalesce(c("from_cache"), F.lit(False))).otherwise(False), (ev == "finish") | again), F.lit(False)).alias("from_cache"),
        F.count("*").cast("int").alias("n_events"),
    )
    return out
