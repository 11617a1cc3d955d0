"""Structured Streaming forms of the job telemetry: M1-M4 and M12 over an append-only event stream."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from plumbline.operators.telemetry import ALIVE_S, BECOMES, seconds, summary_rows

EVENTS = "event_id bigint, ts timestamp, job_id string, owner string, drawing_path string, page int, event string, progress_pct double, from_cache boolean, error string"
JOB = "job_id string, owner string, state string, progress_pct double, heard double, elapsed_s double, error string, from_cache boolean, n_events int"
#: How long the state of a job that has ended is kept for a retry, in milliseconds.
KEEP_MS = 7 * 24 * 3_600_000


class Admit(StatefulProcessor):
    """M1: the jobs of one (owner, drawing, page) that are queued or running; the key holds nothing once all have ended."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.live = handle.getMapState("live", "job_id string", "since timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        live = {k[0]: v[0] for k, v in self.live.iterator()}
        before, admitted = set(live), []
        for e in pd.concat(list(rows)).sort_values(["ts", "event_id"]).itertuples():
            if e.event == "request":
                if not live:
                    admitted.append((e.job_id, *key, e.ts))
                    live[e.job_id] = e.ts
            elif e.event in ("finish", "fail", "cancel"):
                live.pop(e.job_id, None)
            elif e.event in ("enqueue", "start", "retry"):
                live.setdefault(e.job_id, e.ts)
        for job in before - set(live):
            self.live.removeKey((job,))
        for job in set(live) - before:
            self.live.updateValue((job,), (live[job],))
        yield pd.DataFrame(admitted, columns=["job_id", "owner", "drawing_path", "page", "ts"])

    def close(self) -> None:
        pass


def admit_stream(requests: DataFrame, events: DataFrame) -> DataFrame:
    """M1: the requests to queue: those whose (owner, drawing, page) has no job queued or running, each once.

    Both streams have the columns of EVENTS; a request carries the id that its job would get. An admitted request
    holds its key, and so does every job that its events show as queued, running or retried; the key is free again as
    soon as these jobs have finished, failed or been cancelled, and its state is then empty. Rows of a batch count in
    order of time, requests before events of the same time; nothing is forgotten by age, as nothing in the batch form is.
    """
    columns = [f.split()[0] for f in EVENTS.split(", ")]
    both = requests.withColumn("event", F.lit("request")).withColumn("event_id", F.lit(-1).cast("bigint")).select(columns).unionByName(events.select(columns))
    out = "job_id string, owner string, drawing_path string, page int, ts timestamp"
    return both.groupBy("owner", "drawing_path", "page").transformWithStateInPandas(Admit(), out, "append", "none")


def latest_stream(jobs: DataFrame) -> DataFrame:
    """M2: the newest job of each (drawing_path, page), kept up to date (use with update or complete mode)."""
    newest = F.max_by(F.struct("job_id", "event", "ts"), F.struct("ts", "event_id"))
    return jobs.groupBy("drawing_path", "page").agg(newest.alias("j")).select("drawing_path", "page", "j.*")


class Job(NamedTuple):
    """What the summary keeps of a job; times in seconds."""

    state: str = "none"
    pct: float = 0.0
    heard: float | None = None
    started: float | None = None
    elapsed: float | None = None
    cached: bool = False

    def after(self, event: str, at: float, pct: float | None, cached: bool | None) -> Job:
        """The job after one event: the same rules as fold_job_state."""
        if event == "retry":
            return Job("queued") if self.state in ("failed", "cancelled") else self
        job = self._replace(state=BECOMES.get(event, self.state))
        if event == "heartbeat":
            return job._replace(heard=at, pct=self.pct if pct is None or pct != pct else min(max(pct, 0.0), 100.0))
        if event == "start":
            return job._replace(heard=at, started=at, pct=0.0)
        if event == "enqueue":
            return job._replace(pct=0.0)
        if event in ("finish", "fail") and self.started is not None:
            job = job._replace(elapsed=at - self.started)
        return job._replace(pct=100.0, cached=bool(cached)) if event == "finish" else job


class Summary(StatefulProcessor):
    """M3: the jobs of one owner's shard and running counters over them.

    Counters move by what a job was and what it has become, so a batch costs its own events and not the owner's jobs;
    only the running jobs are looked through, for the newest heartbeat. A job that has ended is forgotten ``keep_s``
    after its end; it stays counted.
    """

    STATES = ("queued", "running", "done", "failed", "cancelled")

    def __init__(self, keep_s: float):
        self.keep_s = keep_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getMapState("jobs", "job_id string", "state string, pct double, heard double, started double, elapsed double, cached boolean")
        self.running = handle.getMapState("running", "job_id string", "heard double")
        self.ended = handle.getMapState("ended", "job_id string", "at double")
        self.counts = handle.getValueState("counts", "queued long, running long, done long, failed long, cancelled long, part double, t double, nt long")

    def weight(self, job: Job) -> list[float]:
        timed = job.state == "done" and not job.cached and (job.elapsed or 0) > 0
        return [*[job.state == s for s in self.STATES], job.pct / 100 if job.state == "running" else 0.0, job.elapsed if timed else 0.0, timed]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        counts = list(self.counts.get()) if self.counts.exists() else [0, 0, 0, 0, 0, 0.0, 0.0, 0]
        for (job_id,), events in pd.concat(list(rows)).sort_values(["ts", "event_id"]).groupby(["job_id"], sort=False):
            k = (job_id,)
            old = job = Job(*self.jobs.getValue(k)) if self.jobs.containsKey(k) else Job()
            for e in events.itertuples():
                last = e.ts.value / 1e9
                job = job.after(e.event, last, e.progress_pct, e.from_cache)
            counts = [c + x - y for c, x, y in zip(counts, self.weight(job), self.weight(old))]
            self.jobs.updateValue(k, tuple(job))
            if job.state == "running":
                self.running.updateValue(k, (job.heard,))
            elif old.state == "running":
                self.running.removeKey(k)
            if job.state in ("done", "failed", "cancelled"):
                self.ended.updateValue(k, (last,))
                self.handle.registerTimer(max(int((last + self.keep_s) * 1000), timerValues.getCurrentWatermarkInMs() + 1))
            elif old.state in ("done", "failed", "cancelled"):
                self.ended.removeKey(k)
        whole = [int(c) if i in (0, 1, 2, 3, 4, 7) else float(c) for i, c in enumerate(counts)]
        self.counts.update(tuple(whole))
        heard = max((v[0] for _, v in self.running.iterator() if v[0] is not None), default=None)
        yield pd.DataFrame([(*key, *whole, heard)], columns=["owner", "shard", *self.STATES, "part", "t", "nt", "heard"])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        before = timerValues.getCurrentWatermarkInMs() / 1000 - self.keep_s
        for k in [k for k, (at,) in self.ended.iterator() if at <= before]:
            self.ended.removeKey(k)
            self.jobs.removeKey(k)
        return iter(())

    def close(self) -> None:
        pass


def summary_stream(events: DataFrame, shards: int = 1, keep_ms: int = KEEP_MS, late: str = "7 days") -> DataFrame:
    """M3: counters of each owner's jobs after every batch (update mode), from which summary_of makes job_summary's rows.

    One row for each (owner, shard) that a batch touched: jobs in each state, the running ones' parts, seconds and
    number of timed jobs, and the newest heartbeat of a running one. An owner whose jobs are many is dealt over
    ``shards`` by job, so that no task holds them all. Events of a batch count in order of time; an event older than
    one applied before is applied where it arrives; one that is later than ``late`` is left out.
    """
    shard = F.pmod(F.xxhash64("job_id"), F.lit(shards)).cast("int")
    timed = events.withWatermark("ts", late).withColumn("shard", shard).where(F.col("job_id").isNotNull())
    out = "owner string, shard int, queued long, running long, done long, failed long, cancelled long, part double, t double, nt long, heard double"
    found = timed.groupBy("owner", "shard").transformWithStateInPandas(Summary(keep_ms / 1000), out, "update", "EventTime")
    return found.withColumn("heartbeat_at", F.timestamp_micros(F.round(F.col("heard") * 1e6).cast("bigint"))).drop("heard")


def summary_of(parts: DataFrame, now: Column) -> DataFrame:
    """M3: job_summary's rows from the newest counters of each (owner, shard)."""
    alive = F.coalesce(F.max(seconds(now) - seconds(F.col("heartbeat_at")) < ALIVE_S), F.lit(False)).alias("worker_alive")
    return summary_rows(parts.groupBy("owner").agg(*[F.sum(c).alias(c) for c in (*Summary.STATES, "part", "t", "nt")], alive))


def fold_stream(events: DataFrame, keep_ms: int = KEEP_MS, late: str = "7 days") -> DataFrame:
    """The row of each job after every batch of its events, as fold_job_state gives it (update mode).

    Events of a batch are applied in order of time; an event that is older than one applied before comes too late to
    be put in place and is applied where it arrives; one that is later than ``late`` is left out. The state of a job that has ended
    is dropped once the watermark is ``keep_ms`` past its last event: by event time, so that a run over what is there (availableNow) ends.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now, owner, pct, heard, started, elapsed, error, cached, n = state.get if state.exists else ("none", None, 0.0, None, None, None, "", False, 0)
        for e in pd.concat(list(batches)).sort_values(["ts", "event_id"]).itertuples():
            retry = e.event == "retry" and now in ("failed", "cancelled")
            owner = owner or e.owner
            if e.event in ("start", "heartbeat"):
                heard = e.ts.value / 1e9
            if e.event == "heartbeat" and not pd.isna(e.progress_pct):
                pct = min(max(float(e.progress_pct), 0.0), 100.0)
            if e.event in ("enqueue", "start"):
                pct, started = 0.0, (e.ts.value / 1e9 if e.event == "start" else started)
            elif e.event in ("finish", "fail"):
                elapsed = e.ts.value / 1e9 - started if started is not None else elapsed
                if e.event == "finish":
                    pct, cached = 100.0, bool(e.from_cache) if e.from_cache is not None else False
                else:
                    error = (e.error or "")[:2000]
            if retry:
                now, pct, heard, started, elapsed, error, cached = "queued", 0.0, None, None, None, "", False
            else:
                now = BECOMES.get(e.event, now)
            n += 1
            last = int(e.ts.value // 1_000_000)
        state.update((now, owner, pct, heard, started, elapsed, error, cached, n))
        if now in ("done", "failed", "cancelled"):
            state.setTimeoutTimestamp(max(last + keep_ms, state.getCurrentWatermarkMs() + 1))
        names = ["job_id", "owner", "state", "progress_pct", "heard", "elapsed_s", "error", "from_cache", "n_events"]
        yield pd.DataFrame([(key[0], owner, now, pct, heard, elapsed, error, cached, n)], columns=names)

    kept = "state string, owner string, progress_pct double, heard double, started double, elapsed_s double, error string, from_cache boolean, n_events int"
    out = events.withWatermark("ts", late).groupBy("job_id").applyInPandasWithState(step, JOB, kept, "update", GroupStateTimeout.EventTimeTimeout)
    heartbeat = F.timestamp_micros(F.round(F.col("heard") * 1e6).cast("bigint"))
    return out.select("job_id", "owner", "state", "progress_pct", heartbeat.alias("heartbeat_at"), "elapsed_s", "error", "from_cache", "n_events")


def stale_stream(events: DataFrame, after_ms: int = 900_000) -> DataFrame:
    """M4: jobs that run and give no sign for ``after_ms``, told once when the time is up. Processing time: run it with a processing-time trigger, as its batches never end."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (lost,) = state.get
            state.update((lost + 1,))
            yield pd.DataFrame({"job_id": [key[0]], "becomes": ["failed" if lost else "requeued"]})
            return
        last = pd.concat(list(batches)).sort_values(["ts", "event_id"])["event"].iloc[-1]
        if last in ("finish", "fail", "cancel"):  # nothing is lost any more, and a retry starts afresh
            state.remove()
            return
        state.update((state.get[0] if state.exists and last != "retry" else 0,))
        if last in ("start", "heartbeat"):
            state.setTimeoutDuration(after_ms)

    return events.groupBy("job_id").applyInPandasWithState(step, "job_id string, becomes string", "lost int", "append", GroupStateTimeout.ProcessingTimeTimeout)
