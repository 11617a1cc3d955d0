"""M1 and M3 as streams: after every batch they have what the batch forms give on all rows so far."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import telemetry
from plumbline.streaming import jobs

START = datetime.datetime(2025, 1, 1)
NOW = "2025-01-01 01:00:00"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def batches_of(spark, path, batches):
    """One file a batch, read one a trigger in this order."""
    for k, rows in enumerate(batches):
        one = f"{path}-{k}"
        spark.createDataFrame(rows, jobs.EVENTS).coalesce(1).write.parquet(one)
        os.makedirs(path, exist_ok=True)
        part = next(f for f in os.listdir(one) if f.startswith("part-"))
        os.rename(f"{one}/{part}", f"{path}/{k:03}.parquet")
        os.utime(f"{path}/{k:03}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(jobs.EVENTS).option("maxFilesPerTrigger", 1).parquet(path)


def run(df, mode, each, checkpoint):
    q = df.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    assert q.awaitTermination(300) and q.exception() is None


def event(n, job, kind, owner="u0", path="/a", page=0, pct=None, cached=None):
    return (n, START + datetime.timedelta(seconds=7 * n), job, owner, path, page, kind, pct, cached, None)


def lives(n, seed):
    """Jobs of a few owners that are queued, run, end and are retried, most of them of one owner."""
    rng = random.Random(seed)
    nexts = {"none": ["enqueue"], "queued": ["start", "start", "cancel"], "running": ["heartbeat", "heartbeat", "finish", "fail", "cancel"], "done": ["enqueue", "retry"], "failed": ["retry"], "cancelled": ["retry", "start"]}
    state = {f"j{k}": "none" for k in range(25)}
    out = []
    for i in range(n):
        job = rng.choice(sorted(state))
        kind = rng.choice(nexts[state[job]])
        out.append(event(i, job, kind, "u0" if int(job[1:]) % 4 else "u1", pct=rng.choice([-5.0, 40.0, 250.0, None]), cached=rng.choice([True, False, None])))
        state[job] = "queued" if kind == "retry" and state[job] in ("failed", "cancelled") else telemetry.BECOMES.get(kind, state[job])
    return out


@pytest.mark.parametrize("shards", [1, 3])
def test_summary_after_every_batch(rocks, tmp_path, shards):
    rows = lives(240, shards)
    batches = [rows[a : a + 60] for a in range(0, 240, 60)]
    newest, seen = {}, []

    def each(batch, number):
        for r in batch.collect():
            newest[r.owner, r.shard] = r
        seen.append(number)
        parts = rocks.createDataFrame(list(newest.values()), batch.schema)
        so_far = rocks.createDataFrame([r for b in batches[: len(seen)] for r in b], jobs.EVENTS)
        owners = so_far.groupBy("job_id").agg(F.min("owner").alias("owner"))
        want = telemetry.job_summary(telemetry.fold_job_state(so_far).join(owners, "job_id"), F.lit(NOW).cast("timestamp"))
        assert sorted(map(str, jobs.summary_of(parts, F.lit(NOW).cast("timestamp")).collect())) == sorted(map(str, want.collect()))

    run(jobs.summary_stream(batches_of(rocks, str(tmp_path / "in"), batches), shards), "update", each, tmp_path / "cp")
    assert len(seen) >= len(batches)


def test_a_drawing_is_admitted_while_none_of_its_jobs_is_live(rocks, tmp_path):
    requests = [
        [event(1, "a1", "?"), event(2, "a2", "?"), event(2, "b1", "?", path="/b"), event(3, "c1", "?", owner="u1"), event(3, "d1", "?", page=1)],
        [event(12, "a3", "?")],
        [event(22, "a4", "?"), event(22, "b2", "?", path="/b")],
        [event(40, "a5", "?"), event(44, "a6", "?")],
    ]
    events = [
        [event(4, "a1", "start")],
        [event(11, "a1", "heartbeat"), event(13, "b1", "fail", path="/b"), event(14, "b1", "retry", path="/b")],
        [event(21, "a1", "finish")],
        [event(41, "a4", "start"), event(42, "a4", "cancel"), event(43, "a1", "retry"), event(45, "z", None)],
    ]
    got = []
    asked, told = batches_of(rocks, str(tmp_path / "req"), requests), batches_of(rocks, str(tmp_path / "ev"), events)
    run(jobs.admit_stream(asked, told), "append", lambda batch, n: got.append(sorted(r.job_id for r in batch.collect())), tmp_path / "cp")
    # a2 repeats a1; a3 comes while a1 runs; a4 once it has finished; b1 is retried, so b2 waits; a6 waits for the retried a1
    assert [x for x in got if x] == [["a1", "b1", "c1", "d1"], ["a4"]]
