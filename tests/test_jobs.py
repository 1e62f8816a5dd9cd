"""Jobs and leases: golden logs, the stream against the batch, timers, and what state is left."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sievewright.operators import jobs
from sievewright.storage import shared_folder
from sievewright.streaming import leases

T0 = datetime(2024, 1, 1)


def log(spark, rows):
    return spark.createDataFrame([(j, T0 + timedelta(seconds=s) if s is not None else None, n, k, g, r) for n, (j, s, k, g, r) in enumerate(rows)], jobs.EVENTS)


def outcomes(df):
    return [(r.kind, r.outcome, r.status, r.generation, r.attempt) for r in df.orderBy("at", F.coalesce("seq", F.lit(-1))).collect()]


def test_claim_expire_reclaim_fail_reclaim_succeed(spark):
    rows = [("j", 0, "enqueue", None, None), ("j", 1, "enqueue", None, None), ("j", 2, "claim", None, None), ("j", 3, "claim", None, None), ("j", 100, "heartbeat", 1, None), ("j", 101, "heartbeat", 2, None)]
    rows += [("j", 500, "succeed", 1, None), ("j", 600, "claim", None, None), ("j", 700, "fail", 2, True), ("j", 701, "succeed", 2, None), ("j", 4000, "claim", None, None), ("j", 4100, "succeed", 3, None), ("j", 4101, "heartbeat", 3, None)]
    rows += [("j", 4200, "enqueue", None, None), ("j", 4300, "cancel", None, None), ("j", 4301, "cancel", None, None)]
    assert outcomes(jobs.lease_log(log(spark, rows))) == [
        ("enqueue", "accepted", "queued", 0, 0),
        ("enqueue", "duplicate", "queued", 0, 0),
        ("claim", "accepted", "leased", 1, 1),
        ("claim", "not_claimable", "leased", 1, 1),
        ("heartbeat", "accepted", "leased", 1, 1),
        ("heartbeat", "stale_lease", "leased", 1, 1),
        ("expire", "lease_expired", "retryable_failed", 1, 1),
        ("succeed", "stale_lease", "retryable_failed", 1, 1),
        ("claim", "accepted", "leased", 2, 2),
        ("fail", "accepted", "retryable_failed", 2, 2),
        ("succeed", "stale_lease", "retryable_failed", 2, 2),
        ("claim", "accepted", "leased", 3, 3),
        ("succeed", "accepted", "succeeded", 3, 3),
        ("heartbeat", "stale_lease", None, None, None),
        ("enqueue", "accepted", "queued", 0, 0),
        ("cancel", "accepted", "cancelled", 0, 0),
        ("cancel", "job_not_cancellable", None, None, None),
    ]


def test_attempt_budget(spark):
    rows = [("j", 0, "enqueue", None, None), ("j", 1, "claim", None, None), ("k", 0, "enqueue", None, None), ("k", 1, "claim", None, None), ("k", 2, "fail", 1, False), ("z", 1000, "heartbeat", 1, None)]
    got = {(r.job, r.kind): (r.outcome, r.status) for r in jobs.lease_log(log(spark, rows), attempts=1).collect()}
    assert got["j", "expire"] == ("lease_expired", "terminal_failed") and got["k", "fail"] == ("accepted", "terminal_failed") and got["z", "heartbeat"] == ("stale_lease", None)


def test_odd_rows(spark):
    rows = [(None, 0, "enqueue", None, None), ("j", None, "enqueue", None, None), ("j", 1, None, None, None), ("j", 1, "enqueue", None, None), ("j", 2, "claim", None, None), ("j", 3, "heartbeat", None, None), ("j", 4, "unheard of", 9, None)]
    assert [o for _, o, *_ in outcomes(jobs.lease_log(log(spark, rows)))] == ["accepted", "accepted", "stale_lease", "stale_lease"]
    assert jobs.lease_log(log(spark, [])).collect() == []


def test_stream_equals_batch_and_forgets(spark):
    rng, rows, now = random.Random(1), [], 0
    for _ in range(400):
        now += rng.choice([1, 5, 60, 200, 400])
        job = f"j{rng.randrange(3)}"
        rows.append((job, now, rng.choice(["enqueue", "claim", "heartbeat", "heartbeat", "succeed", "fail", "cancel" if rng.random() < 0.2 else "claim"]), rng.choice([1, 1, 1, 2, 2, 3]), rng.choice([True, True, False, None])))
    events, root = log(spark, rows), shared_folder(spark)
    batch = sorted((tuple(r) for r in jobs.lease_log(events, 900).collect()), key=repr)
    assert {"expire", "succeed"} <= {r[3] for r in batch if r[4] in ("accepted", "lease_expired")}
    events.repartition(1).sortWithinPartitions("at").write.option("maxRecordsPerFile", 90).parquet(f"{root}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    query = leases.lease_stream(stream, 900).writeStream.option("checkpointLocation", f"{root}/state").option("path", f"{root}/out").format("parquet").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((tuple(r) for r in spark.read.parquet(f"{root}/out").collect()), key=repr) == batch
    last = {}
    for r in sorted(batch, key=lambda r: (r[1], r[2] is not None, r[2] or 0)):
        last[r[0]] = r[5]
    state = spark.read.format("statestore").option("stateVarName", "job").load(f"{root}/state")
    assert {r.key.job for r in state.collect()} == {j for j, status in last.items() if status in jobs.PENDING}


def test_schedule_due(spark):
    as_of = F.lit("2024-01-02 00:00:00").cast("timestamp")
    at = lambda day: datetime(2024, 1, day)
    sources = [("a", True, 86_400, at(1), at(9), "p"), ("b", False, 86_400, at(1), at(9), "p"), ("c", True, 86_400, at(3), at(9), "p"), ("d", True, 86_400, at(1), at(2), "p"), ("e", True, 86_400, at(1), at(9), "q"), ("f", True, 86_400, at(1), at(9), "r"), ("g", True, 86_400, at(1), at(9), "p"), ("h", True, 3_600, at(2), at(9), "p"), ("i", True, 86_400, None, at(9), "p")]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    args = [frame(sources, "source string, enabled boolean, cadence long, next_scan_at timestamp, review_due_at timestamp, policy string"), frame([("p", "approved", at(9)), ("q", "draft", at(9)), ("r", "approved", at(2))], "policy string, state string, expires_at timestamp")]
    args += [frame([(s, 0.9) for s in "abcdefhi"] + [("g", 0.89), ("a", 1.0)], "source string, confidence double"), frame([(f"scan_source:a:{19724}",)] * 2, "dedupe_key string")]
    got = {r.source: r for r in jobs.schedule_due(*args, as_of).collect()}
    assert set(got) == {"a", "h"} and got["a"].enqueued is False and got["h"].enqueued is True and got["h"].dedupe_key == f"scan_source:h:{19724 * 24}"
    assert timedelta(days=1) <= got["a"].next_scan_at - at(2) <= timedelta(days=1.1)
    assert [r.source for r in jobs.schedule_due(*args, as_of, 1).collect()] == ["a"]
