"""The scan fold and the ledger against a version that takes scans one by one; refusals, replays, streams, conflicts."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from scan_cases import COLUMNS, OneByOne, invented
from sievewright.operators import scans
from sievewright.sources.ledger import ScanLedger
from sievewright.storage import CommitConflict, TableSet, shared_folder

T0 = datetime(2024, 1, 1)


def frames(spark, deliveries, observations):
    return spark.createDataFrame(deliveries, scans.SCANS), spark.createDataFrame(observations, scans.OBSERVATIONS)


def same(tables, want):
    for name, columns in COLUMNS.items():
        assert sorted((tuple(r) for r in tables[name].select(*columns).collect()), key=repr) == sorted(want[name], key=repr), name


def folded(deliveries, observations):
    return scans.fold(scans.judged(scans.delivered(deliveries, observations)).where("outcome = 'accepted'").drop("outcome"), observations)


@pytest.mark.parametrize("seed,burst,listings", [(1, 0, 40), (3, 0, 120), (2, 2, 40)])
def test_fold_is_step_by_step(spark, seed, burst, listings):
    cases = invented(random.Random(seed), burst=burst, listings=listings, scans=14)
    want = OneByOne().run(*cases).tables()
    assert any(s[-1] for s in want["scans"]) and (not burst or any(s[-1] for s in want["sources"]))
    same(folded(*frames(spark, *cases)), want)


def test_ledger_commits_and_replays(spark):
    deliveries, observations = invented(random.Random(6), burst=1, sources=7, scans=9)
    deliveries.sort(key=lambda r: (r[6], r[0]))
    ledger = ScanLedger(spark, shared_folder(spark))
    seen = spark.createDataFrame(observations, scans.OBSERVATIONS)
    for k in range(0, len(deliveries), 21):
        part = deliveries[max(0, k - 2) : k + 21]  # two are delivered again
        told = ledger.commit(spark.createDataFrame(part, scans.SCANS), seen)
        assert {r.outcome: r["count"] for r in told.groupBy("outcome").count().collect()} == ({"accepted": 21, "replayed": 2} if k else {"accepted": 21})
    same({name: ledger.table(name) for name in COLUMNS}, OneByOne().run(deliveries, observations).tables())
    before = ledger.tables.version()
    told = ledger.commit(spark.createDataFrame(deliveries[:5], scans.SCANS), seen)  # a batch that is run again
    assert {r.outcome for r in told.collect()} == {"replayed"} and ledger.tables.version() == before
    changed = [(*d[:9], d[9] + 1, *d[10:]) for d in deliveries[:5]]
    assert {r.outcome for r in ledger.commit(spark.createDataFrame(changed, scans.SCANS), seen).collect()} == {"scan_replay_mismatch"}
    assert ledger.table("assertions").count() == ledger.table("versions").count()


def test_stream_equals_batch(spark):
    deliveries, observations = invented(random.Random(11), sources=3, scans=6)
    rows, seen = frames(spark, deliveries, observations)
    held = seen.groupBy("scan_id").agg(F.collect_list(F.struct("listing", "fingerprint", "artifact", "assertions")).alias("seen"))
    root = shared_folder(spark)
    rows.join(held, "scan_id", "left").withColumn("part", F.to_date("ended_at")).repartition(1).sortWithinPartitions("ended_at").write.option("maxRecordsPerFile", 6).parquet(f"{root}/in")
    files = spark.read.parquet(f"{root}/in")
    stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in").drop("part")
    ledger = ScanLedger(spark, f"{root}/ledger")
    ledger.stream(stream, "seen", f"{root}/checkpoint").awaitTermination()
    assert ledger.tables.version() == 3
    same({name: ledger.table(name) for name in COLUMNS}, OneByOne().run(deliveries, observations).tables())


def delivery(scan="s", source="a", connector="c", job="j", generation=1, at=0, reason="complete", failed=False, size=1, artifacts=("x",)):
    ended = T0 + timedelta(minutes=at)
    return (scan, source, connector, job, generation, ended - timedelta(minutes=1), ended, reason, failed, size, list(artifacts) if artifacts is not None else None, None)


def test_refusals(spark):
    cases = [
        (delivery("time", job="j1")[:5] + (T0, T0 - timedelta(seconds=1)) + delivery()[7:], "invalid_scan_time_order"),
        (delivery("bytes", job="j2", size=-1), "invalid_byte_count"),
        (delivery("none", job="j3", artifacts=()), "invalid_response_artifacts"),
        (delivery("many", job="j4", artifacts=map(str, range(101))), "invalid_response_artifacts"),
        (delivery("null", job="j5", artifacts=None), "invalid_response_artifacts"),
        (delivery("twice", job="j6"), "invalid_observations"),
        (delivery("unnamed", job="j7"), "invalid_observations"),
        (delivery("outside", job="j8"), "observation_artifact_outside_response"),
        (delivery("expired", job="j9"), "stale_lease"),
        (delivery("nolease", job="j10"), "stale_lease"),
        (delivery("lost", job="j11", source="b"), "source_not_found"),
        (delivery("other", job="j12", connector="d"), "source_snapshot_mismatch"),
        (delivery("failed", job="j13", failed=True, reason="blocked", artifacts=()), "accepted"),
        (delivery("good", job="j14"), "accepted"),
        (delivery("good2", job="j14", at=5), "scan_replay_mismatch"),
    ]
    observations = [("twice", "l", "v", "x", []), ("twice", "l", "w", "x", []), ("unnamed", "l", None, "x", []), ("outside", "l", "v", "y", []), ("good", "l", "v", "x", [])]
    rows, seen = frames(spark, [c for c, _ in cases], observations)
    leases = spark.createDataFrame([(f"j{k}", 1, T0 + timedelta(hours=1 if k != 9 else -1)) for k in range(1, 15) if k != 10], "job string, generation long, expires_at timestamp")
    known = spark.createDataFrame([("a", "c")], "source string, connector string")
    got = {r.scan_id: r.outcome for r in scans.judged(scans.delivered(rows, seen), None, leases, known).collect()}
    assert got == {c[0]: why for c, why in cases}


def test_late_scans_and_cleared_breakers(spark):
    ledger = ScanLedger(spark, shared_folder(spark))
    seen = [("s0", f"l{k}", "v", "x", []) for k in range(20)] + [("s3", "l0", "v", "x", [])]
    commit = lambda *rows: [r.outcome for r in ledger.commit(*frames(spark, rows, seen)).orderBy("scan_id").collect()]
    assert commit(delivery("s0", job="j0"), delivery("s1", job="j1", at=40)) == ["accepted", "accepted"]  # an empty board trips
    assert commit(delivery("late", job="j2", at=-5)) == ["late_scan"]
    (source,) = ledger.table("sources").collect()
    assert (source.health, source.trip_reason, source.open_listings) == ("quarantined", "suspicious_empty", 20)
    ledger.clear(F.col("source") == "a")
    assert ledger.table("sources").first().health == "degraded"
    assert commit(delivery("s3", job="j3", at=80)) == ["accepted"]
    assert {r.scan_id: (r.missing, r.tripped) for r in ledger.table("scans").collect()} == {"s0": (0, None), "s1": (0, "suspicious_empty"), "s3": (0, "count_collapse")}


def test_nothing_delivered(spark):
    rows, seen = frames(spark, [], [])
    assert all(df.count() == 0 for df in folded(rows, seen).values())
    ledger = ScanLedger(spark, shared_folder(spark))
    assert ledger.commit(rows, seen).count() == 0 and ledger.tables.version() == 0


def test_commits_do_not_overtake(spark):
    tables = TableSet(spark, shared_folder(spark))
    first = tables.manifest()
    one, two = spark.range(2), spark.range(3)
    tables.commit(first, {"t": one}, {})
    with pytest.raises(CommitConflict):
        tables.commit(first, {"t": two}, {})
    assert tables.read(tables.manifest(), "t").count() == 2 and tables.read(tables.manifest(0), "t") is None
    later = tables.commit(tables.manifest(), {"t": two}, {"u": one})
    assert (tables.read(later, "t").count(), tables.read(later, "u").count(), tables.read(tables.manifest(1), "t").count()) == (5, 2, 2)


def test_retries_and_opportunities(spark):
    jobs = spark.createDataFrame([(1, True, 1, 3, T0), (2, True, 3, 3, T0), (3, False, 1, 3, T0)], "id int, retryable boolean, attempt int, max_attempts int, ended_at timestamp")
    got = {r.id: (r.status, r.scheduled_at) for r in scans.retried(jobs, F.lit(0.5)).collect()}
    assert got == {1: ("retryable_failed", T0 + timedelta(seconds=2.5)), 2: ("terminal_failed", T0), 3: ("terminal_failed", T0)}
    log = [("a", 1, "opened", 0), ("b", 1, "opened", 5), ("a", 2, "possibly_closed", 10), ("b", 2, "possibly_closed", 20), ("b", 3, "closed", 30), ("a", 3, "closed", 30), ("a", 4, "reopened", 40)]
    events = spark.createDataFrame([("s", x, n, e, T0 + timedelta(minutes=m), f"scan{m:02d}") for x, n, e, m in log], "source string, listing string, sequence long, event string, at timestamp, scan_id string")
    members = spark.createDataFrame([("o", "s", "a"), ("o", "s", "b")], "opportunity string, source string, listing string")
    got = [(r.scan_id, r.status, r.event) for r in scans.opportunity_events(members, events).orderBy("at").collect()]
    assert got == [("scan00", "active", "opened"), ("scan20", "possibly_closed", "possibly_closed"), ("scan30", "closed", "closed"), ("scan40", "active", "reopened")]
    later = scans.opportunity_events(members, events.where("sequence > 2"), spark.createDataFrame([("o", 0, 2)], "opportunity string, active int, possibly int"))
    assert [(r.scan_id, r.event) for r in later.orderBy("at").collect()] == [("scan30", "closed"), ("scan40", "reopened")]
