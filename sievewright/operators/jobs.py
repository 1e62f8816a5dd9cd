"""Jobs and their leases as a log of events: enqueue once, claim, renew, finish, cancel, and leases that run out by themselves."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds of a lease, attempts of a job, sources scheduled at once.
LEASE, ATTEMPTS, MOST_DUE = 300, 5, 500
PENDING = ("queued", "leased", "retryable_failed")
EVENTS = "job string, at timestamp, seq long, kind string, generation long, retryable boolean"
OUT = "job string, at timestamp, seq long, kind string, outcome string, status string, generation long, attempt long"


@dataclass(frozen=True)
class Job:
    """What is known of a job that is not finished; times are microseconds."""

    status: str
    scheduled: int
    generation: int = 0
    attempt: int = 0
    expires: int | None = None


def _delay(job: str, attempt: int) -> int:
    """Microseconds until the next attempt: doubling from five seconds, an hour at most, times a share fixed by job and attempt."""
    share = min(0.999999, int(hashlib.sha256(f"{job}:{attempt}".encode()).hexdigest()[:8], 16) / 0xFFFFFFFF)
    return int(min(3_600_000, 5_000 * 2 ** min(attempt - 1, 30)) * share) * 1_000


def _failed(key: str, job: Job, at: int, retryable: bool, attempts: int) -> tuple[Job | None, str, Job]:
    """State, status and last view of a job whose attempt came to nothing."""
    if retryable and job.attempt < attempts:
        job = replace(job, status="retryable_failed", scheduled=at + _delay(key, job.attempt), expires=None)
        return job, job.status, job
    return None, "terminal_failed", job


def step(key: str, job: Job | None, at: int, kind: str, generation: int | None, retryable: bool, lease: int, attempts: int) -> tuple[Job | None, str, str | None, Job | None]:
    """One event on a job -> the job afterwards (None: finished or unknown), outcome, status, and the view of it that is told."""
    held = job is not None and job.status == "leased" and job.expires > at and generation == job.generation
    if kind == "enqueue":
        if job is not None:
            return job, "duplicate", job.status, job
        job = Job("queued", at)
        return job, "accepted", job.status, job
    if job is None:
        return None, {"claim": "not_claimable", "cancel": "job_not_cancellable"}.get(kind, "stale_lease"), None, None
    if kind == "claim":
        if job.status not in ("queued", "retryable_failed") or job.scheduled > at:
            return job, "not_claimable", job.status, job
        job = replace(job, status="leased", generation=job.generation + 1, attempt=job.attempt + 1, expires=at + lease)
        return job, "accepted", job.status, job
    if kind == "cancel":
        return None, "accepted", "cancelled", job
    if not held:
        return job, "stale_lease", job.status, job
    if kind == "heartbeat":
        job = replace(job, expires=at + lease)
        return job, "accepted", job.status, job
    if kind == "succeed":
        return None, "accepted", "succeeded", job
    after, status, seen = _failed(key, job, at, retryable, attempts)
    return after, "accepted", status, seen


def expired(key: str, job: Job | None, now: int, attempts: int) -> tuple[Job | None, tuple | None]:
    """The job once its lease has run out by ``now``, and the row that tells so; unchanged if it has not."""
    if job is None or job.status != "leased" or job.expires > now:
        return job, None
    after, status, seen = _failed(key, job, job.expires, True, attempts)
    return after, (key, job.expires, None, "expire", "lease_expired", status, seen.generation, seen.attempt)


def taken(key: str, job: Job | None, rows: Iterator[tuple], lease: int, attempts: int) -> tuple[Job | None, list[tuple]]:
    """Events ``at, seq, kind, generation, retryable`` in order -> the job afterwards, and a row for each of them and for each lease that ran out before one."""
    out = []
    for at, seq, kind, generation, retryable in rows:
        job, gone = expired(key, job, at, attempts)
        if gone:
            out.append(gone)
        job, outcome, status, seen = step(key, job, at, kind, generation, retryable is not False, lease, attempts)
        out.append((key, at, seq, kind, outcome, status, seen and seen.generation, seen and seen.attempt))
    return job, out


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 8
    kinds = [pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in OUT.split(", ")])


def lease_log(events: DataFrame, lease: int = LEASE, attempts: int = ATTEMPTS) -> DataFrame:
    """``events(job, at, seq, kind, generation, retryable)`` -> each with its outcome, and a row ``expire`` for each lease that ran out by the log's last event.

    Kinds: ``enqueue`` (``duplicate`` while the job is pending), ``claim`` (``not_claimable`` unless it is queued or due again), ``heartbeat``, ``succeed`` and ``fail``
    (``stale_lease`` unless they name the generation of a lease in force), ``cancel`` (``job_not_cancellable`` unless it is pending). A failed or expired attempt is
    put off by a doubling delay while attempts are left. A finished job may be enqueued anew.

    Whether a claim counts depends on all that came before, so events are folded in order. Spark deals them by job and sorts; a task streams through them and
    holds one job's state, whatever the number of its events. Rows without job, time or kind are left out.
    """
    last = events.agg(F.unix_micros(F.max("at"))).first()[0] or 0  # one number

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, job = None, None
        for batch in batches:
            out = []
            for own, *event in zip(*(batch.column(c).to_pylist() for c in ("job", "us", "seq", "kind", "generation", "retryable"))):
                if own != key:
                    gone = expired(key, job, last, attempts)[1]
                    out += [gone] if gone else []
                    key, job = own, None
                job, rows = taken(key, job, [event], lease * 1_000_000, attempts)
                out += rows
            yield as_batch(out)
        gone = expired(key, job, last, attempts)[1]
        yield as_batch([gone] if gone else [])

    rows = events.where("job is not null and at is not null and kind is not null").select("job", F.unix_micros("at").alias("us"), "seq", "kind", "generation", "retryable")
    return rows.repartition("job").sortWithinPartitions("job", "us", "seq").mapInArrow(fold, OUT)


def schedule_due(sources: DataFrame, policies: DataFrame, evidence: DataFrame, pending: DataFrame, as_of: Column, most: int = MOST_DUE) -> DataFrame:
    """The sources to be scanned next: ``source, dedupe_key, enqueued, next_scan_at``, the longest due first.

    ``sources(source, enabled, cadence, next_scan_at, review_due_at, policy)`` are due if enabled, reviewed, of an approved policy that has not expired
    (``policies(policy, state, expires_at)``) and with ownership evidence of 0.9 or more (``evidence(source, confidence)``). A job is enqueued once for a source and cadence bucket while one is
    pending (``pending(dedupe_key)``); the next scan moves on by the cadence and a jitter fixed by source and bucket, whether it was enqueued or not.
    """
    good = policies.where((F.col("state") == "approved") & (F.col("expires_at") > as_of)).select("policy")
    owned = evidence.where("confidence >= 0.9").select("source")
    due = sources.where(F.col("enabled") & (F.col("next_scan_at") <= as_of) & (F.col("review_due_at") > as_of))
    due = due.join(good, "policy", "left_semi").join(owned, "source", "left_semi").orderBy("next_scan_at", "source").limit(most)
    bucket = F.floor(F.unix_timestamp(as_of.cast("timestamp")) / F.col("cadence")).cast("long")
    due = due.withColumn("bucket", bucket).withColumn("dedupe_key", F.concat_ws(":", F.lit("scan_source"), F.col("source").cast("string"), F.col("bucket").cast("string")))
    due = due.join(pending.select("dedupe_key", F.lit(True).alias("_there")).distinct(), "dedupe_key", "left")
    head = F.conv(F.substring(F.sha2(F.concat_ws(":", F.col("source").cast("string"), F.col("bucket").cast("string")), 256), 1, 8), 16, 10).cast("long")
    wait = F.floor(F.col("cadence").cast("double") * 100 * head / F.lit(0xFFFFFFFF)).cast("long") + F.col("cadence") * 1000
    moved = F.timestamp_millis(F.unix_millis(as_of.cast("timestamp")) + wait)
    return due.select("source", "dedupe_key", F.col("_there").isNull().alias("enqueued"), moved.alias("next_scan_at"))
