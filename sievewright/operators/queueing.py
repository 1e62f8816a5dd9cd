"""Queues and commands as event logs: claims, fencing, replays, limits, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def idempotent(commands: DataFrame, keys: list[str], order: list[str], digest: str) -> DataFrame:
    """Commands with their outcome: the first of a key is accepted; an equal one later is a replay, another is rejected."""
    own = W.partitionBy(*keys).orderBy(*order)
    first = F.first(digest).over(own)
    return commands.withColumn("outcome", F.when(F.row_number().over(own) == 1, "accepted").when(first.eqNullSafe(F.col(digest)), "replayed").otherwise("rejected"))


def fenced(events: DataFrame, key: str, order: list[str], generation: str, claim: str) -> DataFrame:
    """Events of leases with the generation in force, and whether each is current: claims raise it, other events must name it."""
    upto = W.partitionBy(key).orderBy(*order)
    now = F.max(F.when(F.col(claim), F.col(generation))).over(upto)
    return events.withColumn("in_force", now).withColumn("current", F.coalesce(F.col(generation) == F.col("in_force"), F.lit(False)))


def rate_limited(requests: DataFrame, key: str, at: str, order: list[str], limit: int, unit: str = "minute") -> DataFrame:
    """Requests with ``nth`` of their tumbling window and whether they are let through."""
    own = W.partitionBy(key, F.date_trunc(unit, at)).orderBy(*order)
    return requests.withColumn("nth", F.row_number().over(own)).withColumn("allowed", F.col("nth") <= limit)


def claim(jobs: DataFrame, as_of: str, limit: int) -> DataFrame:
    """The next jobs due, oldest first, then by priority, with attempt and generation raised."""
    due = jobs.where((F.col("status") == "ready") & (F.col("scheduled_at") <= F.lit(as_of).cast("timestamp")))
    return due.orderBy("scheduled_at", F.col("priority").desc(), "id").limit(limit).withColumn("attempt", F.col("attempt") + 1).withColumn("generation", F.col("generation") + 1).withColumn("status", F.lit("leased"))


def retention_claim(artifacts: DataFrame, as_of: str, limit: int, stale: str = "15 minutes") -> DataFrame:
    """The next artifacts to delete, longest due first: present ones, failed ones, and those whose deletion began too long ago."""
    now = F.lit(as_of).cast("timestamp")
    stuck = (F.col("state") == "deleting") & (F.col("deletion_started_at") < now - F.expr(f"interval {stale}"))
    due = artifacts.where((F.col("deletion_due_at") <= now) & (F.col("state").isin("present", "delete_failed") | stuck))
    return due.orderBy("deletion_due_at", "created_at", "id").limit(limit).withColumn("state", F.lit("deleting")).withColumn("deletion_started_at", now)


def pending_upsert(requests: DataFrame, key: str, priority: str, order: list[str], payload: str) -> DataFrame:
    """One pending request for a key: the greatest priority asked for, and what was first asked."""
    return requests.groupBy(key).agg(F.max(priority).alias("priority"), F.min_by(payload, F.struct(*order)).alias("payload"), F.count("*").alias("requests"))


def reconcile(catalog: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Keys of one side only: ``missing`` from the store, or ``orphan`` there."""
    missing = catalog.select(key).distinct().join(store, key, "left_anti").withColumn("state", F.lit("missing"))
    orphan = store.select(key).distinct().join(catalog, key, "left_anti").withColumn("state", F.lit("orphan"))
    return missing.union(orphan)


def lease_events(events: DataFrame, key: str, order: list[str], at: str, kind: str, generation: str, seconds: int = 300) -> DataFrame:
    """Events of leases (``claim``, ``heartbeat``, ``succeed``, ``fail``) with ``outcome`` and ``expires_at`` after those accepted.

    A claim opens a lease of ``seconds``, an accepted heartbeat renews it. An event is ``stale`` unless it names the
    generation of the latest claim, comes before the lease ends, and follows no accepted end of it. A lease that ran
    out is never revived, so the fold is a window: no gap between a lease's own events may reach its length.
    """
    own = W.partitionBy(key).orderBy(*order)
    lease = W.partitionBy(key, "_lease").orderBy(*order)
    run = W.partitionBy(key, "_lease", "_named").orderBy(*order)
    out = events.withColumn("_lease", F.sum((F.col(kind) == "claim").cast("int")).over(own))
    out = out.withColumn("_named", (F.col("_lease") > 0) & F.first(generation).over(lease).eqNullSafe(F.col(generation)))
    micros = F.unix_micros(at)
    out = out.withColumn("_late", F.coalesce(micros - F.lag(micros).over(run) >= seconds * 1_000_000, F.lit(False)))
    ended = F.max(F.col(kind).isin("succeed", "fail")).over(run.rowsBetween(W.unboundedPreceding, -1))
    accepted = F.col("_named") & ~F.max("_late").over(run) & ~F.coalesce(ended, F.lit(False))
    out = out.withColumn("outcome", F.when(accepted, "accepted").otherwise("stale"))
    until = F.when(accepted & F.col(kind).isin("claim", "heartbeat"), F.col(at) + F.make_interval(secs=F.lit(seconds)))
    return out.withColumn("expires_at", until).drop("_lease", "_named", "_late")
