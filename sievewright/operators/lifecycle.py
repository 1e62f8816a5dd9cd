"""Absence inference: ordered states, two-step closure, circuit breakers, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Seconds between the first miss and a closure.
SEPARATION = 1_800


def lifecycle(scans: DataFrame, key: str, at: str, seen: str, separation: int = SEPARATION) -> DataFrame:
    """A row per scan of a listing, in order, with ``status`` and ``misses`` after it and the transition it made.

    Seen: active, a closed or missed listing is reopened. A first miss makes it possibly closed; a later miss at
    least ``separation`` seconds after the first closes it, earlier ones only count. Closed stays closed. Runs of
    misses are islands between sightings, so the fold is a window, not a loop. Listings begin when first seen.
    """
    own = W.partitionBy(key).orderBy(at)
    run = W.partitionBy(key, "_island").orderBy(at)
    out = scans.withColumn("_island", F.sum(F.col(seen).cast("int")).over(own)).where(F.col("_island") > 0)
    out = out.withColumn("_n", F.row_number().over(run) - 1)
    miss = F.when(~F.col(seen), F.unix_timestamp(at))
    out = out.withColumn("_since", F.unix_timestamp(at) - F.min(miss).over(run))
    closing = ~F.col(seen) & (F.col("_n") >= 2) & (F.col("_since") >= separation)
    out = out.withColumn("_closing", closing.cast("int")).withColumn("_closed", F.sum("_closing").over(run))
    status = F.when(F.col(seen), "active").when(F.col("_closed") > 0, "closed").otherwise("possibly_closed")
    # the counter stops at the scan that closes
    closed_at = F.min(F.when(F.col("_closing") == 1, F.col("_n"))).over(run)
    misses = F.when(F.col(seen), F.lit(0)).otherwise(F.least(F.col("_n"), F.coalesce(closed_at, F.col("_n"))))
    out = out.withColumn("status", status).withColumn("misses", misses.cast("int"))
    before = F.lag("status").over(own)
    moved = F.when(before.isNull(), "opened").when(before == F.col("status"), F.lit(None).cast("string")).when(F.col("status") == "active", "reopened").otherwise(F.col("status"))
    return out.withColumn("transition", moved).drop("_island", "_n", "_since", "_closing", "_closed")


def breaker(previous: Column, observed: Column, active: Column) -> Column:
    """Why a scan's absences are not believed: ``suspicious_empty``, ``count_collapse``, ``closure_spike`` or null."""
    base = F.greatest(F.coalesce(previous, F.lit(0)), active)
    missing = F.greatest(F.lit(0), active - observed)
    return (
        F.when((base >= 10) & (observed == 0), "suspicious_empty")
        .when((base >= 10) & (F.round((base - observed) / base, 4) >= 0.9), "count_collapse")
        .when((missing >= 50) & (active > 0) & (2 * missing >= active), "closure_spike")
    )


def escalated(trips: DataFrame, group: str, source: str, at: str, seconds: int = 900, least: int = 3) -> DataFrame:
    """Trips with the number of distinct sources of their group that tripped within ``seconds`` up to them, and whether the group trips.

    A source counts by its last trip in that time: its trip counts for the seconds until its next one, or until the time is over. So each source's trips are spans
    that do not meet, and a trip's number is that of the spans that hold it: spans begun up to it less spans ended before it. Both are running sums over the group's seconds, which are combined
    before they are summed, in blocks of time.
    """
    second = F.unix_timestamp(at).cast("long")
    rows = trips.withColumn("_s", second)
    own = W.partitionBy(group, source).orderBy("_s")
    spans = rows.select(group, source, "_s").distinct().withColumn("_next", F.lead("_s").over(own))
    over = F.least(F.col("_s") + seconds + 1, F.coalesce("_next", F.col("_s") + seconds + 1))
    steps = spans.select(group, F.explode(F.array(F.struct(F.col("_s").alias("t"), F.lit(1).alias("n")), F.struct(over.alias("t"), F.lit(-1).alias("n")))).alias("x")).groupBy(group, F.col("x.t").alias("_t")).agg(F.sum("x.n").alias("_n"))
    steps = steps.withColumn("_block", F.floor(F.col("_t") / 86_400))
    totals = steps.groupBy(group, "_block").agg(F.sum("_n").alias("_sum"))
    before = totals.select(F.col(group).alias("_g"), F.col("_block").alias("_b"), (F.sum("_sum").over(W.partitionBy(group).orderBy("_block")) - F.col("_sum")).alias("_before"))
    within = steps.withColumn("_run", F.sum("_n").over(W.partitionBy(group, "_block").orderBy("_t")))
    counted = within.join(before, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_block") == F.col("_b"))).select(F.col(group).alias("_g"), F.col("_t"), (F.col("_run") + F.col("_before")).cast("int").alias("sources"))
    out = rows.join(counted, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_s") == F.col("_t"))).drop("_s", "_g", "_t")
    return out.withColumn("escalates", F.col("sources") >= least)


def versions(log: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Observations with ``version`` (number of the value among the key's distinct values, by first sight), ``is_new`` and ``changed`` (against the one before)."""
    own = W.partitionBy(key).orderBy(*order)
    same = W.partitionBy(key, value).orderBy(*order)
    out = log.withColumn("is_new", F.row_number().over(same) == 1).withColumn("changed", ~F.lag(value).over(own).eqNullSafe(F.col(value)))
    out = out.withColumn("_nth", F.sum(F.col("is_new").cast("int")).over(own))
    return out.withColumn("version", F.first("_nth").over(same)).drop("_nth")


def source_health(scans: DataFrame, key: str, order: list[str], reason: str, observed: str, tripped: str) -> DataFrame:
    """A row per source after all its scans: ``health``, ``last_job_count``, ``last_complete_at``, ``last_nonempty_at`` and two counters.

    The latest scan decides the health: quarantined if its breaker tripped, healthy if complete, else blocked or degraded.
    ``consecutive_failures`` counts scans since the last complete one, ``complete_empty_scans`` complete scans that
    saw nothing since the last complete one that saw something. ``order`` is a time and what settles its ties. Both
    steps are aggregates, so a source with very many scans is combined before it is shuffled.
    """
    at, complete, seen = F.struct(*order), F.col(reason) == "complete", F.col(observed) > 0
    marks = scans.groupBy(F.col(key).alias("_key")).agg(F.max(F.when(complete, at)).alias("_good"), F.max(F.when(complete & seen, at)).alias("_full"))
    health = F.when(F.col(tripped), "quarantined").when(complete, "healthy").when(F.col(reason) == "blocked", "blocked").otherwise("degraded")
    return (
        scans.join(marks, F.col(key).eqNullSafe(F.col("_key")))
        .groupBy(key)
        .agg(
            F.max_by(health, at).alias("health"),
            F.max_by(observed, at).alias("last_job_count"),
            F.max(F.when(complete, F.col(order[0]))).alias("last_complete_at"),
            F.max(F.when(seen, F.col(order[0]))).alias("last_nonempty_at"),
            F.count_if(F.col("_good").isNull() | (at > F.col("_good"))).alias("consecutive_failures"),
            F.count_if(complete & ~seen & (F.col("_full").isNull() | (at > F.col("_full")))).alias("complete_empty_scans"),
        )
    )
