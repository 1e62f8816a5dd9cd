"""Scan commits: one fold of deliveries into scans, listings, versions, observations, assertions, events and roll-ups.

Whether a scan's absences count depends on breakers, which depend on how many listings are open, which depends on earlier absences.
The fold needs no loop all the same: until a source's first trip every complete scan counts, and after it none does, so one
pass finds the trips and a second one applies them. A listing's state after a scan follows from its last sighting and from
the scans since, so absences are never written out as listings times scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievewright.functions.digests import backoff
from sievewright.operators.lifecycle import SEPARATION, breaker
from sievewright.storage import written

#: Seconds and distinct sources by which trips of one connector quarantine it whole; seconds until a source with missing listings is scanned again.
ESCALATION, TRIPS, RESCAN = 900, 3, 1_800
#: Bounds of a delivery.
MOST_ARTIFACTS, MOST_OBSERVATIONS = 100, 100_000

SCANS = "scan_id string, source string, connector string, job string, generation long, started_at timestamp, ended_at timestamp, reason string, failed boolean, bytes long, artifacts array<string>, board_hash string"
OBSERVATIONS = "scan_id string, listing string, fingerprint string, artifact string, assertions array<struct<path: string, value: string, origin: string, confidence: double>>"


def delivered(scans: DataFrame, observations: DataFrame) -> DataFrame:
    """Scans with what their observations say: ``observed``, ``listings``, ``outside`` (an artifact that the response lacks), and ``delivery``.

    ``delivery`` is a hash of the scan's fields and the sums of its observations' hashes, so it does not hang on their order and no scan is gathered in one row.
    """
    told = F.sha2(F.to_json(F.struct("listing", "fingerprint", "artifact", "assertions"), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring("_told", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(8)]
    held = observations.join(scans.select("scan_id", F.col("artifacts").alias("_artifacts")), "scan_id").withColumn("_told", told)
    outside = ~F.coalesce(F.array_contains("_artifacts", F.col("artifact")), F.lit(False))
    held = held.groupBy("scan_id").agg(F.count("*").alias("observed"), F.count_distinct(F.when(F.col("fingerprint").isNotNull(), F.col("listing"))).alias("listings"), F.bool_or(outside).alias("outside"), F.concat_ws("|", *parts).alias("_sums"))
    out = scans.join(held, "scan_id", "left").withColumns({"observed": F.coalesce("observed", F.lit(0)).cast("long"), "listings": F.coalesce("listings", F.lit(0)), "outside": F.coalesce("outside", F.lit(False))})
    fields = F.to_json(F.struct(*[c for c in scans.columns if c != "scan_id"], "_sums"), {"ignoreNullFields": "false"})
    return out.withColumn("delivery", F.sha2(fields, 256)).drop("_sums")


def judged(deliveries: DataFrame, ledger: DataFrame | None = None, leases: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """Deliveries with ``outcome``: ``accepted``, ``replayed`` (seen before, unchanged), or why they are refused.

    ``ledger(job, generation, delivery, source, ended_at)`` holds committed scans, ``leases(job, generation, expires_at)`` the leases in force and
    ``known(source, connector)`` the sources; without the last two no lease and no source is checked. Of deliveries for one lease in a batch the first counts.
    A scan that ended before the source's last committed one is ``late_scan``: the ledger runs forward.
    """
    out = deliveries
    own = W.partitionBy("job", "generation").orderBy("ended_at", "scan_id")
    out = out.withColumns({"_nth": F.row_number().over(own), "_first": F.first("delivery").over(own)})
    if ledger is not None:
        before = ledger.groupBy("job", "generation").agg(F.min("delivery").alias("_before"))
        latest = ledger.groupBy("source").agg(F.max("ended_at").alias("_latest"))
        out = out.join(before, ["job", "generation"], "left").join(latest, "source", "left")
    else:
        out = out.withColumns({"_before": F.lit(None).cast("string"), "_latest": F.lit(None).cast("timestamp")})
    out = out.withColumn("_before", F.coalesce("_before", F.when(F.col("_nth") > 1, F.col("_first"))))
    if leases is not None:
        out = out.join(leases.select("job", "generation", "expires_at", F.lit(True).alias("_held")), ["job", "generation"], "left")
        fenced = F.coalesce(F.col("_held") & (F.col("expires_at") > F.col("ended_at")), F.lit(False))
    else:
        fenced = F.lit(True)
    if known is not None:
        out = out.join(known.select("source", F.col("connector").alias("_connector")), "source", "left")
        lost, other = F.col("_connector").isNull(), F.col("_connector") != F.col("connector")
    else:
        lost = other = F.lit(False)
    artifacts = F.coalesce(F.size("artifacts"), F.lit(0))
    outcome = (
        F.when(F.col("ended_at") < F.col("started_at"), "invalid_scan_time_order")
        .when(F.coalesce(F.col("bytes") < 0, F.lit(True)), "invalid_byte_count")
        .when((artifacts > MOST_ARTIFACTS) | (~F.col("failed") & (artifacts < 1)), "invalid_response_artifacts")
        .when((F.col("observed") > MOST_OBSERVATIONS) | (F.col("listings") < F.col("observed")) | (F.col("failed") & (F.col("observed") > 0)), "invalid_observations")
        .when(F.col("outside"), "observation_artifact_outside_response")
        .when(F.col("_before") == F.col("delivery"), "replayed")
        .when(F.col("_before").isNotNull(), "scan_replay_mismatch")
        .when(~fenced, "stale_lease")
        .when(lost, "source_not_found")
        .when(other, "source_snapshot_mismatch")
        .when(F.col("ended_at") < F.col("_latest"), "late_scan")
        .otherwise("accepted")
    )
    return out.withColumn("outcome", outcome).select(*deliveries.columns, "outcome")


def _after(scans: DataFrame, separation: int) -> DataFrame:
    """For each scan of a source: ``missed``, ordinal of the next scan whose absences count, ``closing``, the first such that comes ``separation`` seconds after that one, and ``upto``, how many count up to it."""
    own = W.partitionBy("source").orderBy("ordinal")
    eligible = F.when(F.col("eligible"), F.col("ordinal"))
    apart = W.partitionBy("source").orderBy(F.unix_micros("ended_at")).rangeBetween(separation * 1_000_000, W.unboundedFollowing)
    marked = scans.withColumn("_closing", F.when(F.col("eligible"), F.min(eligible).over(apart)))
    ahead = own.rowsBetween(1, W.unboundedFollowing)
    return marked.select("source", "ordinal", F.min(eligible).over(ahead).alias("missed"), F.first(F.when(F.col("eligible"), F.col("_closing")), True).over(ahead).alias("_c"), F.first(eligible, True).over(ahead).alias("_m"), F.count(eligible).over(own).alias("upto")).select(
        "source", "ordinal", "missed", F.when(F.col("_c") > F.col("_m"), F.col("_c")).alias("closing"), "upto"
    )


def _followed(sightings: DataFrame, scans: DataFrame, separation: int) -> DataFrame:
    """Sightings with the ordinals at which the listing is first missed and closed before it is seen again, null if it is not."""
    within = lambda c: F.when(F.col("until").isNull() | (F.col(c) < F.col("until")), F.col(c)).alias(c)
    return sightings.join(_after(scans, separation), ["source", "ordinal"]).withColumns({"missed": within("missed"), "closing": within("closing")})


def _counts(scans: DataFrame, followed: DataFrame) -> DataFrame:
    """New scans with ``added``, ``reopened``, ``returned`` (reopened after being closed), ``closed``, and ``open_before``."""
    own = W.partitionBy("source", "listing").orderBy("ordinal")
    seen = followed.withColumns({"_was_missed": F.lag("missed").over(own).isNotNull(), "_was_closed": F.lag("closing").over(own).isNotNull()})
    fresh = seen.where("fresh").groupBy("source", "ordinal").agg(F.count_if("first_ever").alias("added"), F.count_if("_was_missed").alias("reopened"), F.count_if("_was_closed").alias("returned"))
    gone = followed.where("closing is not null").groupBy("source", F.col("closing").alias("ordinal")).agg(F.count("*").alias("closed"))
    out = scans.where("fresh").join(fresh, ["source", "ordinal"], "left").join(gone, ["source", "ordinal"], "left").fillna(0, ["added", "reopened", "returned", "closed"])
    earlier = W.partitionBy("source").orderBy("ordinal").rowsBetween(W.unboundedPreceding, -1)
    grown = F.sum(F.col("added") + F.col("returned") - F.col("closed")).over(earlier)
    return out.withColumn("open_before", F.coalesce("open_listings", F.lit(0)) + F.coalesce(grown, F.lit(0)))


def _trips(counted: DataFrame, prior: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """First trips of sources that no breaker holds, and of connectors: ``source, connector, ordinal, at, reason`` and ``connector, at``.

    A connector trips when three of its sources trip within a quarter of an hour; what would trip after that is held already.
    """
    own = W.partitionBy("source").orderBy("ordinal")
    previous = F.coalesce(F.last(F.when(~F.col("failed"), F.col("observed")), True).over(own.rowsBetween(W.unboundedPreceding, -1)), F.col("last_job_count"))
    why = F.when(F.col("eligible"), breaker(previous, F.col("observed"), F.col("open_before")))
    place = F.struct(F.col("ended_at").alias("ended_at"), F.col("scan_id").alias("scan_id"))
    found = counted.withColumn("_why", why).where("_why is not null").groupBy("source", "connector").agg(F.min_by(F.struct("ordinal", place.alias("at"), F.col("_why").alias("reason")), "ordinal").alias("t")).select("source", "connector", "t.*")
    recent = found.select("connector", "source", "at", F.lit(True).alias("_new"))
    if prior is not None:
        recent = recent.unionByName(prior.where("tripped_at is not null").select("connector", "source", F.struct(F.col("tripped_at").alias("ended_at"), F.lit("").alias("scan_id")).alias("at"), F.lit(False).alias("_new")))
    near = W.partitionBy("connector").orderBy(F.unix_micros("at.ended_at")).rangeBetween(-ESCALATION * 1_000_000, 0)
    # of trips at one instant the last by scan completes the number
    many = recent.withColumns({"_n": F.count("*").over(near), "_last": F.row_number().over(W.partitionBy("connector", "at.ended_at").orderBy(F.desc("at")))})
    connectors = many.where((F.col("_n") - F.col("_last") + 1 >= TRIPS) & F.col("_new")).groupBy("connector").agg(F.min("at").alias("held_from"))
    kept = found.join(connectors, "connector", "left").where("held_from is null or at <= held_from").drop("held_from")
    return kept, connectors


def fold(scans: DataFrame, observations: DataFrame, prior: dict[str, DataFrame] | None = None, separation: int = SEPARATION) -> dict[str, DataFrame]:
    """Accepted scans (:func:`judged`) and their observations, on top of the tables of earlier folds -> the tables after them.

    ``scans``, ``versions``, ``observations``, ``assertions`` and ``events`` hold what is new; ``listings`` and ``sources`` are the whole state of the sources
    that ``prior`` and ``scans`` name. Any number of scans of a source may come at once; folding them one by one gives the same tables.

    A scan's sightings always count, whether it is complete or not; its absences count if it is complete and no breaker holds its source or connector. A breaker stays until
    it is cleared (:func:`clear`). The first absence makes a listing possibly closed, one at least ``separation`` seconds later closes it, a sighting reopens it.
    """
    prior = prior or {}
    have = prior.get("sources")
    ordered = W.partitionBy("source").orderBy("ended_at", "scan_id")
    new = scans.withColumn("_n", F.row_number().over(ordered)).withColumn("fresh", F.lit(True))
    if have is not None:
        state = have.select("source", "last_ordinal", "open_listings", "last_job_count", "tripped_at", F.col("held_from").alias("_held"))
        new = new.join(state, "source", "left")
        # a connector that is held holds all its sources, those that the ledger meets for the first time too
        held = have.where("held_from is not null").groupBy("connector").agg(F.min("held_from").alias("_all"))
        new = new.join(held, "connector", "left").withColumn("_held", F.coalesce("_held", "_all")).drop("_all")
    else:
        new = new.withColumns({"last_ordinal": F.lit(0).cast("long"), "open_listings": F.lit(0).cast("long"), "last_job_count": F.lit(None).cast("long"), "tripped_at": F.lit(None).cast("timestamp"), "_held": F.lit(None).cast("timestamp")})
    new = new.withColumn("ordinal", F.coalesce("last_ordinal", F.lit(0)) + F.col("_n")).drop("_n", "last_ordinal")
    complete = (F.col("reason") == "complete") & ~F.col("failed")
    new = written(new.withColumn("broken", F.col("tripped_at").isNotNull() | F.col("_held").isNotNull()).withColumn("eligible", complete & ~F.col("broken")))
    line = ["source", "ordinal", "scan_id", "ended_at", "eligible", "fresh"]
    older = prior.get("scans")
    touched = new.select("source").distinct()
    past = older.join(touched, "source", "left_semi").withColumn("fresh", F.lit(False)).select(line) if older is not None else None
    timeline = lambda current: current.select(line) if past is None else past.unionByName(current.select(line))

    seen = observations.join(new.where("not failed").select("scan_id", "source", "ordinal", "ended_at"), "scan_id")
    marks = seen.select("source", "listing", "ordinal", F.col("ended_at").alias("at"), "fingerprint", F.lit(True).alias("fresh"))
    listings = prior.get("listings")
    if listings is not None:
        listings = listings.join(touched, "source", "left_semi")
        marks = marks.unionByName(listings.select("source", "listing", F.col("last_ordinal").alias("ordinal"), F.col("last_seen").alias("at"), F.col("current_version").alias("fingerprint"), F.lit(False).alias("fresh")))
    own = W.partitionBy("source", "listing").orderBy("ordinal")
    marks = marks.withColumns({"until": F.lead("ordinal").over(own), "first_ever": F.col("fresh") & (F.row_number().over(own) == 1), "changed": F.lag("fingerprint").over(own) != F.col("fingerprint")})
    marks = written(marks)

    # first pass: as if nothing tripped
    trips, connectors = _trips(_counts(new, _followed(marks, timeline(new), separation)), have)
    trips, connectors = written(trips), written(connectors)
    place = F.struct("ended_at", "scan_id")
    final = new.join(trips.select("source", F.col("at").alias("_at"), F.col("reason").alias("trip")), "source", "left").join(connectors, "connector", "left")
    final = final.withColumn("broken", F.col("broken") | F.coalesce(place >= F.col("_at"), F.lit(False)) | F.coalesce(place > F.col("held_from"), F.lit(False)))
    final = final.withColumns({"trip": F.when(place == F.col("_at"), F.col("trip")), "eligible": complete & ~F.col("broken")})
    final = written(final.drop("_at"))

    # second pass
    followed = written(_followed(marks, timeline(final), separation))
    firsts = seen.groupBy("source", "listing", "fingerprint").agg(F.min_by(F.struct("scan_id", "ordinal", "artifact", "assertions"), "ordinal").alias("v")).select("source", "listing", "fingerprint", "v.*")
    if prior.get("versions") is not None:
        firsts = firsts.join(prior["versions"].select("source", "listing", "fingerprint"), ["source", "listing", "fingerprint"], "left_anti")
    firsts = written(firsts)
    counted = _counts(final, followed)
    versions = firsts.groupBy("source", "ordinal").agg(F.count("*").alias("versions"))
    changes = marks.where("fresh").groupBy("source", "ordinal").agg(F.count_if(F.coalesce("changed", F.lit(False))).alias("changed"))
    counted = counted.join(versions, ["source", "ordinal"], "left").join(changes, ["source", "ordinal"], "left").fillna(0, ["versions", "changed"])
    missing = F.when(F.col("eligible"), F.col("open_before") - (F.col("observed") - F.col("added") - F.col("returned"))).otherwise(0)
    counted = written(counted.withColumn("missing", missing.cast("long")))

    out: dict[str, DataFrame] = {}
    completeness = F.when(F.col("failed"), "failed").when(F.col("reason") == "complete", "complete").otherwise("incomplete")
    counts = ["added", "changed", "missing", "reopened", "closed", "versions"]
    out["scans"] = counted.select(
        "scan_id", "source", "connector", "job", "generation", "started_at", "ended_at", "ordinal", "delivery", "reason", completeness.alias("completeness"), "observed", *counts, "eligible", F.col("trip").alias("tripped"), "broken", "board_hash", "bytes"
    )
    out["observations"] = seen.select("scan_id", "source", "listing", "fingerprint", "artifact", F.col("ended_at").alias("observed_at"))
    out["versions"] = firsts.select("source", "listing", "fingerprint", "scan_id", "artifact")
    out["assertions"] = firsts.select("source", "listing", "fingerprint", F.explode("assertions").alias("a")).select("source", "listing", "fingerprint", "a.*")
    told = _events(followed, timeline(final), listings)
    out["events"] = written(told)
    out["listings"] = _listings(followed, timeline(final), listings, out["events"])
    out["sources"] = _sources(counted, trips, connectors, have)
    return out


def _events(followed: DataFrame, scans: DataFrame, listings: DataFrame | None) -> DataFrame:
    """What happened to listings in the new scans, numbered within each listing."""
    own = W.partitionBy("source", "listing").orderBy("ordinal")
    seen = followed.withColumn("_was_missed", F.lag("missed").over(own).isNotNull()).where("fresh")
    kind = F.when(F.col("first_ever"), "opened").when(F.col("_was_missed"), "reopened")
    sighted = seen.select("source", "listing", "ordinal", kind.alias("event")).where("event is not null")
    absent = lambda column, event: followed.where(F.col(column).isNotNull()).select("source", "listing", F.col(column).alias("ordinal"), F.lit(event).alias("event"))
    every = sighted.unionByName(absent("missed", "possibly_closed")).unionByName(absent("closing", "closed"))
    every = every.join(scans.where("fresh").select("source", "ordinal", "scan_id", "ended_at"), ["source", "ordinal"])
    why = {"opened": "first_observation", "reopened": "source_identity_reappeared", "possibly_closed": "first_complete_absence", "closed": "second_separated_complete_absence"}
    reason = F.lit(None).cast("string")
    for event, said in why.items():
        reason = F.when(F.col("event") == event, said).otherwise(reason)
    before = F.lit(0)
    if listings is not None:
        every = every.join(listings.select("source", "listing", F.col("events").alias("_events")), ["source", "listing"], "left")
        before = F.coalesce("_events", F.lit(0))
    return every.withColumns({"sequence": (before + F.row_number().over(own)).cast("long"), "why": reason}).select("source", "listing", "sequence", "event", F.col("ended_at").alias("at"), "scan_id", "ordinal", "why")


def _listings(followed: DataFrame, scans: DataFrame, listings: DataFrame | None, events: DataFrame) -> DataFrame:
    """The state of each listing after its source's last scan."""
    ends = scans.groupBy("source").agg(F.max("ordinal").alias("_end"), F.count_if("eligible").alias("_all"))
    last = followed.where("until is null").join(ends, "source")
    at = lambda column, name: scans.select("source", F.col("ordinal").alias(column), F.col("ended_at").alias(name))
    last = last.join(at("missed", "first_missing"), ["source", "missed"], "left").join(at("closing", "closed_at"), ["source", "closing"], "left")
    upto = _after(scans, SEPARATION).select("source", F.col("ordinal").alias("closing"), F.col("upto").alias("_at_close"))
    last = last.join(upto, ["source", "closing"], "left")
    status = F.when(F.col("closing").isNotNull(), "closed").when(F.col("missed").isNotNull(), "possibly_closed").otherwise("active")
    told = events.groupBy("source", "listing").agg(F.min(F.when(F.col("event") == "opened", F.col("at"))).alias("_opened"), F.max(F.when(F.col("event") == "reopened", F.col("at"))).alias("_reopened"), F.max("sequence").alias("_events"))
    last = last.join(told, ["source", "listing"], "left")
    if listings is not None:
        last = last.join(listings.select("source", "listing", F.col("first_seen").alias("_first"), F.col("reopened_at").alias("_before"), F.col("events").alias("_had")), ["source", "listing"], "left")
    else:
        last = last.withColumns({"_first": F.lit(None).cast("timestamp"), "_before": F.lit(None).cast("timestamp"), "_had": F.lit(None).cast("long")})
    return last.select(
        "source",
        "listing",
        status.alias("status"),
        (F.coalesce("_at_close", "_all") - F.col("upto")).cast("long").alias("misses"),
        F.coalesce("_first", "_opened").alias("first_seen"),
        F.col("at").alias("last_seen"),
        "first_missing",
        "closed_at",
        F.coalesce("_reopened", "_before").alias("reopened_at"),
        F.col("fingerprint").alias("current_version"),
        F.col("ordinal").alias("last_ordinal"),
        F.coalesce("_events", "_had").alias("events"),
    )


def _sources(counted: DataFrame, trips: DataFrame, connectors: DataFrame, have: DataFrame | None) -> DataFrame:
    """Roll-ups of each source after its last scan; sources without new scans keep theirs, but for a connector's breaker."""
    complete, empty = F.col("completeness") == "complete", F.col("observed") == 0
    rows = counted.withColumn("completeness", F.when(F.col("failed"), "failed").when(F.col("reason") == "complete", "complete").otherwise("incomplete"))
    latest = lambda value: F.max_by(value, "ordinal")
    marks = rows.groupBy("source").agg(F.max(F.when(complete, F.col("ordinal"))).alias("_good"), F.max(F.when(complete & ~empty, F.col("ordinal"))).alias("_full"))
    health = F.when(F.col("broken") & ~F.col("failed"), "quarantined").when(complete, "healthy").when(F.col("reason") == "blocked", "blocked").otherwise("degraded")
    after = F.col("open_before") + F.col("added") + F.col("returned") - F.col("closed")
    rescan = F.when(F.col("missing") > 0, F.col("ended_at") + F.make_interval(secs=F.lit(RESCAN)))
    new = (
        rows.join(marks, "source")
        .groupBy("source", "connector")
        .agg(
            latest(health).alias("health"),
            F.max("ended_at").alias("last_attempt_at"),
            F.max(F.when(~F.col("failed"), F.col("ended_at"))).alias("last_success_at"),
            F.max(F.when(complete, F.col("ended_at"))).alias("last_complete_at"),
            F.max(F.when(~empty, F.col("ended_at"))).alias("last_nonempty_at"),
            F.max_by(F.when(~F.col("failed"), F.col("observed")), F.when(~F.col("failed"), F.col("ordinal"))).alias("last_job_count"),
            F.count_if(F.col("_good").isNull() | (F.col("ordinal") > F.col("_good"))).alias("consecutive_failures"),
            F.count_if(complete & empty & (F.col("_full").isNull() | (F.col("ordinal") > F.col("_full")))).alias("complete_empty_scans"),
            F.max("_good").alias("_good"),
            F.max("_full").alias("_full"),
            F.min(rescan).alias("next_scan_at"),
            latest("board_hash").alias("last_board_hash"),
            F.max("ordinal").alias("last_ordinal"),
            latest(after).cast("long").alias("open_listings"),
        )
    )
    new = new.join(trips.select("source", F.col("at.ended_at").alias("tripped_at"), F.col("reason").alias("trip_reason")), "source", "left")
    if have is None:
        new = new.drop("_good", "_full")
    else:
        old = have.select(F.col("source").alias("_source"), *[F.col(c).alias(f"_old_{c}") for c in have.columns if c != "source"])
        both = new.join(old, F.col("source") == F.col("_source"), "full_outer")
        plus = lambda c, reset: F.coalesce(c, F.lit(0)) + F.when(F.col(reset).isNull(), F.coalesce(f"_old_{c}", F.lit(0))).otherwise(0)
        kept = {c: F.coalesce(c, f"_old_{c}") for c in new.columns if c not in ("source", "_good", "_full", "consecutive_failures", "complete_empty_scans", "next_scan_at")}
        new = both.select(F.coalesce("source", "_source").alias("source"), *[v.alias(c) for c, v in kept.items()], plus("consecutive_failures", "_good").alias("consecutive_failures"), plus("complete_empty_scans", "_full").alias("complete_empty_scans"), F.least("next_scan_at", "_old_next_scan_at").alias("next_scan_at"), F.col("_old_held_from").alias("_held"))
    held = connectors.select("connector", F.col("held_from.ended_at").alias("_from"))
    out = new.join(held, "connector", "left").withColumn("held_from", F.coalesce(*(["_held"] if have is not None else []), "_from"))
    health = F.when(F.col("last_attempt_at") <= F.col("_from"), "quarantined").otherwise(F.col("health"))
    columns = ["source", "connector", "health", "last_attempt_at", "last_success_at", "last_complete_at", "last_nonempty_at", "last_job_count", "consecutive_failures", "complete_empty_scans", "next_scan_at", "last_board_hash", "last_ordinal", "open_listings", "tripped_at", "trip_reason", "held_from"]
    return out.withColumn("health", health).select(*columns)


def clear(sources: DataFrame, chosen: Column, connector: bool = False) -> DataFrame:
    """Sources with the breakers of the chosen ones cleared (``connector``: that of their connectors); what they missed meanwhile stays uncounted."""
    gone = ["tripped_at", "trip_reason"] if not connector else ["held_from"]
    kind = {c: t for c, t in sources.dtypes}
    return sources.withColumns({c: F.when(chosen, F.lit(None).cast(kind[c])).otherwise(F.col(c)) for c in gone}).withColumn("health", F.when(chosen & F.coalesce(*[F.col(c) for c in ("tripped_at", "held_from") if c not in gone]).isNull(), "degraded").otherwise(F.col("health")))


def retried(failures: DataFrame, share: Column) -> DataFrame:
    """Jobs of failed scans (``retryable``, ``attempt``, ``max_attempts``, ``ended_at``) with ``status`` and ``scheduled_at``: backed off while attempts are left."""
    again = F.col("retryable") & (F.col("attempt") < F.col("max_attempts"))
    wait = F.make_interval(secs=(backoff(F.col("attempt"), share) / 1000).cast("decimal(18,6)"))
    return failures.withColumn("status", F.when(again, "retryable_failed").otherwise("terminal_failed")).withColumn("scheduled_at", F.when(again, F.col("ended_at") + wait).otherwise(F.col("ended_at")))


def opportunity_events(members: DataFrame, events: DataFrame, statuses: DataFrame | None = None) -> DataFrame:
    """``members(opportunity, source, listing)`` and listing ``events`` -> every change of an opportunity's status: ``opportunity, at, scan_id, status, event``.

    An opportunity is active while any member is, else possibly closed while any is, else closed. Members' changes in one scan count at once. ``statuses(opportunity, active, possibly)`` holds how many
    members were in each state before.
    """
    now = F.when(F.col("event").isin("opened", "reopened"), "active").otherwise(F.col("event"))
    own = W.partitionBy("source", "listing").orderBy("sequence")
    moves = events.withColumn("_now", now).withColumn("_was", F.coalesce(F.lag("_now").over(own), F.when(F.col("event") == "opened", "new").when(F.col("event") == "possibly_closed", "active").when(F.col("event") == "closed", "possibly_closed").otherwise("closed")))
    step = lambda state: (F.col("_now") == state).cast("int") - (F.col("_was") == state).cast("int")
    moves = moves.join(members, ["source", "listing"]).groupBy("opportunity", "at", "scan_id").agg(F.sum(step("active")).alias("_a"), F.sum(step("possibly_closed")).alias("_p"))
    order = W.partitionBy("opportunity").orderBy("at", "scan_id")
    active, possibly = F.sum("_a").over(order), F.sum("_p").over(order)
    before = F.lit(None).cast("string")
    if statuses is not None:
        moves = moves.join(statuses, "opportunity", "left").fillna(0, ["active", "possibly"])
        active, possibly = active + F.col("active"), possibly + F.col("possibly")
        before = F.when(F.col("active") > 0, "active").when(F.col("possibly") > 0, "possibly_closed")
    moves = moves.withColumn("status", F.when(active > 0, "active").when(possibly > 0, "possibly_closed").otherwise("closed"))
    moves = moves.withColumn("_before", F.coalesce(F.lag("status").over(order), before))
    event = F.when(F.col("_before").isNull(), "opened").when(F.col("status") == "active", "reopened").otherwise(F.col("status"))
    return moves.withColumn("event", event).where("_before is null or _before <> status").select("opportunity", "at", "scan_id", "status", "event")
