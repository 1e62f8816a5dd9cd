"""Queries of the scan fold over ``events``, with SQL that walks a grid of listings and scans instead.

Each event type is a source, scanned once a day; users seen that day are its listings. The day's last event says how the scan went.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewright.operators import scans
from sievewright.plans.catalog import query, stamp, t


def _grid(suffix: str, eligible: str) -> str:
    """Listings by scans since they were first seen, with the state after each, absences counting in scans that are ``eligible``."""
    return f"""
g{suffix} AS (
  SELECT l.source, l.listing, s.k, s.ended, s.scan_id, o.listing IS NOT NULL AS seen, o.fp, {eligible} AS counts
  FROM (SELECT source, listing, min(k) AS born FROM obs GROUP BY 1, 2) l JOIN run s ON s.source = l.source AND s.k >= l.born LEFT JOIN obs o ON o.source = l.source AND o.listing = l.listing AND o.k = s.k),
i{suffix} AS (SELECT *, sum(seen::INT) OVER own AS island FROM g{suffix} WINDOW own AS (PARTITION BY source, listing ORDER BY k)),
m{suffix} AS (
  SELECT *, count(*) FILTER (WHERE counts AND NOT seen) OVER run AS m, min(CASE WHEN counts AND NOT seen THEN ended END) OVER run AS since
  FROM i{suffix} WINDOW run AS (PARTITION BY source, listing, island ORDER BY k)),
c{suffix} AS (SELECT *, counts AND NOT seen AND m >= 2 AND ended - since >= INTERVAL 30 MINUTE AS closing FROM m{suffix}),
e{suffix} AS (
  SELECT *, bool_or(closing) OVER run AS is_closed, min(CASE WHEN closing THEN m END) OVER run AS closing_m, min(CASE WHEN closing THEN ended END) OVER run AS closed_at
  FROM c{suffix} WINDOW run AS (PARTITION BY source, listing, island ORDER BY k)),
w{suffix} AS (SELECT *, CASE WHEN seen OR m = 0 THEN 'active' WHEN is_closed THEN 'closed' ELSE 'possibly_closed' END AS status FROM e{suffix}),
st{suffix} AS (SELECT *, lag(status) OVER own AS before, lag(fp) OVER (PARTITION BY source, listing, seen ORDER BY k) AS prev_fp FROM w{suffix} WINDOW own AS (PARTITION BY source, listing ORDER BY k)),
op{suffix} AS (
  SELECT r.source, r.k, count(*) FILTER (WHERE x.before IS NOT NULL AND x.before <> 'closed') AS open_before FROM run r LEFT JOIN st{suffix} x ON x.source = r.source AND x.k = r.k GROUP BY 1, 2)"""


LOG = f"""
day AS (
  SELECT event_type AS source, ts::DATE AS day, max(ts) AS ended, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY 1, 2),
run AS (
  SELECT source, day, source || ':' || day AS scan_id, ended, v >= 100 AS failed, CASE WHEN v >= 100 THEN 'transport_failure' WHEN v >= 70 THEN 'pagination_incomplete' ELSE 'complete' END AS reason,
    row_number() OVER (PARTITION BY source ORDER BY ended) AS k FROM day),
obs AS (
  SELECT e.event_type AS source, e.user_id AS listing, r.k, r.ended, arg_max(floor(e.value / 10)::BIGINT, (e.ts, e.event_id))::VARCHAR AS fp
  FROM events e JOIN run r ON r.source = e.event_type AND r.day = e.ts::DATE AND NOT r.failed GROUP BY 1, 2, 3, 4),
seen AS (SELECT r.*, count(o.listing) AS observed FROM run r LEFT JOIN obs o ON o.source = r.source AND o.k = r.k GROUP BY ALL),
{_grid("0", "s.reason = 'complete'")},
judge AS (
  SELECT s.*, open_before, coalesce(last_value(CASE WHEN NOT failed THEN observed END IGNORE NULLS) OVER (PARTITION BY s.source ORDER BY s.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev FROM seen s JOIN op0 USING (source, k)),
why AS (
  SELECT *, greatest(prev, open_before) AS base, greatest(0, open_before - observed) AS lost FROM judge),
tripping AS (
  SELECT *, CASE WHEN reason <> 'complete' THEN NULL WHEN base >= 10 AND observed = 0 THEN 'suspicious_empty' WHEN base >= 10 AND round((base - observed)::DOUBLE / base, 4) >= 0.9 THEN 'count_collapse'
    WHEN lost >= 50 AND 2 * lost >= open_before THEN 'closure_spike' END AS trip FROM why),
first_trip AS (SELECT source, min(ended) AS ended, arg_min(trip, ended) AS trip FROM tripping WHERE trip IS NOT NULL GROUP BY 1),
hold AS (
  SELECT min(ended) AS held FROM first_trip a WHERE (SELECT count(*) FROM first_trip b WHERE b.ended <= a.ended AND a.ended - b.ended <= INTERVAL 15 MINUTE) >= 3),
final AS (
  SELECT s.*, f.ended AS tripped_at, f.trip, hold.held, coalesce(s.ended >= f.ended, false) OR coalesce(s.ended > hold.held, false) AS broken
  FROM seen s CROSS JOIN hold LEFT JOIN first_trip f ON f.source = s.source AND (hold.held IS NULL OR f.ended <= hold.held)),
{_grid("1", "s.reason = 'complete' AND NOT (SELECT f.broken FROM final f WHERE f.source = s.source AND f.k = s.k)")},
fresh AS (SELECT source, listing, fp, min(k) AS k FROM obs GROUP BY 1, 2, 3),
told AS (
  SELECT *, CASE WHEN before IS NULL THEN 'opened' WHEN seen AND before <> 'active' THEN 'reopened' WHEN status <> before THEN status END AS event FROM st1),
events_of AS (SELECT *, row_number() OVER (PARTITION BY source, listing ORDER BY k) AS sequence FROM told WHERE event IS NOT NULL),
counted AS (
  SELECT f.source, f.day::VARCHAR AS day, f.k, f.ended, CASE WHEN failed THEN 'failed' WHEN reason = 'complete' THEN 'complete' ELSE 'incomplete' END AS completeness, observed::BIGINT AS observed,
    count(*) FILTER (WHERE x.event = 'opened')::BIGINT AS added, count(*) FILTER (WHERE x.seen AND x.prev_fp <> x.fp)::BIGINT AS changed,
    count(*) FILTER (WHERE NOT x.seen AND x.before <> 'closed' AND reason = 'complete' AND NOT broken)::BIGINT AS missing, count(*) FILTER (WHERE x.event = 'reopened')::BIGINT AS reopened,
    count(*) FILTER (WHERE x.event = 'closed')::BIGINT AS closed, (SELECT count(*) FROM fresh v WHERE v.source = f.source AND v.k = f.k)::BIGINT AS versions,
    reason = 'complete' AND NOT broken AS eligible, CASE WHEN tripped_at = f.ended THEN trip END AS tripped, broken, failed, reason, tripped_at, trip, held
  FROM final f LEFT JOIN told x ON x.source = f.source AND x.k = f.k GROUP BY ALL)"""


def _deliveries(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", "value", F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("ts"))
    scan_id = F.concat_ws(":", "source", F.to_date("ts").cast("string"))
    place = F.struct("ts", "event_id")
    last = F.col("v")
    days = e.groupBy("source", scan_id.alias("scan_id")).agg(F.max("ts").alias("ended_at"), F.min("ts").alias("started_at"), F.max_by("value", place).alias("v"), F.sum(F.lit(64)).alias("bytes"))
    deliveries = days.select(
        "scan_id", "source", F.lit("board").alias("connector"), "scan_id", F.lit(1).cast("long").alias("generation"), "started_at", "ended_at",
        F.when(last >= 100, "transport_failure").when(last >= 70, "pagination_incomplete").otherwise("complete").alias("reason"), (last >= 100).alias("failed"), "bytes",
        F.array(F.col("scan_id")).alias("artifacts"), F.lit(None).cast("string").alias("board_hash"),
    ).toDF("scan_id", "source", "connector", "job", "generation", "started_at", "ended_at", "reason", "failed", "bytes", "artifacts", "board_hash")
    told = F.max_by(F.floor(F.col("value") / 10).cast("long").cast("string"), place)
    seen = e.groupBy(scan_id.alias("scan_id"), F.col("user_id").cast("string").alias("listing")).agg(told.alias("fingerprint"))
    fact = F.array(F.struct(F.lit("/value").alias("path"), F.col("fingerprint").alias("value"), F.lit("source_field").alias("origin"), F.lit(1.0).alias("confidence")))
    seen = seen.join(deliveries.where("not failed").select("scan_id"), "scan_id", "left_semi")
    return deliveries, seen.select("scan_id", "listing", "fingerprint", F.col("scan_id").alias("artifact"), fact.alias("assertions"))


def _folded(spark, d):
    deliveries, seen = _deliveries(spark, d)
    accepted = scans.judged(scans.delivered(deliveries, seen)).where("outcome = 'accepted'").drop("outcome")
    return scans.fold(accepted, seen)


@query(f"WITH {LOG} SELECT source, day, completeness, observed, added, changed, missing, reopened, closed, versions, eligible, tripped FROM counted")
def scan_commit(spark, d):
    out = _folded(spark, d)["scans"].withColumn("day", F.element_at(F.split("scan_id", ":"), -1))
    return out.select("source", "day", "completeness", "observed", "added", "changed", "missing", "reopened", "closed", "versions", "eligible", "tripped")


@query(f"""
WITH {LOG}, last AS (SELECT source, listing, max(k) AS k FROM st1 GROUP BY 1, 2),
sight AS (SELECT source, listing, min(ended) AS first_seen, max(ended) AS last_seen, arg_max(fp, k) AS fp FROM obs GROUP BY 1, 2),
ev AS (SELECT source, listing, max(ended) FILTER (WHERE event = 'reopened') AS reopened_at, count(*)::BIGINT AS events FROM events_of GROUP BY 1, 2)
SELECT s.source, s.listing::VARCHAR AS listing, status, (CASE WHEN status = 'active' THEN 0 ELSE coalesce(closing_m, m) END)::BIGINT AS misses,
  strftime(first_seen, '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen, strftime(since, '%Y-%m-%d %H:%M:%S') AS first_missing,
  strftime(closed_at, '%Y-%m-%d %H:%M:%S') AS closed_at, strftime(reopened_at, '%Y-%m-%d %H:%M:%S') AS reopened_at, sight.fp AS current_version, events
FROM st1 s JOIN last USING (source, listing, k) JOIN sight USING (source, listing) JOIN ev USING (source, listing)
""")
def scan_listings(spark, d):
    out = _folded(spark, d)["listings"]
    times = {c: stamp(c) for c in ("first_seen", "last_seen", "first_missing", "closed_at", "reopened_at")}
    return out.withColumns(times).select("source", "listing", "status", "misses", *times, "current_version", "events")


@query(f"""
WITH {LOG} SELECT source, listing::VARCHAR AS listing, sequence, event, strftime(ended, '%Y-%m-%d %H:%M:%S') AS "at",
  CASE event WHEN 'opened' THEN 'first_observation' WHEN 'reopened' THEN 'source_identity_reappeared' WHEN 'closed' THEN 'second_separated_complete_absence' ELSE 'first_complete_absence' END AS why FROM events_of
""")
def scan_events(spark, d):
    return _folded(spark, d)["events"].select("source", "listing", "sequence", "event", stamp("at").alias("at"), "why")


@query(f"""
WITH {LOG}, z AS (SELECT source, max(k) AS k, coalesce(max(k) FILTER (WHERE completeness = 'complete'), 0) AS good, coalesce(max(k) FILTER (WHERE completeness = 'complete' AND observed > 0), 0) AS full_ FROM counted GROUP BY 1)
SELECT c.source, CASE WHEN max(c.ended) <= max(held) THEN 'quarantined' ELSE max(CASE WHEN c.k = z.k THEN CASE WHEN broken AND NOT failed THEN 'quarantined' WHEN completeness = 'complete' THEN 'healthy' WHEN reason = 'blocked' THEN 'blocked' ELSE 'degraded' END END) END AS health,
  arg_max(observed, c.k) FILTER (WHERE NOT failed) AS last_job_count, strftime(max(c.ended) FILTER (WHERE completeness = 'complete'), '%Y-%m-%d %H:%M:%S') AS last_complete_at,
  count(*) FILTER (WHERE c.k > good)::BIGINT AS consecutive_failures, strftime(min(c.ended + INTERVAL 30 MINUTE) FILTER (WHERE missing > 0), '%Y-%m-%d %H:%M:%S') AS next_scan_at,
  (SELECT count(*) FROM st1 x WHERE x.source = c.source AND x.k = max(z.k) AND x.status <> 'closed')::BIGINT AS open_listings, max(trip) AS trip_reason, strftime(max(held), '%Y-%m-%d %H:%M:%S') AS held_from
FROM counted c JOIN z USING (source) GROUP BY c.source
""")
def scan_sources(spark, d):
    out = _folded(spark, d)["sources"]
    times = {c: stamp(c) for c in ("last_complete_at", "next_scan_at", "held_from")}
    return out.withColumns(times).select("source", "health", "last_job_count", "last_complete_at", "consecutive_failures", "next_scan_at", "open_listings", "trip_reason", "held_from")


@query(f"""
WITH {LOG}, moves AS (SELECT listing, ended, scan_id FROM events_of GROUP BY ALL),
now AS (
  SELECT v.listing, v.ended, v.scan_id, (SELECT CASE WHEN bool_or(s = 'active') THEN 'active' WHEN bool_or(s = 'possibly_closed') THEN 'possibly_closed' ELSE 'closed' END
    FROM (SELECT arg_max(e.status, e.ended) AS s FROM events_of e WHERE e.listing = v.listing AND (e.ended, e.scan_id) <= (v.ended, v.scan_id) GROUP BY e.source)) AS status FROM moves v),
old AS (SELECT *, lag(status) OVER (PARTITION BY listing ORDER BY ended, scan_id) AS was FROM now)
SELECT listing::VARCHAR AS opportunity, strftime(ended, '%Y-%m-%d %H:%M:%S') AS "at", status, CASE WHEN was IS NULL THEN 'opened' WHEN status = 'active' THEN 'reopened' ELSE status END AS event FROM old WHERE was IS NULL OR was <> status
""")
def opportunity_events(spark, d):
    out = _folded(spark, d)
    members = out["listings"].select(F.col("listing").alias("opportunity"), "source", "listing")
    return scans.opportunity_events(members, out["events"]).select("opportunity", stamp("at").alias("at"), "status", "event")
