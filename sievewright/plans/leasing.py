"""Queries of jobs and leases over ``events``, with SQL that folds all jobs' events in lockstep."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievewright.operators import jobs
from sievewright.plans.catalog import query, stamp, t
from sievewright.storage import shared_folder
from sievewright.streaming import leases, twins

#: Half a day a lease, three attempts.
LEASE, ATTEMPTS = 43_200, 3
KINDS = {"signup": "enqueue", "click": "claim", "view": "heartbeat", "purchase": "succeed", "error": "fail"}


def _log(spark, d):
    """Users as jobs; workers name the number of claims since the job was last asked for."""
    e = t(spark, d, "events")
    kind = F.when((F.col("event_type") == "error") & (F.col("value") > 80), "cancel")
    for name, means in KINDS.items():
        kind = kind.when(F.col("event_type") == name, means)
    rows = e.select(F.col("user_id").cast("string").alias("job"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), kind.alias("kind"), (F.col("value") < 50).alias("retryable"))
    own = W.partitionBy("job").orderBy("at", "seq")
    rows = rows.withColumn("_asked", F.count_if(F.col("kind") == "enqueue").over(own))
    return rows.withColumn("generation", F.count_if(F.col("kind") == "claim").over(W.partitionBy("job", "_asked").orderBy("at", "seq"))).select("job", "at", "seq", "kind", "generation", "retryable")


def _delay(attempt: str) -> str:
    return f"(floor(least(3600000, 5000 * 2 ** ({attempt} - 1))::DOUBLE * least(0.999999::DOUBLE, ('0x' || substr(sha256(job || ':' || {attempt}), 1, 8))::BIGINT::DOUBLE / 4294967295::DOUBLE)) * 1000)::BIGINT"


LEASE_SQL = f"""
WITH RECURSIVE k AS (
  SELECT user_id::VARCHAR AS job, epoch_us(ts) AS us, event_id AS seq, value < 50 AS retryable,
    CASE WHEN event_type = 'error' AND value > 80 THEN 'cancel' WHEN event_type = 'signup' THEN 'enqueue' WHEN event_type = 'click' THEN 'claim' WHEN event_type = 'view' THEN 'heartbeat'
      WHEN event_type = 'purchase' THEN 'succeed' ELSE 'fail' END AS kind FROM events),
k2 AS (SELECT *, count(*) FILTER (WHERE kind = 'enqueue') OVER (PARTITION BY job ORDER BY us, seq) AS asked FROM k),
e AS (SELECT *, count(*) FILTER (WHERE kind = 'claim') OVER (PARTITION BY job, asked ORDER BY us, seq) AS named, row_number() OVER (PARTITION BY job ORDER BY us, seq) AS n FROM k2),
st AS (
  SELECT DISTINCT job, 0::BIGINT AS n, NULL::VARCHAR AS status, NULL::BIGINT AS scheduled, 0::BIGINT AS generation, 0::BIGINT AS attempt, NULL::BIGINT AS expires,
    NULL::BIGINT AS us, NULL::BIGINT AS seq, NULL::VARCHAR AS kind, NULL::VARCHAR AS outcome, NULL::VARCHAR AS told, NULL::BIGINT AS told_generation, NULL::BIGINT AS told_attempt,
    NULL::BIGINT AS gone_us, NULL::VARCHAR AS gone_status, NULL::BIGINT AS gone_generation, NULL::BIGINT AS gone_attempt FROM e
  UNION ALL
  SELECT job, n, CASE WHEN outcome <> 'accepted' THEN s WHEN kind = 'enqueue' THEN 'queued' WHEN kind IN ('claim', 'heartbeat') THEN 'leased' WHEN kind = 'fail' AND again THEN 'retryable_failed' END,
    CASE WHEN outcome <> 'accepted' THEN sch WHEN kind = 'enqueue' THEN us WHEN kind = 'fail' THEN us + {_delay('a')} ELSE sch END,
    CASE WHEN outcome = 'accepted' AND kind = 'enqueue' THEN 0 WHEN outcome = 'accepted' AND kind = 'claim' THEN g + 1 ELSE g END, CASE WHEN outcome = 'accepted' AND kind = 'enqueue' THEN 0 WHEN outcome = 'accepted' AND kind = 'claim' THEN a + 1 ELSE a END,
    CASE WHEN outcome = 'accepted' AND kind IN ('claim', 'heartbeat') THEN us + {LEASE}000000 WHEN outcome <> 'accepted' THEN ex END,
    us, seq, kind, outcome,
    CASE WHEN outcome <> 'accepted' THEN s WHEN kind = 'enqueue' THEN 'queued' WHEN kind IN ('claim', 'heartbeat') THEN 'leased' WHEN kind = 'cancel' THEN 'cancelled' WHEN kind = 'succeed' THEN 'succeeded'
      WHEN again THEN 'retryable_failed' ELSE 'terminal_failed' END,
    CASE WHEN s IS NULL AND kind <> 'enqueue' THEN NULL WHEN outcome = 'accepted' AND kind = 'enqueue' THEN 0 WHEN outcome = 'accepted' AND kind = 'claim' THEN g + 1 ELSE g END,
    CASE WHEN s IS NULL AND kind <> 'enqueue' THEN NULL WHEN outcome = 'accepted' AND kind = 'enqueue' THEN 0 WHEN outcome = 'accepted' AND kind = 'claim' THEN a + 1 ELSE a END,
    gone_us, gone_status, CASE WHEN gone_us IS NOT NULL THEN old_g END, CASE WHEN gone_us IS NOT NULL THEN old_a END
  FROM (SELECT *, retryable AND a < {ATTEMPTS} AS again, CASE
      WHEN kind = 'enqueue' THEN CASE WHEN s IS NULL THEN 'accepted' ELSE 'duplicate' END
      WHEN kind = 'claim' THEN CASE WHEN s IN ('queued', 'retryable_failed') AND sch <= us THEN 'accepted' ELSE 'not_claimable' END
      WHEN kind = 'cancel' THEN CASE WHEN s IS NULL THEN 'job_not_cancellable' ELSE 'accepted' END
      WHEN s = 'leased' AND named = g THEN 'accepted' ELSE 'stale_lease' END AS outcome
    FROM (SELECT e.*, st.generation AS g, st.attempt AS a, st.generation AS old_g, st.attempt AS old_a,
        CASE WHEN NOT gone THEN st.status WHEN st.attempt < {ATTEMPTS} THEN 'retryable_failed' END AS s,
        CASE WHEN gone AND st.attempt < {ATTEMPTS} THEN st.expires + {_delay('st.attempt').replace('job ||', 'st.job ||')} ELSE st.scheduled END AS sch, CASE WHEN NOT gone THEN st.expires END AS ex,
        CASE WHEN gone THEN st.expires END AS gone_us, CASE WHEN gone THEN CASE WHEN st.attempt < {ATTEMPTS} THEN 'retryable_failed' ELSE 'terminal_failed' END END AS gone_status
      FROM (SELECT s0.*, coalesce(s0.status = 'leased' AND s0.expires <= nx.us, false) AS gone FROM st s0 JOIN e nx ON nx.job = s0.job AND nx.n = s0.n + 1) st JOIN e ON e.job = st.job AND e.n = st.n + 1))),
ends AS (SELECT arg_max(status, n) AS status, arg_max(expires, n) AS expires, arg_max(generation, n) AS generation, arg_max(attempt, n) AS attempt, job FROM (SELECT *, coalesce(status, '') AS status, coalesce(expires, -1) AS expires FROM (SELECT job, n, coalesce(status, '') AS status, coalesce(expires, -1) AS expires, generation, attempt FROM st)) GROUP BY job),
every AS (
  SELECT job, us, seq, kind, outcome, told AS status, told_generation AS generation, told_attempt AS attempt FROM st WHERE n > 0
  UNION ALL SELECT job, gone_us, NULL, 'expire', 'lease_expired', gone_status, gone_generation, gone_attempt FROM st WHERE gone_us IS NOT NULL
  UNION ALL SELECT job, expires, NULL, 'expire', 'lease_expired', CASE WHEN attempt < {ATTEMPTS} THEN 'retryable_failed' ELSE 'terminal_failed' END, generation, attempt FROM ends
    WHERE status = 'leased' AND expires <= (SELECT max(us) FROM e))
SELECT job, strftime(make_timestamp(us), '%Y-%m-%d %H:%M:%S') AS "at", seq, kind, outcome, status, generation, attempt FROM every
"""
LEASE_SQL = LEASE_SQL.replace("(SELECT *, coalesce(status, '') AS status, coalesce(expires, -1) AS expires FROM (SELECT job, n,", "(SELECT job, n,").replace("generation, attempt FROM st)) GROUP BY job)", "generation, attempt FROM st) GROUP BY job)")


def _told(df):
    return df.select("job", stamp("at").alias("at"), "seq", "kind", "outcome", "status", "generation", "attempt")


@query(LEASE_SQL)
def lease_reaper(spark, d):
    return _told(jobs.lease_log(_log(spark, d), LEASE, ATTEMPTS))


@query(LEASE_SQL)
def stream_lease_reaper(spark, d):
    log, path = _log(spark, d), shared_folder(spark)
    log.write.parquet(path)
    return _told(twins.run_to_end(leases.lease_stream(spark.readStream.schema(log.schema).parquet(path), LEASE, ATTEMPTS)))


@query("""
WITH src AS (
  SELECT c_custkey AS source, c_nationkey AS policy, c_acctbal > 0 AS enabled, 3600 * (1 + c_custkey % 24) AS cadence, max(o_orderdate) AS next_scan_at, min(o_orderdate) + INTERVAL 6 YEAR AS review_due_at
  FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
pol AS (SELECT s_nationkey AS policy FROM supplier GROUP BY 1 HAVING sum(s_acctbal) > 0),
due AS (
  SELECT *, floor(epoch(TIMESTAMP '2000-06-01') / cadence)::BIGINT AS bucket FROM src WHERE enabled AND next_scan_at <= TIMESTAMP '2000-06-01' AND review_due_at > TIMESTAMP '2000-06-01' AND policy IN (SELECT policy FROM pol)
    AND source IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) ORDER BY next_scan_at, source LIMIT 500)
SELECT source, 'scan_source:' || source || ':' || bucket AS dedupe_key, source NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS enqueued,
  strftime(TIMESTAMP '2000-06-01' + to_microseconds(1000 * (cadence * 1000 + floor(cadence::DOUBLE * 100 * ('0x' || substr(sha256(source || ':' || bucket), 1, 8))::BIGINT / 4294967295)::BIGINT)), '%Y-%m-%d %H:%M:%S') AS next_scan_at
FROM due
""")
def schedule_due_sources(spark, d):
    as_of = F.lit("2000-06-01 00:00:00").cast("timestamp_ntz")
    orders, customer = t(spark, d, "orders"), t(spark, d, "customer")
    spans = orders.groupBy(F.col("o_custkey").alias("source")).agg(F.max("o_orderdate").alias("next_scan_at"), (F.min("o_orderdate") + F.expr("INTERVAL 6 YEAR")).alias("review_due_at"))
    sources = spans.join(customer, F.col("source") == F.col("c_custkey")).select("source", (F.col("c_acctbal") > 0).alias("enabled"), (3600 * (1 + F.col("source") % 24)).alias("cadence"), "next_scan_at", "review_due_at", F.col("c_nationkey").alias("policy"))
    balance = t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("policy")).agg(F.sum("s_acctbal").alias("b"))
    policies = balance.select("policy", F.when(F.col("b") > 0, "approved").otherwise("draft").alias("state"), F.lit("2001-01-01").cast("timestamp_ntz").alias("expires_at"))
    evidence = orders.select(F.col("o_custkey").alias("source"), F.when(F.col("o_totalprice") > 200_000, 1.0).otherwise(0.5).alias("confidence"))
    bucket = F.floor(F.unix_timestamp(as_of.cast("timestamp")) / (3600 * (1 + F.col("o_custkey") % 24))).cast("long")
    pending = orders.where("o_orderstatus = 'P'").select(F.concat_ws(":", F.lit("scan_source"), F.col("o_custkey").cast("string"), bucket.cast("string")).alias("dedupe_key"))
    return jobs.schedule_due(sources, policies, evidence, pending, as_of).withColumn("next_scan_at", stamp("next_scan_at"))
