"""Queries of the operator views, registry guards and public projections, with the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewright.operators import console
from sievewright.plans.catalog import query, stamp, t

AS_OF = "TIMESTAMP '2001-01-01 00:00:00'"
SQL_UUID = console.UUID


def as_of():
    return F.lit("2001-01-01 00:00:00").cast("timestamp_ntz")


@query("""
SELECT 'source_health' AS section, o_orderstatus AS name, count(*)::BIGINT AS rows FROM orders GROUP BY 2
UNION ALL SELECT 'pending_reviews', o_orderpriority, count(*)::BIGINT FROM orders WHERE o_orderstatus = 'O' GROUP BY 2
UNION ALL SELECT 'active_breakers', 'tripped', count(*)::BIGINT FROM lineitem WHERE l_returnflag = 'R'
UNION ALL SELECT 'scans_last_24_hours', event_type, count(*)::BIGINT FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 24 HOURS GROUP BY 2
""")
def operator_overview(spark, d):
    orders = t(spark, d, "orders")
    reviews = orders.select(F.col("o_orderpriority").alias("review_type"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done").alias("state"))
    breakers = t(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "R", "tripped").otherwise("cleared").alias("state"))
    scans = t(spark, d, "events").select(F.col("event_type").alias("completeness_reason"), F.col("ts").alias("ended_at"))
    return console.overview(orders.select(F.col("o_orderstatus").alias("health_state")), reviews, breakers, scans, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))


@query("""
SELECT id, priority, CASE WHEN length(r) > 0 THEN r ELSE 'manual review' END AS reason FROM (
  SELECT doc_id AS id, coalesce(n_chars, 0) % 7 AS priority, coalesce(n_chars, 0) AS created_at, substr(regexp_replace(regexp_replace(coalesce(text, ''), '[\\r\\n\\t]+', ' ', 'g'), '^[\\s\\x{A0}\\x{FEFF}\\x{2000}-\\x{200A}\\x{3000}]+|[\\s\\x{A0}\\x{FEFF}\\x{2000}-\\x{200A}\\x{3000}]+$', '', 'g'), 1, 160) AS r
  FROM documents WHERE doc_id IS NOT NULL ORDER BY priority DESC, created_at, id LIMIT 200)
""")
def review_queue(spark, d):
    size = F.coalesce("n_chars", F.lit(0))
    reviews = t(spark, d, "documents").where("doc_id is not null").select(F.col("doc_id").alias("id"), (size % 7).alias("priority"), size.alias("created_at"), F.col("text").alias("reason"))
    return console.review_queue(reviews).select("id", "priority", "reason")


@query(f"""
WITH h AS (SELECT o_custkey, o_orderkey, md5(o_orderkey::VARCHAR) AS m FROM orders),
u AS (SELECT *, substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12) AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM h)
SELECT o_custkey, coalesce(string_agg(id, ',' ORDER BY o_orderkey) FILTER (WHERE regexp_matches(id, '{SQL_UUID}')), '') AS ids FROM u WHERE n <= 10 GROUP BY 1
""")
def review_candidates(spark, d):
    m = F.md5(F.col("o_orderkey").cast("string").cast("binary"))
    part = lambda a, n: F.substring(m, a, n)
    ids = F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12))
    first = console.top_rows(t(spark, d, "orders"), ["o_custkey"], [F.col("o_orderkey")], 10)
    listed = first.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", ids.alias("id")))), lambda x: x["id"]).alias("ids"))
    return listed.select("o_custkey", F.array_join(console.safe_ids(F.col("ids")), ",").alias("ids"))


@query("""
WITH s AS (SELECT o_custkey AS source, o_orderkey AS scan, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
SELECT source, scan, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS started, coalesce(string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) FILTER (WHERE l_partkey IS NOT NULL), '') AS artifacts
FROM s LEFT JOIN lineitem ON l_orderkey = scan WHERE n <= 20 GROUP BY source, scan, o_orderdate
""")
def scan_evidence(spark, d):
    scans = t(spark, d, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("scan"), F.col("o_orderdate").alias("started_at"))
    artifacts = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("scan"), F.col("l_partkey").alias("artifact"), F.col("l_linenumber").alias("place"))
    return console.scan_evidence(scans, artifacts).select("source", "scan", stamp("started_at").alias("started"), F.array_join(F.col("artifacts").cast("array<string>"), ",").alias("artifacts"))


@query("""
WITH k AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY round(c_acctbal) DESC, c_custkey) AS n FROM customer),
m AS (SELECT s_suppkey AS id, c_custkey AS company, 1 + (c_custkey % 3 = 0)::INT AS priority, round(c_acctbal)::BIGINT AS confidence FROM supplier JOIN customer ON s_nationkey = c_nationkey)
SELECT id, company FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY priority DESC, confidence DESC, company) AS r FROM m) WHERE r <= 10
""")
def company_candidates(spark, d):
    known = t(spark, d, "customer").select("c_nationkey", F.col("c_custkey").alias("company"), (1 + (F.col("c_custkey") % 3 == 0).cast("int")).alias("priority"), F.round("c_acctbal").cast("long").alias("confidence"), F.lit(0.0).alias("name_score"))
    # a key's ten best companies are all that any of its askers can list
    best = console.ranked_candidates(known.withColumnRenamed("c_nationkey", "id")).withColumnRenamed("id", "s_nationkey")
    return t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), "s_nationkey").join(best, "s_nationkey").select("id", "company")


@query("""
SELECT p_partkey AS id, strftime(since, '%Y-%m-%d %H:%M:%S') AS since FROM (
  SELECT p_partkey, coalesce(max(l_shipdate), TIMESTAMP '1990-01-01 00:00:00' + to_days(p_size)) AS since FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey, p_size ORDER BY since, p_partkey LIMIT 100)
""")
def oldest_reconciled(spark, d):
    seen = t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.max("l_shipdate").alias("last_reconciled_at"))
    made = F.expr("timestamp_ntz'1990-01-01 00:00:00' + make_dt_interval(p_size)").alias("created_at")
    parts = t(spark, d, "part").select(F.col("p_partkey").alias("id"), made).join(seen, "id", "left")
    return console.oldest_first(parts, 100).select("id", stamp("since").alias("since"))


@query("""
WITH r AS (SELECT lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) AS scan, octet_length(encode(coalesce(html, '')))::BIGINT AS n, row_number() OVER (PARTITION BY lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) ORDER BY page_id) AS k FROM pages)
SELECT scan, count(*)::BIGINT AS responses, sum(n)::BIGINT AS bytes FROM r WHERE k <= 100 GROUP BY scan
""")
def scan_bytes(spark, d):
    host = F.lower(F.regexp_extract("url", "^[a-zA-Z]+://([^/?#:]*)", 1))
    return console.scan_bytes(t(spark, d, "pages").select(host.alias("scan"), F.col("page_id").alias("place"), F.coalesce("html", F.lit("")).alias("body")))


_REGISTRY = f"""
WITH p AS (SELECT n_nationkey AS policy, CASE WHEN n_nationkey % 5 = 0 THEN 'draft' ELSE 'approved' END AS state, CASE WHEN n_nationkey % 7 > 0 THEN {AS_OF} + to_days(n_nationkey - 4) END AS expires_at FROM nation),
s AS (SELECT s_suppkey AS id, s_suppkey % 4 > 0 AS enabled, s_nationkey AS policy, {AS_OF} + to_days((s_suppkey % 9 - 1)::INT) AS review_due_at, 'next' AS next_scan_at FROM supplier)
"""


def _registry(spark, d):
    day = lambda n: F.expr(f"timestamp_ntz'2001-01-01 00:00:00' + make_dt_interval(cast({n} as int))")
    policies = t(spark, d, "nation").select(F.col("n_nationkey").alias("policy"), F.when(F.col("n_nationkey") % 5 == 0, "draft").otherwise("approved").alias("state"), F.when(F.col("n_nationkey") % 7 > 0, day("n_nationkey - 4")).alias("expires_at"))
    sources = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 4 > 0).alias("enabled"), F.col("s_nationkey").alias("policy"), day("s_suppkey % 9 - 1").alias("review_due_at"), F.lit("next").alias("next_scan_at"))
    return sources, policies


@query(
    _REGISTRY
    + f""", e AS (SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_discount + 0.8 >= 0.9)
SELECT s.id, s.enabled, s.policy, CASE WHEN enabled THEN next_scan_at END AS next_scan_at, CASE WHEN NOT enabled THEN NULL
  WHEN review_due_at <= {AS_OF} OR p.policy IS NULL THEN 'policy_not_current' WHEN e.id IS NULL THEN 'ownership_evidence_missing' END AS error
FROM s LEFT JOIN (SELECT * FROM p WHERE state = 'approved' AND expires_at > {AS_OF}) p ON p.policy = s.policy LEFT JOIN e ON e.id = s.id
"""
)
def source_activation(spark, d):
    sources, policies = _registry(spark, d)
    evidence = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), (F.col("l_discount") + 0.8).alias("confidence"))
    return console.activation(sources, policies, evidence, as_of())


@query(
    _REGISTRY
    + f"""SELECT s.id, s.policy, s.enabled AND NOT lapsed AS enabled, CASE WHEN NOT (s.enabled AND lapsed) THEN next_scan_at END AS next_scan_at, s.enabled AND lapsed AS paused
FROM s JOIN (SELECT policy, state <> 'approved' OR expires_at IS NULL OR expires_at <= {AS_OF} AS lapsed FROM p) p ON p.policy = s.policy
"""
)
def policy_pause(spark, d):
    return console.pause_for_policy(*_registry(spark, d), as_of())


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'deleted' ELSE 'changed' END AS violation FROM orders WHERE o_orderstatus = 'F' AND (o_orderkey % 13 = 0 OR o_orderkey % 11 = 0)
""")
def final_scan_guard(spark, d):
    old = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = old.where("o_orderkey % 13 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 11 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return console.frozen_rows(old, new, ["o_orderkey"], F.col("o_orderstatus") == "F")


@query("""
SELECT o_orderkey AS id, o_orderstatus = 'O' AND o_orderkey % 3 <> 0 AND o_orderkey % 10 <> 0 AS allowed FROM orders
""")
def breaker_guard(spark, d):
    orders = t(spark, d, "orders")
    old = orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "tripped").otherwise("cleared").alias("state"), "o_custkey", "o_totalprice")
    new = old.withColumn("state", F.when(F.col("id") % 3 == 0, "tripped").otherwise("cleared")).withColumn("o_custkey", F.when(F.col("id") % 10 == 0, -1).otherwise(F.col("o_custkey")))
    return console.breaker_changes(old, new)


@query(f"""
WITH r AS (SELECT doc_id, ['closed', 'wrong_company', 'duplicate', 'other', 'spam', 'duplicate', 'other'][1 + (doc_id % 7)] AS kind, CASE WHEN doc_id % 4 > 0 THEN text END AS detail,
  CASE doc_id % 7 WHEN 2 THEN '123e4567-e89b-12d3-a456-426614174000' WHEN 1 THEN CASE WHEN doc_id % 2 = 0 THEN 'nobody' END END AS target FROM documents WHERE doc_id IS NOT NULL)
SELECT doc_id, CASE WHEN kind NOT IN ('closed', 'wrong_company', 'wrong_location', 'wrong_salary', 'duplicate', 'broken_link', 'other') THEN 'invalid_request'
  WHEN detail IS NOT NULL AND (length(trim(detail)) < 3 OR length(detail) > 2000) THEN 'invalid_request' WHEN target IS NOT NULL AND NOT regexp_matches(target, '{SQL_UUID}') THEN 'invalid_request'
  WHEN (kind = 'duplicate') <> (target IS NOT NULL) THEN 'duplicate_target_required' WHEN kind = 'other' AND detail IS NULL THEN 'report_detail_required' END AS error FROM r
""")
def problem_reports(spark, d):
    turn = F.col("doc_id") % 7
    kind = F.element_at(F.array(*map(F.lit, ("closed", "wrong_company", "duplicate", "other", "spam", "duplicate", "other"))), (turn + 1).cast("int"))
    target = F.when(turn == 2, "123e4567-e89b-12d3-a456-426614174000").when((turn == 1) & (F.col("doc_id") % 2 == 0), "nobody")
    return t(spark, d, "documents").where("doc_id is not null").select("doc_id", console.report_error(kind, F.when(F.col("doc_id") % 4 > 0, F.col("text")), target).alias("error"))


@query("""
WITH l AS (SELECT l_orderkey, min(l_shipdate) AS generated, max(l_shipdate) AS dataset FROM lineitem GROUP BY 1),
p AS (SELECT c_custkey, min(o_orderdate) AS reviewed, max(o_orderdate) AS expires FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1),
a AS (SELECT o_orderkey, o_orderdate AS observed, generated, dataset, reviewed, expires, dataset + INTERVAL 1 DAY AS as_of FROM orders JOIN l ON l_orderkey = o_orderkey JOIN p ON c_custkey = o_custkey)
SELECT o_orderkey, CASE WHEN generated < as_of - INTERVAL 60 DAY THEN 'wide' WHEN reviewed > as_of OR expires <= as_of OR expires <= reviewed THEN 'policy_not_current'
  WHEN reviewed > dataset OR as_of - reviewed > INTERVAL 30 DAY OR expires - reviewed > INTERVAL 90 DAY THEN 'policy_review_window_invalid'
  WHEN observed > as_of OR observed > dataset THEN 'observation_in_future' WHEN as_of - observed > INTERVAL 7 DAY THEN 'observation_stale' END AS error FROM a
""")
def pilot_freshness(spark, d):
    dates = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("generated"), F.max("l_shipdate").alias("dataset"))
    policies = t(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("reviewed"), F.max("o_orderdate").alias("expires"))
    rows = t(spark, d, "orders").join(dates, "o_orderkey").join(policies, "o_custkey")
    as_of = F.col("dataset") + F.expr("INTERVAL 1 DAY")
    # datasets are made over more than a week here: those are told apart, the others count as made with their review
    error = console.freshness_error(as_of, F.col("dataset"), F.col("dataset"), F.col("o_orderdate"), F.col("reviewed"), F.col("expires"))
    return rows.select("o_orderkey", F.when(F.col("generated") < as_of - F.expr("INTERVAL 60 DAY"), "wide").otherwise(error).alias("error"))


@query("""
SELECT c_mktsegment AS connector, count(*)::BIGINT AS entries, count(DISTINCT c_nationkey)::BIGINT AS domains, count(DISTINCT c_custkey % 50)::BIGINT AS tenants FROM customer GROUP BY 1
""")
def connector_counts(spark, d):
    return console.connector_counts(t(spark, d, "customer").select(F.col("c_mktsegment").alias("connector"), F.col("c_nationkey").alias("domain"), (F.col("c_custkey") % 50).alias("tenant")))


@query("""
WITH v AS (SELECT p_partkey, ['1 HOUR', 'per-day', 'WEEKLY', 'monthly day', 'per year', 'Annual', 'once'][1 + (p_partkey % 7)] AS i, ['Remote', 'Hybrid', 'OnSite', 'on-site', NULL, NULL, NULL][1 + (p_partkey % 7)] AS w, CASE p_partkey % 7 WHEN 4 THEN true WHEN 5 THEN false END AS r, p_size * 100 + 5 AS lo, CASE WHEN p_size > 20 THEN p_size * 200 END AS hi FROM part)
SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'hour' WHEN 1 THEN 'day' WHEN 2 THEN 'week' WHEN 3 THEN 'day' WHEN 4 THEN 'year' WHEN 5 THEN 'year' ELSE 'unknown' END AS period,
  CASE p_partkey % 7 WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'onsite' WHEN 3 THEN 'onsite' WHEN 4 THEN 'remote' WHEN 5 THEN 'unspecified' END AS workplace, printf('%.2f', lo / 100.0::DOUBLE) AS money, greatest(coalesce(hi, lo), lo)::BIGINT AS sort FROM v
""")
def vendor_pay(spark, d):
    turn = (F.col("p_partkey") % 7 + 1).cast("int")
    interval = F.element_at(F.array(*map(F.lit, ("1 HOUR", "per-day", "WEEKLY", "monthly day", "per year", "Annual", "once"))), turn)
    kind = F.element_at(F.array(*map(F.lit, ("Remote", "Hybrid", "OnSite", "on-site", None, None, None))), turn)
    remote = F.when(turn == 5, True).when(turn == 6, False)
    lo, hi = F.col("p_size") * 100 + 5, F.when(F.col("p_size") > 20, F.col("p_size") * 200)
    return t(spark, d, "part").select("p_partkey", console.pay_period(interval).alias("period"), console.workplace(kind, remote).alias("workplace"), console.major_units(lo).alias("money"), console.pay_sort(lo, hi).cast("long").alias("sort"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN 'BUILDING' WHEN c_custkey % 5 = 2 THEN n_name ELSE c_mktsegment || ', ' || n_name END AS location,
  'USD ' || c_nationkey || ' year' AS salary, CASE WHEN c_custkey % 2 = 1 THEN 'unspecified' WHEN c_custkey % 4 = 0 THEN 'worldwide' ELSE 'countries' END AS scope,
  CASE WHEN c_custkey % 4 = 0 THEN '' WHEN n_name < 'NATION_2' THEN n_name || ',NATION_2' WHEN n_name = 'NATION_2' THEN 'NATION_2' ELSE 'NATION_2,' || n_name END AS codes FROM customer JOIN nation ON c_nationkey = n_nationkey
""")
def legacy_projection(spark, d):
    turn = F.col("c_custkey") % 5
    first = F.when(turn == 0, None).when(turn == 1, "BUILDING").when(turn == 2, "").otherwise(F.col("c_mktsegment"))
    second = F.when(turn == 0, "").when(turn == 1, None).otherwise(F.col("n_name"))
    countries = F.when(F.col("c_custkey") % 4 == 0, F.array(F.lit(None).cast("string"), F.lit(""))).otherwise(F.array(F.col("n_name"), F.lit("NATION_2"), F.lit(None), F.col("n_name")))
    scope = console.remote_scope(F.when(F.col("c_custkey") % 2 == 0, "remote"), countries)
    rows = t(spark, d, "customer").join(F.broadcast(t(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # a fixed table of nations
    salary = console.joined_words(F.lit("USD"), F.col("c_nationkey").cast("string"), F.lit(None), F.lit("year"), by=" ")
    return rows.select("c_custkey", console.joined_words(first, second).alias("location"), salary.alias("salary"), scope["kind"].alias("scope"), F.array_join(scope["codes"], ",").alias("codes"))


@query("SELECT s_suppkey, md5(s_name || ':' || s_nationkey) || md5(s_suppkey::VARCHAR) AS fingerprint FROM supplier")
def backfill_fingerprint(spark, d):
    return t(spark, d, "supplier").select("s_suppkey", F.concat(F.md5(F.concat_ws(":", "s_name", "s_nationkey").cast("binary")), F.md5(F.col("s_suppkey").cast("string").cast("binary"))).alias("fingerprint"))


@query("""
SELECT * FROM (SELECT l_orderkey, l_linenumber::BIGINT AS step, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS expected FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) WHERE step <> expected
""")
def sequence_gaps(spark, d):
    steps = t(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("step")).distinct()
    return console.sequence_gaps(steps, ["l_orderkey"], "step")


@query("""
SELECT c_custkey, CASE c_custkey % 5 WHEN 1 THEN 'invalid_tenant' WHEN 2 THEN 'board_mismatch' WHEN 3 THEN 'api_mismatch' END AS error FROM customer
""")
def source_descriptors(spark, d):
    turn, own = F.col("c_custkey") % 5, F.concat(F.lit("t"), "c_custkey")
    tenant = F.when(turn == 1, F.concat(own, F.lit(" x"))).otherwise(own)
    board = F.concat(F.lit("https://boards.example.com/"), F.when(turn == 2, "other").otherwise(own))
    api = F.concat(F.lit("https://api.example.com/v1/boards/"), F.when(turn == 3, "other").otherwise(own), F.lit("/jobs"))
    return t(spark, d, "customer").select("c_custkey", console.descriptor_error(tenant, board, api).alias("error"))


@query("""
SELECT p_partkey AS entity, CASE WHEN p_partkey % 3 <> 1 THEN '{"p_size":' || p_size || ',"p_brand":"' || p_brand || '"}' END AS before, CASE WHEN p_partkey % 3 <> 2 THEN '{"p_size":' || (p_size + 1) || ',"p_brand":"' || p_brand || '"}' END AS after FROM part
""")
def audit_trail(spark, d):
    parts = t(spark, d, "part").select("p_partkey", "p_size", "p_brand")
    return console.audit_rows(parts.where("p_partkey % 3 <> 1"), parts.where("p_partkey % 3 <> 2").withColumn("p_size", F.col("p_size") + 1), "p_partkey")


@query("""
SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 2 AND l_returnflag = 'R')
""")
def assertion_flag(spark, d):
    """Rows for which some assertion at one path says true: a JSON boolean, not a text."""
    value = F.when(F.col("l_returnflag") == "R", "true").when(F.col("l_returnflag") == "A", '"true"').otherwise("false")
    assertions = t(spark, d, "lineitem").select("l_orderkey", F.concat(F.lit("/p"), "l_linenumber").alias("path"), value.alias("value"))
    said = assertions.where((F.col("path") == "/p2") & F.expr("schema_of_variant(parse_json(value)) = 'BOOLEAN' and try_variant_get(parse_json(value), '$', 'boolean')"))
    return t(spark, d, "orders").join(said, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("""
SELECT o_custkey AS opportunity, o_orderkey AS listing, l_linenumber AS version, p_name AS value FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_type = 'ECONOMY'
""")
def member_evidence(spark, d):
    """Members of an opportunity, all their versions, and what these assert at one path."""
    members = t(spark, d, "orders").select(F.col("o_custkey").alias("opportunity"), F.col("o_orderkey").alias("listing"))
    versions = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("listing"), F.col("l_linenumber").alias("version"), F.col("l_partkey").alias("p_partkey"))
    said = t(spark, d, "part").where("p_type = 'ECONOMY'").select("p_partkey", F.col("p_name").alias("value"))
    return members.join(versions.join(said, "p_partkey"), "listing").select("opportunity", "listing", "version", "value")
