"""Queries of the pilot manifest and of vendors' postings over the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewright.operators import domains, pilot, search
from sievewright.plans.catalog import query, t
from sievewright.sources import details

NOW = "2024-06-10 00:00:00"
_CASES = """
b AS (SELECT c_custkey AS no, ['greenhouse', 'lever', 'ashby'][1 + floor(abs(c_acctbal))::BIGINT % 3] AS v, lower(replace(c_name, '#', CASE WHEN c_mktsegment = 'BUILDING' THEN ' ' ELSE '-' END)) AS tenant, c_acctbal > 9000 AS eu,
  'c' || floor(abs(c_acctbal) / 2)::BIGINT || CASE WHEN c_nationkey = 3 THEN '.lever.co' WHEN c_nationkey = 4 THEN '.org.com' ELSE '.com' END AS domain, c_mktsegment = 'MACHINERY' AS elsewhere, c_nationkey AS age FROM customer)"""


@query(f"""
WITH {_CASES},
e AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY no) > 1 AS again FROM b),
c AS (SELECT no, CASE WHEN contains(tenant, ' ') THEN 'invalid_tenant_key' WHEN eu AND v <> 'lever' THEN v || '_identity_mismatch' WHEN v = 'ashby' THEN 'source_policy_missing' WHEN domain LIKE '%.lever.co' THEN 'shared_ats_domain_is_not_employer_identity'
  WHEN domain LIKE '%.org.com' THEN 'primary_domain_not_registrable' WHEN elsewhere THEN 'ownership_evidence_domain_mismatch' WHEN age < 1 THEN 'observation_in_future' WHEN age > 7 THEN 'observation_stale' WHEN again THEN 'duplicate_verified_domain' END AS code FROM e)
SELECT 'entries' AS part, no, code FROM c WHERE code IS NOT NULL
UNION ALL SELECT 'manifest', 0, 'verified_entry_count_mismatch' FROM (SELECT count(*) AS n FROM customer) WHERE n <> 1000
UNION ALL SELECT 'policies', 2, 'duplicate_policy_family'
UNION ALL SELECT 'quarantine', s_suppkey, CASE WHEN s_nationkey < 1 THEN 'quarantine_observation_in_future' WHEN s_nationkey > 7 THEN 'quarantine_observation_stale' WHEN 'c' || s_suppkey || '.com' IN (SELECT domain FROM b) THEN 'quarantine_conflicts_verified_domain' END
  FROM supplier WHERE s_nationkey < 1 OR s_nationkey > 7 OR 'c' || s_suppkey || '.com' IN (SELECT domain FROM b)
""")
def pilot_manifest(spark, d):
    return pilot.manifest_errors(*_manifest(spark, d)).select("part", "no", "code")


def _manifest(spark, d):
    now = F.lit(NOW).cast("timestamp")
    c = t(spark, d, "customer")
    balance = F.floor(F.abs("c_acctbal")).cast("long")
    vendor = F.element_at(F.array(F.lit("greenhouse"), F.lit("lever"), F.lit("ashby")), (balance % 3 + 1).cast("int"))
    tenant = F.lower(F.regexp_replace("c_name", "#", F.when(F.col("c_mktsegment") == "BUILDING", " ").otherwise("-")))
    eu = F.col("c_acctbal") > 9000
    rows = c.select(F.col("c_custkey").alias("no"), vendor.alias("connector"), tenant.alias("tenant"), F.when(eu, "eu").otherwise("global").alias("region"), F.concat(F.lit("c"), F.floor(F.abs("c_acctbal") / 2).cast("string"), F.when(F.col("c_nationkey") == 3, ".lever.co").when(F.col("c_nationkey") == 4, ".org.com").otherwise(".com")).alias("domain"), "c_mktsegment", "c_nationkey")
    at, of = F.col("connector"), F.when(F.col("region") == "eu", ".eu").otherwise("")
    board = F.when(at == "greenhouse", "https://boards.greenhouse.io/").when(at == "lever", F.concat(F.lit("https://jobs"), of, F.lit(".lever.co/"))).otherwise("https://jobs.ashbyhq.com/")
    api = F.when(at == "greenhouse", "https://boards-api.greenhouse.io/v1/boards/").when(at == "lever", F.concat(F.lit("https://api"), of, F.lit(".lever.co/v0/postings/"))).otherwise("https://api.ashbyhq.com/posting-api/job-board/")
    evidence = F.when(F.col("c_mktsegment") == "MACHINERY", "https://elsewhere.com/").otherwise(F.concat(F.lit("https://jobs."), "domain", F.lit("/open")))
    ago = lambda column: F.date_sub(now.cast("date"), F.col(column)).cast("timestamp")
    entries = rows.select("no", "connector", "tenant", "region", F.concat(board, "tenant").alias("board_url"), F.concat(api, "tenant").alias("api_url"), "domain", F.concat(F.lit("https://"), "domain", F.lit("/careers")).alias("careers_url"), evidence.alias("evidence_url"), ago("c_nationkey").alias("observed_at"))
    policies = spark.createDataFrame([(0, "greenhouse", "*.greenhouse.io"), (1, "lever", "*.lever.co"), (2, "lever", "*.lever.co")], "no long, family string, host_pattern string").withColumns({"reviewed_at": F.date_sub(now.cast("date"), 5).cast("timestamp"), "expires_at": F.date_add(now.cast("date"), 60).cast("timestamp")})
    held = t(spark, d, "supplier").select(F.col("s_suppkey").alias("no"), F.col("s_name").alias("company"), F.concat(F.lit("c"), F.col("s_suppkey").cast("string"), F.lit(".com")).alias("domain"), F.lit(None).cast("string").alias("careers_url"), F.lit(None).cast("string").alias("ats_url"), ago("s_nationkey").alias("observed_at"))
    suffixes = domains.rules(spark.createDataFrame([("com",), ("co",)], "rule string"))
    reviewed = F.date_sub(now.cast("date"), 1).cast("timestamp")
    return policies, entries, held, suffixes, now, reviewed, reviewed, 1000


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice FROM lineitem WHERE l_linenumber = 1),
g AS (SELECT o_orderkey AS id, o_orderpriority AS title, o_totalprice AS p, o_orderstatus AS s, floor(o_totalprice)::BIGINT AS lo FROM orders)
SELECT id::VARCHAR AS source_job_id, u.path, u.value, u.origin, u.pointer FROM g, LATERAL (SELECT unnest([
  {'path': '/title', 'value': title, 'origin': 'source_field', 'pointer': '/title'}, {'path': '/descriptionText', 'value': 'Work & ' || s, 'origin': 'deterministic_rule', 'pointer': '/content'},
  {'path': '/locations', 'value': 'Place ' || s, 'origin': 'deterministic_rule', 'pointer': '/location/name'}, {'path': '/department', 'value': CASE WHEN s = 'O' THEN 'Dept' END, 'origin': 'source_field', 'pointer': '/departments/0/name'},
  {'path': '/compensation', 'value': CASE WHEN p > 200000 THEN 'Base: USD ' || lo || '.50–' || (lo + 1) || '.00' END, 'origin': 'deterministic_rule', 'pointer': '/pay_input_ranges/0'},
  {'path': '/applyUrl', 'value': 'https://boards.greenhouse.io/acme/jobs/' || id, 'origin': 'source_field', 'pointer': '/absolute_url'}, {'path': '/canonicalSourceUrl', 'value': 'https://boards.greenhouse.io/acme/jobs/' || id, 'origin': 'source_field', 'pointer': '/absolute_url'}]) AS u)
WHERE u.value IS NOT NULL AND title <> '5-LOW'
UNION ALL SELECT id::VARCHAR, NULL, 'greenhouse_identity_mismatch', 'error', NULL FROM g WHERE title = '5-LOW'
""")
def listing_details(spark, d):
    o = t(spark, d, "orders")
    key, low = F.col("o_orderkey").cast("string"), F.floor("o_totalprice").cast("long")
    url = F.concat(F.lit("https://boards.greenhouse.io/"), F.when(F.col("o_orderpriority") == "5-LOW", "other").otherwise("acme"), F.lit("/jobs/"), key)
    body = F.to_json(
        F.struct(
            F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.struct(F.concat(F.lit("Place "), "o_orderstatus").alias("name")).alias("location"),
            F.concat(F.lit("&lt;p&gt;Work &amp;amp; "), "o_orderstatus", F.lit("&lt;/p&gt;&lt;script&gt;no&lt;/script&gt;")).alias("content"), url.alias("absolute_url"),
            F.when(F.col("o_orderstatus") == "O", F.array(F.struct(F.lit(7).alias("id"), F.lit("Dept").alias("name")))).alias("departments"),
            F.when(F.col("o_totalprice") > 200_000, F.array(F.struct((low * 100 + 50).alias("min_cents"), (low * 100 + 100).alias("max_cents"), F.lit("USD").alias("currency_type"), F.lit("Base").alias("title")))).alias("pay_input_ranges"),
        )
    )
    answers = o.select(key.alias("source_job_id"), F.lit("acme").alias("tenant"), F.lit("global").alias("region"), url.alias("canonical_url"), url.alias("apply_url"), body.alias("body"))
    told = details.evidence_or_error(details.greenhouse_details(answers))
    return told.where("path is null or path <> '/descriptionHtml'").select("source_job_id", "path", "value", "origin", "pointer")


@query("""
WITH o AS (SELECT o_custkey AS id, list({'key': o_orderkey, 'status': o_orderstatus, 'priority': o_orderpriority} ORDER BY o_orderpriority, o_orderkey) AS orders FROM orders GROUP BY 1),
s AS (SELECT c_custkey AS id, list({'supplier': s_name} ORDER BY s_name) AS suppliers FROM customer JOIN supplier ON s_nationkey = c_nationkey AND c_acctbal < 0 GROUP BY 1)
SELECT c_custkey AS id, to_json({'id': c_custkey, 'name': c_name, 'segment': c_mktsegment, 'orders': coalesce(orders, []), 'suppliers': coalesce(suppliers, [])})::VARCHAR AS record FROM customer LEFT JOIN o ON o.id = c_custkey LEFT JOIN s ON s.id = c_custkey
""")
def detail_documents(spark, d):
    c = t(spark, d, "customer")
    orders = t(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    suppliers = t(spark, d, "supplier").select(F.col("s_nationkey").alias("id"), F.col("s_name").alias("supplier"))
    items = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.when(F.col("c_acctbal") < 0, F.col("c_nationkey")).alias("near"))
    return search.detail_documents(items, {"orders": (orders, ["priority", "key"]), "suppliers": (suppliers, ["supplier"])}, {"suppliers": "near"})
