"""The registered queries of the discovery engine, each a thin plan over its operators, with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievewright.functions import digests, redaction, text, urls
from sievewright.operators import lifecycle, queueing, relational, resolve, search, validate
from sievewright.sources import boards
from sievewright.streaming import twins

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def stamp(c) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def money(c) -> F.Column:
    return F.round(c, 2)


# ---- search -----------------------------------------------------------------------------------------------------------


def _items(spark: SparkSession, d: str) -> DataFrame:
    orders, customer, nation = t(spark, d, "orders"), t(spark, d, "customer"), t(spark, d, "nation")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))


@query("""
WITH best AS (SELECT l_orderkey, max(l_extendedprice) AS best_price, count(*)::BIGINT AS lines FROM lineitem GROUP BY 1)
SELECT o_orderkey, c_name, n_name, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS first_seen, round(best_price, 2) AS best_price, lines
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN best ON l_orderkey = o_orderkey
WHERE o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1995-06-01'
  AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o_orderkey AND l_quantity >= 10)
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 26
""")
def search_page_first_seen(spark, d):
    lines = t(spark, d, "lineitem")
    best = lines.groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("best_price"), F.count("*").alias("lines"))
    items = _items(spark, d).where((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") >= F.lit("1995-06-01").cast("timestamp_ntz")))
    items = items.join(lines.where("l_quantity >= 10").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    page = relational.keyset_page(items.join(best, F.col("o_orderkey") == F.col("l_orderkey"), "left"), F.col("o_orderdate"), "o_orderkey", 25)
    return page.select("o_orderkey", "c_name", "n_name", stamp("o_orderdate").alias("first_seen"), money("best_price").alias("best_price"), "lines")


@query("""
SELECT o_orderkey, round(coalesce(o_totalprice, -1), 2) AS price FROM orders
WHERE (coalesce(o_totalprice, -1), o_orderkey) < (200000.0, 500) ORDER BY coalesce(o_totalprice, -1) DESC, o_orderkey DESC LIMIT 26
""")
def search_page_value_keyset(spark, d):
    page = relational.keyset_page(t(spark, d, "orders").withColumn("p", F.coalesce("o_totalprice", F.lit(-1.0))), F.col("p"), "o_orderkey", 25, (200000.0, 500))
    return page.select("o_orderkey", money("p").alias("price"))


@query("""
SELECT c_custkey, c_name FROM customer WHERE (c_name ILIKE '%1%' OR c_mktsegment ILIKE '%BUILD%') AND (lower(c_name), c_custkey) > ('customer#000000050', 50)
ORDER BY lower(c_name), c_custkey LIMIT 26
""")
def company_page_asc_keyset(spark, d):
    known = t(spark, d, "customer").where(search.contains(F.col("c_name"), "1") | search.contains(F.col("c_mktsegment"), "BUILD"))
    return relational.keyset_page(known, F.lower("c_name"), "c_custkey", 25, ("customer#000000050", 50), descending=False).select("c_custkey", "c_name")


@query("""
SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_extendedprice >= 30000)
""")
def facet_semi_join(spark, d):
    rich = t(spark, d, "lineitem").where("l_returnflag = 'R' and l_extendedprice >= 30000").select(F.col("l_orderkey").alias("o_orderkey"))
    return t(spark, d, "orders").select("o_orderkey").join(rich, "o_orderkey", "left_semi")


@query("""
SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount >= 0.09)
""")
def facet_exists_or(spark, d):
    wanted = "SELECT o_orderkey FROM {orders} WHERE o_orderpriority = '1-URGENT' OR EXISTS (SELECT 1 FROM {lines} WHERE l_orderkey = o_orderkey AND l_discount >= 0.09)"
    return spark.sql(wanted, orders=t(spark, d, "orders"), lines=t(spark, d, "lineitem"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50)")
def facet_in_subquery(spark, d):
    used = t(spark, d, "lineitem").where("l_quantity = 50").select(F.col("l_suppkey").alias("s_suppkey"))
    return t(spark, d, "supplier").join(used, "s_suppkey", "left_semi").select("s_suppkey", "s_name")


@query("""
WITH tok AS (SELECT doc_id, [x for x in regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+') if x <> ''] AS w FROM documents)
SELECT doc_id, round(len([x for x in w if x IN ('the', 'idiot', 'scum')])::DOUBLE / len(w), 6) AS relevance FROM tok
WHERE (list_contains(w, 'the') AND list_contains(w, 'idiot') AND NOT list_contains(w, 'clown')) OR list_contains(w, 'scum')
""")
def fulltext_match(spark, d):
    tokens = t(spark, d, "documents").select("doc_id", text.words(F.col("text")).alias("w"))
    q = "the idiot -clown or scum"
    return tokens.where(search.matches(F.col("w"), q)).select("doc_id", search.rank(F.col("w"), q).alias("relevance"))


@query("""
WITH p AS (SELECT DISTINCT p_name FROM part),
g AS (SELECT p_name, list_distinct(flatten([[substr('  ' || w || ' ', i::INTEGER, 3) for i in range(1, len(w) + 2)] for w in regexp_split_to_array(lower(p_name), '[^\\p{L}\\p{N}]+') if w <> ''])) AS s FROM p)
SELECT a.p_name AS a, b.p_name AS b, round(len(list_intersect(a.s, b.s))::DOUBLE / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))), 4) AS score
FROM g a JOIN g b ON a.p_name < b.p_name WHERE round(len(list_intersect(a.s, b.s))::DOUBLE / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))), 4) >= 0.3
""")
def trigram_similarity(spark, d):
    names = t(spark, d, "part").select("p_name").distinct().withColumn("s", text.trigrams(F.col("p_name")))
    return resolve.similar_pairs(names, "p_name", "s", search.FUZZY, "jaccard")


@query()
def search_items_fuzzy(spark, d):
    items = _items(spark, d).select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("c_custkey").alias("company"), F.col("c_name").alias("company_name"), text.words(F.concat_ws(" ", "o_orderpriority", "n_name")).alias("tokens"), F.lit("active").alias("status"), F.col("o_orderdate").alias("first_seen"), F.col("o_orderdate").alias("posted"))
    amounts = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_extendedprice").alias("amount"), F.col("l_returnflag").alias("currency"), F.col("l_linestatus").alias("period"))
    filters = search.Filters(q="urgent or high", least_compensation=20_000, currency="N", sort="relevance", limit=50)
    return search.search(items, filters, amounts).select("id", "title", "relevance", "best_amount")


# ---- joins ------------------------------------------------------------------------------------------------------------


@query("""
SELECT DISTINCT user_id FROM events e WHERE ts < TIMESTAMP '2024-01-08' AND NOT EXISTS (
  SELECT 1 FROM events f WHERE f.user_id = e.user_id AND f.ts >= TIMESTAMP '2024-01-08' AND f.ts < TIMESTAMP '2024-01-09')
""")
def missing_anti_join(spark, d):
    events = t(spark, d, "events")
    day = events.where((F.col("ts") >= F.lit("2024-01-08").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-09").cast("timestamp_ntz"))).select("user_id")
    return events.where(F.col("ts") < F.lit("2024-01-08").cast("timestamp_ntz")).select("user_id").distinct().join(day, "user_id", "left_anti")


@query("""
SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS price FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS n FROM lineitem) WHERE n = 1
""")
def lateral_top1_line(spark, d):
    best = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min_by(F.struct("l_linenumber", "l_extendedprice"), F.struct(-F.col("l_extendedprice"), F.col("l_linenumber"))).alias("b"))
    return best.select("l_orderkey", "b.l_linenumber", money("b.l_extendedprice").alias("price"))


@query("""
SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id
""")
def lateral_latest_event(spark, d):
    last = t(spark, d, "events").groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("e"))
    return last.select("user_id", "e.event_id", "e.event_type")


@query("""
SELECT p_partkey, p_name, l_orderkey, l_linenumber FROM part JOIN (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_shipdate, l_orderkey, l_linenumber) AS n FROM lineitem) ON l_partkey = p_partkey WHERE n = 1
""")
def best_evidence_inner(spark, d):
    best = relational.top_rows(t(spark, d, "lineitem"), ["l_partkey"], [F.col("l_quantity").desc(), F.col("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")])
    return t(spark, d, "part").join(best, F.col("p_partkey") == F.col("l_partkey")).select("p_partkey", "p_name", "l_orderkey", "l_linenumber")


@query("""
WITH s AS (SELECT user_id, event_type, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1, 2, date_trunc('hour', ts))
SELECT x.event_type, x.user_id AS left_user, y.user_id AS right_user, strftime(x.a, '%Y-%m-%d %H:%M:%S') AS began FROM s x JOIN s y ON x.event_type = y.event_type AND x.user_id < y.user_id AND x.a <= y.b AND y.a <= x.b
""")
def interval_overlap_join(spark, d):
    spans = t(spark, d, "events").groupBy("user_id", "event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour")).agg(F.min("ts").alias("start"), F.max("ts").alias("until")).drop("hour")
    spans = spans.withColumn("began", stamp("start"))
    # few spans last longer than a minute: bins of minutes compare little but what meets
    pairs = relational.overlap_join(spans, spans, ["event_type"], bin_seconds=60).where("user_id < user_id_r")
    return pairs.select("event_type", F.col("user_id").alias("left_user"), F.col("user_id_r").alias("right_user"), "began")


@query("""
SELECT DISTINCT s_suppkey, c_custkey FROM supplier JOIN customer ON (s_nationkey = c_nationkey AND c_acctbal > 9000) OR (s_suppkey = c_custkey)
""")
def disjunctive_union_join(spark, d):
    s, c = t(spark, d, "supplier"), t(spark, d, "customer")
    return relational.either_join(s, c.where("c_acctbal > 9000"), c, ("s_suppkey", "c_custkey"), ("s_nationkey", "c_nationkey"))


@query("""
SELECT c_custkey, coalesce(count(o_orderkey), 0)::BIGINT AS urgent, round(coalesce(sum(o_totalprice), 0), 2) AS total
FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY c_custkey
""")
def left_filter_on_clause(spark, d):
    urgent = t(spark, d, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))
    return t(spark, d, "customer").select("c_custkey").join(urgent, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("urgent"), money(F.coalesce("s", F.lit(0.0))).alias("total"))


@query("SELECT r_name, n_name FROM region CROSS JOIN nation WHERE r_regionkey = 1 AND n_nationkey = 3")
def crossjoin_pair(spark, d):
    return t(spark, d, "region").where("r_regionkey = 1").select("r_name").crossJoin(t(spark, d, "nation").where("n_nationkey = 3").select("n_name"))


# ---- aggregates and windows -------------------------------------------------------------------------------------------


@query("""
SELECT l_orderkey, CASE WHEN bool_or(l_linestatus = 'O') THEN 'active' ELSE 'closed' END AS status FROM lineitem GROUP BY l_orderkey
""")
def status_rollup_dominance(spark, d):
    lines = t(spark, d, "lineitem").withColumn("s", F.when(F.col("l_linestatus") == "O", "active").otherwise("closed"))
    return lines.groupBy("l_orderkey").agg(relational.dominance("s", ["active", "possibly_closed", "closed"]).alias("status"))


@query("""
SELECT event_type, count(*) FILTER (WHERE value > 50)::BIGINT AS high, count(*) FILTER (WHERE value <= 50)::BIGINT AS low,
  strftime(min(ts) FILTER (WHERE value > 50), '%Y-%m-%d %H:%M:%S') AS oldest_high FROM events GROUP BY event_type
""")
def queue_health_filtered_counts(spark, d):
    high = F.col("value") > 50
    return t(spark, d, "events").groupBy("event_type").agg(F.count_if(high).alias("high"), F.count_if(F.col("value") <= 50).alias("low"), stamp(F.min(F.when(high, F.col("ts")))).alias("oldest_high"))


@query("SELECT event_type, count(DISTINCT user_id)::BIGINT AS users, count(*)::BIGINT AS events, max(event_id) AS last_id FROM events GROUP BY event_type")
def distinct_counts(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count("*").alias("events"), F.max("event_id").alias("last_id"))


@query("""
SELECT l_orderkey, string_agg(l_linenumber || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS lines,
  coalesce(string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) FILTER (WHERE l_returnflag = 'R'), '') AS returned FROM lineitem GROUP BY l_orderkey
""")
def ordered_json_agg(spark, d):
    item = F.struct("l_linenumber", "l_returnflag")
    grouped = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("x"), F.array_sort(F.collect_list(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber")))).alias("r"))
    return grouped.select("l_orderkey", F.array_join(F.transform("x", lambda e: F.concat_ws(":", e["l_linenumber"], e["l_returnflag"])), ",").alias("lines"), F.array_join("r", ",").alias("returned"))


@query("SELECT md5(text) AS digest, count(*)::BIGINT AS rows FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_having(spark, d):
    return validate.duplicates(t(spark, d, "documents").select(F.md5("text").alias("digest")), ["digest"])


@query("""
SELECT (SELECT count(*) FROM orders)::BIGINT AS orders, (SELECT count(DISTINCT o_custkey) FROM orders)::BIGINT AS buyers,
  (SELECT count(*) FROM customer)::BIGINT AS customers, EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'P') AS any_pending
""")
def scalar_subquery_metrics(spark, d):
    o = t(spark, d, "orders").agg(F.count("*").alias("orders"), F.count_distinct("o_custkey").alias("buyers"), F.coalesce(F.bool_or(F.col("o_orderstatus") == "P"), F.lit(False)).alias("any_pending"))
    return o.crossJoin(t(spark, d, "customer").agg(F.count("*").alias("customers"))).select("orders", "buyers", "customers", "any_pending")


@query("SELECT source, sha256(string_agg(h, chr(10) ORDER BY h)) AS board_hash FROM (SELECT source, sha256(text) AS h FROM documents) GROUP BY source")
def board_hash(spark, d):
    return relational.ordered_hash(t(spark, d, "documents").select("source", F.sha2("text", 256).alias("h")), "source", "h", "board_hash")


@query("SELECT user_id, least(1.0::DOUBLE, count(DISTINCT event_type) / 6.0::DOUBLE) AS coverage FROM events GROUP BY user_id")
def provenance_coverage(spark, d):
    return t(spark, d, "events").groupBy("user_id").agg(F.least(F.lit(1.0), F.count_distinct("event_type") / F.lit(6.0)).alias("coverage"))


@query("SELECT event_id, (10 + row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS sequence FROM events")
def sequence_allocator(spark, d):
    own = W.partitionBy("user_id").orderBy("ts", "event_id")
    return t(spark, d, "events").select("event_id", (F.lit(10) + F.row_number().over(own)).cast("long").alias("sequence"))


SCANS_SQL = """
users AS (SELECT DISTINCT user_id FROM events), buckets AS (SELECT DISTINCT floor(epoch(ts) / 21600)::BIGINT AS b FROM events),
hits AS (SELECT DISTINCT user_id, floor(epoch(ts) / 21600)::BIGINT AS b FROM events),
scans AS (SELECT u.user_id, b.b, h.b IS NOT NULL AS seen FROM users u CROSS JOIN buckets b LEFT JOIN hits h ON h.user_id = u.user_id AND h.b = b.b),
isl AS (SELECT *, sum(seen::INT) OVER (PARTITION BY user_id ORDER BY b) AS island FROM scans),
num AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY b) - 1 AS n, b * 21600 - min(CASE WHEN NOT seen THEN b * 21600 END) OVER (PARTITION BY user_id, island ORDER BY b) AS since FROM isl WHERE island > 0),
mark AS (SELECT *, NOT seen AND n >= 2 AND since >= 43200 AS closing FROM num)
"""


def _scans(spark, d) -> DataFrame:
    """Users as listings, six-hour buckets of the events as complete scans of all of them."""
    e = t(spark, d, "events").select("user_id", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 21_600).cast("long").alias("b"))
    grid = e.select("user_id").distinct().crossJoin(F.broadcast(e.select("b").distinct()))
    hits = e.distinct().withColumn("seen", F.lit(True))
    return grid.join(hits, ["user_id", "b"], "left").select("user_id", "b", F.coalesce("seen", F.lit(False)).alias("seen"), F.timestamp_seconds(F.col("b") * 21_600).alias("at"))


@query(f"""
WITH {SCANS_SQL}
SELECT user_id, b, CASE WHEN seen THEN 'active' WHEN bool_or(closing) OVER (PARTITION BY user_id, island ORDER BY b) THEN 'closed' ELSE 'possibly_closed' END AS status,
  (CASE WHEN seen THEN 0 ELSE least(n, coalesce(min(CASE WHEN closing THEN n END) OVER (PARTITION BY user_id, island ORDER BY b), n)) END)::INTEGER AS misses
FROM mark
""")
def lifecycle_closure(spark, d):
    return lifecycle.lifecycle(_scans(spark, d), "user_id", "at", "seen", 43_200).select("user_id", "b", "status", "misses")


@query(f"""
WITH {SCANS_SQL}
SELECT user_id, island::BIGINT AS island, count(*) FILTER (WHERE NOT seen)::BIGINT AS misses, min(CASE WHEN NOT seen THEN b END) AS first_missing FROM isl WHERE island > 0 GROUP BY 1, 2 HAVING count(*) FILTER (WHERE NOT seen) > 0
""")
def miss_run_islands(spark, d):
    own = W.partitionBy("user_id").orderBy("b")
    isl = _scans(spark, d).withColumn("island", F.sum(F.col("seen").cast("int")).over(own)).where("island > 0")
    return isl.groupBy("user_id", "island").agg(F.count_if(~F.col("seen")).alias("misses"), F.min(F.when(~F.col("seen"), F.col("b"))).alias("first_missing")).where("misses > 0")


@query("""
WITH s AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'error' THEN 'blocked' WHEN 'purchase' THEN 'truncated' ELSE 'complete' END AS reason,
    CASE WHEN value < 20 THEN 0 ELSE 10 END AS n, value > 95 AS tripped,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
m AS (SELECT user_id, max(i) AS latest, coalesce(max(i) FILTER (WHERE reason = 'complete'), 0) AS good, coalesce(max(i) FILTER (WHERE reason = 'complete' AND n > 0), 0) AS full_ FROM s GROUP BY 1)
SELECT user_id, max(CASE WHEN i = latest THEN CASE WHEN tripped THEN 'quarantined' WHEN reason = 'complete' THEN 'healthy' WHEN reason = 'blocked' THEN 'blocked' ELSE 'degraded' END END) AS health,
  max(CASE WHEN i = latest THEN n END)::INTEGER AS last_job_count, strftime(max(ts) FILTER (WHERE reason = 'complete'), '%Y-%m-%d %H:%M:%S') AS last_complete_at,
  strftime(max(ts) FILTER (WHERE n > 0), '%Y-%m-%d %H:%M:%S') AS last_nonempty_at, count(*) FILTER (WHERE i > good)::BIGINT AS consecutive_failures,
  count(*) FILTER (WHERE reason = 'complete' AND n = 0 AND i > full_)::BIGINT AS complete_empty_scans
FROM s JOIN m USING (user_id) GROUP BY user_id
""")
def source_health(spark, d):
    kind, value = F.col("event_type"), F.col("value")
    reason = F.when(kind == "error", "blocked").when(kind == "purchase", "truncated").otherwise("complete")
    scans = t(spark, d, "events").select("user_id", "event_id", "ts", reason.alias("reason"), F.when(value < 20, 0).otherwise(10).alias("n"), (value > 95).alias("tripped"))
    out = lifecycle.source_health(scans, "user_id", ["ts", "event_id"], "reason", "n", "tripped")
    return out.withColumn("last_complete_at", stamp("last_complete_at")).withColumn("last_nonempty_at", stamp("last_nonempty_at"))


@query("""
WITH day AS (SELECT event_type, ts::DATE AS dt, count(*) AS n FROM events GROUP BY 1, 2),
l AS (SELECT *, lag(n) OVER (PARTITION BY event_type ORDER BY dt) AS p, 12 AS active FROM day)
SELECT event_type, dt::VARCHAR AS day, n::BIGINT AS observed, CASE
  WHEN greatest(coalesce(p, 0), active) >= 10 AND n = 0 THEN 'suspicious_empty'
  WHEN greatest(coalesce(p, 0), active) >= 10 AND round((greatest(coalesce(p, 0), active) - n)::DOUBLE / greatest(coalesce(p, 0), active), 4) >= 0.9 THEN 'count_collapse'
  WHEN greatest(0, active - n) >= 50 AND 2 * greatest(0, active - n) >= active THEN 'closure_spike' END AS reason FROM l
""")
def count_collapse_breaker(spark, d):
    day = t(spark, d, "events").groupBy("event_type", F.col("ts").cast("date").alias("dt")).agg(F.count("*").alias("n"))
    p = F.lag("n").over(W.partitionBy("event_type").orderBy("dt"))
    return day.withColumn("p", p).select("event_type", F.col("dt").cast("string").alias("day"), F.col("n").alias("observed"), lifecycle.breaker(F.col("p"), F.col("n"), F.lit(12)).alias("reason"))


@query("""
WITH e AS (SELECT event_id, event_type, user_id, floor(epoch(ts))::BIGINT AS s FROM events WHERE event_type = 'error')
SELECT a.event_id, count(DISTINCT b.user_id)::INTEGER AS sources, count(DISTINCT b.user_id) >= 3 AS escalates
FROM e a JOIN e b ON b.s BETWEEN a.s - 900 AND a.s GROUP BY a.event_id
""")
def breaker_escalation_15m(spark, d):
    trips = t(spark, d, "events").where("event_type = 'error'").withColumn("at", F.col("ts").cast("timestamp"))
    return lifecycle.escalated(trips, "event_type", "user_id", "at").select("event_id", "sources", "escalates")


@query("""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 AS is_new,
  lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM event_type AS changed FROM events),
n AS (SELECT *, sum(is_new::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM o)
SELECT event_id, is_new, changed, (first_value(nth) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id))::BIGINT AS version FROM n
""")
def scd_versions(spark, d):
    return lifecycle.versions(t(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "is_new", "changed", "version")


@query("""
WITH day AS (SELECT DISTINCT user_id, date_diff('day', DATE '2024-01-01', ts::DATE) AS n FROM events),
g AS (SELECT *, lag(n) OVER (PARTITION BY user_id ORDER BY n) AS p FROM day)
SELECT n::BIGINT AS scan, count(*) FILTER (WHERE p IS NULL)::BIGINT AS added, count(*) FILTER (WHERE n - p > 1)::BIGINT AS reopened, count(*) FILTER (WHERE n - p = 1)::BIGINT AS kept FROM g GROUP BY n
""")
def scan_counters(spark, d):
    day = t(spark, d, "events").select("user_id", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("n")).distinct()
    g = day.withColumn("p", F.lag("n").over(W.partitionBy("user_id").orderBy("n")))
    return g.groupBy(F.col("n").cast("long").alias("scan")).agg(F.count_if(F.col("p").isNull()).alias("added"), F.count_if(F.col("n") - F.col("p") > 1).alias("reopened"), F.count_if(F.col("n") - F.col("p") == 1).alias("kept"))


@query("""
WITH o AS (SELECT user_id, max(event_id) AS v FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1), n AS (SELECT user_id, max(event_id) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1)
SELECT user_id, CASE WHEN n.v IS NOT NULL AND (o.v IS NULL OR n.v > o.v) THEN n.v ELSE o.v END AS event_id FROM o FULL JOIN n USING (user_id)
""")
def upsert_latest(spark, d):
    events, cut = t(spark, d, "events"), F.lit("2024-01-15").cast("timestamp_ntz")
    old = events.where(F.col("ts") < cut).groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    new = events.where(F.col("ts") >= cut).groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    return relational.upsert(old, new, ["user_id"], F.col("new_event_id") > F.col("old_event_id"))


@query("SELECT user_id, max(value) AS priority, arg_min(event_type, (ts, event_id)) AS payload, count(*)::BIGINT AS requests FROM events GROUP BY user_id")
def pending_upsert_greatest(spark, d):
    return queueing.pending_upsert(t(spark, d, "events"), "user_id", "value", ["ts", "event_id"], "event_type")


# ---- queue ------------------------------------------------------------------------------------------------------------


@query("""
WITH c AS (SELECT event_id, user_id, event_type, ts, floor(value / 50)::VARCHAR AS h FROM events)
SELECT event_id, CASE WHEN row_number() OVER w = 1 THEN 'accepted' WHEN first_value(h) OVER w = h THEN 'replayed' ELSE 'rejected' END AS outcome FROM c WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)
""")
def idempotent_commands(spark, d):
    commands = t(spark, d, "events").withColumn("h", F.floor(F.col("value") / 50).cast("string"))
    return queueing.idempotent(commands, ["user_id", "event_type"], ["ts", "event_id"], "h").select("event_id", "outcome")


@query("""
WITH e AS (SELECT *, event_type = 'signup' AS is_claim, (event_id % 7)::BIGINT AS gen FROM events),
f AS (SELECT *, max(CASE WHEN is_claim THEN gen END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS in_force FROM e)
SELECT event_id, in_force, coalesce(gen = in_force, false) AS current FROM f
""")
def fencing_generation(spark, d):
    events = t(spark, d, "events").withColumn("gen", F.col("event_id") % 7).withColumn("is_claim", F.col("event_type") == "signup")
    return queueing.fenced(events, "user_id", ["ts", "event_id"], "gen", "is_claim").select("event_id", "in_force", "current")


@query("""
WITH e AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'signup' THEN 'claim' WHEN 'purchase' THEN 'succeed' WHEN 'error' THEN 'fail' ELSE 'heartbeat' END AS kind, event_id % 2 AS gen FROM events),
l AS (SELECT *, sum(CASE WHEN kind = 'claim' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS lease FROM e),
n AS (SELECT *, lease > 0 AND gen = first_value(gen) OVER (PARTITION BY user_id, lease ORDER BY ts, event_id) AS named FROM l),
g AS (SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 172800000000, false) AS late, coalesce(bool_or(kind IN ('succeed', 'fail')) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ended FROM n WINDOW w AS (PARTITION BY user_id, lease, named ORDER BY ts, event_id)),
a AS (SELECT *, named AND NOT ended AND NOT bool_or(late) OVER (PARTITION BY user_id, lease, named ORDER BY ts, event_id) AS ok FROM g)
SELECT event_id, CASE WHEN ok THEN 'accepted' ELSE 'stale' END AS outcome, strftime(CASE WHEN ok AND kind IN ('claim', 'heartbeat') THEN ts + INTERVAL 2 DAY END, '%Y-%m-%d %H:%M:%S') AS expires_at FROM a
""")
def lease_outcomes(spark, d):
    names = F.col("event_type")
    kind = F.when(names == "signup", "claim").when(names == "purchase", "succeed").when(names == "error", "fail").otherwise("heartbeat")
    events = t(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), (F.col("event_id") % 2).alias("gen"))
    out = queueing.lease_events(events, "user_id", ["ts", "event_id"], "ts", "kind", "gen", 172_800)
    return out.select("event_id", "outcome", stamp("expires_at").alias("expires_at"))


@query("SELECT event_id, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id)::INTEGER AS nth, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) <= 3 AS allowed FROM events")
def rate_limit_window(spark, d):
    return queueing.rate_limited(t(spark, d, "events"), "event_type", "ts", ["ts", "event_id"], 3, "hour").select("event_id", "nth", "allowed")


@query("""
SELECT user_id, floor(epoch(ts) / 43200)::BIGINT AS bucket, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2
""")
def cadence_bucket_dedupe(spark, d):
    e = t(spark, d, "events").withColumn("bucket", digests.cadence_bucket(F.col("ts").cast("timestamp"), 43_200))
    return e.groupBy("user_id", "bucket").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("SELECT c_custkey, floor(4320000.0::DOUBLE * ('0x' || substr(sha256(c_custkey || ':' || (c_custkey % 10)), 1, 8))::BIGINT / 4294967295)::BIGINT AS jitter_ms FROM customer")
def jitter_hash(spark, d):
    return t(spark, d, "customer").select("c_custkey", digests.jitter(F.col("c_custkey"), F.col("c_custkey") % 10, 43_200).alias("jitter_ms"))


@query("SELECT o_orderkey, floor(least(3600000.0::DOUBLE, 5000 * pow(2.0::DOUBLE, greatest(0, (o_orderkey % 15) - 1))) * 0.5)::BIGINT AS wait_ms FROM orders")
def backoff_schedule(spark, d):
    return t(spark, d, "orders").select("o_orderkey", digests.backoff(F.col("o_orderkey") % 15, F.lit(0.5)).alias("wait_ms"))


@query("""
SELECT c_custkey, round(c_acctbal, 2) AS balance FROM customer WHERE c_acctbal > 0 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000) ORDER BY c_acctbal, c_custkey LIMIT 100
""")
def due_sources(spark, d):
    evidence = t(spark, d, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    due = t(spark, d, "customer").where("c_acctbal > 0").join(evidence, "c_custkey", "left_semi")
    return due.orderBy("c_acctbal", "c_custkey").limit(100).select("c_custkey", money("c_acctbal").alias("balance"))


@query("""
SELECT o_orderkey AS id, o_orderstatus AS was, (o_orderkey % 3 + 1)::BIGINT AS attempt, (o_orderkey % 5 + 1)::BIGINT AS generation FROM orders
WHERE o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1998-01-01' ORDER BY o_orderdate, o_orderpriority DESC, o_orderkey LIMIT 100
""")
def queue_claim(spark, d):
    jobs = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "ready").otherwise("done").alias("status"), F.col("o_orderstatus").alias("was"), F.col("o_orderdate").cast("timestamp").alias("scheduled_at"), F.col("o_orderpriority").alias("priority"), (F.col("o_orderkey") % 3).alias("attempt"), (F.col("o_orderkey") % 5).alias("generation"))
    return queueing.claim(jobs, "1998-01-01", 100).select("id", "was", "attempt", "generation")


@query("""
SELECT doc_id, 'missing' AS state FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
UNION ALL SELECT DISTINCT doc_id, 'orphan' FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE l.doc_id = d.doc_id)
""")
def orphan_reconcile(spark, d):
    return queueing.reconcile(t(spark, d, "documents").select("doc_id"), t(spark, d, "labels").select("doc_id"), "doc_id")


@query("""
SELECT o_orderkey AS id, o_orderstatus AS was, 'deleting' AS state FROM orders
WHERE o_orderdate <= TIMESTAMP '1996-01-01' AND (o_orderstatus IN ('F', 'P') OR o_orderstatus = 'O' AND o_orderdate + INTERVAL 1 DAY < TIMESTAMP '1995-12-31 23:45:00')
ORDER BY o_orderdate, o_orderkey LIMIT 100
""")
def retention_due(spark, d):
    at = F.col("o_orderdate").cast("timestamp")
    state = F.when(F.col("o_orderstatus") == "O", "deleting").when(F.col("o_orderstatus") == "P", "delete_failed").otherwise("present")
    artifacts = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("was"), state.alias("state"), at.alias("created_at"), at.alias("deletion_due_at"), (at + F.expr("interval 1 day")).alias("deletion_started_at"))
    return queueing.retention_claim(artifacts, "1996-01-01", 100).select("id", "was", "state")


# ---- text, URLs, identity ---------------------------------------------------------------------------------------------


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS name FROM part")
def title_normalize_ascii(spark, d):
    return t(spark, d, "part").select("p_partkey", text.ascii_name(F.col("p_name")).alias("name"))


@query()
def title_normalize_unicode(spark, d):
    return t(spark, d, "documents").select("doc_id", text.search_title(F.col("text")).alias("title"), text.company_name(F.col("text")).alias("name"))


@query("""
WITH p AS (SELECT DISTINCT ' ' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) || ' ' AS n, p_name FROM part),
g AS (SELECT p_name, list_distinct([substr(n, i::INTEGER, 2) for i in range(1, len(n))]) AS s FROM p)
SELECT a.p_name AS a, b.p_name AS b, round(2.0::DOUBLE * len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s)), 4) AS score FROM g a JOIN g b ON a.p_name < b.p_name
WHERE round(2.0::DOUBLE * len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s)), 4) >= 0.65
""")
def company_name_dice(spark, d):
    names = t(spark, d, "part").select("p_name").distinct().withColumn("s", text.bigrams(text.ascii_name(F.col("p_name"))))
    return resolve.similar_pairs(names, "p_name", "s", resolve.NAME_REVIEW)


@query("""
WITH l AS (SELECT doc_id, lang, list_distinct([x for x in regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+') if x <> '']) AS s FROM documents)
SELECT a.doc_id AS a, b.doc_id AS b, round(len(list_intersect(a.s, b.s))::DOUBLE / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))), 4) AS score
FROM l a JOIN l b ON a.lang = b.lang AND a.doc_id < b.doc_id AND len(a.s) > 0 AND len(b.s) > 0
WHERE round(len(list_intersect(a.s, b.s))::DOUBLE / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))), 4) >= 0.6
""")
def title_jaccard(spark, d):
    titles = t(spark, d, "documents").select("doc_id", "lang", "text")
    return resolve.similar_pairs(titles, "doc_id", text.word_set(F.col("text")), resolve.TITLE_REVIEW, "jaccard", ["lang"])


@query("""
SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) AS host, regexp_replace(regexp_replace(url, '#.*$', ''), '\\?.*$', '?[REDACTED]') AS redacted, substr(sha256(url), 1, 16) AS path_hash FROM pages
""")
def url_parts(spark, d):
    return t(spark, d, "pages").select("page_id", urls.host(F.col("url")).alias("host"), urls.redacted(F.col("url")).alias("redacted"), urls.path_hash(F.col("url")).alias("path_hash"))


@query("""
WITH p AS (SELECT page_id, string_split(url, '://') AS s FROM pages),
q AS (SELECT page_id, s[1] AS scheme, string_split(s[2], '/') AS steps FROM p),
r AS (SELECT page_id, scheme, steps[1] AS h, steps[2] AS lang, split_part(split_part(steps[3], '#', 1), '?', 1) AS leaf, split_part(split_part(steps[len(steps)], '#', 1), '?', 2) AS search FROM q),
k AS (SELECT *, [x for x in string_split(search, '&') if x <> '' AND split_part(x, '=', 1) NOT IN ('ref', 'utm_source')] AS kept, split_part(leaf, '.', 1)::INTEGER % 3 AS turn FROM r)
SELECT page_id, CASE WHEN scheme = 'https' THEN 'https://' || h || CASE turn WHEN 1 THEN ':8443' ELSE '' END || '/' || lang || '/' || leaf || '?' || array_to_string(list_sort(kept || ['a=1', 'z=%26+b']), '&') END AS canonical,
  CASE WHEN scheme <> 'https' THEN 'normalized_url_invalid' END AS error, scheme || '://' || h || CASE turn WHEN 1 THEN ':8443' WHEN 2 THEN CASE scheme WHEN 'http' THEN ':443' ELSE '' END ELSE '' END AS origin FROM k
""")
def url_canonical(spark, d):
    # a port of its own, the scheme's, or none; segments that lead nowhere; parameters to be dropped, sorted and spelled anew
    parts = [F.regexp_extract("url", r"^([a-z]+)://([^/]+)/([^/]+)/(\d+(?:\.html)?)/?(?:\?([^#]*))?", i) for i in range(1, 6)]
    turn = F.substring_index(parts[3], ".", 1).cast("int") % 3
    where = F.concat(F.upper(parts[1]), F.when(turn == 1, ":8443").when(turn == 2, ":443").otherwise(""))
    given = F.concat(parts[0], F.lit("://"), where, F.lit("//x/../"), parts[2], F.lit("/./"), parts[3], F.lit("/?utm_source=q&z=%26%20b&"), parts[4], F.lit("&token=s&a=1#top"))
    c = urls.canonical(F.col("given"))
    return t(spark, d, "pages").withColumn("given", given).select("page_id", c.alias("canonical"), F.when(c.isNull(), "normalized_url_invalid").alias("error"), urls.origin(F.col("given")).alias("origin"))


@query("""
WITH s AS (SELECT s_suppkey, s_suppkey % 4 AS k, regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') AS n FROM supplier)
SELECT s_suppkey, CASE k WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'ashby' END AS vendor, CASE WHEN k < 3 THEN n END AS tenant, CASE k WHEN 1 THEN 'eu' END AS region, CASE k WHEN 1 THEN 100 WHEN 3 THEN NULL ELSE 1 END::INTEGER AS requests FROM s
""")
def url_vendor_plan(spark, d):
    base = t(spark, d, "supplier").select("s_suppkey", F.element_at(F.array(F.lit("https://boards.greenhouse.io/"), F.lit("https://jobs.eu.lever.co/"), F.lit("https://jobs.ashbyhq.com/"), F.lit("https://example.com/")), (F.col("s_suppkey") % 4 + 1).cast("int")).alias("p"), F.regexp_replace(F.lower("s_name"), "[^a-z0-9]", "").alias("n"))
    found = base.withColumn("v", urls.vendor(F.concat("p", "n")))
    return found.select("s_suppkey", "v.vendor", "v.tenant", "v.region", F.size(urls.enumeration_urls(F.col("v.vendor"), F.col("v.tenant"), F.col("v.region"))).alias("requests"))


@query("""
WITH c AS (SELECT c_custkey, (c_custkey * 7919) % 256 AS a, (c_custkey * 104729) % 256 AS b FROM customer)
SELECT c_custkey, NOT (a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 198 AND b IN (18, 19))) AS is_public FROM c
""")
def public_addresses(spark, d):
    address = F.concat_ws(".", (F.col("c_custkey") * 7919) % 256, (F.col("c_custkey") * 104729) % 256, F.lit(77), F.lit(9))
    return t(spark, d, "customer").select("c_custkey", urls.is_public_v4(address).alias("is_public"))


@query()
def html_sanitize(spark, d):
    page = t(spark, d, "pages").select("page_id", text.html_to_text(F.col("html")).alias("visible"))
    return page.select("page_id", F.length("visible").alias("n_chars"), F.sha2("visible", 256).alias("digest"), F.sha2(text.escape_html(F.col("visible")), 256).alias("escaped"))


@query("""
SELECT p_partkey, CASE WHEN regexp_matches(p_type, '(?i)\\b(temporary)\\b') THEN 'temporary' WHEN p_type IS NULL OR p_type = '' THEN NULL
  ELSE regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') END AS employment,
  CASE WHEN p_size < 1 THEN 'under_1s' WHEN p_size < 10 THEN '1s_to_10s' WHEN p_size < 60 THEN '10s_to_60s' ELSE 'over_60s' END AS duration FROM part
""")
def employment_classifier(spark, d):
    return t(spark, d, "part").select("p_partkey", text.employment_type(F.col("p_type")).alias("employment"), text.duration_bucket(F.col("p_size") * 1000).alias("duration"))


@query("SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events WHERE (props::JSON->>'k') IS NOT NULL")
def json_extract_explode(spark, d):
    return t(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k")).where("k is not null")


@query("""
SELECT doc_id, sha256('{' || concat_ws(',', '"lang":"' || lang || '"', '"n_chars":' || n_chars, '"source":"' || source || '"') || '}') AS fingerprint FROM documents
""")
def semantic_fingerprint(spark, d):
    return t(spark, d, "documents").select("doc_id", digests.fingerprint(F.col("lang"), F.col("n_chars"), F.col("source")).alias("fingerprint"))


@query("""
SELECT event_type || ' ' || strftime(ts, '%Y-%m-%d %H') AS board, count(*)::BIGINT AS listings, CASE WHEN count(DISTINCT user_id) < count(*) THEN 'duplicate_ids' ELSE 'complete' END AS reason FROM events GROUP BY 1
""")
def json_scan_completeness(spark, d):
    job = F.struct(F.col("user_id").alias("id"), F.col("event_type").alias("title"), F.lit("2024-01-01").alias("updated_at"), F.struct(F.lit("Paris").alias("name")).alias("location"), F.concat(F.lit("https://example.com/"), "event_id").alias("absolute_url"))
    body = t(spark, d, "events").groupBy(F.concat_ws(" ", "event_type", F.date_format("ts", "yyyy-MM-dd HH")).alias("board")).agg(F.to_json(F.struct(F.collect_list(job).alias("jobs"), F.struct(F.count("*").alias("total")).alias("meta"))).alias("body"))
    return boards.greenhouse(body).select("board", F.size("listings").cast("long").alias("listings"), "reason")


@query("""
WITH p AS (SELECT p_partkey::VARCHAR AS id, p_name, p_brand, p_type FROM part)
SELECT id AS source_job_id, u.path, u.value, u.origin, 1.0::DOUBLE AS confidence FROM p, LATERAL (SELECT unnest([
  {'path': '/displayTitle', 'value': p_name, 'origin': 'source_field'}, {'path': '/normalizedTitle', 'value': trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), 'origin': 'deterministic_rule'},
  {'path': '/descriptionText', 'value': p_type, 'origin': 'deterministic_rule'}, {'path': '/locations', 'value': '["Remote - ' || p_brand || '","' || p_brand || '"]', 'origin': 'deterministic_rule'},
  {'path': '/workplaceType', 'value': 'remote', 'origin': 'deterministic_rule'}, {'path': '/employmentType', 'value': regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), 'origin': 'deterministic_rule'},
  {'path': '/canonicalSourceUrl', 'value': 'https://jobs.example.com/p/' || id || '?a=1&b=2', 'origin': 'deterministic_rule'}]) AS u)
""")
def normalized_listings(spark, d):
    parts = t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("source_job_id"), F.col("p_name").alias("title"), F.concat(F.lit("Remote - "), "p_brand", F.lit("; "), "p_brand").alias("location"), F.concat(F.lit("https://Jobs.Example.com//p/"), "p_partkey", F.lit("/?utm_source=x&b=2&a=1#top")).alias("url"), F.concat(F.lit("<p>"), "p_type", F.lit("</p>")).alias("description_html"), F.col("p_type").alias("employment"), F.lit(None).cast("string").alias("workplace_explicit"), F.col("p_brand").alias("artifact"))
    return boards.assertions(boards.normalize(parts)).select("source_job_id", "path", "value", "origin", "confidence")


# ---- resolution -------------------------------------------------------------------------------------------------------


@query("""
WITH inc AS (SELECT s_suppkey AS id, 'verified_domain' AS kind, 'n' || s_nationkey || '.example' AS value, 3 AS w FROM supplier UNION ALL SELECT s_suppkey, 'ats_tenant', 'x:global:' || (s_suppkey % 50), 2 FROM supplier),
known AS (SELECT c_custkey AS company, 'verified_domain' AS kind, 'n' || c_nationkey || '.example' AS value FROM customer UNION SELECT c_custkey, 'ats_tenant', 'x:global:' || (c_custkey % 50) FROM customer),
hits AS (SELECT DISTINCT id, w, company FROM inc JOIN known USING (kind, value)), best AS (SELECT id, w, count(DISTINCT company) AS n, min(company) AS company FROM hits GROUP BY 1, 2),
top AS (SELECT id, arg_max(n, w) AS n, arg_max(company, w) AS company, max(w) AS w FROM best GROUP BY id), tot AS (SELECT id, count(DISTINCT company) AS companies FROM hits GROUP BY id),
r AS (SELECT DISTINCT inc.id, top.company, CASE WHEN n > 1 THEN 'ambiguous_' || CASE top.w WHEN 3 THEN 'verified_domain' ELSE 'ats_tenant' END WHEN companies > 1 THEN 'conflicting_exact_evidence'
  WHEN n IS NOT NULL THEN 'exact_' || CASE top.w WHEN 3 THEN 'verified_domain' ELSE 'ats_tenant' END ELSE 'unclaimed_exact_identity' END AS reason FROM inc LEFT JOIN top ON top.id = inc.id LEFT JOIN tot ON tot.id = inc.id)
SELECT id, CASE WHEN reason LIKE 'exact_%' THEN 'match' WHEN reason = 'unclaimed_exact_identity' THEN 'create' ELSE 'review' END AS action, reason, CASE WHEN reason LIKE 'exact_%' THEN company END AS company FROM r
""")
def company_resolution(spark, d):
    keys = lambda df, i, n: df.select(F.col(i).alias("id"), F.explode(F.array(F.struct(F.lit("verified_domain").alias("kind"), F.concat(F.lit("n"), n, F.lit(".example")).alias("value")), F.struct(F.lit("ats_tenant").alias("kind"), F.concat(F.lit("x:global:"), F.col(i) % 50).alias("value")))).alias("k")).select("id", "k.*")
    known = keys(t(spark, d, "customer"), "c_custkey", "c_nationkey").withColumnRenamed("id", "company")
    return resolve.resolve_companies(keys(t(spark, d, "supplier"), "s_suppkey", "s_nationkey"), known)


@query("""
WITH a AS (SELECT l_orderkey AS target, CASE WHEN l_linenumber % 2 = 0 THEN '/ship' ELSE '/price' END AS path, l_extendedprice::DECIMAL(12,2)::VARCHAR AS value, 1 - l_discount AS confidence,
  CASE WHEN l_returnflag = 'R' THEN false WHEN l_returnflag = 'A' THEN true END AS accepted, CASE l_linestatus WHEN 'O' THEN 4 ELSE 2 END AS w, l_suppkey AS listing, l_partkey * 10 + l_linenumber AS id FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY target, path ORDER BY coalesce(accepted, false) DESC, confidence DESC, w DESC, listing, id) AS n FROM a WHERE accepted IS DISTINCT FROM false)
SELECT target, path, max(CASE WHEN n = 1 THEN value END) AS value, max(CASE WHEN n = 1 THEN id END) AS selected, string_agg(id::VARCHAR, ',' ORDER BY id) AS alternatives FROM r GROUP BY target, path
""")
def evidence_projection(spark, d):
    a = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("target"), F.when(F.col("l_linenumber") % 2 == 0, "/ship").otherwise("/price").alias("path"), F.col("l_extendedprice").cast("decimal(12,2)").cast("string").alias("value"), (1 - F.col("l_discount")).alias("confidence"), F.when(F.col("l_returnflag") == "R", F.lit(False)).when(F.col("l_returnflag") == "A", F.lit(True)).alias("accepted"), F.when(F.col("l_linestatus") == "O", "source_field").otherwise("deterministic_rule").alias("origin"), F.col("l_suppkey").alias("listing"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("id"))
    return resolve.project_evidence(a).withColumn("alternatives", F.array_join("alternatives", ","))


@query("""
WITH d AS (SELECT o_custkey AS id, arg_max(o_orderkey % 3 <> 0, o_orderkey) AS is_merge, max(o_orderkey) % 10 + 1 AS canonical FROM orders GROUP BY 1)
SELECT c_custkey AS id, CASE WHEN is_merge THEN canonical ELSE c_custkey END AS canonical_id,
  CASE WHEN is_merge THEN 'merged' WHEN c_acctbal < 0 THEN 'provisional' ELSE 'verified' END AS status FROM customer LEFT JOIN d ON id = c_custkey
""")
def company_merges(spark, d):
    companies = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") < 0, "provisional").otherwise("verified").alias("status"))
    key = F.col("o_orderkey")
    decisions = t(spark, d, "orders").select(F.col("o_custkey").alias("source"), (key % 10 + 1).alias("canonical"), F.when(key % 3 == 0, "split").otherwise("merge").alias("operation"), key.alias("seq"))
    return resolve.merged_companies(companies, decisions)


# ---- rules ------------------------------------------------------------------------------------------------------------


@query("""
SELECT c_custkey, CASE WHEN c_name IS NULL THEN 'name_missing' WHEN c_acctbal < 0 THEN 'balance_negative' WHEN c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY', 'HOUSEHOLD') THEN 'segment_unknown' END AS violation FROM customer
""")
def pilot_rules(spark, d):
    rules = [("name_missing", F.col("c_name").isNull()), ("balance_negative", F.col("c_acctbal") < 0), ("segment_unknown", ~F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD"))]
    return t(spark, d, "customer").select("c_custkey", validate.first_violation(rules).alias("violation"))


@query("""
WITH s AS (SELECT n_nationkey, n_nationkey * 100.0::DOUBLE AS lag, n_nationkey / 25.0::DOUBLE AS disk FROM nation)
SELECT n_nationkey, 'queue_lag' AS name, CASE WHEN lag >= 1800 THEN 'critical' ELSE 'warning' END AS severity, lag AS observed, 900.0::DOUBLE AS threshold FROM s WHERE lag >= 900
UNION ALL SELECT n_nationkey, 'count_collapse', 'critical', 0.1, 0.2 FROM s WHERE n_nationkey >= 10
UNION ALL SELECT n_nationkey, 'disk_pressure', CASE WHEN disk >= 0.9 THEN 'critical' ELSE 'warning' END, disk, 0.8 FROM s WHERE disk >= 0.8
""")
def operational_alerts(spark, d):
    snapshot = t(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") * 100.0).alias("queue_lag"), (F.col("n_nationkey") / 25.0).alias("disk_usage"), F.col("n_nationkey").alias("count_baseline"), F.lit(0.1).alias("count_ratio"), F.lit(0).alias("closures"), F.lit(0.0).alias("closure_ratio"), F.lit(0).alias("ssrf_rejections"))
    return validate.alerts(snapshot, ["n_nationkey"])


@query("""
SELECT event_id, '[REDACTED]' AS api_key, CASE event_id % 4
    WHEN 0 THEN 'https://example.com/jobs/' || user_id || '?[REDACTED]'
    WHEN 1 THEN '[REDACTED_SIGNED_URL]'
    WHEN 2 THEN '[REDACTED_URL_TEXT]' ELSE event_type END AS note
FROM events
""")
def redact_map(spark, d):
    url = F.concat(F.lit("https://example.com/jobs/"), F.col("user_id"))
    note = F.element_at(F.array(F.concat(url, F.lit("?q=1#top")), F.concat(url, F.lit("?sig=abc")), F.concat(F.lit("see "), url), F.col("event_type")), (F.col("event_id") % 4).cast("int") + 1)
    fields = redaction.safe_fields(F.create_map(F.lit("api_key"), F.col("user_id").cast("string"), F.lit("note"), note))
    return t(spark, d, "events").select("event_id", fields.alias("f")).select("event_id", F.col("f.api_key").alias("api_key"), F.col("f.note").alias("note"))


@query("""
SELECT event_id, CASE WHEN event_type NOT IN ('click', 'purchase') THEN 'unknown_event' WHEN event_type = 'purchase' THEN 'missing_property' END AS problem FROM events
""")
def product_event_validate(spark, d):
    keys = F.coalesce(F.json_object_keys("props"), F.array().cast("array<string>"))
    problem = validate.event_schema(F.col("event_type"), keys, {"click": ["k"], "purchase": ["amount"]}, {"click": []})
    return t(spark, d, "events").select("event_id", problem.alias("problem"))


@query("SELECT user_id, count(DISTINCT event_type)::BIGINT AS payloads FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 1")
def immutability_violations(spark, d):
    return validate.changed_payloads(t(spark, d, "events"), ["user_id"], "event_type")


@query("""
SELECT o_orderkey, 'o_orderstatus' AS field, 'changed' AS change, o_orderstatus AS old_value, 'X' AS new_value FROM orders WHERE o_orderkey % 10 = 0 AND o_orderkey % 7 <> 0 AND o_orderstatus <> 'X'
UNION ALL SELECT o_orderkey, f, 'removed', CASE f WHEN 'o_orderstatus' THEN o_orderstatus ELSE o_orderpriority END, NULL FROM orders CROSS JOIN (VALUES ('o_orderstatus'), ('o_orderpriority')) v(f) WHERE o_orderkey % 7 = 0
""")
def structural_diff(spark, d):
    old = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    new = old.where("o_orderkey % 7 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 10 == 0, "X").otherwise(F.col("o_orderstatus")))
    return validate.table_diff(old, new, ["o_orderkey"])


# ---- streams ----------------------------------------------------------------------------------------------------------


@query("SELECT event_type, count(DISTINCT event_id)::BIGINT AS events FROM events GROUP BY event_type")
def stream_deduplicated(spark, d):
    once = twins.run_to_end(twins.deduplicated(twins.read_events(spark, d), ["event_id"]))
    return once.groupBy("event_type").agg(F.count("*").alias("events"))


@query("""
WITH w AS (SELECT event_type, date_trunc('day', ts) AS s, count(*)::BIGINT AS n FROM events GROUP BY 1, 2)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, event_type, n AS events FROM w WHERE s + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
""")
def stream_daily_counts(spark, d):
    closed = twins.run_to_end(twins.windowed_counts(twins.read_events(spark, d), "1 day"))
    return closed.select(stamp("start").alias("start"), "event_type", "events")


@query("""
WITH s AS (SELECT user_id, ts, event_id, event_type <> 'error' AS seen FROM events),
isl AS (SELECT *, sum(seen::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM s),
num AS (SELECT *, row_number() OVER run - 1 AS n, epoch_us(ts) - min(CASE WHEN NOT seen THEN epoch_us(ts) END) OVER run AS since FROM isl WHERE island > 0 WINDOW run AS (PARTITION BY user_id, island ORDER BY ts, event_id)),
mark AS (SELECT *, NOT seen AND n >= 2 AND since >= 1800000000 AS closing FROM num),
st AS (SELECT CASE WHEN seen THEN 'active' WHEN bool_or(closing) OVER run THEN 'closed' ELSE 'possibly_closed' END AS status, CASE WHEN seen THEN 0 ELSE least(n, coalesce(min(CASE WHEN closing THEN n END) OVER run, n)) END AS misses
  FROM mark WINDOW run AS (PARTITION BY user_id, island ORDER BY ts, event_id))
SELECT status, count(*)::BIGINT AS states, max(misses)::INTEGER AS misses FROM st GROUP BY status
""")
def stream_lifecycle(spark, d):
    e = twins.read_events(spark, d)
    scans = e.select(F.col("user_id").alias("listing"), F.col("ts").alias("at"), (F.col("event_type") != "error").alias("seen"))
    return twins.run_to_end(twins.lifecycle_states(scans)).groupBy("status").agg(F.count("*").alias("states"), F.max("misses").alias("misses"))
