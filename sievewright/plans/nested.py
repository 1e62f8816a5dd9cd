"""Queries of nested differences, bounded JSON, addresses and domains, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievewright.functions import addresses, urls
from sievewright.operators import differences, domains
from sievewright.plans.catalog import query, t
from sievewright.sources import bounded


def _order_documents(spark, d):
    """Each order as a document, beside the same customer's next one."""
    line = F.struct(F.col("l_linenumber").alias("no"), F.struct(F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag")).alias("item"))
    lines = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(line)).alias("lines"))  # an order's lines are few
    orders = t(spark, d, "orders").join(lines, "o_orderkey")
    document = F.to_json(F.struct(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).alias("head"), "lines", (F.col("o_orderstatus") == "O").alias("open")))
    own = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return orders.select("o_custkey", "o_orderdate", "o_orderkey", document.alias("doc")).withColumn("next", F.lead("doc").over(own)).where("next is not null")


@query("""
WITH l AS (SELECT l_orderkey AS o_orderkey, list({'no': l_linenumber, 'item': {'part': l_partkey, 'flag': l_returnflag}} ORDER BY l_linenumber, l_partkey, l_returnflag) AS lines FROM lineitem GROUP BY 1),
o AS (SELECT o_custkey, o_orderkey, o_orderdate, to_json({'head': {'status': o_orderstatus, 'priority': o_orderpriority}, 'lines': lines, 'open': o_orderstatus = 'O'})::JSON AS doc FROM orders JOIN l USING (o_orderkey)),
p AS (SELECT o_orderkey AS id, doc AS a, lead(doc) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM o),
x AS (SELECT p.id, j.fullkey AS path, j.path AS parent, j.type AS kind, CASE WHEN j.type IN ('OBJECT', 'ARRAY') THEN j.value::VARCHAR ELSE coalesce(j.atom::VARCHAR, 'null') END AS v FROM p, LATERAL (SELECT * FROM json_tree(a)) j WHERE b IS NOT NULL),
y AS (SELECT p.id, j.fullkey AS path, j.path AS parent, j.type AS kind, CASE WHEN j.type IN ('OBJECT', 'ARRAY') THEN j.value::VARCHAR ELSE coalesce(j.atom::VARCHAR, 'null') END AS v FROM p, LATERAL (SELECT * FROM json_tree(b)) j WHERE b IS NOT NULL),
z AS (SELECT coalesce(x.id, y.id) AS id, coalesce(x.path, y.path) AS path, coalesce(x.parent, y.parent) AS parent, x.kind AS ka, y.kind AS kb, x.v AS va, y.v AS vb FROM x FULL JOIN y ON x.id = y.id AND x.path = y.path)
SELECT id, path, CASE WHEN ka IS NULL THEN 'added' WHEN kb IS NULL THEN 'removed' ELSE 'changed' END AS kind FROM z
WHERE (ka IS NULL OR kb IS NULL OR (ka NOT IN ('OBJECT', 'ARRAY') AND va <> vb)) AND EXISTS (SELECT 1 FROM z u WHERE u.id = z.id AND u.path = z.parent AND u.ka = u.kb)
""")
def json_diff(spark, d):
    docs = _order_documents(spark, d).withColumnRenamed("o_orderkey", "id")
    out = differences.paired_diff(docs, "id", "doc", "next", 5)
    return out.select("id", "path", "kind")


@query(r"""
WITH e AS (SELECT event_id AS id, props AS body, 1 AS keys FROM events),
m AS (SELECT id, body, len(json_keys(body)) AS n, length(body) AS size FROM e)
SELECT id, 1::BIGINT AS depth, (1 + n)::BIGINT AS nodes, (list_max([len(k) for k in json_keys(body)]))::BIGINT AS longest, CASE WHEN size > 9 THEN 'byte_limit' END AS error FROM m WHERE size <= 9
UNION ALL SELECT id, NULL, NULL, NULL, 'byte_limit' FROM m WHERE size > 9
""")
def bounded_events(spark, d):
    rows = t(spark, d, "events").select(F.col("event_id").alias("id"), "props")
    return bounded.bounded_json(rows, "props", bounded.Limits(bytes=9)).select("id", "depth", "nodes", "longest", "error")


@query(r"""
WITH d AS (SELECT doc_id AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents WHERE doc_id IS NOT NULL),
u AS (SELECT id, len(lines) AS n, greatest(6, list_max([length(l) + len(regexp_extract_all(l, '[\x{10000}-\x{10FFFF}]')) for l in lines])) AS longest, strlen(to_json({'id': id, 'lang': lang, 'lines': lines})::VARCHAR) AS size FROM d)
SELECT id, 2::BIGINT AS depth, (4 + n)::BIGINT AS nodes, greatest(longest, 5)::BIGINT AS longest, CASE WHEN 4 + n > 30 THEN 'node_limit' WHEN longest > 300 THEN 'string_limit' END AS error FROM u
""")
def bounded_documents(spark, d):
    rows = t(spark, d, "documents").where("doc_id is not null")
    body = F.to_json(F.struct(F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("")).alias("locale"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines")))
    out = bounded.bounded_json(rows.select(F.col("doc_id").alias("id"), body.alias("body")), "body", bounded.Limits(bytes=50 << 20, nodes=30, string=300))
    return out.select("id", "depth", "nodes", "longest", "error")


#: Networks beside those made from the tables: address/bits and what they are.
NETWORKS = (("2001:db8::/32", "documentation"), ("2001:db8:a000::/36", "half"), ("fc00::/7", "unique local"), ("::ffff:0:0/96", "mapped"), ("2600::/12", "public"), ("10.0.0.0/8", "private"), ("10.128.0.0/9", "upper"))
HEADS = ("20010db8a", "20010db8", "fd", "2606470000000000000000000000", "00000000000000000000ffff", "0")
_SQL_HEADS = ", ".join(f"'{h}'" for h in HEADS)


def _customer_hex(c: Column) -> Column:
    digest = F.md5(c.cast("string").cast("binary"))
    head = F.get(F.array(*map(F.lit, HEADS)), (F.conv(F.substring(digest, 1, 2), 16, 10).cast("int") % len(HEADS)))
    return F.concat(head, F.substring(digest, F.lit(1), F.lit(32) - F.length(head)))


def _spelled(text: Column) -> Column:
    """32 hex digits as an address: short words, and the first run of zero words left out; mapped ones end in an IPv4 address."""
    words = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.regexp_replace(F.substring(text, i * 4 + 1, F.lit(4)), "^0{1,3}", ""))
    short = F.regexp_replace(F.array_join(words, ":"), r"^((?:(?!0:|:0:)[0-9a-f:])*?)(^|:)0(:0)+(:|$)", "$1::")
    quad = F.array_join(F.transform(F.sequence(F.lit(24), F.lit(30), F.lit(2)), lambda i: F.conv(F.substring(text, i + 1, F.lit(2)), 16, 10)), ".")
    return F.when(text.startswith("0" * 20 + "ffff"), F.concat(F.lit("::FFFF:"), quad)).otherwise(short)


@query(f"""
WITH h AS (SELECT c_custkey, md5(c_custkey::VARCHAR) AS m FROM customer),
g AS (SELECT c_custkey, [{_SQL_HEADS}][1 + ('0x' || substr(m, 1, 2))::INTEGER % {len(HEADS)}] AS head, m FROM h),
x AS (SELECT c_custkey, head || substr(m, 1, 32 - length(head)) AS hex FROM g),
w AS (SELECT c_custkey, hex, substr(hex, 1, 8) = '20010db8' AS doc FROM x)
SELECT c_custkey, CASE WHEN doc AND substr(hex, 9, 1) = 'a' THEN 36 WHEN doc THEN 32 WHEN substr(hex, 1, 2) IN ('fc', 'fd') THEN 7 WHEN substr(hex, 1, 24) = '{'0' * 20}ffff' THEN 96 WHEN substr(hex, 1, 3) = '260' THEN 12 END::INTEGER AS bits,
  CASE WHEN doc AND substr(hex, 9, 1) = 'a' THEN 'half' WHEN doc THEN 'documentation' WHEN substr(hex, 1, 2) IN ('fc', 'fd') THEN 'unique local' WHEN substr(hex, 1, 24) = '{'0' * 20}ffff' THEN 'mapped' WHEN substr(hex, 1, 3) = '260' THEN 'public' END AS label,
  substr(hex, 1, 3) = '260' AS is_public, hex FROM w
UNION ALL
SELECT -s_suppkey, CASE WHEN s_suppkey % 256 >= 128 THEN 9 ELSE 8 END, CASE WHEN s_suppkey % 256 >= 128 THEN 'upper' ELSE 'private' END, false, NULL FROM supplier
""")
def address_networks(spark, d):
    nets = addresses.networks(spark.createDataFrame(NETWORKS, "net string, label string"), "net").drop("net")
    six = t(spark, d, "customer").select("c_custkey", _customer_hex(F.col("c_custkey")).alias("hex")).withColumn("address", _spelled(F.col("hex")))
    four = t(spark, d, "supplier").select((-F.col("s_suppkey")).alias("c_custkey"), F.lit(None).cast("string").alias("hex"), F.concat(F.lit("10."), (F.col("s_suppkey") % 256).cast("string"), F.lit(".7.1")).alias("address"))
    valued = addresses.valued(six.unionByName(four), "address", "value")
    out = addresses.longest_match(valued, "address", nets, "value")
    value = F.col("value")
    digits = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return out.select("c_custkey", "bits", "label", addresses.public_number(value).alias("is_public"), F.when(F.col("hex").isNotNull(), F.concat(digits(value["hi"]), digits(value["lo"]))).alias("hex"))


#: Suffix rules for the hosts of ``pages``: plain ones, one of a vendor, a wildcard and its exception.
RULES = (("com", True), ("net", True), ("org", True), ("example.com", False), ("*.example.net", True), ("!ththth.example.net", True))


@query(r"""
WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host FROM pages),
l AS (SELECT *, string_split(host, '.') AS x FROM p),
s AS (SELECT *, len(x) AS n, CASE WHEN host = 'ththth.example.net' OR host LIKE '%.ththth.example.net' THEN 2 WHEN host LIKE '%_.example.net' THEN 3 WHEN host = 'example.com' OR host LIKE '%.example.com' THEN 2 ELSE 1 END AS k FROM l)
SELECT page_id, array_to_string(x[n - k + 1:], '.') AS suffix, CASE WHEN n > k THEN array_to_string(x[n - k:], '.') END AS domain,
  NOT (host = 'example.com' OR host LIKE '%.example.com') AND x[n] IN ('com', 'net', 'org') AS icann FROM s
""")
def registrable_domains(spark, d):
    suffixes = domains.rules(spark.createDataFrame(RULES, "rule string, icann boolean"), section="icann")
    hosts = t(spark, d, "pages").select("page_id", urls.host(F.col("url")).alias("host"))
    return domains.registrable(hosts, "host", suffixes).select("page_id", "suffix", "domain", "icann")
