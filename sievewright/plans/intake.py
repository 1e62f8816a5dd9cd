"""Queries of redaction of trees, content encodings, schema steps and the content store, with their SQL."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from sievewright.functions import redaction
from sievewright.plans.catalog import query, t
from sievewright.sources import decoding, schema_steps
from sievewright.sources.board_source import BoardSource, stored
from sievewright.storage import shared_folder


@query("""
WITH e AS (SELECT event_id, user_id, event_type, props, value, 'https://x.example:8443/' || user_id AS u FROM events)
SELECT event_id, '{"who":{"id":' || user_id || ',"emailAddress":"[REDACTED]"},"props":' || replace(props, ' ', '') || ',"url":"' || CASE event_type WHEN 'click' THEN u || '?[REDACTED]' WHEN 'error' THEN '[REDACTED_SIGNED_URL]' WHEN 'view' THEN '[REDACTED_URL_TEXT]' ELSE u END
  || '","trail":[[[[["deep",["[TRUNCATED]"]]]]]],"note":"' || CASE WHEN value > 100 THEN '[REDACTED]' ELSE 'plain' END || '"}' AS document FROM e
""")
def redact_nested(spark, d):
    u = F.concat(F.lit("https://x.example:8443/"), F.col("user_id").cast("string"))
    kind = F.col("event_type")
    url = F.when(kind == "click", F.concat(u, F.lit("?page=2"))).when(kind == "error", F.concat(u, F.lit("?a=1&sig=2"))).when(kind == "view", F.concat(F.lit("see "), u)).otherwise(u)
    note = F.when(F.col("value") > 100, "Bearer abcdefgh.ijk").otherwise("plain")
    document = F.concat(F.lit('{"who": {"id": '), F.col("user_id").cast("string"), F.lit(', "emailAddress": "a@b.example"}, "props": '), "props", F.lit(', "url": "'), url, F.lit('", "trail": [[[[["deep", [["deeper"]]]]]]], "note": "'), note, F.lit('"}'))
    return t(spark, d, "events").select("event_id", redaction.redact_nested(document).alias("document"))


#: Bytes that a decoded page may have here.
CEILING = 5_000


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What servers would send: gzip, deflate or plain, by scheme and page."""
    for batch in batches:
        ids, kinds, bodies = (batch.column(c).to_pylist() for c in ("page_id", "encoding", "body"))
        made = []
        for kind, body in zip(kinds, bodies):
            engine = zlib.compressobj(6, zlib.DEFLATED, 31 if kind == "gzip" else 15)
            made.append(body if kind not in ("gzip", "deflate") else engine.compress(body) + engine.flush())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(made, pa.binary())], ["page_id", "encoding", "body"])


@query(f"""
WITH p AS (SELECT page_id, strlen(html) AS n, sha256(html) AS h, CASE WHEN url LIKE 'https://www.%' THEN 'br' WHEN url LIKE 'https://%' THEN 'gzip' WHEN url LIKE '%.html' THEN 'identity' ELSE 'deflate' END AS encoding FROM pages)
SELECT page_id, encoding, CASE WHEN encoding <> 'br' AND n <= {CEILING} THEN h END AS sha256, CASE WHEN encoding = 'br' THEN 'unsupported_content_encoding' WHEN n > {CEILING} THEN 'decoded_limit_exceeded' END AS error FROM p
""")
def content_decoding(spark, d):
    url = F.col("url")
    kind = F.when(url.startswith("https://www."), "br").when(url.startswith("https://"), "gzip").when(url.endswith(".html"), "identity").otherwise("deflate")
    sent = t(spark, d, "pages").select("page_id", kind.alias("encoding"), F.col("html").cast("binary").alias("body")).mapInArrow(_encoded, "page_id bigint, encoding string, body binary")
    out = decoding.decode_bodies(sent, "body", "encoding", CEILING)
    return out.select("page_id", "encoding", F.sha2("decoded", 256).alias("sha256"), F.col("decode_error").alias("error"))


@query("""
WITH s AS (SELECT lpad((n_nationkey + 1)::VARCHAR, 4, '0') || '_' || replace(lower(n_name), ' ', '_') || '.sql' AS name, 't := SELECT ''' || n_name || ''' AS n, ' || n_regionkey || ' AS r' AS content, n_regionkey AS r FROM nation),
r AS (SELECT name, sha256(CASE WHEN r = 2 THEN content || ' ' ELSE content END) AS checksum FROM s WHERE r <= 2 UNION ALL SELECT '0099_' || lower(r_name) || '.sql', sha256(r_name) FROM region WHERE r_regionkey = 4)
SELECT coalesce(s.name, r.name) AS name, CASE WHEN s.name IS NULL THEN 'unknown' WHEN r.name IS NULL THEN 'pending' WHEN sha256(content) = checksum THEN 'applied' ELSE 'checksum_mismatch' END AS state,
  CASE WHEN s.name IS NULL THEN '' ELSE '' END AS failure FROM s FULL JOIN r ON s.name = r.name
UNION ALL
SELECT name, 'file', 'out_of_sequence:' || lpad(n::VARCHAR, 4, '0') FROM (SELECT *, row_number() OVER (ORDER BY name) AS n FROM s WHERE r <> 0) WHERE substr(name, 1, 4)::INTEGER <> n
""")
def schema_ledger(spark, d):
    nation, region = t(spark, d, "nation"), t(spark, d, "region")
    name = F.concat(F.lpad((F.col("n_nationkey") + 1).cast("string"), 4, "0"), F.lit("_"), F.regexp_replace(F.lower("n_name"), " ", "_"), F.lit(".sql"))
    content = F.concat(F.lit("t := SELECT '"), "n_name", F.lit("' AS n, "), F.col("n_regionkey").cast("string"), F.lit(" AS r"))
    steps = nation.select(name.alias("name"), content.alias("content"), F.col("n_regionkey").alias("r"))
    recorded = steps.where("r <= 2").select("name", F.sha2(F.when(F.col("r") == 2, F.concat("content", F.lit(" "))).otherwise(F.col("content")), 256).alias("checksum"))
    lost = region.where("r_regionkey = 4").select(F.concat(F.lit("0099_"), F.lower("r_name"), F.lit(".sql")).alias("name"), F.sha2("r_name", 256).alias("checksum"))
    states = schema_steps.step_states(steps.drop("r"), recorded.union(lost)).withColumn("failure", F.lit(""))
    # without the files of one region the numbers have gaps
    failures = schema_steps.step_failures(steps.where("r <> 0").drop("r"))
    return states.unionByName(failures.select("name", F.lit("file").alias("state"), "failure"))


@query("SELECT sha256(text) AS sha256, strlen(text)::BIGINT AS bytes FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def content_store(spark, d):
    spark.dataSource.register(BoardSource)
    path = shared_folder(spark)
    bodies = t(spark, d, "documents").where("text is not null").select(F.sha2("text", 256).alias("sha256"), F.col("text").cast("binary").alias("body"))
    for _ in range(2):  # a repeated write adds nothing
        bodies.write.format("boards").mode("append").option("path", path).save()
    return stored(spark, path).select("sha256", F.octet_length("body").cast("long").alias("bytes"))
