"""Redaction of trees, content encodings, schema steps, and boards as a data source."""

import gzip
import hashlib
import json
import os
import zlib

import pytest
from pyspark.sql import functions as F

from sievewright.functions import redaction
from sievewright.sources import board_source, decoding, schema_steps
from sievewright.sources.board_source import BoardSource
from sievewright.storage import shared_folder


def test_redaction_of_trees(spark):
    deep = {"a": 1}
    for _ in range(9):
        deep = {"d": deep}
    document = {
        "authorization": "Bearer do-not-emit-this",
        "nested": {"responseBody": "private application", "value": "CANARY_SECRET_observability_123", "list": [{"apiKey": "x"}, "fine", 7, None, True]},
        "signed": "https://objects.example/file?X-Amz-Signature=secret",
        "ordinary": "https://boards.example/jobs?team=platform",
        "fragment": "https://boards.example/jobs#token=x",
        "user": "https://u:p@boards.example/",
        "embedded": "request failed at https://objects.example/file?signature=secret",
        "long": "x" * 2000,
        "deep": deep,
        "many": list(range(150)),
    }
    rows = [(1, json.dumps(document)), (2, None), (3, "{"), (4, '"basic abcdefghi"'), (5, json.dumps({f"k{k}": k for k in range(150)})), (6, "[1, 2.5]"), (7, "[" * 50 + "]" * 50)]
    got = {r["id"]: r.d for r in spark.createDataFrame(rows, "id int, d string").select("id", redaction.redact_nested(F.col("d")).alias("d")).collect()}
    out = json.loads(got[1])
    assert out["authorization"] == "[REDACTED]" and out["nested"] == {"responseBody": "[REDACTED]", "value": "[REDACTED]", "list": [{"apiKey": "[REDACTED]"}, "fine", 7, None, True]}
    assert (out["signed"], out["ordinary"], out["fragment"], out["user"], out["embedded"]) == ("[REDACTED_SIGNED_URL]", "https://boards.example/jobs?[REDACTED]", "https://boards.example/jobs?[REDACTED]", "[REDACTED_SIGNED_URL]", "[REDACTED_URL_TEXT]")
    assert len(out["long"]) == 1000 and len(out["many"]) == 100 and out["deep"] == {"d": {"d": {"d": {"d": {"d": {"d": "[TRUNCATED]"}}}}}}
    assert (got[2], got[3], json.loads(got[4]), len(json.loads(got[5])), got[6], got[7]) == (None, None, "[REDACTED]", 100, "[1,2.5]", '[[[[[[["[TRUNCATED]"]]]]]]]')


def test_flat_and_nested_redaction_agree(spark):
    texts = ["plain", "Bearer abcdefgh12", "https://X.com/a?sig=1", "https://x.com/a?b=1#c", "https://x.com:8443/a#sig=2", "see https://x.com/?token=1 now", "sk_abcdefgh9", "HTTPS://x.com", "https://a@b/", "?sig=1", "ftp://x?y", "", "https://[::1]:80/p?q"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", redaction.safe_value(F.col("t")).alias("a"), redaction.redact_nested(F.to_json(F.struct(F.col("t").alias("v")))).alias("b"))
    assert [(r.t, json.loads(r.b)["v"]) for r in df.collect()] == [(r.t, r.a) for r in df.collect()]


def test_inflate_within_bounds():
    text = os.urandom(3000) * 500
    for encoding, body in (("gzip", gzip.compress(text)), ("deflate", zlib.compress(text)), (" GZIP ", gzip.compress(text[:700_000]) + gzip.compress(text[700_000:])), ("identity", text), (None, text), ("", text)):
        assert decoding.inflate(body, encoding) == (text, None)
        assert decoding.inflate(body, encoding, len(text)) == (text, None)
        assert decoding.inflate(body, encoding, len(text) - 1) == (None, "decoded_limit_exceeded")
    assert decoding.inflate(gzip.compress(text)[:-9], "gzip") == (None, "decoded_limit_exceeded")
    assert decoding.inflate(b"none", "deflate") == (None, "decoded_limit_exceeded") and decoding.inflate(b"", "gzip") == (None, "decoded_limit_exceeded")
    assert decoding.inflate(text, "br") == (None, "unsupported_content_encoding") and decoding.inflate(gzip.compress(b""), "gzip") == (b"", None)


def test_bomb_costs_its_ceiling(spark):
    bomb = zlib.compress(b"\0" * (300 << 20), 9)
    rows = [(1, bomb, "deflate", "x"), (2, gzip.compress(b"fine"), "gzip", "y"), (3, None, "gzip", "z"), (4, b"raw", None, "w")]
    out = decoding.decode_bodies(spark.createDataFrame(rows, "id int, body binary, encoding string, decoded_by string"), "body", "encoding", 1 << 20).drop("body").collect()
    assert {r["id"]: (r.decoded and bytes(r.decoded), r.decode_error, r.decoded_by) for r in out} == {1: (None, "decoded_limit_exceeded", "x"), 2: (b"fine", None, "y"), 3: (None, None, "z"), 4: (b"raw", None, "w")}


def steps(spark, rows):
    return spark.createDataFrame(rows, "name string, content string")


def test_step_failures(spark):
    rows = [("0001_first.sql", "t := SELECT 1 AS a"), ("0003_third.sql", " \n\t"), ("0004_Upper.sql", "x"), ("notes.txt", "x"), ("0002_second.sql", "BEGIN; COPY t FROM PROGRAM 'x'"), ("0005_fifth.sql", "x")]
    got = {(r["name"], r.failure) for r in schema_steps.step_failures(steps(spark, rows)).collect()}
    assert got == {("0003_third.sql", "empty"), ("0004_Upper.sql", "malformed_name"), ("notes.txt", "malformed_name"), ("0002_second.sql", "prohibited"), ("0005_fifth.sql", "out_of_sequence:0004")}
    assert schema_steps.step_failures(steps(spark, [])).collect() == []


def test_steps_apply_once(spark, tmp_path):
    ledger = schema_steps.SchemaLedger(spark, shared_folder(spark))
    first = ("0001_make.sql", "items := SELECT id, id * 2 AS twice FROM range(5); names := SELECT 'a' AS name")
    second = ("0002_widen.sql", "items := SELECT *, twice + 1 AS odd FROM {items}")
    assert ledger.apply(steps(spark, [first])) == (["0001_make.sql"], [])
    assert ledger.apply(steps(spark, [second, first])) == (["0002_widen.sql"], ["0001_make.sql"])
    assert ledger.apply(steps(spark, [first, second])) == ([], ["0001_make.sql", "0002_widen.sql"]) and ledger.tables.version() == 2
    manifest = ledger.tables.manifest()
    assert sorted(map(tuple, ledger.tables.read(manifest, "items").collect())) == [(k, 2 * k, 2 * k + 1) for k in range(5)] and ledger.tables.read(manifest, "names").count() == 1
    assert {r["name"]: r.checksum for r in ledger.recorded().collect()} == {n: hashlib.sha256(c.encode()).hexdigest() for n, c in (first, second)}
    for changed, why in (([first, ("0002_widen.sql", second[1] + " ")], "0002_widen.sql: checksum_mismatch"), ([first], "0002_widen.sql: unknown"), ([first, second, ("0004_gap.sql", "x := SELECT 1 AS a")], "out_of_sequence:0003"), ([first, second, ("0003_none.sql", "SELECT 1")], "no target")):
        with pytest.raises(schema_steps.StepRefused, match=why):
            ledger.apply(steps(spark, changed))
    for name, content in (first, second, ("README.md", "about")):
        (tmp_path / name).write_text(content)
    assert ledger.apply(schema_steps.read_steps(spark, f"file://{tmp_path}")) == ([], ["0001_make.sql", "0002_widen.sql"])


def boards(path, tenants):
    for tenant, pages in tenants.items():
        (path / tenant).mkdir(exist_ok=True)
        for k in range(pages):
            (path / tenant / f"{k}.json").write_bytes(json.dumps([{"id": f"{tenant}-{k}"}]).encode())


def test_boards_by_pages(spark, tmp_path):
    spark.dataSource.register(BoardSource)
    boards(tmp_path, {"acme": 23, "beta": 1})
    read = lambda: spark.read.format("boards").options(transport="sievewright.sources.board_source:folder_page", path=str(tmp_path), tenants="acme,beta,none", pages=40).load()
    rows = read().collect()
    assert sorted((r.tenant, r.page) for r in rows) == [("acme", k) for k in range(23)] + [("beta", 0)]
    assert all(hashlib.sha256(bytes(r.body)).hexdigest() == r.sha256 for r in rows) and read().rdd.getNumPartitions() == 12


def test_store_keeps_each_content_once(spark, tmp_path):
    spark.dataSource.register(BoardSource)
    store = f"{tmp_path}/store"
    rows = [(hashlib.sha256(b"%d" % (k % 7)).hexdigest() if k % 2 else None, b"%d" % (k % 7)) for k in range(40)]
    df = spark.createDataFrame(rows, board_source.STORED).repartition(4)
    keep = lambda frame: frame.write.format("boards").mode("append").option("path", store).save()
    keep(df)
    keep(df)
    found = board_source.stored(spark, store).collect()
    assert sorted((r.sha256, bytes(r.body)) for r in found) == sorted((hashlib.sha256(b"%d" % k).hexdigest(), b"%d" % k) for k in range(7))
    records = [json.load(open(f"{store}/_writes/{n}")) for n in os.listdir(f"{store}/_writes")]
    assert sorted(r["added"] for r in records) == [0, 7] and all(r["rows"] == 40 for r in records) and os.listdir(f"{store}/_staging") == []
    with pytest.raises(Exception, match="content_hash_mismatch"):
        keep(spark.createDataFrame([("0" * 64, b"new")], board_source.STORED))
    assert board_source.stored(spark, store).count() == 7


def test_boards_as_a_stream(spark, tmp_path):
    spark.dataSource.register(BoardSource)
    boards(tmp_path, {"acme": 12, "beta": 2})
    out = shared_folder(spark)
    stream = lambda: spark.readStream.format("boards").options(transport="sievewright.sources.board_source:folder_page", path=str(tmp_path), tenants="acme,beta").load()

    def catch_up():
        query = stream().writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(processingTime="0 seconds").start()
        query.processAllAvailable()
        query.stop()
        return sorted((r.tenant, r.page) for r in spark.read.parquet(f"{out}/data").collect())

    assert catch_up() == [("acme", k) for k in range(12)] + [("beta", 0), ("beta", 1)]
    boards(tmp_path, {"beta": 4})
    assert catch_up() == [("acme", k) for k in range(12)] + [("beta", k) for k in range(4)]
