from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sievewright.functions import digests, redaction, text, urls


def values(spark, rows, column, schema="v string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column).collect()]


def test_search_title(spark):
    got = values(spark, ["Sénior Platform—Engineer", "ソフトウェア・エンジニア", "مهندس برمجيات", "Ｆｕｌｌ　Ｓｔａｃｋ", "Senior‮exe.Engineer⁦", None], text.search_title(F.col("v")))
    assert got == ["senior platform engineer", "ソフトウェア エンジニア", "مهندس برمجيات", "full stack", "seniorexe engineer", None]


def test_company_name(spark):
    assert values(spark, ["  Ａcmé‮  株式会社  ", "Café"], text.company_name(F.col("v"))) == ["acme 株式会社", "cafe"]


def test_employment_type(spark):
    got = values(spark, ["Full-time", "Temps partiel", "Freelance", "Praktikum", "Temps plein", "Night Shift", "", None], text.employment_type(F.col("v")))
    assert got == ["full_time", "part_time", "contract", "internship", "full_time", "night_shift", None, None]


def test_word_ends_are_ascii(spark):
    assert values(spark, ["éremote", "xremote", "Remote — Paris"], text.remote_eligible(F.col("v"))) == [True, False, True]


def test_canonical_url(spark):
    got = values(spark, ["https://EXAMPLE.com//jobs/1/?utm_source=x&token=secret&b=2&a=1#private", "http://example.com/", "https://u:p@example.com/", "https://example.com"], urls.canonical(F.col("v")))
    assert got == ["https://example.com/jobs/1?a=1&b=2", None, None, "https://example.com/"]


def test_vendor(spark):
    got = values(spark, ["https://boards.greenhouse.io/Acme", "https://jobs.eu.lever.co/acme/x", "https://api.ashbyhq.com/posting-api/job-board/acme", "https://example.com/acme"], urls.vendor(F.col("v")))
    assert [tuple(x) for x in got] == [("greenhouse", "acme", None), ("lever", "acme", "eu"), ("ashby", "acme", None), (None, None, None)]


def test_public_addresses(spark):
    got = values(spark, ["8.8.8.8", "10.1.2.3", "127.0.0.1", "203.0.113.7", "224.0.0.1", "no", "1.2.3"], urls.is_public_v4(F.col("v")))
    assert got == [True, False, False, False, False, False, False]


def test_html_to_text():
    assert text.visible("<div><script>bad()</script><p>Safe &amp; sound</p><img onerror=x></div>") == "Safe & sound"
    assert text.visible(None) is None


def test_identity_keys(spark):
    rows = [("verified_domain", "ACME.Example."), ("ats_tenant", "GreenHouse:GLOBAL:Acme"), ("verified_domain", "acme.example/path"), ("ats_tenant", "a:b")]
    got = spark.createDataFrame(rows, "k string, v string").select(text.identity_key(F.col("k"), F.col("v"))).collect()
    assert [r[0] for r in got] == ["acme.example", "greenhouse:global:acme", None, None]


def test_cursor_is_bound():
    cursor = digests.encode_cursor("items", {"q": "x"}, 5, "id")
    assert digests.decode_cursor(cursor, "items", {"q": "x"}) == {"primary": 5, "id": "id"}
    for scope, filters in (("other", {"q": "x"}), ("items", {"q": "y"})):
        with pytest.raises(ValueError, match="invalid_cursor"):
            digests.decode_cursor(cursor, scope, filters)


def test_set_hash_ignores_order(spark):
    df = spark.createDataFrame([(["a", "b"],), (["b", "a"],)], "v array<string>")
    assert df.select(digests.set_hash(F.col("v")).alias("h")).distinct().count() == 1
    assert spark.createDataFrame([(datetime(2024, 1, 1, 12),)], "t timestamp").select(digests.cadence_bucket(F.col("t"), 43_200)).first()[0] == 39_447 - 0


def test_telemetry_fields(spark):
    seen = [
        ("note", "Bearer abcdefgh123", "[REDACTED]"),
        ("note", "ghp_abcdefgh12345", "[REDACTED]"),
        ("Session-Token", "x", "[REDACTED]"),
        ("note", "https://u:p@example.com/", "[REDACTED_SIGNED_URL]"),
        ("note", "https://example.com/a?b=1", "https://example.com/a?[REDACTED]"),
        ("note", "https://example.com/a", "https://example.com/a"),
        ("note", "see https://example.com/a", "[REDACTED_URL_TEXT]"),
        ("note", "a" * 1500, "a" * 1000),
        ("note", "", ""),
        ("note", None, None),
    ]
    df = spark.createDataFrame([(i, {k: v}) for i, (k, v, _) in enumerate(seen)], "i int, f map<string,string>")
    got = {r["i"]: r["g"] for r in df.select("i", redaction.safe_fields(F.col("f")).alias("g")).collect()}
    assert [got[i][k] for i, (k, _, _) in enumerate(seen)] == [x for _, _, x in seen]


def test_urls_keep_ports_and_brackets(spark):
    from sievewright.functions import urls

    cases = [
        ("https://EXAMPLE.com//jobs/1/?utm_source=x&token=secret&b=2&a=1#private", "https://example.com/jobs/1?a=1&b=2", "https://example.com"),
        ("https://jobs.x.com:8443/a?b=1", "https://jobs.x.com:8443/a?b=1", "https://jobs.x.com:8443"),
        ("https://x.com:443", "https://x.com/", "https://x.com"),
        ("https://x.com.:0443/a/", "https://x.com/a", "https://x.com"),
        ("https://[2001:DB8::1]:8443/a", "https://[2001:db8::1]:8443/a", "https://[2001:db8::1]:8443"),
        ("https://[::1]/a/b/../../c/./d", "https://[::1]/c/d", "https://[::1]"),
        ("https://x.com/../../a//b/..", "https://x.com/a", "https://x.com"),
        ("https://x.com/%2e%2E/a/%2e/b", "https://x.com/a/b", "https://x.com"),
        ("https://x.com/a?b&a-b=2&a=1&a=0", "https://x.com/a?a=1&a=0&a-b=2&b=", "https://x.com"),
        ("https://x.com/?q=a%20b+c&p=%zz", "https://x.com/?p=%25zz&q=a+b+c", "https://x.com"),
        ("https://x.com:99999/", None, "https://x.com:99999"),
        ("https://x.com:8o/", None, "https://x.com"),
        ("http://x.com/", None, "http://x.com"),
        ("https://u:p@x.com/", None, "https://x.com"),
        ("https://", None, "https://"),
        (None, None, None),
    ]
    got = spark.createDataFrame([(u, k) for k, (u, *_) in enumerate(cases)], "u string, k int").select("k", urls.canonical(F.col("u")).alias("c"), urls.origin(F.col("u")).alias("o")).collect()
    assert [(cases[r.k][0], r.c, r.o) for r in sorted(got, key=lambda r: r.k)] == cases


def test_policy_windows(spark):
    from sievewright.operators.console import freshness_error, report_error, safe_text

    day = lambda n: F.date_add(F.lit("2024-06-01").cast("date"), n).cast("timestamp")
    cases = [((-1, 0, -1, -28, 60), None), ((-1, 0, -1, -28, 80), "policy_review_window_invalid"), ((-1, 1, -1, -1, 60), "dataset_review_in_future"), ((0, -1, -1, -1, 60), "dataset_review_in_future"), ((-8, 0, -1, -1, 60), "dataset_review_stale"), ((-2, -2, -2, -1, 60), "policy_review_window_invalid"), ((-1, 0, -1, -31, 30), "policy_review_window_invalid"), ((-1, 0, -1, -1, 0), "policy_not_current"), ((-1, 0, -1, 1, 60), "policy_not_current"), ((-2, -2, -1, -3, 60), "observation_in_future"), ((-1, 0, -8, -1, 60), "observation_stale")]
    row = spark.range(1).select(*[freshness_error(day(0), *map(day, dates)).alias(f"c{k}") for k, (dates, _) in enumerate(cases)]).first()
    assert list(row) == [want for _, want in cases]
    got = spark.range(1).select(report_error(F.lit("other"), F.lit("   "), F.lit(None).cast("string")), safe_text(F.lit("　 \n"), "none"), safe_text(F.lit("  a\tb "), "none")).first()
    assert list(got) == ["invalid_request", "none", "a b"]
