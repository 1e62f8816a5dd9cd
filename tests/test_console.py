"""Operator views and registry guards: nulls, ties, empty tables and clashing columns."""

from datetime import datetime

from pyspark.sql import functions as F

from sievewright.operators import console

T0 = datetime(2024, 1, 1)
AT = lambda d: datetime(2024, 1, d)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_overview_counts_sections(spark):
    sources = spark.createDataFrame([("healthy",), ("healthy",), (None,)], "health_state string")
    reviews = spark.createDataFrame([("a", "pending"), ("a", "done"), (None, "pending")], "review_type string, state string")
    breakers = spark.createDataFrame([("tripped",), ("cleared",)], "state string")
    scans = spark.createDataFrame([("complete", AT(2)), ("complete", AT(1)), ("blocked", None)], "completeness_reason string, ended_at timestamp")
    got = rows(console.overview(sources, reviews, breakers, scans, F.lit(AT(2))))
    assert got == sorted([("source_health", "healthy", 2), ("source_health", None, 1), ("pending_reviews", "a", 1), ("pending_reviews", None, 1), ("active_breakers", "tripped", 1), ("scans_last_24_hours", "complete", 2)], key=repr)
    assert rows(console.overview(*(df.where("false") for df in (sources, reviews, breakers, scans)), F.lit(AT(2)))) == [("active_breakers", "tripped", 0)]


def test_review_queue_and_ids(spark):
    reviews = spark.createDataFrame([(1, 5, AT(2), " a\nb "), (2, 5, AT(1), None), (3, 9, AT(9), "x" * 200), (4, 5, AT(1), "")], "id int, priority int, created_at timestamp, reason string")
    got = console.review_queue(reviews, 3).collect()
    assert [(r.id, r.reason) for r in got] == [(3, "x" * 160), (2, "manual review"), (4, "manual review")]
    good = "123e4567-e89b-12d3-a456-426614174000"
    ids = spark.createDataFrame([([good, "bad", None, good.upper()],), ([],), (None,)], "ids array<string>")
    assert [r[0] for r in ids.select(console.safe_ids(F.col("ids"))).collect()] == [[good, good.upper()], [], None]
    assert spark.range(1).select(console.safe_uuid(F.lit(good[:-1])), console.safe_uuid(F.lit(good))).first()[:] == (None, good)


def test_scan_views(spark):
    scans = spark.createDataFrame([("s", k, AT(1 + k // 2)) for k in range(5)], "source string, scan int, started_at timestamp")
    artifacts = spark.createDataFrame([(4, "b", 1), (4, "a", 0), (2, "c", 0)], "scan int, artifact string, place int")
    got = {r.scan: r.artifacts for r in console.scan_evidence(scans, artifacts, 3).collect()}
    assert got == {4: ["a", "b"], 3: [], 2: ["c"]}
    sizes = spark.createDataFrame([(1, k, "é" * k) for k in range(5)] + [(2, 0, None)], "scan int, place int, body string")
    assert rows(console.scan_bytes(sizes, 3)) == [(1, 3, 6), (2, 1, None)]
    old = spark.createDataFrame([(1, AT(5), None), (2, AT(1), AT(9)), (3, AT(5), None)], "id int, created_at timestamp, last_reconciled_at timestamp")
    assert [r.id for r in console.oldest_first(old, 2).collect()] == [1, 3]
    matches = spark.createDataFrame([(1, c, 1, 0.5, 0.1) for c in range(12)], "id int, company int, priority int, confidence double, name_score double")
    assert sorted(r.company for r in console.ranked_candidates(matches).collect()) == list(range(10))


def test_activation_and_policies(spark):
    sources = spark.createDataFrame([(1, True, "p", AT(9), AT(3)), (2, False, "p", AT(1), AT(3)), (3, True, "q", AT(9), AT(3)), (4, True, "p", AT(2), AT(3)), (5, True, "p", AT(9), None), (6, True, None, AT(9), AT(3))], "id int, enabled boolean, policy string, review_due_at timestamp, next_scan_at timestamp")
    policies = spark.createDataFrame([("p", "approved", AT(9)), ("q", "approved", AT(2))], "policy string, state string, expires_at timestamp")
    evidence = spark.createDataFrame([(1, 0.9), (1, 1.0), (3, 1.0), (4, 1.0), (5, 0.89)], "source int, confidence double")
    got = {r.id: (r.next_scan_at, r.error) for r in console.activation(sources, policies, evidence, F.lit(AT(2))).collect()}
    assert got == {1: (AT(3), None), 2: (None, None), 3: (AT(3), "policy_not_current"), 4: (AT(3), "policy_not_current"), 5: (None, "ownership_evidence_missing"), 6: (AT(3), "policy_not_current")}
    paused = {r.id: (r.enabled, r.next_scan_at, r.paused) for r in console.pause_for_policy(sources, policies, F.lit(AT(2))).collect()}
    assert paused[1] == (True, AT(3), False) and paused[3] == (False, None, True) and paused[2][0] is False and paused[6] == (True, AT(3), False)


def test_guards(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 1), (4, "d", 1)], "id int, v string, _there int")
    new = spark.createDataFrame([(1, "a", None), (2, "x", 1), (4, "x", 1)], "id int, v string, _there int")
    assert rows(console.frozen_rows(old.drop("_there"), new.drop("_there"), ["id"], F.col("id") != 4)) == [(2, "changed"), (3, "deleted")]
    was = spark.createDataFrame([(1, "tripped", "r"), (2, "cleared", "r"), (3, "tripped", "r"), (4, "tripped", None)], "id int, state string, reason string")
    now = spark.createDataFrame([(1, "cleared", "r"), (2, "tripped", "r"), (3, "cleared", "s"), (4, "cleared", None), (9, "tripped", "r")], "id int, state string, reason string")
    assert {r.id: r.allowed for r in console.breaker_changes(was, now).collect()} == {1: True, 2: False, 3: False, 4: True}
    audit = {r.entity: (r.before, r.after) for r in console.audit_rows(old.drop("_there"), new.drop("_there"), "id").collect()}
    assert audit == {2: ('{"v":"b"}', '{"v":"x"}'), 3: ('{"v":"c"}', None), 4: ('{"v":"d"}', '{"v":"x"}')}
    nulls = console.audit_rows(spark.createDataFrame([(1, None)], "id int, v string"), spark.createDataFrame([(1, "x")], "id int, v string"), "id").first()
    assert (nulls.before, nulls.after) == ('{"v":null}', '{"v":"x"}')
    steps = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), ("b", 2)], "k string, n long")
    assert rows(console.sequence_gaps(steps, ["k"], "n")) == [("a", 4, 3), ("b", 2, 1)] and rows(console.sequence_gaps(steps.where("false"), ["k"], "n")) == []


def test_reports_and_pay(spark):
    uuid = "123e4567-e89b-12d3-a456-426614174000"
    cases = [("closed", "gone now", None, None), ("closed", None, None, None), (None, "x", None, "invalid_request"), ("spam", None, None, "invalid_request"), ("closed", "ab", None, "invalid_request"), ("closed", "x" * 2001, None, "invalid_request"), ("duplicate", None, None, "duplicate_target_required"), ("duplicate", None, "7", "invalid_request"), ("duplicate", None, uuid, None), ("closed", None, uuid, "duplicate_target_required"), ("other", None, None, "report_detail_required"), ("other", "why not", None, None)]
    df = spark.createDataFrame(cases, "k string, d string, t string, want string")
    assert all(r.got == r.want for r in df.select("want", console.report_error(F.col("k"), F.col("d"), F.col("t")).alias("got")).collect())
    row = spark.range(1).select(*[console.pay_period(F.lit(x)) for x in ("per-hour-wage", "1 YEAR", "Annual", "weekly", "", None)], console.major_units(F.lit(123456)), console.joined_words(F.lit("a"), F.lit(""), F.lit(None).cast("string"), F.lit("b"))).first()
    assert row[:] == ("hour", "year", "year", "week", "unknown", "unknown", "1234.56", "a, b")
    kinds = spark.createDataFrame([("Remote", None), ("OnSite", True), (None, True), (None, False), (None, None)], "w string, r boolean")
    assert [r[0] for r in kinds.select(console.workplace(F.col("w"), F.col("r"))).collect()] == ["remote", "onsite", "remote", "unspecified", None]
