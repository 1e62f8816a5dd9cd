from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sievewright.operators import lifecycle, queueing, relational, resolve, search, validate
from sievewright.sources import boards
from sievewright.streaming import twins

T0 = datetime(2024, 1, 1)


def test_lifecycle_vectors(spark):
    half = timedelta(minutes=30)
    rows = [(1, T0, True), (1, T0 + timedelta(minutes=1), False), (1, T0 + timedelta(minutes=1) + half - timedelta(milliseconds=1), False), (1, T0 + timedelta(minutes=1) + half, False), (1, T0 + 4 * half, False), (1, T0 + 5 * half, True)]
    got = lifecycle.lifecycle(spark.createDataFrame(rows, "k int, at timestamp, seen boolean"), "k", "at", "seen").orderBy("at").collect()
    assert [(r.status, r.misses, r.transition) for r in got] == [("active", 0, "opened"), ("possibly_closed", 1, "possibly_closed"), ("possibly_closed", 2, None), ("closed", 3, "closed"), ("closed", 3, None), ("active", 0, "reopened")]


def test_breaker(spark):
    rows = [(10, 0, 10, "suspicious_empty"), (100, 10, 100, "count_collapse"), (200, 100, 200, "closure_spike"), (20, 18, 20, None), (None, 0, 0, None)]
    got = spark.createDataFrame(rows, "p int, o int, a int, want string").select("want", lifecycle.breaker(F.col("p"), F.col("o"), F.col("a")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_source_health(spark):
    scans = [(1, 1, "complete", 5, False), (1, 2, "complete", 0, False), (1, 3, "blocked", 0, False), (2, 1, "truncated", 4, False), (2, 2, "complete", 0, False), (3, 1, "complete", 9, True), (None, 1, "truncated", 1, False)]
    table = spark.createDataFrame(scans, "k int, at int, reason string, n int, tripped boolean")
    got = {r.k: tuple(r)[1:] for r in lifecycle.source_health(table, "k", ["at"], "reason", "n", "tripped").collect()}
    assert got == {1: ("blocked", 0, 2, 1, 1, 1), 2: ("healthy", 0, 2, 1, 0, 1), 3: ("quarantined", 9, 1, 1, 0, 0), None: ("degraded", 1, None, 1, 1, 0)}


def test_lease_events(spark):
    log = [(0, 0, "heartbeat"), (1, 1, "claim"), (200, 1, "heartbeat"), (499, 1, "heartbeat"), (500, 2, "succeed"), (799, 1, "succeed"), (900, 2, "claim"), (901, 1, "heartbeat"), (950, 2, "fail"), (951, 2, "heartbeat")]
    rows = [(7, T0 + timedelta(seconds=s), g, k) for s, g, k in log]
    got = queueing.lease_events(spark.createDataFrame(rows, "job int, at timestamp, gen int, kind string"), "job", ["at"], "at", "kind", "gen").orderBy("at").collect()
    # the lease renewed at 499 has ended by 799
    assert [r.outcome == "accepted" for r in got] == [False, True, True, True, False, False, True, False, True, False]
    assert got[3].expires_at == T0 + timedelta(seconds=799)


def test_merged_companies(spark):
    companies = spark.createDataFrame([(1, "verified"), (2, "provisional"), (3, "verified")], "id int, status string")
    decisions = spark.createDataFrame([(2, 1, "merge", 1), (3, 1, "merge", 2), (2, 1, "split", 3)], "source int, canonical int, operation string, seq int")
    got = {tuple(r) for r in resolve.merged_companies(companies, decisions).collect()}
    assert got == {(1, 1, "verified"), (2, 2, "provisional"), (3, 1, "merged")}


def test_streaming_lifecycle_equals_batch(spark, sf):
    events = twins.read_events(spark, sf)
    scans = events.select(F.col("user_id").alias("listing"), F.col("ts").alias("at"), (F.col("event_type") != "error").alias("seen"))
    stream = {(r.listing, r["at"], r.status) for r in twins.run_to_end(twins.lifecycle_states(scans)).collect()}
    table = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("listing"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") != "error").alias("seen"))
    batch = {(r.listing, r["at"], r.status) for r in lifecycle.lifecycle(table, "listing", "at", "seen").collect()}
    assert stream == batch and batch


def test_keyset_pages_meet_every_row_once(spark):
    df = spark.createDataFrame([(i, float(i % 4) if i % 5 else None) for i in range(23)], "id int, v double").withColumn("s", F.coalesce("v", F.lit(-1.0)))
    seen, after = [], None
    while True:
        rows = relational.keyset_page(df, F.col("s"), "id", 4, after).collect()
        seen += [r.id for r in rows[:4]]
        if len(rows) <= 4:
            break
        after = (rows[3].s, rows[3].id)
    assert sorted(seen) == list(range(23))


def test_search_filters():
    with pytest.raises(ValueError, match="relevance_requires_query"):
        search.Filters(sort="relevance")
    with pytest.raises(ValueError, match="invalid_page_size"):
        search.Filters(limit=101)
    assert search.parse_web_query('data "big table" -old or spark') == [[(False, ["data"]), (False, ["big", "table"]), (True, ["old"])], [(False, ["spark"])]]


def test_company_cascade(spark):
    known = spark.createDataFrame([(1, "verified_domain", "a.x"), (2, "ats_tenant", "g:g:b"), (3, "verified_domain", "d.x"), (4, "verified_domain", "d.x")], "company int, kind string, value string")
    incoming = [(10, "verified_domain", "a.x"), (11, "ats_tenant", "g:g:b"), (12, "verified_domain", "a.x"), (12, "ats_tenant", "g:g:b"), (13, "verified_domain", "d.x"), (14, "verified_domain", "new.x"), (15, "verified_alias", "who"), (16, "verified_alias", "like")]
    names = spark.createDataFrame([(16,)], "id int")
    got = {r.id: (r.action, r.reason, r.company) for r in resolve.resolve_companies(spark.createDataFrame(incoming, "id int, kind string, value string"), known, names).collect()}
    assert got == {
        10: ("match", "exact_verified_domain", 1),
        11: ("match", "exact_ats_tenant", 2),
        12: ("review", "conflicting_exact_evidence", None),
        13: ("review", "ambiguous_verified_domain", None),
        14: ("create", "unclaimed_exact_identity", None),
        15: ("review", "insufficient_exact_evidence", None),
        16: ("review", "name_similarity_requires_review", None),
    }


def test_projection(spark):
    rows = [("o", "/title", "A", 1.0, None, "source_field", 1, 1), ("o", "/title", "B", 0.9, True, "human_review", 1, 2), ("o", "/title", "C", 1.0, False, "human_review", 1, 3), ("o", "/title", "D", 1.5, True, "human_review", 1, 4)]
    got = resolve.project_evidence(spark.createDataFrame(rows, "target string, path string, value string, confidence double, accepted boolean, origin string, listing int, id int")).collect()
    assert [(r.value, r.selected, r.alternatives) for r in got] == [("B", 2, [1, 2])]


def test_alerts(spark):
    snapshot = spark.createDataFrame([(1, 1800.0, 0.95, 100, 0.1, 20, 0.5, 1), (2, 0.0, 0.1, 100, 1.0, 0, 0.0, 0)], "id int, queue_lag double, disk_usage double, count_baseline int, count_ratio double, closures int, closure_ratio double, ssrf_rejections int")
    got = [(r.id, r.name, r.severity) for r in validate.alerts(snapshot, ["id"]).collect()]
    assert got == [(1, "queue_lag", "critical"), (1, "count_collapse", "critical"), (1, "closure_spike", "critical"), (1, "disk_pressure", "critical"), (1, "ssrf_rejection", "warning")]


def test_idempotent_and_upsert(spark):
    log = spark.createDataFrame([("k", 1, "a"), ("k", 2, "a"), ("k", 3, "b")], "key string, n int, h string")
    assert [r.outcome for r in queueing.idempotent(log, ["key"], ["n"], "h").orderBy("n").collect()] == ["accepted", "replayed", "rejected"]
    old, new = spark.createDataFrame([(1, 5), (2, 9)], "k int, v int"), spark.createDataFrame([(1, 7), (2, 3), (3, 1)], "k int, v int")
    assert sorted(map(tuple, relational.upsert(old, new, ["k"], F.col("new_v") > F.col("old_v")).collect())) == [(1, 7), (2, 9), (3, 1)]


def test_board_completeness(spark):
    job = '{"id":%d,"title":"T","updated_at":"2024","location":{"name":"X"},"absolute_url":"https://x"}'
    rows = [("ok", '{"jobs":[%s,%s],"meta":{"total":2}}' % (job % 1, job % 2)), ("empty", '{"jobs":[],"meta":{"total":0}}'), ("total", '{"jobs":[%s],"meta":{"total":2}}' % (job % 1)), ("twice", '{"jobs":[%s,%s],"meta":{"total":2}}' % (job % 1, job % 1)), ("drift", '{"items":[]}'), ("bad", "{")]
    got = {r.board: r.reason for r in boards.greenhouse(spark.createDataFrame(rows, "board string, body string")).collect()}
    assert got == {"ok": "complete", "empty": "suspicious_empty", "total": "schema_invalid", "twice": "duplicate_ids", "drift": "schema_invalid", "bad": "invalid_json"}


def test_paged_completeness(spark):
    page = lambda ids: "[" + ",".join('{"id":"%d","text":"T","categories":{},"hostedUrl":"u","createdAt":1}' % i for i in ids) + "]"
    rows = [("full", 0, page(range(100))), ("done", 0, page(range(100))), ("done", 100, page(range(100, 103))), ("gap", 0, page(range(100))), ("gap", 200, page([7])), ("none", 0, "[]")]
    got = {r.board: (r.reason, r.next_skip) for r in boards.lever(spark.createDataFrame(rows, "board string, skip int, body string")).collect()}
    assert got == {"full": ("pagination_incomplete", 100), "done": ("complete", None), "gap": ("schema_invalid", None), "none": ("suspicious_empty", None)}


def test_similar_pairs_equal_brute_force(spark):
    import random

    rng = random.Random(3)
    sets = {i: sorted({rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))}) for i in range(60)}
    df = spark.createDataFrame(list(sets.items()), "id int, s array<string>")
    got = {(r.a, r.b) for r in resolve.similar_pairs(df, "id", "s", 0.6, "jaccard").collect()}
    want = {(a, b) for a in sets for b in sets if a < b and round(len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]}), 4) >= 0.6}
    assert got == want
    got = {(r.a, r.b) for r in resolve.similar_pairs(df, "id", "s", 0.65).collect()}
    assert got == {(a, b) for a in sets for b in sets if a < b and round(2 * len({*sets[a]} & {*sets[b]}) / (len(sets[a]) + len(sets[b])), 4) >= 0.65}


def test_similar_pairs_of_copies_and_long_sets(spark):
    base = [f"w{k}" for k in range(60)]
    sets = {0: base, 1: base, 2: base[:50] + ["x"], 3: base[:30] + [f"y{k}" for k in range(30)], 4: base[:30] + [f"y{k}" for k in range(30)], 5: [f"z{k}" for k in range(60)]}
    for rows in (sets, {k + 10 * n: [f"{e}{n}" if n else e for e in s] for n in range(4) for k, s in sets.items()}):
        frame = spark.createDataFrame(list(rows.items()), "id int, s array<string>")
        out = resolve.similar_pairs(frame, "id", "s", 0.6, "jaccard")
        assert sorted((r.a, r.b) for r in out.collect()) == [(a, b) for a in rows for b in rows if a < b and len({*rows[a]} & {*rows[b]}) / len({*rows[a]} | {*rows[b]}) >= 0.6]
    # copies are one class when sets meet
    assert "c_a" in out._jdf.queryExecution().analyzed().toString()


def test_retention_claim(spark):
    day = "1996-01-01 12:00:00"
    rows = [
        (1, "present", "1996-01-01 11:00:00", None),
        (2, "present", "1996-01-02 00:00:00", None),
        (3, "deleting", "1996-01-01 10:00:00", "1996-01-01 11:44:59"),
        (4, "deleting", "1996-01-01 10:00:00", "1996-01-01 11:45:00"),
        (5, "delete_failed", "1996-01-01 09:00:00", "1996-01-01 11:59:00"),
        (6, "deleted", "1996-01-01 09:00:00", None),
    ]
    df = spark.createDataFrame(rows, "id long, state string, due string, started string")
    df = df.select("id", "state", F.col("due").cast("timestamp").alias("deletion_due_at"), F.col("due").cast("timestamp").alias("created_at"), F.col("started").cast("timestamp").alias("deletion_started_at"))
    assert [r["id"] for r in queueing.retention_claim(df, day, 10).orderBy("deletion_due_at").collect()] == [5, 3, 1]
    assert [r["id"] for r in queueing.retention_claim(df, day, 1).collect()] == [5]


def test_overlaps_are_brute_force(spark):
    import random

    rng = random.Random(8)
    hour = timedelta(hours=1)

    def made(n):
        rows = []
        for k in range(n):
            start = T0 + rng.randrange(-3000, 3000) * hour / 2
            until = rng.choice([None, start, start + rng.randrange(20) * hour / 3, start + rng.randrange(30_000) * hour / 7, start - hour, datetime(2500, 1, 1)])
            rows.append((rng.choice("xy"), k, start, until))
        return rows

    left, right = made(90), made(80) + [("x", 900, datetime(1950, 1, 1), None), ("y", 901, datetime(1960, 5, 1), datetime(1980, 1, 1))]
    frame = lambda rows: spark.createDataFrame(rows, "k string, id int, start timestamp, until timestamp")
    end = datetime(9999, 12, 31)
    meets = lambda a, b: a[0] == b[0] and a[2] <= (a[3] or end) and b[2] <= (b[3] or end) and a[2] <= (b[3] or end) and b[2] <= (a[3] or end)
    want = sorted((a[1], b[1]) for a in left for b in right if meets(a, b))
    for short in (1000, 5):
        assert sorted((r.id, r.id_r) for r in relational.overlap_join(frame(left), frame(right), ["k"], short=short).collect()) == want


def test_escalation_counts_sources(spark):
    import random

    rng = random.Random(2)
    trips = [(k, rng.choice(["a", "b", None]), rng.randrange(6), T0 + timedelta(seconds=rng.choice([rng.randrange(200_000), 86_390 + rng.randrange(20), 400 * rng.randrange(9)]))) for k in range(300)]
    got = lifecycle.escalated(spark.createDataFrame(trips, "id int, g string, s int, at timestamp"), "g", "s", "at").collect()
    want = {k: len({s for _, h, s, u in trips if h == g and 0 <= (t - u).total_seconds() <= 900}) for k, g, _, t in trips}
    assert {r.id: r.sources for r in got} == want and all(r.escalates == (r.sources >= 3) for r in got) and len(got) == 300


def test_ordered_hash(spark):
    import hashlib
    import random

    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", "", None]), hashlib.sha256(b"%d" % rng.randrange(50)).hexdigest()) for _ in range(300)] + [("n", None), ("a", None)]
    got = {r.k: r.h for r in relational.ordered_hash(spark.createDataFrame(rows, "k string, v string"), "k", "v", "h").collect()}
    want = {k: hashlib.sha256("\n".join(sorted(v for j, v in rows if j == k and v)).encode()).hexdigest() for k in {k for k, _ in rows}}
    assert got == want and relational.ordered_hash(spark.createDataFrame([], "k string, v string"), "k", "v", "h").collect() == []
