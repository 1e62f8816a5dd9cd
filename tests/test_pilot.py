"""Every rule of the pilot manifest by a row that breaks it, and the report."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sievewright.operators import domains, pilot

NOW = datetime(2024, 6, 10)
DAY = timedelta(days=1)
ENTRY = "no long, connector string, tenant string, region string, board_url string, api_url string, domain string, careers_url string, evidence_url string, observed_at timestamp"
POLICY = "no long, family string, host_pattern string, reviewed_at timestamp, expires_at timestamp"
HELD = "no long, company string, domain string, careers_url string, ats_url string, observed_at timestamp"


def entry(no, connector="greenhouse", tenant=None, region="global", domain=None, observed=NOW - 2 * DAY, **other):
    tenant = tenant or f"t{no}"
    domain = domain or f"d{no}.com"
    hosts = {"greenhouse": ("boards.greenhouse.io", "boards-api.greenhouse.io/v1/boards"), "lever": ("jobs.eu.lever.co" if region == "eu" else "jobs.lever.co", ("api.eu.lever.co" if region == "eu" else "api.lever.co") + "/v0/postings"), "ashby": ("jobs.ashbyhq.com", "api.ashbyhq.com/posting-api/job-board")}
    board, api = hosts.get(connector, ("x.com", "y.com"))
    row = dict(no=no, connector=connector, tenant=tenant, region=region, board_url=f"https://{board}/{tenant}", api_url=f"https://{api}/{tenant}", domain=domain, careers_url=f"https://careers.{domain}/", evidence_url=f"https://{domain}/jobs", observed_at=observed)
    return tuple((row | other).values())


def policy(no, family, host=None, reviewed=NOW - 2 * DAY, expires=NOW + 60 * DAY):
    return no, family, host or pilot.POLICY_HOSTS[family], reviewed, expires


def errors(spark, policies, entries, quarantine, expected=None, generated=NOW - 2 * DAY, reviewed=NOW - DAY, synthetic=False):
    suffixes = domains.rules(spark.createDataFrame([("com",), ("co.uk",), ("uk",)], "rule string"))
    found = pilot.manifest_errors(spark.createDataFrame(policies, POLICY), spark.createDataFrame(entries, ENTRY), spark.createDataFrame(quarantine, HELD), suffixes, F.lit(NOW), F.lit(generated), F.lit(reviewed), len(entries) if expected is None else expected, synthetic)
    return {(r.part, r.no): r.code for r in found.collect()}, found


ALL = [policy(0, "greenhouse"), policy(1, "lever"), policy(2, "ashby")]


def test_entries(spark):
    cases = [
        (entry(0), None), (entry(1, "lever"), None), (entry(2, "lever", region="eu"), None), (entry(3, "ashby", board_url="https://jobs.ashbyhq.com/t3/"), None), (entry(4, tenant="-bad"), "invalid_tenant_key"),
        (entry(5, region="eu"), "greenhouse_identity_mismatch"), (entry(6, board_url="https://boards.greenhouse.io/other"), "greenhouse_identity_mismatch"), (entry(7, api_url="https://boards-api.greenhouse.io/v1/boards/t7?x=1"), "greenhouse_identity_mismatch"), (entry(8, "lever", region="eu", board_url="https://jobs.lever.co/t8"), "lever_identity_mismatch"),
        (entry(9, "ashby", board_url="https://jobs.ashbyhq.com/t9#top"), "ashby_identity_mismatch"), (entry(10, domain="x.lever.co"), "shared_ats_domain_is_not_employer_identity"), (entry(11, domain="a.b.com"), "primary_domain_not_registrable"), (entry(12, domain="co.uk"), "primary_domain_not_registrable"),
        (entry(13, evidence_url="https://elsewhere.com/"), "ownership_evidence_domain_mismatch"), (entry(14, careers_url="https://xd14.com/"), "ownership_evidence_domain_mismatch"), (entry(15, observed=NOW), "observation_in_future"), (entry(16, observed=NOW + DAY), "observation_in_future"), (entry(17, observed=NOW - 8 * DAY), "observation_stale"),
        (entry(18, domain="d0.com"), "duplicate_verified_domain"), (entry(19, tenant="T0"), "duplicate_active_tenant"), (entry(20, "other"), "manifest_schema_invalid"), (entry(21, domain="acme.test"), "primary_domain_not_registrable"), (entry(22, domain="x.co.uk"), None), (entry(23, board_url="https://job-boards.greenhouse.io/t23"), None),
    ]
    got, _ = errors(spark, ALL, [e for e, _ in cases], [])
    assert got == {("entries", e[0]): code for e, code in cases if code}
    assert errors(spark, ALL, [entry(21, domain="acme.test")], [], synthetic=True)[0] == {}
    assert errors(spark, ALL[:1], [entry(1, "lever")], [])[0] == {("entries", 1): "source_policy_missing"}


def test_policies_dataset_and_quarantine(spark):
    policies = [policy(0, "lever", reviewed=NOW + DAY), policy(1, "lever"), policy(2, "ashby", "*.lever.co"), policy(3, "greenhouse", expires=NOW)]
    got, found = errors(spark, policies, [entry(0)], [], expected=3)
    assert got == {("policies", 0): "policy_not_current", ("policies", 1): "duplicate_policy_family", ("policies", 2): "policy_host_mismatch", ("policies", 3): "policy_not_current", ("manifest", 0): "verified_entry_count_mismatch"}
    assert tuple(pilot.first_error(found).first()) == ("manifest", 0, "verified_entry_count_mismatch")
    for bad in (policy(0, "ashby", reviewed=NOW - 31 * DAY), policy(0, "ashby", reviewed=NOW - 2 * DAY, expires=NOW + 89 * DAY), policy(0, "ashby", reviewed=NOW - DAY / 2)):
        assert errors(spark, [bad], [entry(0, "ashby")], [])[0] == {("policies", 0): "policy_review_window_invalid"}
    for days, code in (((1, -1), "dataset_review_in_future"), ((-1, 1), "dataset_review_in_future"), ((-1, -2), "dataset_review_in_future"), ((-8, -1), "dataset_review_stale")):
        assert errors(spark, ALL, [entry(0, observed=NOW - 3 * DAY)], [], generated=NOW + days[0] * DAY, reviewed=NOW + days[1] * DAY)[0].get(("dataset", 0)) == code
    at = NOW - 2 * DAY
    held = [(0, "A", "new.com", None, None, at), (1, "a", "new.com", None, None, at), (2, "B", "d0.com", None, None, at), (3, "C", None, "https://c.com", None, NOW), (4, "D", None, None, "https://x", NOW - 8 * DAY), (5, "E", None, None, None, at), (6, "F", None, "https://c.com", None, at), (7, "f", None, "https://c.com", None, at)]
    got, found = errors(spark, ALL, [entry(0)], held)
    assert got == {("quarantine", 1): "duplicate_quarantine_entry", ("quarantine", 2): "quarantine_conflicts_verified_domain", ("quarantine", 3): "quarantine_observation_in_future", ("quarantine", 4): "quarantine_observation_stale", ("quarantine", 5): "manifest_schema_invalid", ("quarantine", 7): "duplicate_quarantine_entry"}
    assert tuple(pilot.first_error(found).first()) == ("quarantine", 1, "duplicate_quarantine_entry") and pilot.first_error(found.where("false")).collect() == []


def test_report_and_changes(spark):
    entries = spark.createDataFrame([entry(0), entry(1, "lever"), entry(2, "lever", region="eu", tenant="t1"), entry(3, "ashby")], ENTRY)
    got = pilot.manifest_report(spark.createDataFrame(ALL, POLICY), entries, spark.createDataFrame([(0, "A", "x.com", None, None, NOW)], HELD)).first().asDict()
    assert got == {"verified_entries": 4, "greenhouse": 1, "lever": 2, "ashby": 1, "unique_domains": 4, "unique_tenants": 4, "quarantined_entries": 1, "policies": 3}
    manifest = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "source string, fingerprint string")
    registry = spark.createDataFrame([("b", "2", "active"), ("c", "0", "active"), ("d", "4", "quarantined"), ("e", "5", "active")], "source string, fingerprint string, state string")
    assert {r.source: r.change for r in pilot.candidate_changes(manifest, registry).collect()} == {"a": "added", "b": "unchanged", "c": "updated", "d": "reopened", "e": "absent"}
