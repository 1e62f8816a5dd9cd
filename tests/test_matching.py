"""Cascades of resolution, membership decisions, evidence and projections: golden cases and brute force."""

import random
from datetime import datetime


from sievewright.operators import matching, membership, resolve

LISTING = "id string, company string, title string, fingerprint string, location string, start timestamp, until timestamp"
OPPORTUNITY = LISTING.replace("id string", "opportunity string", 1)
KEYS = "id string, kind string, value string, evidence string"
Y = lambda n: datetime(n, 1, 1)


def cascade(spark, listings, requisitions, opportunities, members, claims):
    frames = [spark.createDataFrame(listings, LISTING), spark.createDataFrame(requisitions, KEYS), spark.createDataFrame(opportunities, OPPORTUNITY), spark.createDataFrame(members, "opportunity string, listing string"), spark.createDataFrame(claims, KEYS.replace("id string", "opportunity string", 1))]
    return {r["id"]: (r.action, r.reason, r.opportunity, r.confidence, tuple(r.evidence), r.candidates) for r in matching.match_opportunities(*frames).collect()}


def test_opportunity_cascade(spark):
    same = ("acme", "platform engineer", "f", "remote:FR")
    listings = [(n, *same, Y(2026), None) for n in ("member", "req", "two")] + [("other", "zeta", *same[1:], Y(2026), None), ("content", *same, Y(2026), None), ("past", *same, Y(2026), None), ("near", "acme", "senior platform engineer", "x", "x", Y(2026), None), ("order", "acme", "engineer platform", "f", "remote:FR", Y(2026), None), ("kind", "solo", "t", "f", "l", Y(2026), None), ("empty", "none", "...", "", "", Y(2026), None)]
    opportunities = [("o1", "acme", "platform engineer", "f", "remote:FR", Y(2026), None), ("o2", "acme", "gardener", "g", "x", Y(2026), None), ("o3", "solo", "else", "h", "l", Y(2026), None), ("o4", "past", *same[1:], Y(2024), Y(2025))]
    listings[5] = ("past", "past", *same[1:], Y(2026), None)
    requisitions = [("req", "ats", " Ｒ-1 ", "e1"), ("two", "ats", "r-1", "e2"), ("two", "ats", "r-2", "e3"), ("other", "ats", "r-1", "e4"), ("kind", "other", "r-3", "e5"), ("member", "ats", "r-2", "e6"), ("near", "ats", "", "e7"), ("near", "ats", "r-1", None)]
    claims = [("o1", "ats", "R-1", "c1"), ("o2", "ats", "r-2", "c2"), ("o3", "ats", "r-3", "c3")]
    got = cascade(spark, listings, requisitions, opportunities, [("o3", "member"), ("o1", "elsewhere")], claims)
    assert got == {
        "member": ("existing_member", "source_listing_identity", "o3", 1.0, (), 1),
        "req": ("automatic_match", "exact_requisition_key", "o1", 1.0, ("c1", "e1"), 1),
        "two": ("review", "ambiguous_requisition_key", "o1", None, (), 2),
        "other": ("create_new", "no_candidate", None, 1.0, (), 0),
        "content": ("automatic_match", "exact_content_interval", "o1", 0.97, (), 1),
        "past": ("review", "title_similarity_without_strong_evidence", "o4", None, (), 1),
        "near": ("review", "title_similarity_without_strong_evidence", "o1", None, (), 1),
        "order": ("review", "title_similarity_without_strong_evidence", "o1", None, (), 1),  # the same words are not the same title
        "kind": ("create_new", "no_candidate", None, 1.0, (), 0),
        "empty": ("create_new", "no_candidate", None, 1.0, (), 0),
    }
    assert cascade(spark, [], [], [], [], []) == {}


def test_similar_across_is_brute_force(spark):
    rng = random.Random(3)
    make = lambda n: {k: (rng.choice("xy"), sorted({rng.choice("abcdefg") for _ in range(rng.randrange(6))})) for k in range(n)}
    left, right = make(70), make(60)
    frame = lambda rows, i: spark.createDataFrame([(k, s, e) for k, (s, e) in rows.items()], f"{i} int, scope string, set array<string>")
    for measure, least in (("jaccard", 0.6), ("dice", 0.65)):
        score = lambda a, b: round(len(a & b) / len(a | b) if measure == "jaccard" else 2 * len(a & b) / (len(a) + len(b)), 4)  # noqa: B023, E731
        want = {(i, j) for i, (s, a) in left.items() for j, (t, b) in right.items() if s == t and a and b and score({*a}, {*b}) >= least}
        assert {(r.a, r.b) for r in matching.similar_across(frame(left, "a"), frame(right, "b"), ["scope"], least, measure).collect()} == want


def test_copies_and_sets_out_of_reach_do_not_meet(spark):
    frame = lambda rows, i: spark.createDataFrame(rows, f"{i} int, set array<string>")
    left = frame([(k, ["a", "b", "c"]) for k in range(300)] + [(k, ["s", "u", "p", "0", str(k)]) for k in range(300, 340)], "a")
    right = frame([(k, ["c", "b", "a", "d"]) for k in range(300)] + [(k, ["c", "t", "m", "0", str(k)]) for k in range(300, 340)], "b")
    assert [tuple(r) for r in matching.similar_classes(left, right, [], 0.65, "dice").collect()] == [(["a", "b", "c"], ["a", "b", "c", "d"], 0.8571)]


def test_company_cascade(spark):
    companies = [("c1", "Acme Software", None), ("c2", "Beta", "Acme Softwares"), ("c3", "Gamma", None), ("c4", "Delta", None)]
    theirs = [("c1", "verified_domain", "acme.test", "k1", 1.0), ("c2", "ats_tenant", "g:global:beta", "k2", 0.95), ("c3", "verified_domain", "twice.test", "k3", 1.0), ("c4", "verified_domain", "twice.test", "k4", 1.0), ("c4", "verified_alias", "delta co", "k5", 0.9), ("c3", "ats_tenant", "g:global:weak", "k6", 0.5)]
    incoming = [("domain", "Unlike"), ("tenant", "Unlike"), ("conflict", "Unlike"), ("twice", "Unlike"), ("named", "ACME software"), ("new", "Unlike"), ("alias", "Unlike"), ("none", "Unlike"), ("weak", "Unlike"), ("both", "Gamma")]
    mine = [("domain", "verified_domain", "acme.test", "e1", 0.9), ("tenant", "ats_tenant", "g:global:beta", "e2", 1.0), ("conflict", "verified_domain", "acme.test", "e3", 1.0), ("conflict", "ats_tenant", "g:global:beta", "e4", 1.0), ("twice", "verified_domain", "twice.test", "e5", 1.0), ("new", "verified_domain", "new.test", "e7", 0.95), ("new", "verified_alias", "new", "e6", 0.99), ("alias", "verified_alias", "delta co", "e8", 1.0), ("weak", "ats_tenant", "g:global:weak", "e9", 1.0), ("none", "verified_domain", "acme.test", "", 1.0), ("both", "verified_domain", "acme.test", "e10", 0.8)]
    keys = "id string, kind string, value string, evidence string, confidence double"
    decisions, listed = matching.match_companies(spark.createDataFrame(incoming, "id string, name string"), spark.createDataFrame(mine, keys), spark.createDataFrame(companies, "company string, name string, legal_name string"), spark.createDataFrame(theirs, keys.replace("id", "company", 1)))
    assert {r["id"]: tuple(r)[1:5] + (tuple(r.evidence),) for r in decisions.collect()} == {
        "domain": ("automatic_match", "exact_verified_domain", "c1", 0.9, ("e1", "k1")),
        "tenant": ("automatic_match", "exact_ats_tenant", "c2", 0.95, ("e2", "k2")),
        "conflict": ("review", "conflicting_exact_evidence", None, None, ()),
        "twice": ("review", "ambiguous_verified_domain", None, None, ()),
        "named": ("review", "name_similarity_requires_review", None, None, ()),
        "new": ("create_new", "unclaimed_exact_identity", None, 0.99, ("e6", "e7")),
        "alias": ("automatic_match", "exact_verified_alias", "c4", 0.9, ("e8", "k5")),
        "none": ("review", "insufficient_exact_evidence", None, None, ()),
        "weak": ("create_new", "unclaimed_exact_identity", None, 1.0, ("e9",)),
        "both": ("review", "name_similarity_requires_review", None, None, ()),
    }
    got = {(r["id"], r.place): (r.company, tuple(r.kinds), r.confidence) for r in listed.collect()}
    assert got["conflict", 1] == ("c1", ("verified_domain",), 1.0) and got["conflict", 2] == ("c2", ("ats_tenant",), 0.95) and got["named", 1][0] == "c1" and got["named", 2][0] == "c2"


DECISION = "seq long, operation string, opportunity string, listing string, action string, reason string, confidence double, evidence array<string>, actor string, reviewed boolean, same_company boolean"


def test_membership_decisions(spark):
    auto = lambda n, listing, reason="exact_content_interval", confidence=0.97, evidence=(), actor="system", reviewed=False, same=True: (n, "attach", "o", listing, "automatic_match", reason, confidence, list(evidence), actor, reviewed, same)
    bare = lambda n, op, listing=None, actor="system", opportunity="o", same=True: (n, op, opportunity, listing, None, None, None, None, actor, None, same)
    review = lambda n, listing, actor="operator", reviewed=True: (n, "attach", "o", listing, "review", "ambiguous_requisition_key", None, None, actor, reviewed, True)
    cases = [
        (auto(0, "a"), "opportunity_not_found"), (bare(1, "create", "a"), None), (bare(2, "create", "a"), "opportunity_exists"), (auto(3, "b"), None), (auto(4, "c", confidence=0.9), "automatic_confidence_too_low"),
        (auto(5, "c", "exact_requisition_key", 1.0, ["x", "x"]), "invalid_resolution_contract"), (auto(6, "c", "exact_requisition_key", 1.0, ["x", "y"]), None), (auto(7, "d", reviewed=True), "review_binding_required"),
        (review(8, "d", actor="system"), "review_binding_required"), (review(9, "d"), None), (auto(10, "e", same=False), "opportunity_company_mismatch"), (bare(11, "split", "b"), "operator_required"),
        (bare(12, "split", "b", "operator"), None), (bare(13, "split", "b", "operator"), "active_membership_not_found"), (bare(14, "rebuild"), None), (bare(15, "split", "z", "operator"), "active_membership_not_found"), (auto(16, "b"), None), (bare(17, "split", "b", "operator"), None),
        (bare(18, "merge"), "invalid_operation"), (auto(19, "f", "no_candidate", 0.97), "invalid_resolution_contract"), (bare(20, "create", "q", opportunity="p", same=False), "listing_company_mismatch"),
    ]
    df = spark.createDataFrame([c for c, _ in cases], DECISION)
    assert {r.seq: r.error for r in membership.judged_decisions(df).collect()} == {c[0]: e for c, e in cases}
    state = membership.membership_state(df)
    assert {r.listing: (r.state, r.reason, r.confidence, r.decisions) for r in state.collect()} == {"a": ("automatic", "no_candidate", 1.0, 1), "b": ("human_rejected", None, 1.0, 8), "c": ("automatic", "exact_requisition_key", 1.0, 3), "d": ("human_confirmed", "ambiguous_requisition_key", 1.0, 4)}
    assert [tuple(r) for r in membership.opportunity_status(state).collect()] == [("o", "active", 3)]
    gone = spark.createDataFrame([bare(1, "create", "a"), bare(2, "split", "a", "operator")], DECISION)
    assert [tuple(r) for r in membership.opportunity_status(membership.membership_state(gone)).collect()] == [("o", "closed", 0)]


def test_evidence_is_checked_anew(spark):
    assertions = [("r1", "l1", "/requisitionId", "Req-1", None, False), ("r2", "m1", "/requisitionId", "req-1", None, False), ("r3", "m1", "/connectorMapping", "req-1", None, False), ("r4", "m2", "/requisitionId", "req-1", None, False), ("r5", "m1", "/requisitionId", "req-1", "rejected", False), ("r6", "m1", "/requisitionId", "other", None, False), ("r7", "l1", "/title", "req-1", None, False)]
    assertions += [(f"{x}{k}", x, p, v, None, True) for x in ("l1", "m1", "m3") for k, (p, v) in enumerate(zip(membership.CONTENT_PATHS, ("t", "d", "remote", "fr" if x != "m3" else "de")))]
    members = [("o", "m1", "automatic"), ("o", "m2", "human_rejected"), ("p", "m3", "automatic"), ("q", "m4", "automatic")]
    cases = [("a", "o", ["r1", "r2"], None), ("b", "o", ["r1", "r3"], "x"), ("c", "o", ["r1", "r4"], "x"), ("d", "o", ["r1", "r5"], "x"), ("e", "o", ["r1", "r6"], "x"), ("f", "o", ["r1"], "x"), ("g", "o", ["r1", "r7"], "x"), ("h", "p", ["r1", "r2"], "x"), ("i", "o", ["r1", "gone"], "x")]
    attaches = [(n, "l1", o, "exact_requisition_key", e) for n, o, e, _ in cases] + [(n, x, o, "exact_content_interval", []) for n, x, o in (("s", "l1", "o"), ("t", "l1", "p"), ("u", "l1", "q"), ("v", "l2", "o"))]
    listings = [("l1", Y(2024), None), ("m1", Y(2023), Y(2025)), ("m3", Y(2024), None), ("m4", Y(2024), None), ("l2", Y(2024), None)]
    out = membership.evidence_revalidated(spark.createDataFrame(attaches, "id string, listing string, opportunity string, reason string, evidence array<string>"), spark.createDataFrame(members, "opportunity string, listing string, state string"), spark.createDataFrame(assertions, "assertion string, listing string, path string, value string, review string, selected boolean"), spark.createDataFrame(listings, "listing string, start timestamp, until timestamp"))
    want = {n: e and "requisition_evidence_mismatch" for n, _, _, e in cases} | {"s": None, "t": "exact_content_evidence_mismatch", "u": "exact_content_evidence_mismatch", "v": "exact_content_evidence_mismatch"}
    assert {r["id"]: r.error for r in out.collect()} == want


def test_projection_clears_old_selections(spark):
    rows = [(f"{x}{p}", x, p, f"{x} {p}", 0.9 if x == "a" else 1.0, True if x == "a" else None, "human_review" if x == "a" else "source_field") for x in ("a", "b", "c") for p in membership.REQUIRED if p != "/applyUrl"]
    assertions = spark.createDataFrame(rows, "id string, listing string, path string, value string, confidence double, accepted boolean, origin string")
    members = spark.createDataFrame([("o", "a", "automatic"), ("o", "b", "automatic"), ("o", "c", "human_rejected")], "opportunity string, listing string, state string")
    first = membership.opportunity_projection(members, assertions)
    got = {r.path: (r.value, r.alternatives, r.error) for r in first.collect()}
    assert got["/displayTitle"] == ("a /displayTitle", ["a/displayTitle", "b/displayTitle"], None) and got["/applyUrl"] == (None, None, "missing_opportunity_assertion:/applyUrl")
    again = membership.opportunity_projection(members.where("listing = 'b'"), assertions, first).where("path = '/displayTitle'").collect()
    assert sorted((r.current, r.value) for r in again) == [(False, "a /displayTitle"), (True, "b /displayTitle")]


def test_split_gives_back_the_status_before_the_merge(spark):
    companies = spark.createDataFrame([(k, "provisional") for k in (1, 2, 3, 4)], "id int, status string")
    log = [(2, None, "review", 1, "verified"), (2, 1, "merge", 2, None), (2, 1, "split", 3, None), (3, 1, "merge", 1, None), (4, None, "review", 5, "verified")]
    got = {tuple(r) for r in resolve.merged_companies(companies, spark.createDataFrame(log, "source int, canonical int, operation string, seq int, status string")).collect()}
    assert got == {(1, 1, "provisional"), (2, 2, "verified"), (3, 1, "merged"), (4, 4, "verified")}
