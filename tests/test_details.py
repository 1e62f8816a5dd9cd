"""Vendors' postings: records with evidence and pay, and refusals."""

import json

from sievewright.sources import details

ANSWER = "source_job_id string, tenant string, region string, canonical_url string, apply_url string, body string"
UUID = "123e4567-e89b-12d3-a456-426614174000"


def told(df):
    rows = df.collect()
    return {r.source_job_id: (r.error, {f.path: (f.value, f.origin, f.pointer) for f in r.fields or []}, r.pay and tuple(r.pay)) for r in rows}, rows


def test_greenhouse(spark):
    url = "https://boards.greenhouse.io/acme/jobs/7"
    job = {"id": 7, "title": "Engineer", "location": {"name": "Paris"}, "content": "&lt;p&gt;Safe &amp;amp; sound&lt;/p&gt;&lt;script&gt;x&lt;/script&gt;", "absolute_url": url, "first_published": "2024-01-01T00:00:00Z", "departments": [{"id": 1, "name": "R&D"}], "pay_input_ranges": [{"min_cents": 123456, "max_cents": 200000, "currency_type": "EUR", "title": "Base"}], "unknown": 1}
    two = job | {"departments": job["departments"] * 2, "pay_input_ranges": job["pay_input_ranges"] * 2}
    rows = [("7", "acme", "global", url, url, json.dumps(x)) for x in (job, two, job | {"id": 8}, job | {"content": "&lt;script&gt;x&lt;/script&gt;"}, job | {"title": ""}, {})] + [("7", "other", "global", url, url, json.dumps(job)), ("7", "acme", "global", url + "x", url, json.dumps(job)), ("7", "acme", "global", url, url, "{"), ("7", "acme", "global", url, url, None)]
    got = [told(details.greenhouse_details(spark.createDataFrame([r], ANSWER)))[0]["7"] for r in rows]
    error, fields, pay = got[0]
    assert error is None and pay == ("Base: EUR 1234.56–2000.00", 1234.56, 2000.0, "EUR", "unknown")
    assert fields == {
        "/title": ("Engineer", "source_field", "/title"),
        "/descriptionHtml": ("Safe &amp; sound", "deterministic_rule", "/content"),
        "/descriptionText": ("Safe & sound", "deterministic_rule", "/content"),
        "/locations": ("Paris", "deterministic_rule", "/location/name"),
        "/department": ("R&D", "source_field", "/departments/0/name"),
        "/compensation": ("Base: EUR 1234.56–2000.00", "deterministic_rule", "/pay_input_ranges/0"),
        "/applyUrl": (url, "source_field", "/absolute_url"),
        "/canonicalSourceUrl": (url, "source_field", "/absolute_url"),
    }
    assert got[1][0] is None and got[1][2] is None and "/department" not in got[1][1]
    assert [e for e, *_ in got[2:]] == ["greenhouse_identity_mismatch", "greenhouse_schema_invalid", "greenhouse_schema_invalid", "greenhouse_schema_invalid", "greenhouse_identity_mismatch", "greenhouse_identity_mismatch", "greenhouse_schema_invalid", "greenhouse_schema_invalid"]


def test_lever(spark):
    url = f"https://jobs.eu.lever.co/acme/{UUID}"
    job = {"id": UUID, "text": "Engineer", "categories": {"location": "Paris", "commitment": " Full-time ", "team": "", "department": "R&D", "allLocations": ["Paris", " Paris ", "Berlin", ""]}, "createdAt": 1704067200123, "description": "<b>Work</b>", "hostedUrl": url, "applyUrl": url + "/apply", "workplaceType": "on-site", "salaryRange": {"currency": "EUR", "interval": "per-year-salary", "min": 50000, "max": 60000.5}}
    plain = job | {"categories": {"location": "Rome"}, "salaryRange": None, "workplaceType": None, "createdAt": None}
    rows = [job, plain, job | {"applyUrl": url}, job | {"hostedUrl": url.replace(".eu", "")}, job | {"categories": {}}, job | {"description": "<style>x</style>"}, []]
    got = [told(details.lever_details(spark.createDataFrame([(UUID, "acme", "eu", x["hostedUrl"] if x else url, "", json.dumps(x))], ANSWER))) for x in rows]
    error, fields, pay = got[0][0][UUID]
    assert error is None and pay == ("EUR 50000–60000.5 (per-year-salary)", 50000.0, 60000.5, "EUR", "year") and got[0][1][0].posted_at == "2024-01-01T00:00:00.123Z"
    assert fields["/locations"] == ("Paris; Berlin", "deterministic_rule", "/categories/allLocations") and fields["/workplaceType"] == ("onsite", "source_field", "/workplaceType") and fields["/employmentType"][0] == "Full-time" and "/team" not in fields
    assert got[1][0][UUID][1]["/locations"] == ("Rome", "deterministic_rule", "/categories/location") and got[1][0][UUID][2] is None and got[1][1][0].posted_at is None
    assert [g[0][UUID][0] for g in got[2:]] == ["lever_identity_mismatch", "lever_identity_mismatch", "lever_schema_invalid", "lever_schema_invalid", "lever_schema_invalid"]


def test_ashby(spark):
    url = f"https://jobs.ashbyhq.com/acme/{UUID}"
    salary = {"compensationType": "Salary", "interval": "1 YEAR", "currencyCode": "USD", "minValue": 1.5, "maxValue": None}
    job = {"title": "Engineer", "location": "Paris ", "secondaryLocations": [{"location": "Rome"}, {"location": "Paris"}], "isListed": True, "isRemote": True, "descriptionHtml": "<p>Work</p>", "publishedAt": "2024-01-01", "employmentType": "FullTime", "jobUrl": url, "applyUrl": url + "/application", "compensation": {"compensationTierSummary": "some", "summaryComponents": [salary, {"compensationType": "Bonus", "interval": "1 YEAR"}]}}
    other = job | {"jobUrl": url[:-1] + "1", "applyUrl": url[:-1] + "1/application"}
    foreign = job | {"jobUrl": url.replace("acme", "beta"), "applyUrl": url}
    board = lambda *jobs, version="1": json.dumps({"apiVersion": version, "jobs": jobs})
    many = job | {"compensation": {"compensationTierSummary": "some", "summaryComponents": [salary, salary]}}
    bodies = [board(other, job), board(many), board(job, job), board(job | {"isListed": False}), board(foreign, job), board(other), board(job, version="2"), board(job | {"descriptionHtml": ""}), board(job | {"isRemote": False, "compensation": None})]
    got = [told(details.ashby_details(spark.createDataFrame([(UUID, "acme", "global", url, url + "/application", b)], ANSWER)))[0][UUID] for b in bodies]
    error, fields, pay = got[0]
    assert error is None and pay == ("some", 1.5, None, "USD", "year")
    assert fields["/title"][2] == "/jobs/1/title" and fields["/locations"][0] == "Paris; Rome" and fields["/workplaceType"] == ("remote", "source_field", "/jobs/1/isRemote")
    assert got[1][0] is None and got[1][2] is None and "/compensation" not in got[1][1] and got[8][1]["/workplaceType"][0] == "unspecified"
    assert [e for e, *_ in got[2:8]] == ["ashby_identity_mismatch", "ashby_identity_mismatch", "ashby_identity_mismatch", "ashby_identity_mismatch", "ashby_schema_invalid", "ashby_schema_invalid"]


def test_evidence(spark):
    url = "https://boards.greenhouse.io/acme/jobs/7"
    job = {"id": 7, "title": "T", "location": {"name": "Paris"}, "content": "x", "absolute_url": url}
    df = spark.createDataFrame([("7", "acme", "global", url, url, json.dumps(job)), ("8", "acme", "global", url, url, "")], ANSWER)
    got = {(r.source_job_id, r.path): r.confidence for r in details.evidence(details.greenhouse_details(df)).collect()}
    assert got["7", "/title"] == 1.0 and got["7", "/descriptionText"] == 0.99 and {i for i, _ in got} == {"7"}
    assert details.greenhouse_details(df.where("false")).collect() == []
