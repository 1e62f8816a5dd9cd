"""Postings in full: one vendor answer each to a record of evidence-backed fields and pay, or the reason why it is refused."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sievewright.functions import text, urls
from sievewright.operators.console import major_units, pay_period, workplace
from sievewright.sources.boards import ASHBY, LEVER

# Schema of one posting of the first vendor; pay components of the third.
GREENHOUSE_DETAIL = "struct<id:bigint,title:string,company_name:string,first_published:string,updated_at:string,application_deadline:string,location:struct<name:string>,content:string,absolute_url:string,departments:array<struct<id:bigint,name:string>>,offices:array<struct<id:bigint,name:string,location:string>>,pay_input_ranges:array<struct<min_cents:bigint,max_cents:bigint,currency_type:string,title:string,blurb:string>>>"
ASHBY_DETAIL = ASHBY.replace("compensation:struct<compensationTierSummary:string>", "compensation:struct<compensationTierSummary:string,scrapeableCompensationSalarySummary:string,summaryComponents:array<struct<compensationType:string,interval:string,currencyCode:string,minValue:double,maxValue:double>>>")
LEVER_DETAIL = LEVER.removeprefix("array<").removesuffix(">")
POSTING = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
FIELD, RULE = "source_field", "deterministic_rule"
PAY = "struct<raw:string,minimum:double,maximum:double,currency:string,period:string>"


@F.pandas_udf(StringType())
def unfolded_text(contents: pd.Series) -> pd.Series:
    """Visible text below two layers of character references, in one pass."""
    return contents.map(lambda c: None if c is None else text.visible(html.unescape(html.unescape(c))))


def _field(path: str, value: Column, origin: str, pointer: Column | str) -> Column:
    return F.struct(F.lit(path).alias("path"), value.cast("string").alias("value"), F.lit(origin).alias("origin"), (F.lit(pointer) if isinstance(pointer, str) else pointer).alias("pointer"))


def _trimmed(value: Column) -> Column:
    return F.when(F.trim(value) != "", F.trim(value))


def _number(value: Column) -> Column:
    """A number without decimals that say nothing."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))


def _finish(rows: DataFrame, error: Column, dates: dict[str, Column], fields: list[Column], pay: Column) -> DataFrame:
    told = rows.withColumn("error", error)
    good = F.col("error").isNull()
    kept = F.filter(F.array(*fields), lambda f: f["value"].isNotNull())
    return told.select("source_job_id", "error", *[F.when(good, c).alias(n) for n, c in dates.items()], F.when(good, kept).alias("fields"), F.when(good, pay.cast(PAY)).alias("pay"))


def greenhouse_details(answers: DataFrame) -> DataFrame:
    """``answers(source_job_id, tenant, canonical_url, apply_url, body)`` -> ``source_job_id, error, posted_at, updated_at, valid_through, fields, pay``.

    Errors: ``greenhouse_schema_invalid`` for bodies of another form or without visible text, ``greenhouse_identity_mismatch`` where the posting is another one, or hosted on another tenant's board.
    """
    rows = answers.withColumn("j", F.from_json("body", GREENHOUSE_DETAIL)).withColumn("_text", unfolded_text(F.col("j.content")))
    j = F.col("j")
    hosted = urls.vendor(j["absolute_url"])
    complete = j["id"].isNotNull() & j["title"].between("\x01", "\U0010ffff") & (F.length(j["title"]) <= 500) & j["location"]["name"].isNotNull() & j["absolute_url"].isNotNull() & j["content"].isNotNull()
    same = (j["id"].cast("string") == F.col("source_job_id")) & (j["absolute_url"] == F.col("canonical_url")) & ~F.coalesce((hosted["vendor"] == "greenhouse") & (hosted["tenant"] != F.lower("tenant")), F.lit(False))
    error = F.when(~F.coalesce(complete, F.lit(False)), "greenhouse_schema_invalid").when(~F.coalesce(same, F.lit(False)), "greenhouse_identity_mismatch").when(F.coalesce("_text", F.lit("")) == "", "greenhouse_schema_invalid")
    one = F.when(F.size(j["pay_input_ranges"]) == 1, F.get(j["pay_input_ranges"], F.lit(0)))
    raw = F.concat(one["title"], F.lit(": "), one["currency_type"], F.lit(" "), major_units(one["min_cents"]), F.lit("–"), major_units(one["max_cents"]))
    pay = F.when(one.isNotNull(), F.struct(raw, (one["min_cents"] / 100).cast("double"), (one["max_cents"] / 100).cast("double"), one["currency_type"], F.lit("unknown")))
    department = F.when(F.size(j["departments"]) == 1, F.get(j["departments"], F.lit(0))["name"])
    fields = [
        _field("/title", j["title"], FIELD, "/title"),
        _field("/descriptionHtml", text.escape_html(F.col("_text")), RULE, "/content"),
        _field("/descriptionText", F.col("_text"), RULE, "/content"),
        _field("/locations", j["location"]["name"], RULE, "/location/name"),
        _field("/department", department, FIELD, "/departments/0/name"),
        _field("/compensation", F.when(one.isNotNull(), raw), RULE, "/pay_input_ranges/0"),
        _field("/applyUrl", j["absolute_url"], FIELD, "/absolute_url"),
        _field("/canonicalSourceUrl", j["absolute_url"], FIELD, "/absolute_url"),
    ]
    return _finish(rows, error, {"posted_at": j["first_published"], "updated_at": j["updated_at"], "valid_through": j["application_deadline"]}, fields, pay)


def lever_details(answers: DataFrame) -> DataFrame:
    """``answers(source_job_id, tenant, region, canonical_url, apply_url, body)`` -> as :func:`greenhouse_details`, errors ``lever_...``.

    Both URLs of a posting are its tenant's on the region's board, the second one's path ends in ``/apply``. Several locations are joined by ``; ``.
    """
    rows = answers.withColumn("j", F.from_json("body", LEVER_DETAIL)).withColumn("_text", text.html_to_text(F.col("j.description")))
    j, c = F.col("j"), F.col("j.categories")
    board = F.concat(F.when(F.col("region") == "eu", "https://jobs.eu.lever.co/").otherwise("https://jobs.lever.co/"), "tenant", F.lit("/"), "source_job_id")
    places = F.when(F.size(c["allLocations"]) > 0, c["allLocations"]).otherwise(F.array_compact(F.array(c["location"])))
    labels = F.array_distinct(F.filter(F.transform(places, lambda x: F.trim(x)), lambda x: x != ""))
    complete = j["id"].isNotNull() & j["text"].isNotNull() & c.isNotNull() & j["description"].isNotNull() & j["hostedUrl"].isNotNull() & j["applyUrl"].isNotNull()
    same = (j["id"] == F.col("source_job_id")) & j["id"].rlike(POSTING) & (j["hostedUrl"] == F.col("canonical_url")) & (j["hostedUrl"] == board) & (j["applyUrl"] == F.concat(board, F.lit("/apply")))
    error = F.when(~F.coalesce(complete, F.lit(False)), "lever_schema_invalid").when(~F.coalesce(same, F.lit(False)), "lever_identity_mismatch").when((F.coalesce("_text", F.lit("")) == "") | (F.size(labels) == 0), "lever_schema_invalid")
    s = j["salaryRange"]
    raw = F.concat(s["currency"], F.lit(" "), _number(s["min"]), F.lit("–"), _number(s["max"]), F.lit(" ("), s["interval"], F.lit(")"))
    pay = F.when(s.isNotNull(), F.struct(raw, s["min"], s["max"], s["currency"], pay_period(s["interval"])))
    kind = F.when(j["workplaceType"] == "on-site", "onsite").otherwise(j["workplaceType"])
    fields = [
        _field("/title", j["text"], FIELD, "/text"),
        _field("/descriptionHtml", text.escape_html(F.col("_text")), RULE, "/description"),
        _field("/descriptionText", F.col("_text"), RULE, "/description"),
        _field("/locations", F.array_join(labels, "; "), RULE, F.when(F.size(c["allLocations"]) > 0, "/categories/allLocations").otherwise("/categories/location")),
        _field("/workplaceType", kind, FIELD, "/workplaceType"),
        _field("/employmentType", _trimmed(c["commitment"]), FIELD, "/categories/commitment"),
        _field("/compensation", F.when(s.isNotNull(), raw), RULE, "/salaryRange"),
        _field("/department", _trimmed(c["department"]), FIELD, "/categories/department"),
        _field("/team", _trimmed(c["team"]), FIELD, "/categories/team"),
        _field("/applyUrl", j["applyUrl"], FIELD, "/applyUrl"),
        _field("/canonicalSourceUrl", j["hostedUrl"], FIELD, "/hostedUrl"),
    ]
    none = F.lit(None).cast("string")
    created = F.date_format(F.timestamp_millis(j["createdAt"]), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return _finish(rows, error, {"posted_at": created, "updated_at": none, "valid_through": none}, fields, pay)


def ashby_details(answers: DataFrame) -> DataFrame:
    """``answers(source_job_id, tenant, canonical_url, apply_url, body)`` (the body is the whole board) -> as :func:`greenhouse_details`, errors ``ashby_...``.

    Exactly one listed job of the board has the id in its URL, and both its URLs; every job's URLs are the tenant's. Pointers name its place on the board.
    """
    parsed = answers.withColumn("b", F.from_json("body", ASHBY_DETAIL))
    board = F.concat(F.lit("https://jobs.ashbyhq.com/"), "tenant", F.lit("/"))
    own = lambda x: F.coalesce(F.startswith(x["jobUrl"], board) & F.substring(x["jobUrl"], F.length(board) + 1, F.lit(36)).rlike(POSTING) & (F.length(x["jobUrl"]) == F.length(board) + 36) & (x["applyUrl"] == F.concat(x["jobUrl"], F.lit("/application"))), F.lit(False))
    numbered = F.transform(F.col("b.jobs"), lambda x, i: F.struct(x.alias("job"), i.alias("i")))
    matches = F.filter(numbered, lambda x: F.endswith(x["job"]["jobUrl"], F.concat(F.lit("/"), F.col("source_job_id"))))
    rows = parsed.withColumns({"_foreign": F.exists("b.jobs", lambda x: ~own(x)), "_matches": matches})
    rows = rows.withColumn("m", F.when(F.size("_matches") == 1, F.get("_matches", F.lit(0)))).withColumn("_text", text.html_to_text(F.col("m.job.descriptionHtml")))
    j, at = F.col("m.job"), F.concat(F.lit("/jobs/"), F.col("m.i").cast("string"))
    complete = (F.col("b.apiVersion") == "1") & F.col("b.jobs").isNotNull()
    same = ~F.col("_foreign") & F.col("m").isNotNull() & j["isListed"] & (j["jobUrl"] == F.col("canonical_url")) & (j["applyUrl"] == F.col("apply_url"))
    error = F.when(~F.coalesce(complete, F.lit(False)), "ashby_schema_invalid").when(~F.coalesce(same, F.lit(False)), "ashby_identity_mismatch").when(j["title"].isNull() | j["publishedAt"].isNull() | (F.coalesce("_text", F.lit("")) == ""), "ashby_schema_invalid")
    salaries = F.filter(F.coalesce(j["compensation"]["summaryComponents"], F.array().cast("array<struct<compensationType:string,interval:string,currencyCode:string,minValue:double,maxValue:double>>")), lambda x: x["compensationType"] == "Salary")
    one = F.get(salaries, F.lit(0))
    raw = F.when(F.size(salaries) <= 1, F.coalesce(_trimmed(j["compensation"]["scrapeableCompensationSalarySummary"]), _trimmed(j["compensation"]["compensationTierSummary"])))
    pay = F.when(raw.isNotNull(), F.struct(raw, one["minValue"], one["maxValue"], one["currencyCode"], pay_period(one["interval"])))
    labels = F.array_distinct(F.filter(F.transform(F.concat(F.array(j["location"]), F.coalesce(F.transform(j["secondaryLocations"], lambda x: x["location"]), F.array().cast("array<string>"))), lambda x: F.trim(x)), lambda x: x != ""))
    under = lambda name: F.concat(at, F.lit(f"/{name}"))
    fields = [
        _field("/title", j["title"], FIELD, under("title")),
        _field("/descriptionHtml", text.escape_html(F.col("_text")), RULE, under("descriptionHtml")),
        _field("/descriptionText", F.col("_text"), RULE, under("descriptionHtml")),
        _field("/locations", F.array_join(labels, "; "), RULE, under("location")),
        _field("/workplaceType", workplace(j["workplaceType"], j["isRemote"]), FIELD, F.when(j["workplaceType"].isNotNull(), under("workplaceType")).otherwise(under("isRemote"))),
        _field("/employmentType", j["employmentType"], FIELD, under("employmentType")),
        _field("/compensation", raw, RULE, under("compensation")),
        _field("/department", _trimmed(j["department"]), FIELD, under("department")),
        _field("/team", _trimmed(j["team"]), FIELD, under("team")),
        _field("/applyUrl", j["applyUrl"], FIELD, under("applyUrl")),
        _field("/canonicalSourceUrl", j["jobUrl"], FIELD, under("jobUrl")),
    ]
    none = F.lit(None).cast("string")
    return _finish(rows, error, {"posted_at": j["publishedAt"], "updated_at": none, "valid_through": none}, fields, pay)


def evidence(parsed: DataFrame) -> DataFrame:
    """A row per field with its evidence: ``source_job_id, path, value, origin, pointer, confidence``: what a source says outright counts 1, what a rule made of it 0.99."""
    told = parsed.where("error is null").select("source_job_id", F.explode("fields").alias("f")).select("source_job_id", "f.*")
    return told.withColumn("confidence", F.when(F.col("origin") == FIELD, 1.0).otherwise(0.99))


def evidence_or_error(parsed: DataFrame) -> DataFrame:
    """``source_job_id, path, value, origin, pointer``: a row per field, and one of a refused posting with its error as the value; postings are parsed once for both."""
    none = F.lit(None).cast("string")
    refused = F.array(F.struct(none.alias("path"), F.col("error").alias("value"), F.lit("error").alias("origin"), none.alias("pointer")))
    return parsed.select("source_job_id", F.explode(F.when(F.col("error").isNull(), F.col("fields")).otherwise(refused)).alias("f")).select("source_job_id", "f.*")
