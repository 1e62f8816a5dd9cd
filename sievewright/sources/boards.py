"""Board scans: vendor JSON to listings, with completeness, and listings to normalised, evidence-backed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions import digests, text, urls

# Schemas of vendors' boards; unknown keys are put up with.
GREENHOUSE = "struct<jobs:array<struct<id:bigint,internal_job_id:bigint,title:string,updated_at:string,location:struct<name:string>,absolute_url:string,language:string>>,meta:struct<total:bigint>>"
LEVER = "array<struct<id:string,text:string,categories:struct<location:string,commitment:string,team:string,department:string,level:string,allLocations:array<string>>,country:string,createdAt:bigint,description:string,hostedUrl:string,applyUrl:string,workplaceType:string,salaryRange:struct<currency:string,interval:string,min:double,max:double>>>"
ASHBY = "struct<apiVersion:string,jobs:array<struct<id:string,title:string,location:string,secondaryLocations:array<struct<location:string>>,department:string,team:string,isListed:boolean,isRemote:boolean,workplaceType:string,descriptionHtml:string,publishedAt:string,employmentType:string,jobUrl:string,applyUrl:string,compensation:struct<compensationTierSummary:string>>>>"
PAGE = 100


def read_artifacts(spark, path: str, limit: int = 5 << 20) -> DataFrame:
    """Stored responses: ``path, sha256, bytes, body``; what is too long or no UTF-8 has a null body and an error."""
    raw = spark.read.format("binaryFile").load(path)
    body = F.col("content").cast("string")
    error = F.when(F.col("length") > limit, "byte_limit").when(~F.is_valid_utf8(body), "invalid_utf8")
    return raw.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), error.alias("error"), F.when(error.isNull(), body).alias("body"))


def _finish(rows: DataFrame, reason: Column) -> DataFrame:
    return rows.withColumn("reason", reason).withColumn("complete", F.col("reason") == "complete")


def greenhouse(boards: DataFrame) -> DataFrame:
    """``boards(board, body)`` -> ``board, listings, reason, complete``: one JSON document a board.

    Complete only if the document parses, its total is the number of jobs, ids are distinct and there are any.
    """
    parsed = boards.withColumn("j", F.from_json("body", GREENHOUSE))
    jobs = F.col("j.jobs")
    fp = lambda x: digests.listing_fingerprint(x["id"], x["title"], x["updated_at"], x["location"]["name"], x["absolute_url"])
    listing = F.transform(jobs, lambda x: F.struct(x["id"].cast("string").alias("source_job_id"), x["title"].alias("title"), x["location"]["name"].alias("location"), x["absolute_url"].alias("url"), x["updated_at"].alias("updated_at"), fp(x).alias("fingerprint")))
    ids = F.transform(jobs, lambda x: x["id"])
    reason = (
        F.when(F.try_parse_json("body").isNull(), "invalid_json")
        .when(jobs.isNull() | F.exists(ids, lambda i: i.isNull()) | (F.coalesce(F.col("j.meta.total"), F.size(jobs).cast("long")) != F.size(jobs)), "schema_invalid")
        .when(F.size(jobs) == 0, "suspicious_empty")
        .when(F.size(F.array_distinct(ids)) < F.size(ids), "duplicate_ids")
        .otherwise("complete")
    )
    return _finish(parsed.withColumn("listings", listing), reason).drop("j", "body")


def lever(pages: DataFrame) -> DataFrame:
    """``pages(board, skip, body)`` -> ``board, listings, reason, complete``: pages must follow each other and end with a short one."""
    parsed = pages.withColumn("j", F.from_json("body", LEVER)).withColumn("bad", F.try_parse_json("body").isNull())
    grouped = parsed.groupBy("board").agg(F.array_sort(F.collect_list(F.struct("skip", F.coalesce(F.size("j"), F.lit(-1)).alias("n"), "j"))).alias("pages"), F.max("bad").alias("bad"))
    items = F.flatten(F.transform("pages", lambda p: F.coalesce(p["j"], F.from_json(F.lit("[]"), LEVER))))
    fp = lambda x: digests.listing_fingerprint(x["id"], x["text"], x["createdAt"], x["categories"]["location"], x["hostedUrl"])
    listing = F.transform(items, lambda x: F.struct(x["id"].alias("source_job_id"), x["text"].alias("title"), x["categories"]["location"].alias("location"), x["hostedUrl"].alias("url"), F.timestamp_millis(x["createdAt"]).cast("string").alias("updated_at"), fp(x).alias("fingerprint")))
    last = F.element_at("pages", -1)
    contiguous = F.forall(F.sequence(F.lit(0), F.size("pages") - 1), lambda i: F.get("pages", i)["skip"] == i * PAGE)
    inner = F.forall(F.slice("pages", 1, F.size("pages") - 1), lambda p: p["n"] == PAGE)
    ids = F.transform("listings", lambda x: x["source_job_id"])
    reason = (
        F.when(F.col("bad"), "invalid_json")
        .when(F.exists("pages", lambda p: p["n"] < 0) | ~contiguous | ~inner, "schema_invalid")
        .when(last["n"] >= PAGE, "pagination_incomplete")
        .when(F.size("listings") == 0, "suspicious_empty")
        .when(F.size(F.array_distinct(ids)) < F.size(ids), "duplicate_ids")
        .otherwise("complete")
    )
    out = _finish(grouped.withColumn("listings", listing), reason)
    next_skip = F.when(F.col("reason") == "pagination_incomplete", last["skip"] + PAGE)
    return out.withColumn("next_skip", next_skip).drop("pages", "bad")


def ashby(boards: DataFrame) -> DataFrame:
    """``boards(board, body)`` -> as :func:`greenhouse`; unlisted jobs count for identity and then go."""
    parsed = boards.withColumn("j", F.from_json("body", ASHBY))
    jobs = F.col("j.jobs")
    identity = lambda x: F.regexp_extract(x["jobUrl"], "/([0-9a-fA-F-]{36})(?:/|$|\\?)", 1)
    fp = lambda x: digests.listing_fingerprint(identity(x), x["title"], x["publishedAt"], x["location"], x["jobUrl"])
    listing = F.transform(F.filter(jobs, lambda x: x["isListed"]), lambda x: F.struct(identity(x).alias("source_job_id"), x["title"].alias("title"), x["location"].alias("location"), x["jobUrl"].alias("url"), x["publishedAt"].alias("updated_at"), fp(x).alias("fingerprint")))
    ids = F.transform(jobs, identity)
    reason = (
        F.when(F.try_parse_json("body").isNull(), "invalid_json")
        .when(jobs.isNull() | F.exists(ids, lambda i: i.isNull() | (i == "")), "schema_invalid")
        .when(F.size("listings") == 0, "suspicious_empty")
        .when(F.size(F.array_distinct(ids)) < F.size(ids), "duplicate_ids")
        .otherwise("complete")
    )
    return _finish(parsed.withColumn("listings", listing), reason).drop("j", "body")


def normalize(listings: DataFrame) -> DataFrame:
    """``source_job_id, title, location, url, description_html, employment, workplace_explicit`` -> candidate columns and its fingerprint."""
    locations = F.array_distinct(F.transform(F.split("location", r"\s*;\s*"), lambda x: F.trim(x)))
    out = listings.select(
        "*",
        text.clean(F.col("title"), 500).alias("display_title"),
        text.search_title(F.col("title")).alias("normalized_title"),
        text.html_to_text(F.col("description_html")).alias("description_text"),
        locations.alias("locations"),
        text.employment_type(F.col("employment")).alias("employment_type"),
        urls.canonical(F.col("url")).alias("canonical_url"),
    ).withColumn("workplace_type", text.workplace(F.col("workplace_explicit"), F.col("locations")))
    parts = ["canonical_url", "description_text", "display_title", "employment_type", "locations", "normalized_title", "source_job_id", "workplace_type"]
    out = out.withColumn("semantic_fingerprint", digests.fingerprint(*map(F.col, parts)))
    return out.withColumn("error", F.when(F.col("canonical_url").isNull(), "normalized_url_invalid"))


def assertions(normalized: DataFrame, artifact: str = "artifact") -> DataFrame:
    """A row per field of a record with its evidence: ``source_job_id, path, value, origin, artifact, confidence``; changed values are a rule's."""
    changed = lambda new, old: F.when(F.col(new).eqNullSafe(F.col(old)), "source_field").otherwise("deterministic_rule")
    rule = F.lit("deterministic_rule")
    one = lambda path, value, origin: F.struct(F.lit(path).alias("path"), value.cast("string").alias("value"), origin.alias("origin"))
    rows = F.array(
        one("/displayTitle", F.col("display_title"), changed("display_title", "title")),
        one("/normalizedTitle", F.col("normalized_title"), rule),
        one("/descriptionText", F.col("description_text"), rule),
        one("/locations", F.to_json("locations"), rule),
        one("/workplaceType", F.col("workplace_type"), F.when(F.col("workplace_explicit").isNull(), rule).otherwise("source_field")),
        one("/employmentType", F.col("employment_type"), rule),
        one("/canonicalSourceUrl", F.col("canonical_url"), changed("canonical_url", "url")),
    )
    out = normalized.select("source_job_id", F.col(artifact).alias("artifact"), F.explode(rows).alias("a"))
    return out.select("source_job_id", "a.*", "artifact", F.lit(1.0).alias("confidence")).where("value is not null")


def write_public(items: DataFrame, path: str) -> None:
    """The public projection of items as JSON lines, one directory swap per write."""
    items.withColumn("status", F.when(F.col("status") == "active", "open").otherwise("closed")).write.mode("overwrite").json(path)
