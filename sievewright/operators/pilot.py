"""Rules of a pilot manifest: policies, verified entries and quarantine as tables, each row with the first rule that it breaks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievewright.functions import urls
from sievewright.operators import domains
from sievewright.operators.console import DATASET_DAYS, OBSERVATION_DAYS, REVIEW_DAYS, VALIDITY_DAYS
from sievewright.operators.validate import first_violation

# Hosts of each vendor's policies, and of its boards and interfaces by region.
POLICY_HOSTS = {"greenhouse": "*.greenhouse.io", "lever": "*.lever.co", "ashby": "*.ashbyhq.com"}
TENANT = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,199}$"
ORDER = ("manifest", "dataset", "policies", "entries", "quarantine")
_DAY = 86_400


def _age(as_of: Column, at: Column) -> Column:
    return F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(at.cast("timestamp"))


def _exact(url: Column, host: Column, path: Column) -> Column:
    """Whether a URL is that host and path, without query and fragment."""
    return (urls.host(url) == host) & (F.regexp_replace(urls.path(url), "/$", "") == path) & (urls.query(url) == "") & ~url.rlike("#.")


def identity_error(connector: Column, tenant: Column, region: Column, board: Column, api: Column) -> Column:
    """Why a source's URLs are not those of its vendor, tenant and region; null if they are."""
    own = F.concat(F.lit("/"), tenant)
    eu = region == "eu"
    greenhouse = (region == "global") & (_exact(board, F.lit("boards.greenhouse.io"), own) | _exact(board, F.lit("job-boards.greenhouse.io"), own)) & _exact(api, F.lit("boards-api.greenhouse.io"), F.concat(F.lit("/v1/boards/"), tenant))
    lever = _exact(board, F.when(eu, "jobs.eu.lever.co").otherwise("jobs.lever.co"), own) & _exact(api, F.when(eu, "api.eu.lever.co").otherwise("api.lever.co"), F.concat(F.lit("/v0/postings/"), tenant))
    ashby = (region == "global") & _exact(board, F.lit("jobs.ashbyhq.com"), own) & _exact(api, F.lit("api.ashbyhq.com"), F.concat(F.lit("/posting-api/job-board/"), tenant))
    no = lambda held: ~F.coalesce(held, F.lit(False))
    return (
        F.when(no(tenant.rlike(TENANT)), "invalid_tenant_key")
        .when((connector == "greenhouse") & no(greenhouse), "greenhouse_identity_mismatch")
        .when((connector == "lever") & no(lever), "lever_identity_mismatch")
        .when((connector == "ashby") & no(ashby), "ashby_identity_mismatch")
        .when(no(connector.isin(*POLICY_HOSTS)), "manifest_schema_invalid")
    )


def _again(*keys: str) -> Column:
    """Whether a row's keys were there in an earlier row."""
    return F.row_number().over(W.partitionBy(*keys).orderBy("no")) > 1


def manifest_errors(policies: DataFrame, entries: DataFrame, quarantine: DataFrame, suffixes: DataFrame, as_of: Column, generated: Column, reviewed: Column, expected: int, synthetic: bool = False) -> DataFrame:
    """``part, no, code``: each row of a manifest that breaks a rule, with the first that it breaks, and rows of the manifest and its dataset as a whole.

    ``policies(no, family, host_pattern, reviewed_at, expires_at)``, ``entries(no, connector, tenant, region, board_url, api_url, domain, careers_url, evidence_url, observed_at)``,
    ``quarantine(no, company, domain, careers_url, ats_url, observed_at)``, ``suffixes`` as :func:`sievewright.operators.domains.rules` gives them. Of equal rows the first counts, the others repeat it.
    A manifest is valid if there is no row.
    """
    reviewed_age = lambda at: F.unix_timestamp(at.cast("timestamp")) > F.unix_timestamp(reviewed.cast("timestamp"))
    future = lambda at: (_age(as_of, at) < 0) | reviewed_age(at)
    whole = entries.agg(F.count("*").alias("n")).select(F.lit("manifest").alias("part"), F.lit(0).cast("long").alias("no"), F.when(F.col("n") != expected, "verified_entry_count_mismatch").alias("code"))
    dataset = first_violation([("dataset_review_in_future", (_age(as_of, generated) < 0) | (_age(as_of, reviewed) < 0) | (_age(reviewed, generated) < 0)), ("dataset_review_stale", (_age(as_of, generated) > DATASET_DAYS * _DAY) | (_age(as_of, reviewed) > DATASET_DAYS * _DAY))])
    dated = entries.sparkSession.range(1).select(F.lit("dataset").alias("part"), F.lit(0).cast("long").alias("no"), dataset.alias("code"))

    host = F.lit(None).cast("string")
    for family, pattern in POLICY_HOSTS.items():
        host = F.when(F.col("family") == family, pattern).otherwise(host)
    since, until = F.col("reviewed_at"), F.col("expires_at")
    window = reviewed_age(since) | (_age(as_of, since) > REVIEW_DAYS * _DAY) | (_age(until, since) > VALIDITY_DAYS * _DAY)
    checked = first_violation([("duplicate_policy_family", F.col("_again")), ("policy_host_mismatch", ~F.col("host_pattern").eqNullSafe(host)), ("policy_not_current", (_age(as_of, since) < 0) | (_age(as_of, until) >= 0) | (_age(until, since) <= 0)), ("policy_review_window_invalid", window)])
    policy = policies.withColumn("_again", _again("family")).select(F.lit("policies").alias("part"), F.col("no").cast("long").alias("no"), checked.alias("code"))

    known = policies.select(F.col("family").alias("connector")).distinct().withColumn("_policy", F.lit(True))
    named = entries.withColumnRenamed("domain", "primary")
    told = domains.registrable(named, "primary", suffixes).withColumnRenamed("domain", "_registrable").join(known, "connector", "left")
    told = told.withColumns({"_tenant": F.concat_ws(":", "connector", "region", F.lower("tenant"))}).withColumns({"_domain_again": _again("primary"), "_tenant_again": _again("_tenant")})
    domain_error = domains.employer_domain_error(F.col("primary"), F.col("_registrable"), F.col("icann"), urls.host(F.col("careers_url")), urls.host(F.col("evidence_url")), F.lit(synthetic))
    at = F.col("observed_at")
    later = first_violation([("observation_in_future", future(at)), ("observation_stale", _age(as_of, at) > OBSERVATION_DAYS * _DAY), ("duplicate_verified_domain", F.col("_domain_again")), ("duplicate_active_tenant", F.col("_tenant_again"))])
    identity = identity_error(F.col("connector"), F.col("tenant"), F.col("region"), F.col("board_url"), F.col("api_url"))
    code = F.coalesce(identity, F.when(F.col("_policy").isNull(), "source_policy_missing"), domain_error, later)
    entry = told.select(F.lit("entries").alias("part"), F.col("no").cast("long").alias("no"), code.alias("code"))

    verified = entries.select("domain").distinct().withColumn("_verified", F.lit(True))
    held = quarantine.join(verified, "domain", "left").withColumn("_company", F.lower("company")).withColumn("_again", _again("_company", "domain", "careers_url", "ats_url"))
    checked = first_violation([("manifest_schema_invalid", F.coalesce("domain", "careers_url", "ats_url").isNull()), ("quarantine_observation_in_future", future(at)), ("quarantine_observation_stale", _age(as_of, at) > OBSERVATION_DAYS * _DAY), ("quarantine_conflicts_verified_domain", F.col("_verified")), ("duplicate_quarantine_entry", F.col("_again"))])
    kept = held.select(F.lit("quarantine").alias("part"), F.col("no").cast("long").alias("no"), checked.alias("code"))
    return reduce(DataFrame.unionByName, (whole, dated, policy, entry, kept)).where("code is not null")


def first_error(errors: DataFrame) -> DataFrame:
    """The one error that a manifest is refused with: of its first part that has any, the first row's."""
    place = F.array_position(F.array(*map(F.lit, ORDER)), F.col("part"))
    return errors.agg(F.min(F.struct(place.alias("p"), "no", "part", "code")).alias("e")).where("e is not null").select("e.part", "e.no", "e.code")


def manifest_report(policies: DataFrame, entries: DataFrame, quarantine: DataFrame) -> DataFrame:
    """One row of counts: verified and quarantined entries, entries by connector, distinct domains and tenants, policies."""
    tenant = F.concat_ws(":", "connector", "region", F.lower("tenant"))
    none = F.lit(None).cast("string")
    rows = entries.select(F.lit("entry").alias("part"), "connector", "domain", tenant.alias("tenant"))
    for name, df in (("quarantine", quarantine), ("policy", policies)):
        rows = rows.unionByName(df.select(F.lit(name).alias("part"), none.alias("connector"), none.alias("domain"), none.alias("tenant")))
    many = lambda part: F.count_if(F.col("part") == part)
    return rows.agg(many("entry").alias("verified_entries"), *[F.count_if(F.col("connector") == c).alias(c) for c in POLICY_HOSTS], F.count_distinct("domain").alias("unique_domains"), F.count_distinct("tenant").alias("unique_tenants"), many("quarantine").alias("quarantined_entries"), many("policy").alias("policies"))


def candidate_changes(manifest: DataFrame, registry: DataFrame) -> DataFrame:
    """``manifest(source, fingerprint)`` against ``registry(source, fingerprint, state)`` -> ``source, change``: ``added``, ``updated``, ``unchanged``, ``reopened`` (quarantined before), or ``absent`` from the manifest."""
    both = manifest.select("source", F.col("fingerprint").alias("_new")).join(registry.select("source", F.col("fingerprint").alias("_old"), "state"), "source", "full_outer")
    change = F.when(F.col("_new").isNull(), "absent").when(F.col("_old").isNull(), "added").when(F.col("state") == "quarantined", "reopened").when(F.col("_new") == F.col("_old"), "unchanged").otherwise("updated")
    return both.select("source", change.alias("change"))
