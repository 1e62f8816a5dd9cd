"""Operator views, registry guards and public projections: what people look at, and what may change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.operators.relational import top_rows

UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-8][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$"
#: Kinds of problem reports; days after which data, observations, policy reviews and policies are stale.
REPORT_KINDS = ("closed", "wrong_company", "wrong_location", "wrong_salary", "duplicate", "broken_link", "other")
DATASET_DAYS, OBSERVATION_DAYS, REVIEW_DAYS, VALIDITY_DAYS = 7, 7, 30, 90
#: Words of a pay interval, in the order in which they are looked for.
PERIODS = ("hour", "day", "week", "month", "year")


def trimmed(text: Column) -> Column:
    """A text without white space of any kind at its ends."""
    blank = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
    return F.regexp_replace(text, f"^{blank}|{blank}$", "")


def safe_text(value: Column, fallback: str, limit: int = 160) -> Column:
    """One line of at most ``limit`` characters; ``fallback`` for null and blank."""
    line = F.substring(trimmed(F.regexp_replace(F.coalesce(value, F.lit("")), r"[\r\n\t]+", " ")), 1, limit)
    return F.when(F.length(line) > 0, line).otherwise(F.lit(fallback))


def safe_uuid(value: Column) -> Column:
    """The value if it is a well-formed UUID of versions 1 to 8, else null."""
    return F.when(value.rlike(UUID), value)


def safe_ids(ids: Column, most: int = 10) -> Column:
    """The well-formed UUIDs among the first ``most`` of a list."""
    return F.filter(F.slice(ids, 1, most), lambda x: x.rlike(UUID))


def overview(sources: DataFrame, reviews: DataFrame, breakers: DataFrame, scans: DataFrame, as_of: Column) -> DataFrame:
    """``section, name, rows``: health states, pending reviews by type, tripped breakers, reasons of the last 24 hours' scans.

    ``sources(health_state)``, ``reviews(review_type, state)``, ``breakers(state)``, ``scans(completeness_reason, ended_at)``.
    """
    by = lambda df, section, column: df.groupBy(F.lit(section).alias("section"), F.col(column).alias("name")).agg(F.count("*").alias("rows"))
    tripped = breakers.where("state = 'tripped'").agg(F.count("*").alias("rows")).select(F.lit("active_breakers").alias("section"), F.lit("tripped").alias("name"), "rows")
    recent = scans.where(F.col("ended_at") >= as_of - F.expr("INTERVAL 24 HOURS"))
    return by(sources, "source_health", "health_state").union(by(reviews.where("state = 'pending'"), "pending_reviews", "review_type")).union(tripped).union(by(recent, "scans_last_24_hours", "completeness_reason"))


def review_queue(reviews: DataFrame, most: int = 200) -> DataFrame:
    """``reviews(id, priority, created_at, reason, ...)``: the most urgent ones, oldest first, their reasons made safe to show."""
    return reviews.withColumn("reason", safe_text(F.col("reason"), "manual review")).orderBy(F.col("priority").desc(), "created_at", "id").limit(most)


def scan_evidence(scans: DataFrame, artifacts: DataFrame, most: int = 20) -> DataFrame:
    """``scans(source, scan, started_at)``, ``artifacts(scan, artifact, place)``: each source's latest scans with their artifacts in order."""
    latest = top_rows(scans, ["source"], [F.col("started_at").desc(), F.col("scan").desc()], most)
    # responses of a scan are bounded (a hundred), and so is the list
    item = F.when(F.col("artifact").isNotNull(), F.struct("place", "artifact"))
    listed = latest.join(artifacts, "scan", "left").groupBy("source", "scan", "started_at").agg(F.array_sort(F.collect_list(item)).alias("x"))
    return listed.select("source", "scan", "started_at", F.transform("x", lambda x: x["artifact"]).alias("artifacts"))


def ranked_candidates(matches: DataFrame, most: int = 10) -> DataFrame:
    """``matches(id, company, priority, confidence, name_score)``: each id's best candidates with their rank."""
    order = [F.col("priority").desc(), F.col("confidence").desc(), F.col("name_score").desc(), F.col("company")]
    return top_rows(matches, ["id"], order, most)


def oldest_first(artifacts: DataFrame, most: int) -> DataFrame:
    """``artifacts(id, created_at, last_reconciled_at)``: those that were reconciled, or else made, the longest ago."""
    return artifacts.withColumn("since", F.coalesce("last_reconciled_at", "created_at")).orderBy("since", "id").limit(most)


def scan_bytes(responses: DataFrame, most: int = 100) -> DataFrame:
    """``responses(scan, place, body)``: number and bytes of each scan's first ``most`` responses."""
    sized = responses.select("scan", "place", F.octet_length("body").cast("long").alias("n"))
    return top_rows(sized, ["scan"], [F.col("place")], most).groupBy("scan").agg(F.count("*").alias("responses"), F.sum("n").alias("bytes"))


def activation(sources: DataFrame, policies: DataFrame, evidence: DataFrame, as_of: Column) -> DataFrame:
    """``sources(id, enabled, policy, review_due_at, next_scan_at)`` with ``error``; a source that is off has no next scan.

    An enabled source needs a review that is not due, an approved policy (``policies(policy, state, expires_at)``) that
    has not expired, and ownership evidence (``evidence(source, confidence)``) of 0.9 or more.
    """
    current = policies.where((F.col("state") == "approved") & (F.col("expires_at") > as_of)).select("policy", F.lit(True).alias("_current"))
    owned = evidence.where("confidence >= 0.9").select(F.col("source").alias("id")).distinct().withColumn("_owned", F.lit(True))
    joined = sources.join(current, "policy", "left").join(owned, "id", "left")
    error = F.when(~F.col("enabled"), None).when((F.col("review_due_at") <= as_of) | F.col("_current").isNull(), "policy_not_current").when(F.col("_owned").isNull(), "ownership_evidence_missing")
    return joined.select("id", "enabled", "policy", F.when(F.col("enabled"), F.col("next_scan_at")).alias("next_scan_at"), error.alias("error"))


def pause_for_policy(sources: DataFrame, policies: DataFrame, as_of: Column) -> DataFrame:
    """Enabled sources of policies that are not approved, or expired, are switched off and lose their next scan."""
    lapsed = (F.col("state") != "approved") | F.col("expires_at").isNull() | (F.col("expires_at") <= as_of)
    out = sources.join(policies.where(lapsed).select("policy", F.lit(True).alias("_lapsed")), "policy", "left")
    off = F.col("enabled") & F.col("_lapsed").isNotNull()
    return out.select("id", "policy", (F.col("enabled") & ~off).alias("enabled"), F.when(~off, F.col("next_scan_at")).alias("next_scan_at"), off.alias("paused"))


def frozen_rows(old: DataFrame, new: DataFrame, keys: list[str], frozen: Column) -> DataFrame:
    """Rows that a change set alters or drops although ``frozen`` (on the old row) holds: ``keys, violation``."""
    values = [c for c in old.columns if c not in keys]
    after = new.select(*keys, F.lit(True).alias("_there"), *[F.col(c).alias(f"_new_{c}") for c in values])
    differs = F.lit(False)
    for c in values:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_new_{c}"))
    violation = F.when(F.col("_there").isNull(), "deleted").when(differs, "changed")
    return old.where(frozen).join(after, keys, "left").select(*keys, violation.alias("violation")).where("violation is not null")


def breaker_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``id, allowed`` for each breaker in both tables: only from tripped to cleared, and nothing else may change."""
    values = [c for c in old.columns if c not in ("id", "state")]
    joined = old.alias("o").join(new.alias("n"), "id")
    same = (F.col("o.state") == "tripped") & (F.col("n.state") == "cleared")
    for c in values:
        same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    return joined.select("id", same.alias("allowed"))


def report_error(kind: Column, detail: Column, duplicate: Column) -> Column:
    """What is wrong with a problem report; null if nothing."""
    return (
        F.when(kind.isNull() | ~kind.isin(*REPORT_KINDS), "invalid_request")
        .when(detail.isNotNull() & ((F.length(trimmed(detail)) < 3) | (F.length(detail) > 2000)), "invalid_request")
        .when(duplicate.isNotNull() & ~duplicate.rlike(UUID), "invalid_request")
        .when((kind == "duplicate") != duplicate.isNotNull(), "duplicate_target_required")
        .when((kind == "other") & detail.isNull(), "report_detail_required")
    )


def freshness_error(as_of: Column, generated: Column, dataset: Column, observed: Column, reviewed: Column, expires: Column) -> Column:
    """The first rule that a manifest entry's dates break; null if they keep all.

    A dataset is reviewed after it is made, and both lie within the last days; a policy is in force, its review is recent and not later than the dataset's,
    and its validity is counted from the review; an observation is recent and not later than the dataset's review.
    """
    seconds = lambda at: F.unix_timestamp(at.cast("timestamp"))
    age = lambda at: seconds(as_of) - seconds(at)
    day = 86_400
    return (
        F.when((age(generated) < 0) | (age(dataset) < 0) | (seconds(generated) > seconds(dataset)), "dataset_review_in_future")
        .when((age(generated) > DATASET_DAYS * day) | (age(dataset) > DATASET_DAYS * day), "dataset_review_stale")
        .when((age(reviewed) < 0) | (age(expires) >= 0) | (seconds(expires) <= seconds(reviewed)), "policy_not_current")
        .when((seconds(reviewed) > seconds(dataset)) | (age(reviewed) > REVIEW_DAYS * day) | (seconds(expires) - seconds(reviewed) > VALIDITY_DAYS * day), "policy_review_window_invalid")
        .when((age(observed) < 0) | (seconds(observed) > seconds(dataset)), "observation_in_future")
        .when(age(observed) > OBSERVATION_DAYS * day, "observation_stale")
    )


def connector_counts(entries: DataFrame) -> DataFrame:
    """``entries(connector, domain, tenant)``: entries, distinct domains and distinct tenants of each connector."""
    return entries.groupBy("connector").agg(F.count("*").alias("entries"), F.count_distinct("domain").alias("domains"), F.count_distinct("tenant").alias("tenants"))


def pay_period(interval: Column) -> Column:
    """The period that a vendor's interval names; ``annual`` is a year."""
    low = F.lower(F.coalesce(interval, F.lit("")))
    out = F.when(low.contains("annual"), "year").otherwise("unknown")
    for word in reversed(PERIODS):
        out = F.when(low.contains(word), word).otherwise(out)
    return out


def workplace(kind: Column, remote: Column) -> Column:
    """A vendor's workplace type, or what its remote flag says of it."""
    return F.when(kind == "Remote", "remote").when(kind == "Hybrid", "hybrid").when(kind.isin("OnSite", "on-site"), "onsite").when(remote, "remote").when(~remote, "unspecified")


def major_units(cents: Column) -> Column:
    """Cents as a text of major units with two decimals."""
    return F.format_string("%.2f", cents / 100)


def pay_sort(minimum: Column, maximum: Column) -> Column:
    return F.greatest(F.coalesce(maximum, minimum), F.coalesce(minimum, maximum))


def joined_words(*parts: Column, by: str = ", ") -> Column:
    """Texts joined without those that are null or empty; null if none is left."""
    text = F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), by)
    return F.when(text != "", text)


def remote_scope(mode: Column, countries: Column) -> Column:
    """Kind and sorted distinct country codes of where remote work is possible."""
    codes = F.array_sort(F.array_distinct(F.filter(countries, lambda x: x.isNotNull() & (x != ""))))
    kind = F.when(~F.coalesce(mode == "remote", F.lit(False)), "unspecified").when(F.size(codes) > 0, "countries").otherwise("worldwide")
    return F.struct(kind.alias("kind"), codes.alias("codes"))


def sequence_gaps(steps: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Steps whose number is not their place in the sequence: ``keys, number, expected``."""
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy(*keys).orderBy(number)).cast("long")
    return steps.withColumn("expected", place).where(F.col(number) != F.col("expected")).select(*keys, number, "expected")


def descriptor_error(tenant: Column, board_url: Column, api_url: Column) -> Column:
    """Whether a source's tenant, the last part of its board's URL and the tenant of its API's URL agree; null if they do."""
    board = F.regexp_extract(board_url, r"^https://[^/]+/([^/?#]+)/?$", 1)
    api = F.regexp_extract(api_url, r"/boards/([^/?#]+)", 1)
    return F.when(tenant.isNull() | ~tenant.rlike(r"^[A-Za-z0-9_-]+$"), "invalid_tenant").when(board != tenant, "board_mismatch").when(api != tenant, "api_mismatch")


def audit_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Append-only audit of a change set: ``entity, before, after`` as JSON; a row only where they differ."""
    pack = lambda df, name: df.select(F.col(key).alias("entity"), F.to_json(F.struct(*[c for c in df.columns if c != key]), {"ignoreNullFields": "false"}).alias(name))
    both = pack(old, "before").join(pack(new, "after"), "entity", "full_outer")
    return both.where(~F.col("before").eqNullSafe(F.col("after")))
