"""Members of opportunities as a log of decisions: create, attach, split, rebuild; evidence checked anew; projections with provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievewright.operators.matching import CONTENT, FOREVER
from sievewright.operators.resolve import project_evidence

# Paths that show a requisition, that make up content, and that an opportunity must have.
REQUISITION = ("/requisitionId", "/connectorMapping")
CONTENT_PATHS = ("/normalizedTitle", "/descriptionText", "/workplaceType", "/locationSignature")
REQUIRED = ("/displayTitle", "/normalizedTitle", "/descriptionText", "/workplaceType", "/canonicalSourceUrl", "/applyUrl")


def judged_decisions(decisions: DataFrame) -> DataFrame:
    """Decisions with ``error``, null for those that hold.

    ``decisions(seq, operation, opportunity, listing, action, reason, confidence, evidence, actor, reviewed, same_company)``. An attachment by a machine needs a requisition (confidence 1, two pieces of
    evidence) or equal content (0.97, none); one from a review needs an operator and the review. A split needs an operator and a member; what is split may be
    attached again. The last valid decision on a pair tells whether it is a member, whether that split was itself refused or not.
    """
    op, automatic = F.col("operation"), F.col("action") == "automatic_match"
    pieces, confidence = F.coalesce(F.size(F.array_distinct("evidence")), F.lit(0)), F.col("confidence")
    contract = F.when(F.col("reason") == "exact_requisition_key", (confidence == 1) & (F.size("evidence") == 2) & (pieces == 2)).when(F.col("reason") == "exact_content_interval", (confidence == CONTENT) & (pieces == 0)).otherwise(False)
    operator = F.col("actor") == "operator"
    attach = (
        F.when(~F.coalesce(F.col("action").isin("automatic_match", "review"), F.lit(False)), "invalid_resolution_contract")
        .when((~automatic != F.coalesce("reviewed", F.lit(False))) | (~automatic & ~operator), "review_binding_required")
        .when(automatic & (confidence < CONTENT), "automatic_confidence_too_low")
        .when(automatic & ~F.coalesce(contract, F.lit(False)), "invalid_resolution_contract")
        .when(~F.coalesce("same_company", F.lit(False)), "opportunity_company_mismatch")
    )
    early = F.when(op == "attach", attach).when(op == "create", F.when(~F.coalesce("same_company", F.lit(False)), "listing_company_mismatch")).when((op == "split") & ~operator, "operator_required").when(~op.isin("attach", "create", "split", "rebuild"), "invalid_operation")
    marked = decisions.withColumn("_early", early)
    pair, whole = W.partitionBy("opportunity", "listing").orderBy("seq"), W.partitionBy("opportunity").orderBy("seq")
    valid = F.when(F.col("_early").isNull() & op.isin("attach", "create", "split"), op)
    before = F.last(valid, True).over(pair.rowsBetween(W.unboundedPreceding, -1))
    made = F.coalesce(F.max(F.col("_early").isNull() & (op == "create")).over(whole.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    marked = marked.withColumns({"_before": before, "_made": made})
    late = F.when((op != "create") & ~F.col("_made"), "opportunity_not_found").when((op == "create") & F.col("_made"), "opportunity_exists").when((op == "split") & ~F.coalesce(F.col("_before").isin("attach", "create"), F.lit(False)), "active_membership_not_found")
    return marked.withColumn("error", F.coalesce("_early", late)).drop("_early", "_before", "_made")


def membership_state(decisions: DataFrame) -> DataFrame:
    """Decisions (as :func:`judged_decisions` takes them) -> ``opportunity, listing, state, reason, confidence, decisions``: each pair as its last decision that holds left it.

    States: ``automatic``, ``human_confirmed``, ``human_rejected``. ``decisions`` numbers the opportunity's decisions up to that one. All steps are windows and aggregates by pair or opportunity.
    """
    held = judged_decisions(decisions).where("error is null")
    numbered = held.withColumn("decisions", F.row_number().over(W.partitionBy("opportunity").orderBy("seq")).cast("long"))
    state = F.when(F.col("operation") == "split", "human_rejected").when((F.col("operation") == "attach") & (F.col("action") == "review"), "human_confirmed").otherwise("automatic")
    told = F.struct(state.alias("state"), F.when(F.col("operation") == "create", "no_candidate").otherwise(F.col("reason")).alias("reason"), F.when((F.col("operation") == "attach") & (F.col("action") == "automatic_match"), F.col("confidence")).otherwise(1.0).alias("confidence"), "decisions")
    return numbered.where("operation <> 'rebuild'").groupBy("opportunity", "listing").agg(F.max_by(told, "seq").alias("t")).select("opportunity", "listing", "t.*")


def opportunity_status(members: DataFrame) -> DataFrame:
    """``opportunity, status, members``: closed once nobody is left."""
    active = members.groupBy("opportunity").agg(F.count_if(F.col("state") != "human_rejected").alias("members"))
    return active.select("opportunity", F.when(F.col("members") > 0, "active").otherwise("closed").alias("status"), "members")


def evidence_revalidated(attaches: DataFrame, members: DataFrame, assertions: DataFrame, listings: DataFrame) -> DataFrame:
    """Automatic attachments with ``error``: whether their evidence still holds against the members there are.

    ``attaches(id, listing, opportunity, reason, evidence)``, ``members(opportunity, listing, state)``, ``assertions(assertion, listing, path, value, review, selected)``, ``listings(listing, start, until)``. A requisition
    needs both assertions, neither rejected, one of the listing and one of a member, of one path and with equal values whatever their case; content needs a member whose
    four content fields equal the listing's, and a member whose interval meets the listing's. Each check is one conjunction over joined evidence.
    """
    live = members.where("state <> 'human_rejected'").select("opportunity", F.col("listing").alias("_member"))
    usable = assertions.where(F.coalesce(F.col("review") != "rejected", F.lit(True)))

    required = attaches.where("reason = 'exact_requisition_key'").select("id", "listing", "opportunity", F.explode(F.array_distinct("evidence")).alias("assertion"))
    shown = required.join(usable.where(F.col("path").isin(*REQUISITION)).select("assertion", F.col("listing").alias("_of"), "path", F.lower("value").alias("value")), "assertion", "left")
    shown = shown.join(live.withColumn("_is", F.lit(True)), (shown["opportunity"] == live["opportunity"]) & (F.col("_of") == F.col("_member")), "left").drop(live["opportunity"])
    own = F.col("_of") == F.col("listing")
    good = shown.groupBy("id").agg(
        (F.bool_and(F.col("_of").isNotNull()) & (F.count("*") == 2) & (F.count_if(own) == 1) & (F.count_if(~own & F.col("_is")) == 1) & (F.count_distinct("path") == 1) & (F.count_distinct("value") == 1)).alias("holds")
    )

    chosen = usable.where(F.col("selected") & F.col("path").isin(*CONTENT_PATHS))
    content = chosen.groupBy("listing").agg(*[F.max(F.when(F.col("path") == p, F.col("value"))).alias(f"c{k}") for k, p in enumerate(CONTENT_PATHS)])
    columns = [f"c{k}" for k in range(len(CONTENT_PATHS))]
    content = content.dropna(subset=columns)
    asked = attaches.where("reason = 'exact_content_interval'").select("id", "listing", "opportunity")
    pairs = asked.join(live, "opportunity").where("_member <> listing")
    theirs = content.select(F.col("listing").alias("_member"), F.struct(*columns).alias("_theirs"))
    mine = content.select("listing", F.struct(*columns).alias("_mine"))
    end = F.lit(FOREVER).cast("timestamp")
    spans = listings.select("listing", "start", F.coalesce("until", end).alias("until"))
    others = spans.select(F.col("listing").alias("_member"), F.col("start").alias("_s"), F.col("until").alias("_u"))
    compared = pairs.join(mine, "listing", "left").join(theirs, "_member", "left").join(spans, "listing", "left").join(others, "_member", "left")
    equal = compared.groupBy("id").agg((F.coalesce(F.bool_or(F.col("_mine") == F.col("_theirs")), F.lit(False)) & F.coalesce(F.bool_or((F.col("start") <= F.col("_u")) & (F.col("_s") <= F.col("until"))), F.lit(False))).alias("same"))
    out = attaches.join(good, "id", "left").join(equal, "id", "left")
    error = F.when((F.col("reason") == "exact_requisition_key") & ~F.coalesce("holds", F.lit(False)), "requisition_evidence_mismatch").when((F.col("reason") == "exact_content_interval") & ~F.coalesce("same", F.lit(False)), "exact_content_evidence_mismatch")
    return out.select("id", "listing", "opportunity", "reason", error.alias("error"))


def opportunity_projection(members: DataFrame, assertions: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """What each opportunity shows, from its members' assertions: ``opportunity, path, value, selected, alternatives, current, error``.

    ``members(opportunity, listing, state, decisions)``, ``assertions(id, listing, path, value, confidence, accepted, origin)``. A required path without evidence is a row with ``error``. ``earlier`` holds
    rows of former projections: they are kept, with ``current`` false, as their selections are cleared.
    """
    live = members.where("state <> 'human_rejected'").select("opportunity", "listing")
    shown = project_evidence(live.join(assertions, "listing"), "opportunity")
    wanted = live.select("opportunity").distinct().withColumn("path", F.explode(F.array(*map(F.lit, REQUIRED))))
    out = wanted.join(shown, ["opportunity", "path"], "full_outer")
    error = F.when(F.col("value").isNull() & F.col("path").isin(*REQUIRED), F.concat(F.lit("missing_opportunity_assertion:"), "path"))
    out = out.select("opportunity", "path", "value", "selected", "alternatives", F.lit(True).alias("current"), error.alias("error"))
    return out if earlier is None else out.unionByName(earlier.withColumn("current", F.lit(False)).select(out.columns))
