"""Entity resolution: exact keys first, then similarity within blocks, then evidence projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievewright.operators import sketches
from sievewright.storage import small_or_joined, written

NAME_REVIEW, TITLE_REVIEW = 0.65, 0.6


def similar_pairs(df: DataFrame, identity: str, elements: str | Column, least: float, measure: str = "dice", scope: list[str] | None = None) -> DataFrame:
    """Pairs ``(a, b, score)``, a < b, whose sets score at least ``least``.

    Equal sets are one class, and classes meet, each pair of them once: first their sketches, in tiles of two blocks of like sizes, then the sets of the few pairs that these leave, in the same tiles.
    Sets (``elements``, a column or what makes it) are worked out again for these, so that only keys, sizes and sketches of all of them are written and moved. Work grows with the square of the number of different sets
    of like size, some nanoseconds a pair; what is moved stays a few times the sketches, and a task holds two blocks' share.
    """
    scope = scope or []
    floor = least - 5e-5  # scores have four decimals
    part = floor / 2 if measure == "dice" else floor / (1 + floor)
    sets = lambda some: some.select(F.col(identity).alias("id"), *scope, F.sort_array(elements).alias("set"))
    key = F.unhex(F.sha2(F.to_json(F.struct(*scope, "set")), 256)).alias("c")
    rows = written(sets(df.dropna(subset=[identity, *scope])).select("id", *scope, key, F.size("set").alias("n"), sketches.sketch(F.col("set")).alias("p"))).where("n > 0")
    classes = written(rows.groupBy("c", *scope).agg(F.any_value("n").alias("n"), F.any_value("p").alias("p"), F.min("id").alias("id")))
    near = written(sketches.near_pairs(classes.drop("id"), scope, part))

    asked = near.select(F.col("c_a").alias("c")).unionByName(near.select(F.col("c_b").alias("c"))).distinct()
    asked = written(classes.select("c", "id").join(asked, "c", "left_semi").select(F.col("id").alias(identity)).distinct())
    shown = sets(df.join(small_or_joined(asked), identity, "left_semi")).select(key, "set").dropDuplicates(["c"])
    n, shared = F.col("n_a") + F.col("n_b"), F.col("shared")
    score = F.round(2 * shared / n if measure == "dice" else shared / (n - shared), 4)
    pairs = sketches.shared_elements(near, shown).select("c_a", "c_b", score.alias("score")).where(F.col("score") >= least)
    members = rows.select("id", "c")
    mine, theirs = (members.select(F.col("id").alias(i), F.col("c").alias(f"c_{x}")) for i, x in (("i", "a"), ("j", "b")))
    unlike = pairs.join(mine, "c_a").join(theirs, "c_b").where("i <> j").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "score")
    alike = mine.join(theirs, F.col("c_a") == F.col("c_b")).where("i < j").select(F.col("i").alias("a"), F.col("j").alias("b"), F.lit(1.0).alias("score"))
    return unlike.unionByName(alike)


def resolve_companies(incoming: DataFrame, known: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """``incoming(id, kind, value)``, ``known(company, kind, value)`` -> ``id, action, reason, company``.

    Kinds in order of weight: verified_domain, ats_tenant, verified_alias. The strongest kind that matches decides;
    several companies there are ambiguous, another company at a weaker kind is a conflict. Without a match,
    ``names(id)`` (similar names) asks for review, a strong key creates, anything else is reviewed.
    """
    weight = F.when(F.col("kind") == "verified_domain", 3).when(F.col("kind") == "ats_tenant", 2).otherwise(1)
    keys = incoming.withColumn("weight", weight)
    # one row a key, however many claim it: the least and the largest company tell whether there are several
    claims = known.groupBy("kind", "value").agg(F.min("company").alias("lo"), F.max("company").alias("hi"))
    hits = keys.join(claims, ["kind", "value"])
    best = hits.groupBy("id", "weight").agg(F.when(F.min("lo") == F.max("hi"), 1).otherwise(2).alias("n"), F.min("lo").alias("company"))
    top = best.groupBy("id").agg(F.max(F.struct("weight", "n", "company")).alias("t"))
    companies = hits.groupBy("id").agg(F.when(F.min("lo") == F.max("hi"), 1).otherwise(2).alias("companies"))
    base = keys.groupBy("id").agg(F.max("weight").alias("strongest")).join(top, "id", "left").join(companies, "id", "left")
    if names is not None:
        base = base.join(names.select("id", F.lit(True).alias("named")).distinct(), "id", "left")
    else:
        base = base.withColumn("named", F.lit(None).cast("boolean"))
    kind = F.element_at(F.array(F.lit("verified_alias"), F.lit("ats_tenant"), F.lit("verified_domain")), F.col("t.weight"))
    reason = (
        F.when(F.col("t.n") > 1, F.concat(F.lit("ambiguous_"), kind))
        .when(F.col("companies") > 1, "conflicting_exact_evidence")
        .when(F.col("t").isNotNull(), F.concat(F.lit("exact_"), kind))
        .when(F.col("named"), "name_similarity_requires_review")
        .when(F.col("strongest") >= 2, "unclaimed_exact_identity")
        .otherwise("insufficient_exact_evidence")
    )
    action = F.when(reason.startswith("exact_"), "match").when(reason == "unclaimed_exact_identity", "create").otherwise("review")
    return base.select("id", action.alias("action"), reason.alias("reason"), F.when(action == "match", F.col("t.company")).alias("company"))


# How much an origin of evidence weighs.
ORIGINS = {"human_review": 5, "source_field": 4, "structured_data": 3, "deterministic_rule": 2, "model": 1}


def project_evidence(assertions: DataFrame, target: str = "target") -> DataFrame:
    """``assertions(target, path, value, confidence, accepted, origin, listing, id)`` -> the selected value of each path, with all ids as provenance.

    Rejected evidence and confidences outside 0..1 are dropped. Order: accepted, confidence, origin's weight, listing, id.
    """
    weight = F.coalesce(*[F.when(F.col("origin") == k, F.lit(v)) for k, v in ORIGINS.items()], F.lit(0))
    usable = assertions.where("accepted is not false and confidence between 0 and 1")
    order = W.partitionBy(target, "path").orderBy(F.coalesce("accepted", F.lit(False)).desc(), F.col("confidence").desc(), weight.desc(), "listing", "id")
    ranked = usable.withColumn("rank", F.row_number().over(order))
    return ranked.groupBy(target, "path").agg(F.max(F.when(F.col("rank") == 1, F.col("value"))).alias("value"), F.max(F.when(F.col("rank") == 1, F.col("id"))).alias("selected"), F.array_sort(F.collect_list("id")).alias("alternatives"))


def merged_companies(companies: DataFrame, decisions: DataFrame) -> DataFrame:
    """``companies(id, status)``, ``decisions(source, canonical, operation, seq)`` -> ``id, canonical_id, status`` now, one hop deep.

    ``status`` is what a company had before its decisions; decisions may carry a ``status`` that was given to it in between (operation ``review``). The latest merge or split holds: a merge makes it
    ``merged`` and points to the canonical company, a split gives it back its own identity and the status that it had before that merge. Companies without decisions are their own.
    """
    given = F.col("status") if "status" in decisions.columns else F.lit(None).cast("string")
    log = decisions.select(F.col("source").alias("id"), "canonical", "operation", "seq", given.alias("_given"))
    latest = log.where("operation in ('merge', 'split')").groupBy("id").agg(F.max_by(F.struct("operation", "canonical"), "seq").alias("d"), F.max(F.when(F.col("operation") == "merge", F.col("seq"))).alias("_merged_at"))
    # what was given after a merge is given to a company that is not its own any more
    before = log.where("operation = 'review'").join(latest.select("id", "_merged_at", F.col("d.operation").alias("_last")), "id", "left").where("_merged_at is null or seq < _merged_at or _last = 'split'")
    status = before.groupBy("id").agg(F.max_by("_given", "seq").alias("_status"))
    merged = F.coalesce(F.col("d.operation") == "merge", F.lit(False))
    out = companies.join(latest, "id", "left").join(status, "id", "left")
    return out.select("id", F.when(merged, F.col("d.canonical")).otherwise(F.col("id")).alias("canonical_id"), F.when(merged, "merged").otherwise(F.coalesce("_status", "status")).alias("status"))
