"""Differences of nested JSON documents, addressed by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Levels of nesting that are walked; what lies deeper is compared as a whole. Differences of one document that are told.
DEPTH, MOST = 16, 1_000


def _kind(text: Column) -> Column:
    head = F.substring(text, 1, 1)
    return F.when(head == "{", "object").when(head == "[", "array").when(head == '"', "string").when(head.isin("t", "f"), "boolean").when(head == "n", "null").otherwise("number")


def flattened(docs: DataFrame, identity: str, document: str, depth: int = DEPTH) -> DataFrame:
    """``identity, document`` (JSON text) -> every node: ``identity, path, parent, place, kind, text``.

    Paths start at ``$``; keys that are names follow a point, others stand in brackets and quotes, elements of arrays by number. ``place`` sorts nodes as
    they are met: keys by code point, elements by number. One level is opened at a time, nodes and their children stay in one line of rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(identity), F.try_parse_json(document).alias("v")).where("v is not null")
    rows = rows.select(identity, F.lit("$").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit("").alias("place"), "v", F.lit(True).alias("fresh"))
    for _ in range(depth):
        # an opened node stays as it is, beside its children
        opened = rows.lateralJoin(spark.tvf.variant_explode_outer(F.when(F.col("fresh").outer(), F.col("v").outer())))
        name = F.to_json(F.struct(F.col("key").alias("k")))
        quoted = F.substring(name, 6, F.length(name) - 6)
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(F.col("key").rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*$"), F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit("["), quoted, F.lit("]")))
        place = F.concat("place", F.lit("\x01"), F.coalesce("key", F.lpad(F.col("pos").cast("string"), 10, "0")))
        child = F.struct(F.concat("path", step).alias("path"), F.col("path").alias("parent"), place.alias("place"), F.col("value").alias("v"), F.lit(True).alias("fresh"))
        itself = F.struct("path", "parent", "place", "v", F.lit(False).alias("fresh"))
        nodes = F.when(F.col("pos").isNull(), F.array(itself)).when(F.col("pos") == 0, F.array(itself, child)).otherwise(F.array(child))
        rows = opened.select(identity, F.explode(nodes).alias("n")).select(identity, "n.*")
    text = F.to_json("v")
    return rows.select(identity, "path", "parent", "place", _kind(text).alias("kind"), text.alias("text"))


def json_diff(baseline: DataFrame, candidate: DataFrame, identity: str, document: str, depth: int = DEPTH, most: int = MOST) -> DataFrame:
    """Two tables of JSON documents -> ``identity, path, kind, baseline, candidate``: a row per difference, values as JSON.

    Objects are compared key by key and arrays element by element; a part that one side lacks is ``added`` or ``removed`` as a whole, everything else that differs is
    ``changed``. Numbers are equal if their doubles are. Documents meet by identity and are opened together; a difference counts only below a part that is an object, or an array, on
    both sides. Of each document the first ``most`` differences are told.

    Defined cases: null and malformed documents are absent, as a whole; a document that one side lacks is added or removed at ``$``; equal ones give no row.
    """
    a, b = baseline.select(identity, F.col(document).alias("_a")), candidate.select(identity, F.col(document).alias("_b"))
    return paired_diff(a.join(b, identity, "full_outer"), identity, "_a", "_b", depth, most)


def paired_diff(pairs: DataFrame, identity: str, baseline: str, candidate: str, depth: int = DEPTH, most: int = MOST) -> DataFrame:
    """:func:`json_diff` of documents that stand in one row.

    Both are opened together, a level at a time: parts that are objects, or arrays, on both sides give way to their children, paired by key or place; what else there is stays, to be
    compared. Nothing is shuffled but the differences.
    """
    array, fields = "array<variant>", "map<string,variant>"
    rows = pairs.select(identity, F.lit("$").alias("path"), F.lit("").alias("place"), F.try_parse_json(baseline).alias("a"), F.try_parse_json(candidate).alias("b"))
    for _ in range(depth):
        opened = rows.select("*", *[F.try_variant_get(v, "$", kind).alias(f"_{v}{n}") for n, kind in ((1, array), (2, fields)) for v in ("a", "b")])
        none = F.lit(None)
        listed = F.transform(F.arrays_zip(F.col("_a1").alias("x"), F.col("_b1").alias("y")), lambda e, i: F.struct(none.cast("string").alias("key"), i.alias("pos"), e["x"].alias("a"), e["y"].alias("b")))
        zipped = F.map_entries(F.map_zip_with("_a2", "_b2", lambda k, x, y: F.struct(x.alias("x"), y.alias("y"))))
        named = F.transform(zipped, lambda e: F.struct(e["key"].alias("key"), none.cast("int").alias("pos"), e["value"]["x"].alias("a"), e["value"]["y"].alias("b")))
        itself = F.array(F.struct(none.cast("string").alias("key"), none.cast("int").alias("pos"), F.col("a"), F.col("b")))
        children = F.when(F.col("_a1").isNotNull() & F.col("_b1").isNotNull(), listed).when(F.col("_a2").isNotNull() & F.col("_b2").isNotNull(), named).otherwise(itself)
        rows = opened.select(identity, "path", "place", F.explode(children).alias("n")).select(identity, "path", "place", "n.*")
        name = F.to_json(F.struct(F.col("key").alias("k")))
        quoted = F.substring(name, 6, F.length(name) - 6)
        step = F.when(F.col("pos").isNotNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(F.col("key").isNull(), "").when(F.col("key").rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*$"), F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit("["), quoted, F.lit("]")))
        place = F.when(F.coalesce("key", F.col("pos").cast("string")).isNull(), F.col("place")).otherwise(F.concat("place", F.lit("\x01"), F.coalesce("key", F.lpad(F.col("pos").cast("string"), 10, "0"))))
        rows = rows.select(identity, F.concat("path", step).alias("path"), place.alias("place"), "a", "b")
    # texts come out of a generator: nothing that asks for them below makes them again
    texts = F.explode(F.array(F.struct(F.to_json("a").alias("text_a"), F.to_json("b").alias("text_b"))))
    told = rows.select(identity, "path", "place", texts.alias("t")).select(identity, "path", "place", "t.*")
    kind_a, kind_b = _kind(F.col("text_a")), _kind(F.col("text_b"))
    number = lambda c: F.col(c).cast("double")
    # what the last level left closed is compared whole
    same = (kind_a == kind_b) & F.when(kind_a == "number", number("text_a") == number("text_b")).otherwise(F.col("text_a") == F.col("text_b"))
    change = F.when(F.col("text_a").isNull() & F.col("text_b").isNull(), None).when(F.col("text_a").isNull(), "added").when(F.col("text_b").isNull(), "removed").when(~same, "changed")
    found = told.withColumn("kind", change).where("kind is not null")
    # a running count: a rank would be cut before the shuffle as well, by a sort of its own that leaves out next to nothing
    first = found.withColumn("_n", F.count("*").over(W.partitionBy(identity).orderBy("place").rowsBetween(W.unboundedPreceding, 0))).where(F.col("_n") <= most)
    return first.select(identity, "path", "kind", F.col("text_a").alias("baseline"), F.col("text_b").alias("candidate"))


def shadow_diff(cases: DataFrame, identity: str, baseline: Column, candidate: Column, depth: int = DEPTH) -> DataFrame:
    """Outputs of two versions of a step on the same cases -> ``identity, changed, differences``: which cases change, and at how many paths."""
    rows = cases.select(identity, baseline.alias("_a"), candidate.alias("_b"))
    found = paired_diff(rows, identity, "_a", "_b", depth).groupBy(identity).agg(F.count("*").alias("differences"))
    out = cases.select(identity).distinct().join(found, identity, "left")
    return out.select(identity, F.col("differences").isNotNull().alias("changed"), F.coalesce("differences", F.lit(0)).alias("differences"))
