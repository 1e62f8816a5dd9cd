"""The trie of conversation prefixes: each conversation owns the nodes of its path of which it is the smallest member."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievewright.llm.scratch import materialize

#: Conversations that share a first part, and the most turns that are shared, less one.
FAMILY, SHARED = 5, 9
#: Turns of one conversation are summed in blocks of so many turn numbers; ids of one node are joined in blocks of so many ids.
BLOCK, IDS = 1024, 4096
#: A node's key: its depth, and position-bound digests of its turns, summed in four parts of 32 bits.
SUMS = ["k1", "k2", "k3", "k4"]
KEY = ["depth", *SUMS]


def _running(rows: DataFrame, key: str, block: Column, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with running sums within ``key`` in ``order``: within blocks of the order by windows, over blocks by their totals."""
    cut = rows.withColumn("_block", block)
    totals = cut.groupBy(key, "_block").agg(*[F.sum(v).alias(f"_{c}") for c, v in sums.items()])
    before = W.partitionBy(key).orderBy(F.asc_nulls_first("_block"))
    carried = totals.select(F.col(key).alias("_of"), F.col("_block").alias("_at"), *[(F.sum(f"_{c}").over(before) - F.col(f"_{c}")).alias(f"_{c}") for c in sums])
    own = W.partitionBy(key, "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    within = cut.withColumns({c: F.sum(v).over(own) for c, v in sums.items()})
    joined = within.join(carried, (F.col(key) == F.col("_of")) & F.col("_block").eqNullSafe(F.col("_at")))
    return joined.withColumns({c: F.col(c) + F.col(f"_{c}") for c in sums}).drop("_of", "_at", "_block", *[f"_{c}" for c in sums])


def shared_turns(c: Column) -> Column:
    """How many first turns a conversation takes from its family's first."""
    return (F.crc32(c.cast("string").cast("binary")) % SHARED).cast("long")


def rebuilt_turns(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Original turns -> every ``conv_id`` with its number of rebuilt turns, and the rebuilt turns ``conv_id, depth, role, text``."""
    own = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.asc_nulls_first("turn"), F.col("role"), F.col("text")]
    own = materialize(_running(own, "conv_id", F.floor(F.col("turn") / BLOCK), order, {"i": F.lit(1)}).select("conv_id", "i", "role", "text"))
    sizes = own.groupBy("conv_id").agg(F.max("i").alias("n"))
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    convs = sizes.select("conv_id", "n", shared_turns(F.col("conv_id")).alias("h"), family.alias("first"))
    convs = convs.join(sizes.select(F.col("conv_id").alias("first"), F.col("n").alias("there")), "first", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    convs = materialize(convs.select("conv_id", "h", "first", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")))
    heads = own.where(F.col("i") < SHARED).withColumnRenamed("conv_id", "first").join(convs.where("taken > 0").select("conv_id", "first", "taken"), "first").where("i <= taken")
    tails = own.join(convs.select("conv_id", "h", "taken"), "conv_id").where("i > h")
    return convs.select("conv_id", "n"), heads.select("conv_id", F.col("i").alias("depth"), "role", "text").unionByName(tails.select("conv_id", (F.col("i") - F.col("h") + F.col("taken")).alias("depth"), "role", "text"))


def occurrences(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """A row for each conversation and node on its path, the root included: ``conv_id, n``, the node's key, its ``bytes`` and those from the root up to it."""
    said = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    marked = turns.select("conv_id", "depth", F.octet_length("text").cast("long").alias("bytes"), said.alias("said"))
    parts = {k: F.conv(F.substring("said", 1 + 8 * i, 8), 16, 10).cast("long") for i, k in enumerate(SUMS)}
    path = _running(marked, "conv_id", F.floor(F.col("depth") / BLOCK), [F.col("depth")], {**parts, "upto": F.col("bytes")})
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", "n", *[zero.alias(c) for c in (*KEY, "bytes", "upto")])
    return roots.unionByName(path.drop("said").join(convs, "conv_id"))


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of ids sorted by node: the hash of all of a node's blocks, read one after the other."""
    node, digest = None, None

    def ended() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([k]) for k in node), pa.array([digest.hexdigest()])], [*KEY, "ends_sha256"])

    for batch in batches:
        for *key, ids in zip(*(batch.column(k).to_pylist() for k in (*KEY, "ids"))):
            if key != node:
                if node is not None:
                    yield ended()
                node, digest = key, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
    if node is not None:
        yield ended()


def _ends(path: DataFrame) -> DataFrame:
    """The hash of the ids that end at each node, ascending: ids are joined in blocks first, and only nodes of several blocks are read in turn."""
    block = F.floor(F.col("conv_id") / IDS)
    blocks = path.where("depth = n").groupBy(*KEY, block.alias("block")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    blocks = materialize(blocks)
    held = blocks.groupBy(*KEY).agg(F.min("block").alias("a"), F.max("block").alias("b"), F.min("ids").alias("ids"))
    single = held.where("a = b").select(*KEY, F.sha2("ids", 256).alias("ends_sha256"))
    several = blocks.join(held.where("a < b").select(*KEY), KEY, "left_semi")
    schema = ", ".join(f"{k} bigint" for k in KEY) + ", ends_sha256 string"
    return single.unionByName(several.repartition(*KEY).sortWithinPartitions(*KEY, "block").mapInArrow(_hashed_ids, schema))


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """Conversations ``conv_id, n`` and their turns ``conv_id, depth, role, text`` (``depth`` from 1 to ``n``) -> one row per node of the trie of their prefixes:
    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    A node is a distinct sequence of first turns, known by its depth and 128 bits of summed digests of (position, role, text); it is owned by its
    smallest member. Smaller members of a longer prefix are members of the shorter too, so what a conversation owns is a suffix of its path, told by the depth
    at which it begins. What a subtree saves is then a sum over its occurrences, of bytes that are not their own: those from the node to where the conversation's own
    nodes begin; its leaves are the members that own the childless node at which they end. One aggregate by node sums both. Owners come from an aggregate too:
    a window over a node's members would hold every conversation at the root.

    Defined cases: a conversation without turns is a member of the root only; no conversations give no rows.
    """
    path = materialize(occurrences(convs, turns))
    nodes = path.groupBy(*KEY).agg(F.min(F.struct("conv_id", "n")).alias("least"), F.count("*").alias("n_convs"), F.count_if(F.col("depth") == F.col("n")).alias("ending"))
    nodes = materialize(nodes.select(*KEY, F.col("least.conv_id").alias("owner"), F.col("least.n").alias("owner_n"), "n_convs", "ending"))
    owners = materialize(nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.min("depth").alias("begins"), F.max((F.col("ending") == F.col("n_convs")).cast("long")).alias("leaf")))
    # where a conversation's own nodes begin; beyond its end if it owns none
    marked = path.join(owners, "conv_id", "left").withColumn("owns", F.col("begins").isNotNull()).withColumn("begins", F.coalesce("begins", F.col("n") + 1))
    last = materialize(marked.where("depth = begins - 1").select("conv_id", "owns", *KEY, F.col("upto").alias("foreign")))
    values = marked.join(last.select("conv_id", "foreign"), "conv_id", "left")
    saved = F.when(F.col("depth") < F.col("begins"), F.col("foreign") - F.col("upto") + F.col("bytes")).otherwise(0)
    sums = values.groupBy(*KEY).agg(F.sum(saved).alias("saved_tokens"), F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"))

    # a node's children: the next on its owner's path, and the first own node of each conversation that leaves there
    leaving = last.where("owns")
    children = leaving.groupBy(*KEY).agg(F.count("*").alias("leaving"))
    parents = leaving.join(nodes.select(*KEY, F.col("owner").alias("above")), KEY).select(F.col("conv_id").alias("owner"), (F.col("depth") + 1).alias("depth"), "above")
    out = nodes.join(sums, KEY).join(children, KEY, "left").join(_ends(path), KEY, "left").join(parents, ["owner", "depth"], "left")
    out = out.select(
        F.col("owner").alias("conv_id"),
        "depth",
        F.when(F.col("depth") > 0, F.coalesce("above", "owner")).alias("parent_conv_id"),
        "n_convs",
        (F.coalesce("leaving", F.lit(0)) + (F.col("owner_n") > F.col("depth")).cast("long")).alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
    return out


def prefix_trie(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text, ...)`` -> the :func:`trie` of the rebuilt conversations.

    Every ``conv_id`` c is rebuilt from the first h turns of conversation ``c - c % 5`` and its own turns after its first h,
    h being ``crc32(c) % 9``.

    Defined cases: null role or text is empty; turns of one number go by role, then text, null numbers first; repeated rows are turns of their own; rows without
    ``conv_id`` belong to no conversation and are left out; a conversation may be left without turns; an empty table gives no rows; texts count whole; extra columns, whatever their names, are ignored.
    """
    return trie(*rebuilt_turns(rows))


ORACLE = r"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n::BIGINT)) AS t),
own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id AS c, xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295::BIGINT), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM own), crc),
turns AS (
  SELECT c, i, 0 AS part, role, text FROM convs JOIN own ON conv_id = c - c % 5 AND i <= h
  UNION ALL SELECT c, i, 1, role, text FROM convs JOIN own ON conv_id = c AND i > h),
numbered AS (SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY part, i) AS d FROM turns),
paths AS (SELECT c, list({'role': role, 'text': text} ORDER BY d) AS p FROM numbered GROUP BY c),
whole AS (SELECT c, coalesce(p, []) AS p FROM convs LEFT JOIN paths USING (c)),
occ AS (SELECT c, len(p) AS n, unnest(range(len(p) + 1)) AS d, p FROM whole),
occ2 AS (SELECT c, n, d, p[:d] AS k, p[:d - 1] AS up, CASE WHEN d > 0 THEN strlen(p[d].text) ELSE 0 END AS b FROM occ),
nodes AS (
  SELECT d, k, any_value(up) AS up, any_value(b) AS b, min(c) AS owner, count(*) AS n_convs, count(*) FILTER (WHERE n = d) AS ending,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256 FROM occ2 GROUP BY d, k),
below AS (SELECT a.owner, a.d, sum((x.n_convs - 1) * x.b)::BIGINT AS saved_tokens, count(*) FILTER (WHERE x.ending = x.n_convs)::BIGINT AS n_leaves
  FROM nodes a JOIN nodes x ON x.d >= a.d AND x.k[:a.d] = a.k GROUP BY 1, 2),
kids AS (SELECT d - 1 AS d, up AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL)
SELECT a.owner AS conv_id, a.d::BIGINT AS depth, CASE WHEN a.d > 0 THEN u.owner END AS parent_conv_id, a.n_convs::BIGINT AS n_convs, coalesce(kids.n, 0)::BIGINT AS n_children,
  n_leaves, saved_tokens, a.ends_sha256
FROM nodes a JOIN below ON below.owner = a.owner AND below.d = a.d LEFT JOIN nodes u ON u.d = a.d - 1 AND u.k = a.up LEFT JOIN kids ON kids.d = a.d AND kids.k = a.k
"""
