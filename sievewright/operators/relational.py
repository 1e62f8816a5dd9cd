"""Generic relational operators: top rows, keysets, overlaps, sequences, upserts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_rows(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group; the order must be total."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def keyset_page(df: DataFrame, sort: Column, identity: str, limit: int, after: tuple | None = None, descending: bool = True) -> DataFrame:
    """Rows behind ``after`` in the order of ``(sort, identity)``, one more than ``limit`` to tell whether more follow.

    ``sort`` must not be null: put a sentinel there, in the sort and so in the cursor.
    """
    place = F.struct(sort.alias("s"), F.col(identity).alias("i"))
    if after is not None:
        kind = df.select(place.alias("p")).schema["p"].dataType
        edge = F.struct(F.lit(after[0]).cast(kind["s"].dataType).alias("s"), F.lit(after[1]).cast(kind["i"].dataType).alias("i"))
        df = df.where(place < edge if descending else place > edge)
    order = [sort.desc(), F.col(identity).desc()] if descending else [sort.asc(), F.col(identity).asc()]
    return df.orderBy(*order).limit(limit + 1)


#: Parts of a crowded key: rows of one side are dealt over them, rows of the other come to each.
SPREAD = 32


def spread_join(many: DataFrame, few: DataFrame, key: str, by: str, outer: bool = False) -> DataFrame:
    """Rows of equal ``key`` (``outer``: all of ``many``), however few keys there are: a key's rows of ``many`` are dealt over parts by column ``by``, and its rows of ``few`` come to each part.

    The number of partitions is given, so that what goes in, which may be little, does not decide how many tasks make what comes out.
    """
    parts = max(int(many.sparkSession.conf.get("spark.sql.shuffle.partitions")), SPREAD)
    dealt = many.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(SPREAD)).cast("int")).repartition(parts, key, "_part")
    copied = few.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))).repartition(parts, key, "_part")
    return dealt.hint("merge").join(copied, [key, "_part"], "left" if outer else "inner").drop("_part")


def either_join(left: DataFrame, right: DataFrame, every: DataFrame, ids: tuple[str, str], groups: tuple[str, str]) -> DataFrame:
    """Distinct pairs of ids of ``left`` and ``right`` with equal groups, and of ``left`` and ``every`` with equal ids.

    A pair is made once and not compared with others: sides have one row an id with its groups, a pair counts at the smallest group that it shares, and equal ids are added where no group has them.
    """
    (i, j), (g, h) = ids, groups
    held = left.groupBy(i).agg(F.collect_set(g).alias("_l"))  # an id's groups are few
    rich = right.groupBy(j).agg(F.collect_set(h).alias("_r"))
    once = (F.size("_l") == 1) | (F.size("_r") == 1) | (F.col("_g") == F.array_min(F.array_intersect("_l", "_r")))
    grouped = spread_join(rich.withColumn("_g", F.explode("_r")), held.withColumn("_g", F.explode("_l")), "_g", j).where(once).select(i, j)
    same = held.join(every.select(j).distinct(), F.col(i) == F.col(j)).join(rich.withColumnRenamed(j, "_j"), F.col("_j") == F.col(j), "left")
    return grouped.union(same.where(~F.coalesce(F.arrays_overlap("_l", "_r"), F.lit(False))).select(i, j))


#: Levels of the tree of bins: more than any two bins of time may lie apart.
_LEVELS = 29


def _covers(rows: DataFrame, first: str, last: str) -> DataFrame:
    """A row for each of the few aligned blocks of bins, ``_level`` and ``_node``, that make up an interval of bins however long it is."""
    step = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)
    low = lambda k: F.ceil(F.col(first) / step(k)).cast("long")
    high = lambda k: F.floor((F.col(last) + 1) / step(k)).cast("long")
    node = lambda when, k, n: F.when(when, F.struct(k.alias("_level"), n.alias("_node")))
    ends = lambda k: F.array(node((low(k) < high(k)) & (low(k) % 2 != 0), k, low(k)), node((low(k) < high(k)) & (high(k) % 2 != 0), k, high(k) - 1))
    nodes = F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(_LEVELS)), ends)))
    return rows.withColumn("_n", F.explode(nodes)).select(*rows.columns, "_n._level", "_n._node")


def _points(rows: DataFrame, bin_column: str) -> DataFrame:
    """A row for each block of bins that holds a bin."""
    levels = F.transform(F.sequence(F.lit(0), F.lit(_LEVELS)), lambda k: F.struct(k.alias("_level"), F.call_function("shiftright", F.col(bin_column), k).alias("_node")))
    return rows.withColumn("_n", F.explode(levels)).select(*rows.columns, "_n._level", "_n._node")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], forever: str = "9999-12-31", bin_seconds: int = 3600, short: int = 1000) -> DataFrame:
    """Pairs of equal keys whose closed intervals ``(start, until)`` meet; a null end is open. Columns of the right side end in ``_r``.

    Time is cut into bins. Short intervals meet in the bins that both reach, and a pair counts in the first of these. Long and open ones are made up of a few
    aligned blocks of bins: of two intervals that meet, one starts within the other, and a start is looked up by the blocks that hold it. So no row meets the other side by key alone, and
    what is compared is what meets, but for the bins at the ends.
    """
    renamed = right.select(*keys, *[F.col(c).alias(f"{c}_r") for c in right.columns if c not in keys])
    end = F.to_timestamp(F.lit(forever))
    number = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / bin_seconds).cast("long")
    last = F.floor(F.unix_timestamp(end) / bin_seconds).cast("long")

    def sides(df: DataFrame, start: str, until: str, first: str, final: str) -> tuple[DataFrame, DataFrame]:
        told = df.withColumn(first, number(start)).withColumn(final, F.coalesce(number(until), last)).where(F.col(first) <= F.col(final))
        near = F.col(final) - F.col(first) < short
        return told.where(near), told.where(~near)

    a, far_a = sides(left, "start", "until", "_a", "_a2")
    b, far_b = sides(renamed, "start_r", "until_r", "_b", "_b2")
    bins = lambda df, first, final: df.withColumn("_bin", F.explode(F.sequence(first, final)))
    ends, ends_r = F.coalesce(F.col("until").cast("timestamp"), end), F.coalesce(F.col("until_r").cast("timestamp"), end)
    start, start_r = F.col("start").cast("timestamp"), F.col("start_r").cast("timestamp")
    in_left, in_right = (start <= start_r) & (start_r <= ends), (start_r < start) & (start <= ends_r)
    out = left.columns + [c for c in renamed.columns if c not in keys]
    block = [*keys, "_level", "_node"]
    near = bins(a, "_a", "_a2").join(bins(b, "_b", "_b2"), [*keys, "_bin"]).where((F.col("_bin") == F.greatest("_a", "_b")) & (start <= ends_r) & (start_r <= ends)).select(out)
    pairs = [
        _covers(far_a, "_a", "_a2").join(_points(b.unionByName(far_b), "_b"), block).where(in_left),
        _covers(far_b, "_b", "_b2").join(_points(a.unionByName(far_a), "_a"), block).where(in_right),
        bins(b, "_b", "_b2").join(far_a.withColumn("_bin", F.col("_a")), [*keys, "_bin"]).where(in_right),
        bins(a, "_a", "_a2").join(far_b.withColumn("_bin", F.col("_b")), [*keys, "_bin"]).where(in_left),
    ]
    for pair in pairs:
        near = near.union(pair.select(out))
    return near


def upsert(state: DataFrame, new: DataFrame, keys: list[str], replace: Column | None = None) -> DataFrame:
    """Rows of both by key; where both have one, the new values, or where ``replace`` (on columns ``old_x``, ``new_x``) does not hold, the old ones."""
    values = [c for c in state.columns if c not in keys]
    old = state.select(*keys, F.lit(True).alias("_old"), *[F.col(c).alias(f"old_{c}") for c in values])
    fresh = new.select(*keys, F.lit(True).alias("_new"), *[F.col(c).alias(f"new_{c}") for c in values])
    joined = old.join(fresh, keys, "full_outer")
    take = F.col("_new").isNotNull() & (F.col("_old").isNull() | (replace if replace is not None else F.lit(True)))
    return joined.select(*keys, *[F.when(take, F.col(f"new_{c}")).otherwise(F.col(f"old_{c}")).alias(c) for c in values])


def insert_new(state: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key the state lacks, one of each key."""
    return new.join(state.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys)


def ordered_list(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Values of each group as an array in the order of the sort columns."""
    item = F.struct(*order, value.alias("_value"))
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["_value"]).alias(name))


def dominance(status: str, ranks: list[str]) -> Column:
    """The status of a group: the first of ``ranks`` that any member has."""
    rank = F.coalesce(*[F.when(F.col(status) == s, F.lit(i)) for i, s in enumerate(ranks)])
    return F.element_at(F.array(*map(F.lit, ranks)), F.min(rank) + 1)


def ordered_hash(df: DataFrame, key: str, value: str, name: str, separator: str = "\n") -> DataFrame:
    """``key, name``: SHA-256 of each group's values (hex digests) in ascending order, joined by the separator.

    A hash of many values must be fed in order, but no group is gathered: values are joined in blocks by their first digits, and a task streams through the blocks of its groups.
    Null values are left out, a group of nulls has the hash of the empty text; a null key is a group.
    """
    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("k"), F.col(key).isNull().alias("none"), F.substring(value, 1, 4).alias("block"), F.col(value).alias("v"))
    blocks = rows.groupBy("k", "none", "block").agg(F.array_join(F.array_sort(F.collect_list("v")), separator).alias("text"))
    link = separator.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, digest, fed = None, None, False

        def ended() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([group[0]], schema.field("k").type), pa.array([digest.hexdigest()])], ["k", "hash"])

        for batch in batches:
            schema = batch.schema
            for k, none, text in zip(*(batch.column(c).to_pylist() for c in ("k", "none", "text"))):
                if group != (k, none):
                    if group is not None:
                        yield ended()
                    group, digest, fed = (k, none), hashlib.sha256(), False
                if text:
                    digest.update(link + text.encode() if fed else text.encode())
                    fed = True
        if group is not None:
            yield ended()

    out = blocks.repartition("k", "none").sortWithinPartitions("k", "none", "block").mapInArrow(run, f"k {kind}, hash string")
    return out.select(F.col("k").alias(key), F.col("hash").alias(name))
