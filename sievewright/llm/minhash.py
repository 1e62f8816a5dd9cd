"""Near-duplicate documents: an LSH forest of MinHash signatures, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.llm.components import connected_components
from sievewright.llm.scratch import discard, materialize, row_key, small_or_joined
from sievewright.llm.texts import U, grouped, local_components, mix, segment_sums, shingle_sets, slices

#: Trees of the forest, permutations, and the prefix length that makes rows of a tree's order one region.
TREES, PERMUTATIONS = 24, 120
DEPTH = 5
#: A region of more rows is cut at the first of these prefix lengths that leaves no more.
REGION_ROWS, DEPTHS = 512, (8, 12, 18, 27)
#: Rows of one block of a group that is compared in pairs of blocks; of groups of more rows than ``REGION_LARGE`` blocks are larger, so that rows are copied less often.
REGION_BLOCK, REGION_LARGE, LARGE_BLOCK = 512, 8192, 2048
#: Groups of more rows are searched from row to row, smaller ones are compared all at once.
SEARCHED = 64
#: Slack of the signature's estimate below the threshold: four standard deviations.
SLACK = 0.13
#: Rows and shingles of one block of a large cluster.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 1_000_000
#: Buckets of the histogram by which shingles are rare or common.
RARITY_BITS = 18

_RNG = np.random.default_rng(8128)
_MUL = _RNG.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * U(2) + U(1)
_ADD = _RNG.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_MIX = _RNG.integers(1, 1 << 63, DEPTHS[-1], dtype=np.uint64) * U(2) + U(1)


def _orders() -> np.ndarray:
    """The permutations by which each tree sorts: the first of them its own, then others in an order of its own."""
    own = np.arange(TREES * DEPTH).reshape(TREES, DEPTH)
    rest = [_RNG.permutation(np.setdiff1d(np.arange(PERMUTATIONS), x))[: DEPTHS[-1] - DEPTH] for x in own]
    return np.concatenate([own, rest], 1)


_ORDERS = _orders()


def signatures(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash signature (16 bits kept of each minimum) of every non-empty set."""
    out = np.zeros((len(offsets) - 1, PERMUTATIONS), np.uint16)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        at = offsets[full]
        for k in range(PERMUTATIONS):
            low = np.minimum.reduceat((sets * _MUL[k] + _ADD[k]) >> U(24), at)
            out[full, k] = (mix(low) & U(0xFFFF)).astype(np.uint16)
    return out


def prefix_key(sig: np.ndarray, tree: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """A hash of the first values of each signature in its tree's order."""
    picked = np.take_along_axis(sig, _ORDERS[tree, :depth], 1).astype(np.uint64)
    return mix((picked * _MIX[:depth]).sum(1, dtype=np.uint64) + mix((tree + TREES * depth).astype(np.uint64))).view(np.int64)


def _sigs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), PERMUTATIONS)


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets, offsets = shingle_sets(batch.column("text"), width)
            sig = signatures(sets, offsets)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("row_key"),
                    pa.array(np.diff(offsets)),
                    pa.array(segment_sums(mix(sets), offsets).view(np.int64)),
                    pa.array(segment_sums(mix(sets ^ U(0x5851F42D4C957F2D)), offsets).view(np.int64)),
                    pa.array([s.tobytes() for s in sig], pa.binary()),
                ],
                ["doc_id", "row_key", "n_shingles", "k1", "k2", "sig"],
            )

    return run


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sig, node = _sigs(batch.column("sig")), batch.column("node").to_numpy(zero_copy_only=False)
        tree = np.tile(np.arange(TREES), len(node))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node, TREES)), pa.array(tree.astype(np.int32)), pa.array(prefix_key(np.repeat(sig, TREES, 0), tree))], ["node", "tree", "region"])


def _deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sig, tree = _sigs(batch.column("sig")), batch.column("tree").to_numpy()
        for depth in DEPTHS:
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("tree"), pa.array(np.full(len(tree), depth, np.int32)), pa.array(prefix_key(sig, tree, depth))], ["node", "tree", "depth", "region"])


def alike_star(sig: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the graph of rows whose signatures agree enough: every row is compared with all that are not reached yet."""
    left, right = [], []
    todo, rest = np.arange(len(sig)), sig
    while len(todo) > 1:
        front, todo, rest = [todo[0]], todo[1:], rest[1:]
        while front and len(todo):
            one = front.pop()
            alike = (rest == sig[one]).mean(1) >= least
            if alike.any():
                found = todo[alike]
                left.append(np.full(len(found), one))
                right.append(found)
                front.extend(found.tolist())
                todo, rest = todo[~alike], rest[~alike]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _neighbours(least: float):
    """Rows sorted by region and blocks: compare the signatures of all rows of a group, emit a spanning star of those alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, ["region", "lo", "hi"]):
            keys = np.stack([rows.column(k).to_numpy() for k in ("region", "lo", "hi")])
            cuts = np.r_[0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1, rows.num_rows]
            size = np.diff(cuts)
            group = np.repeat(np.arange(len(size)), size)
            node = rows.column("node").to_numpy()
            sig = _sigs(rows.column("sig"))
            left, right = [], []
            live = np.flatnonzero(size[group] <= SEARCHED)
            for gap in range(1, SEARCHED):
                live = live[live + gap < len(group)]
                live = live[group[live] == group[live + gap]]
                if not len(live):
                    break
                for part in np.array_split(live, len(live) // 20_000 + 1):
                    alike = part[(sig[part] == sig[part + gap]).mean(1) >= least]
                    left.append(node[alike])
                    right.append(node[alike + gap])
            for k in np.flatnonzero(size > SEARCHED).tolist():
                own = slice(cuts[k], cuts[k + 1])
                a, b = alike_star(sig[own], least)
                left.append(node[own][a])
                right.append(node[own][b])
            if left and sum(map(len, left)):
                nodes, roots = local_components(np.concatenate(left), np.concatenate(right))
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["a", "b"])

    return run


def _class_sets(width: int):
    """One set per class and task, of rows whose text is the class's: rows may share a ``doc_id`` and differ in text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets, offsets = shingle_sets(batch.column("text"), width)
            own = segment_sums(mix(sets), offsets).view(np.int64)
            rows = np.flatnonzero(own == batch.column("node").to_numpy())
            keys = [batch.column(k).take(pa.array(rows)) for k in batch.schema.names if k != "text"]
            yield pa.RecordBatch.from_arrays([*keys, pa.array([sets[offsets[i] : offsets[i + 1]].tobytes() for i in rows], pa.binary())], [*(k for k in batch.schema.names if k != "text"), "shingles"])

    return run


def _rarity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = np.zeros(1 << RARITY_BITS, np.int64)
    for batch in batches:
        for own in batch.column("shingles"):
            held += np.bincount((np.frombuffer(own.as_buffer(), np.uint64) >> U(64 - RARITY_BITS)).astype(np.int64), minlength=len(held))
    some = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], ["bucket", "n"])


def prefix_length(size: np.ndarray, percent: int) -> np.ndarray:
    """Two sets that are alike by ``percent`` share one of so many of their first shingles, whatever the common order."""
    return size + (-percent * size // 100) + 1


def _rarest(percent: int, shared: Broadcast):
    """A row for each of a set's rarest shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for batch in batches:
            for node, raw in zip(batch.column("node").to_pylist(), batch.column("shingles")):
                own = np.frombuffer(raw.as_buffer(), np.uint64)
                order = np.lexsort((own, common[(own >> U(64 - RARITY_BITS)).astype(np.int64)]))
                first = own[order[: int(prefix_length(np.int64(len(own)), percent))]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), node)), pa.array(mix(first).view(np.int64))], ["node", "region"])

    return run


def linked_star(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, int]:
    """A spanning forest of the links of some sets, and the number of pairs that were compared.

    Only sets whose sizes allow the ratio and that share one of their rarest shingles are compared; what has been
    reached is not compared again, so a group of near copies takes about as many comparisons as it has members.
    """
    size = np.array([len(x) for x in sets])
    uniq, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    begin = ends - size
    row = np.repeat(np.arange(len(sets)), size)
    order = np.lexsort((flat, np.bincount(flat)[flat], row))
    first = np.arange(len(flat)) - np.repeat(begin, size) < np.repeat(prefix_length(size, percent), size)
    at, word = row[order][first], flat[order][first]
    own = np.searchsorted(at, np.arange(len(sets) + 1))
    by_word = np.argsort(word, kind="stable")
    cut = np.searchsorted(word[by_word], np.arange(len(uniq) + 1))
    held: dict[int, np.ndarray] = {}
    seen, reached = np.zeros(len(uniq), np.int32), np.zeros(len(sets), bool)
    left, right, compared = [], [], 0
    for start in range(len(sets)):
        if reached[start]:
            continue
        reached[start], front = True, [start]
        while front:
            i = front.pop()
            met = []
            for w in word[own[i] : own[i + 1]].tolist():
                if cut[w + 1] - cut[w] > 1:
                    rest = held.get(w)
                    rest = at[by_word[cut[w] : cut[w + 1]]] if rest is None else rest
                    held[w] = rest = rest[~reached[rest]]
                    met.append(rest)
            met = np.unique(np.concatenate(met)) if met else row[:0]
            met = met[100 * np.minimum(size[met], size[i]) >= percent * np.maximum(size[met], size[i])]
            if not len(met):
                continue
            compared += len(met)
            seen[flat[begin[i] : ends[i]]] = 1
            step = np.r_[0, np.cumsum(size[met])]
            common = np.add.reduceat(seen[flat[np.arange(step[-1]) + np.repeat(begin[met] - step[:-1], size[met])]], step[:-1])
            seen[flat[begin[i] : ends[i]]] = 0
            hit = met[100 * common >= percent * (size[i] + size[met] - common)]
            reached[hit] = True
            left.append(np.full(len(hit), i))
            right.append(hit)
            front.extend(hit.tolist())
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right]), compared


def _confirm(percent: int):
    """Blocks of a cluster, whole: a spanning star of the links of their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, ["cluster", "lo", "hi"]):
            keys = np.stack([rows.column(k).to_numpy() for k in ("cluster", "lo", "hi")])
            cuts = np.r_[0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1, rows.num_rows]
            node, own, left, right = rows.column("node").to_numpy(), rows.column("shingles").to_pylist(), [], []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if b - a > 1:
                    x, y, _ = linked_star([np.frombuffer(x, np.uint64) for x in own[a:b]], percent)
                    left.append(node[a:b][x])
                    right.append(node[a:b][y])
            if left and sum(map(len, left)):
                nodes, roots = local_components(np.concatenate(left), np.concatenate(right))
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["a", "b"])

    return run


def _in_blocks(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of a group with ``blocks`` > 1 are dealt in pairs of blocks: ``lo``, ``hi``; any two rows meet."""
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # two blocks together hold the pairs within each
    dealt = dealt.where("blocks = 1 or own <> other").withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("own", "other", "blocks")
    return dealt.repartition(*keys, "lo", "hi").sortWithinPartitions(*keys, "lo", "hi")


def _alike(rows: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """``rows(node, region, blocks)``: pairs ``a, b`` that span what is alike within each region."""
    return _in_blocks(rows.join(sigs, "node"), "region").mapInArrow(_neighbours(least), "a bigint, b bigint")


def _enough_blocks() -> Column:
    return F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """``sets(cluster, blocks, node, shingles)``: pairs ``a, b`` that span the links of each cluster.

    A large cluster is first compared block by block, each beside the cluster's first member, which ties together the blocks of
    near copies. Rows that do not belong to the component of most rows by then are compared with all blocks, in blocks of their
    own; rows of that component need no more, so near copies are moved once.
    """
    own = sets.withColumn("lo", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("hi", F.lit(-1))
    hubs = own.where("blocks > 1 and node = cluster").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("to <> lo")
    columns = ["cluster", "lo", "hi", "node", "shingles"]

    def compared(rows: DataFrame) -> DataFrame:
        return rows.repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi").mapInArrow(_confirm(percent), "a bigint, b bigint")

    near = materialize(compared(own.select(columns).unionByName(hubs.withColumn("lo", F.col("to")).select(columns))))
    large = own.where("blocks > 1")
    if large.isEmpty():
        return near
    rooted = large.select("cluster", "node", (F.octet_length("shingles") / 8).alias("n_shingles")).join(connected_components(near), "node", "left").withColumn("root", F.coalesce("root", "node"))
    most = rooted.groupBy("cluster", "root").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max(F.struct("n", "root"))["root"].alias("main"))
    rest = materialize(rooted.join(most, "cluster").where("root <> main").select("cluster", "node", "n_shingles"))
    groups = rest.groupBy("cluster").agg(_enough_blocks().alias("others"))
    every = large.join(groups, "cluster")
    by_block = every.withColumn("hi", F.explode(F.sequence(F.lit(0), F.col("others") - 1))).select(columns)
    alone = every.join(rest.select("node"), "node", "left_semi").withColumn("hi", F.pmod(F.xxhash64("node", F.lit("other")), F.col("others")).cast("int"))
    return near.union(compared(by_block.unionByName(alone.withColumn("lo", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(columns))))


def _region_blocks(rows: Column) -> Column:
    """Blocks of a crowded group: any two together are a small part of it."""
    return F.ceil(rows / F.when(rows > REGION_LARGE, LARGE_BLOCK).otherwise(REGION_BLOCK)).cast("int")


def _rare_way(sets: DataFrame, edges: DataFrame, sigs: DataFrame, percent: int, least: float) -> DataFrame:
    """Pairs of crowded rows, found by what is rare: sets that are alike share one of their rarest shingles.

    Rows that the forest has brought into one cluster need no more edges, so groups of one cluster are left out.
    """
    counts = sets.mapInArrow(_rarity, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # 2^18 rows at most
    common = np.zeros(1 << RARITY_BITS, np.int64)
    common[counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    rows = sets.mapInArrow(_rarest(percent, sets.sparkSession.sparkContext.broadcast(common)), "node bigint, region bigint")
    known = connected_components(edges)
    rows = materialize(rows.join(known, "node", "left").select("node", "region", F.coalesce("root", "node").alias("known")))
    mixed = rows.groupBy("region").agg(F.min("known").alias("a"), F.max("known").alias("b"), _region_blocks(F.count("*")).alias("blocks")).where("a <> b").select("region", "blocks")
    return _alike(rows.select("node", "region").join(materialize(mixed), "region"), sigs, least)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> one row per document: ``doc_id, n_shingles, component_id, kept, row_key, first``.

    Words are runs of anything but blanks, lower-cased in A-Z; a document's set holds its distinct
    ``width``-word shingles. Two documents are linked when ``100 * |A and B| >= percent * |A or B|``;
    ``component_id`` is the smallest ``doc_id`` that a document reaches, and it is kept when that is its own.

    Method: equal sets become one class. Each of 24 trees sorts the classes' signatures by permutations of its
    own; rows of an order that share a common prefix of five values lie in one region. A region of more than 512
    rows is cut at the first longer prefix (8, 12, 18 or 27 values) that leaves no more. All rows of a region are
    compared on their signatures. What a cut may part is found by an exact way: of two sets that are alike, each has one of
    its rarest shingles in the other's rarest, so rows of crowded regions meet there once more, in groups by rare
    shingle (dealt in pairs of blocks where crowded), unless the forest has them all in one cluster. Rows whose signatures
    agree enough to allow the threshold join one cluster. Members of a cluster are then compared on full shingle sets, by size
    and rare shingles, large clusters block by block (see :func:`_links`), and only a spanning star of links leaves a task.

    Defined cases: null or blank texts have no shingles and link with nothing; shorter texts than
    ``width`` words have one shingle; repeated rows are all returned, with the same component; rows of one ``doc_id`` with
    different texts are documents of their own (``row_key`` tells them apart, and ``first`` is true for one text of a component only); a null ``doc_id`` is a document by itself (component null, kept).
    Extra columns, whatever their names, are ignored; an empty table gives no rows.
    """
    least = percent / 100 - SLACK
    docs = docs.select("doc_id", "text")
    signed = materialize(docs.withColumn("row_key", row_key()).mapInArrow(_sign(width), "doc_id bigint, row_key bigint, n_shingles bigint, k1 bigint, k2 bigint, sig binary"))
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    reps = materialize(usable.groupBy("k1", "k2", "n_shingles").agg(F.min(F.struct("doc_id", "sig")).alias("r")).select(F.col("k1").alias("node"), "k2", "n_shingles", F.col("r.doc_id").alias("rep"), "r.sig"))
    sigs = reps.select("node", "sig")

    def texts(nodes: DataFrame) -> DataFrame:
        return docs.select(F.col("doc_id").alias("rep"), "text").join(small_or_joined(materialize(nodes.join(reps.select("node", "rep"), "node"))), "rep").drop("rep")

    rows = sigs.mapInArrow(_regions, "node bigint, tree int, region bigint")
    crowds = materialize(rows.groupBy("region").agg(F.count("*").alias("crowd")).where("crowd > 1"))
    kept = materialize(rows.join(crowds, "region"))
    calm = kept.where(F.col("crowd") <= REGION_ROWS).select("node", "region")
    crowded = kept.where(F.col("crowd") > REGION_ROWS).select("node", "tree")
    if not crowded.isEmpty():
        deep = materialize(crowded.join(sigs, "node").mapInArrow(_deeper, "node bigint, tree int, depth int, region bigint"))
        fits = materialize(deep.groupBy("region").agg(F.count("*").alias("crowd")).where(F.col("crowd") <= REGION_ROWS))
        first = deep.join(fits, "region").groupBy("node", "tree").agg(F.min(F.struct("depth", "region", "crowd")).alias("x"))
        calm = calm.union(first.where("x.crowd > 1").select("node", "x.region"))
    edges = materialize(_alike(calm.withColumn("blocks", F.lit(1)), sigs, least))
    if not crowded.isEmpty():
        sets = texts(crowded.select("node").distinct()).mapInArrow(_class_sets(width), "node bigint, shingles binary")
        edges = edges.union(materialize(_rare_way(materialize(sets.dropDuplicates(["node"])), edges, sigs, percent, least)))
    clusters = materialize(connected_components(edges).withColumnRenamed("root", "cluster"))
    discard(kept)

    sized = clusters.join(reps.select("node", "n_shingles"), "node")
    blocks = sized.groupBy("cluster").agg(_enough_blocks().alias("blocks"))
    members = texts(clusters.join(blocks, "cluster").select("cluster", "blocks", "node"))
    sets = members.select("cluster", "blocks", "node", "text").mapInArrow(_class_sets(width), "cluster bigint, blocks int, node bigint, shingles binary")
    found = connected_components(_links(materialize(sets), percent))

    classes = reps.select("node", "k2", "n_shingles", "rep").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = classes.groupBy("root").agg(F.min(F.struct("rep", "node")).alias("low"))
    classes = classes.join(lowest, "root").select(F.col("node").alias("k1"), "k2", "n_shingles", F.col("low.rep").alias("lowest"), (F.col("low.node") == F.col("node")).alias("leads"))
    out = signed.drop("sig").join(classes, ["k1", "k2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("lowest", "doc_id"))
    kept = F.coalesce(component == F.col("doc_id"), F.lit(True))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "row_key", (kept & F.coalesce("leads", F.lit(True))).alias("first"))
