"""All pairs of sets that may be alike: sets lie in blocks by size, blocks meet in tiles, and a tile compares parities before it compares elements."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from sievewright.storage import written

#: Bits of a sketch for each element at least, and those that are looked at first.
BITS, FIRST = 4, 1.6
#: Blocks of a scope, sets and bytes of sketches of one block: a tile holds one block, whatever the table's size.
BLOCKS, LEAST_SETS, MOST_SETS, MOST_BYTES = 16, 2_048, 32_768, 16 << 20
#: Bits that are counted at once when sketches are made, pairs that are told at once.
AT_ONCE = 1 << 23
TOLD = 1 << 16


@F.arrow_udf(BinaryType())
def _sketches(hashes: pa.Array) -> pa.Array:
    return _parities(hashes)


def sketch(elements: Column) -> Column:
    """A set's parities: each bit tells whether an odd number of its elements fall to it. Two sketches of one width differ in no more bits than their sets in elements."""
    return _sketches(F.transform(elements, lambda e: F.xxhash64(e)))


def _parities(hashes: pa.Array) -> pa.Array:
    """Lists of hashes -> sketches of a power of two of 64-bit words; a sketch folded in half is that of half the width."""
    hashes = hashes.combine_chunks() if isinstance(hashes, pa.ChunkedArray) else hashes
    sizes = hashes.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    words = 1 << np.ceil(np.log2(np.maximum(sizes * BITS / 64, 1))).astype(np.int64)
    values = np.asarray(hashes.flatten().to_numpy(zero_copy_only=False), np.int64)
    ends, bits = np.cumsum(sizes), np.cumsum(words * 64)
    out, at = [], 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(bits, (bits[at - 1] if at else 0) + AT_ONCE, "right")))
        n, w = sizes[at:to], words[at:to] * 64
        slots = values[ends[at] - sizes[at] : ends[to - 1]] & np.repeat(w - 1, n)
        odd = np.bincount(slots + np.repeat(np.cumsum(w) - w, n), minlength=int(w.sum())) & 1
        out.append(np.packbits(odd.astype(bool), bitorder="little"))
        at = to
    offsets = np.concatenate([[0], np.cumsum(words * 8)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(out) if out else b"")])


def near_pairs(classes: DataFrame, scope: list[str], part: float) -> DataFrame:
    """``c, n, p, scope...`` (key, size, sketch of different sets) -> ``tile, c_a, c_b, n_a, n_b``: a superset of the pairs of one scope that share ``part`` of both sizes' sum, each once.

    Sets lie in blocks by size. Blocks that sizes let meet are tiles: a task holds one block and streams the other past it. This looks at all pairs within reach of their sizes, but moves
    and keeps sketches only, a few bits for an element. Where too many bits differ, the sets cannot share enough.
    """
    scopes = W.partitionBy(*scope)
    sizes = classes.groupBy(*scope, "n").agg(F.count("*").alias("many"), F.max(F.octet_length("p")).alias("wide"))  # one row a size
    most = F.least(F.greatest(F.sum("many").over(scopes) / BLOCKS, F.lit(LEAST_SETS)), F.lit(MOST_SETS))
    sizes = sizes.withColumn("share", F.col("many") * F.greatest(1 / most, F.col("wide") / MOST_BYTES))
    before = F.coalesce(F.sum("share").over(scopes.orderBy("n").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    within = F.pmod(F.xxhash64("c"), F.lit(1 << 20)) / (1 << 20)
    placed = classes.join(sizes.select(*scope, "n", "share", before.alias("before")), [*scope, "n"]).withColumn("block", F.floor(F.col("before") + F.col("share") * within))
    blocks = written(placed.groupBy(*scope, "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi")))
    other = blocks.select(*scope, F.col("block").alias("b"), F.col("lo").alias("least"))
    met = blocks.withColumnRenamed("block", "a").join(other, scope) if scope else blocks.withColumnRenamed("block", "a").crossJoin(other)
    met = met.where((F.col("a") == F.col("b")) | ((F.col("a") < F.col("b")) & (F.col("hi") >= F.ceil((F.col("hi") + F.col("least")) * part - 1e-9))))
    tiles = written(met.select(*scope, "a", "b", F.monotonically_increasing_id().alias("tile")))
    sides = [placed.join(tiles.withColumnRenamed(x, "block"), [*scope, "block"]).select("tile", F.lit(k).alias("side"), (F.lit(0) if k == 0 else F.col("block") == F.col("a")).cast("boolean").alias("same"), "n", "c", "p") for k, x in enumerate("ab")]
    dealt = by_tile(sides[0].unionByName(sides[1]), "side", "n", "c")
    kind = dict(classes.dtypes)["c"]
    return dealt.mapInArrow(lambda batches: _met(batches, part), f"tile long, c_a {kind}, c_b {kind}, n_a int, n_b int")


def by_tile(df: DataFrame, *order: str) -> DataFrame:
    """Rows of a tile in one task, in order; a tile is work for seconds and few bytes, so tasks are more than their bytes ask for."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, "tile").sortWithinPartitions("tile", *order)


def runs(batch: pa.RecordBatch, *names: str) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Parts of a batch whose values of ``names`` are equal, in order."""
    if not batch.num_rows:
        return
    keys = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
    changes = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    cuts = [0, *(np.flatnonzero(changes) + 1).tolist(), batch.num_rows]
    for i, j in zip(cuts, cuts[1:]):
        yield tuple(k[i].item() for k in keys), batch.slice(i, j - i)


def _met(batches: Iterator[pa.RecordBatch], part: float) -> Iterator[pa.RecordBatch]:
    block, tile, parts, streamed, told, count = None, None, [], 0, [], 0
    for batch in batches:
        for (of, side), rows in runs(batch, "tile", "side"):
            if of != tile:
                block, tile, parts, streamed = None, of, [], 0
            if side == 0:
                parts.append(rows)
                continue
            if not parts:
                continue
            block = block or _Block(pa.Table.from_batches(parts).combine_chunks(), part)
            upto = rows.column("same")[0].as_py()
            sizes, keys = rows.column("n").to_numpy(), rows.column("c")
            for k, bits in enumerate(rows.column("p")):
                hits = block.near(int(sizes[k]), np.frombuffer(bits.as_buffer(), np.uint64), streamed + k if upto else None)
                if len(hits):
                    told.append(_pairs(tile, block, hits, keys[k], int(sizes[k])))
                    count += len(hits)
                    if count >= TOLD:
                        yield from told
                        told, count = [], 0
            streamed += rows.num_rows
    yield from told


def _pairs(tile: int, block: _Block, hits: np.ndarray, key: pa.Scalar, size: int) -> pa.RecordBatch:
    n = len(hits)
    return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(tile, pa.int64()), n), block.keys.take(pa.array(hits)), pa.repeat(key, n), pa.array(block.sizes[hits], pa.int32()), pa.repeat(pa.scalar(size, pa.int32()), n)], ["tile", "c_a", "c_b", "n_a", "n_b"])


def _folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches (rows of words) at a smaller width."""
    while sketches.shape[-1] > words:
        half = sketches.shape[-1] // 2
        sketches = sketches[..., :half] ^ sketches[..., half:]
    return sketches


class _Block:
    """Sets of a block in order of size, those of one width of sketch together."""

    def __init__(self, rows: pa.Table, part: float):
        self.part, self.sizes, self.keys = part, rows["n"].to_numpy().astype(np.int64), rows["c"].combine_chunks()
        self.keys = self.keys.combine_chunks() if isinstance(self.keys, pa.ChunkedArray) else self.keys
        sketches = rows["p"].to_pylist()
        widths = np.array([len(s) // 8 for s in sketches])
        cuts = [0, *(np.flatnonzero(widths[1:] != widths[:-1]) + 1).tolist(), len(widths)]
        self.groups = [(i, j, np.frombuffer(b"".join(sketches[i:j]), np.uint64).reshape(j - i, -1)) for i, j in zip(cuts, cuts[1:])]
        self._views: dict[tuple[int, int], np.ndarray] = {}
        self._asked, self._reach = None, None
        self._x, self._y = np.empty(len(widths), np.uint64), np.empty(len(widths), np.uint8)

    def _view(self, group: int, words: int, across: bool) -> np.ndarray:
        """A group's sketches at a width; across: word by word."""
        key = (group, -words if across else words)
        if key not in self._views:
            at_width = _folded(self.groups[group][2], words)
            self._views[key] = np.ascontiguousarray(at_width.T) if across else at_width
        return self._views[key]

    def _within(self, size: int) -> tuple[int, int, np.ndarray]:
        """Sets that a set of ``size`` can share enough with, from and to, and in how many elements each may differ from it."""
        if size != self._asked:
            need = np.ceil((self.sizes + size) * self.part - 1e-9).astype(np.int64)
            at = np.flatnonzero(np.minimum(self.sizes, size) >= need)
            lo, hi = (int(at[0]), int(at[-1]) + 1) if len(at) else (0, 0)
            self._asked, self._reach = size, (lo, hi, (self.sizes + size - 2 * need)[lo:hi])
        return self._reach

    def near(self, size: int, sketch: np.ndarray, upto: int | None) -> np.ndarray:
        """Places of the sets, before ``upto`` if given, whose sketches let them share enough with a set of ``size``."""
        lo, hi, apart = self._within(size)
        hi = hi if upto is None else min(hi, upto)
        found = []
        for g, (i, j, own) in enumerate(self.groups):
            i0, j0 = max(i, lo), min(j, hi)
            if i0 >= j0:
                continue
            words = min(own.shape[1], len(sketch))
            first = words
            while first > 1 and first // 2 * 64 >= FIRST * max(size, int(self.sizes[j0 - 1])):
                first //= 2
            most = apart[i0 - lo : j0 - lo]
            hits = np.flatnonzero(self._differ(self._view(g, first, True)[:, i0 - i : j0 - i], _folded(sketch, first)) <= most)
            if len(hits) and first < words:
                differ = np.bitwise_count(self._view(g, words, False)[hits + (i0 - i)] ^ _folded(sketch, words)).sum(axis=1, dtype=np.int64)
                hits = hits[differ <= most[hits]]
            if len(hits):
                found.append(hits + i0)
        return np.concatenate(found) if found else np.empty(0, np.int64)

    def _differ(self, columns: np.ndarray, sketch: np.ndarray) -> np.ndarray:
        n = columns.shape[1]
        x, y, out = self._x[:n], self._y[:n], np.zeros(n, np.uint16 if len(sketch) < 1_000 else np.uint32)
        for column, word in zip(columns, sketch):
            np.bitwise_xor(column, word, out=x)
            np.bitwise_count(x, out=y)
            np.add(out, y, out=out)
        return out


def shared_elements(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``tile, c_a, c_b, n_a, n_b`` and ``c, set`` -> ``c_a, c_b, n_a, n_b, shared``: a set is sent once to each tile that has pairs of it, however many these are."""
    asked = pairs.select("tile", F.col("c_a").alias("c")).unionByName(pairs.select("tile", F.col("c_b").alias("c"))).distinct()
    none = F.lit(None)
    kinds = dict(pairs.dtypes)
    held = sets.hint("merge").join(asked, "c").select("tile", F.lit(0).alias("side"), F.col("c").alias("c_a"), none.cast(kinds["c_b"]).alias("c_b"), none.cast("int").alias("n_a"), none.cast("int").alias("n_b"), "set")
    told = pairs.select("tile", F.lit(1).alias("side"), "c_a", "c_b", "n_a", "n_b", none.cast(dict(sets.dtypes)["set"]).alias("set"))
    return by_tile(held.unionByName(told), "side").mapInArrow(_compared, f"c_a {kinds['c_a']}, c_b {kinds['c_b']}, n_a int, n_b int, shared int")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tile, held, one = None, {}, {}
    for batch in batches:
        for (of, side), rows in runs(batch, "tile", "side"):
            if of != tile:
                tile, held, one = of, {}, {}
            left = rows.column("c_a").to_pylist()
            if side == 0:
                # equal elements of different sets are one object
                held.update((c, frozenset([one.setdefault(e, e) for e in s])) for c, s in zip(left, rows.column("set").to_pylist()))
                continue
            shared = [len(held[a] & held[b]) for a, b in zip(left, rows.column("c_b").to_pylist())]
            yield pa.RecordBatch.from_arrays([*[rows.column(n) for n in ("c_a", "c_b", "n_a", "n_b")], pa.array(shared, pa.int32())], ["c_a", "c_b", "n_a", "n_b", "shared"])
