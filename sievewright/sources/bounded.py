"""JSON within bounds: what it holds is measured over its bytes before anything is built from it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


#: Bytes of documents that are measured together.
AT_ONCE = 1 << 18


@dataclass(frozen=True)
class Limits:
    """Bounds of a document; the defaults are the usual ones, and none may pass the ceilings."""

    bytes: int = 5 << 20
    depth: int = 64
    nodes: int = 250_000
    string: int = 1_000_000

    def __post_init__(self):
        for value, most in ((self.bytes, 50 << 20), (self.depth, 256), (self.nodes, 1_000_000), (self.string, 5_000_000)):
            if not 0 < value <= most:
                raise ValueError("invalid_limits")


def measure(raw: bytes) -> tuple[int, int, int]:
    """Depth, values and longest string (in UTF-16 units, keys included) of well-formed JSON, in passes over its bytes."""
    return tuple(int(found[0]) for found in _measure([raw]))


def _measure(documents: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The measures of many documents in the same passes: they stand in a row, each behind a blank.

    Depth is 0 for the outermost value. A container that is not empty holds one value more than commas; strings and escapes are told by runs of backslashes. A well-formed document
    ends outside of strings and containers; one that does not is measured by itself.
    """
    count = len(documents)
    depth, nodes, longest = (np.zeros(count, np.int64) for _ in range(3))
    data = np.frombuffer(b" " + b" ".join(documents) + b" ", np.uint8)
    begin = np.cumsum([0, *(len(d) + 1 for d in documents)])
    owner = np.repeat(np.arange(count + 1), [*(len(d) + 1 for d in documents), 1])
    at = np.arange(len(data))
    slash = data == 0x5C
    # a byte is escaped if the run of backslashes before it has an odd length
    last_other = np.maximum.accumulate(np.where(slash, -1, at))
    before = np.r_[0, (at - last_other)[:-1]]
    escaped = before % 2 == 1
    quote = (data == 0x22) & ~escaped
    inside = np.cumsum(quote) % 2 == 1  # from the opening quote to before the closing one
    plain = ~inside & ~quote
    opens = plain & ((data == 0x7B) | (data == 0x5B))
    closes = plain & ((data == 0x7D) | (data == 0x5D))
    level = np.cumsum(opens.astype(np.int64) - closes)
    if count > 1 and (inside[begin].any() or level[begin].any()):
        for k, d in enumerate(documents):
            depth[k], nodes[k], longest[k] = (found[0] for found in _measure([d]))
        return depth, nodes, longest
    solid = np.flatnonzero((data != 0x20) & (data != 0x09) & (data != 0x0A) & (data != 0x0D))
    nodes[owner[solid]] = 1
    start = np.flatnonzero(opens)
    if len(start):
        follows = solid[np.minimum(np.searchsorted(solid, start, "right"), len(solid) - 1)]
        filled = ~closes[follows]
        np.maximum.at(depth, owner[start], level[start] - 1 + filled)
        nodes += np.bincount(owner[start], filled, count).astype(np.int64)[:count]
    nodes += np.bincount(owner[plain & (data == 0x2C)], minlength=count)[:count]
    marks = np.flatnonzero(quote)
    if len(marks) >= 2:
        # units: bytes that begin a character, once more for four-byte ones, without what escapes take
        hold = inside & ~quote
        units = (hold & ((data & 0xC0) != 0x80)).astype(np.int64) + (hold & (data >= 0xF0)) - (hold & slash & ~escaped) - 4 * (hold & escaped & (data == 0x75))
        sums = np.r_[0, np.cumsum(units)]
        first = marks[0 : 2 * (len(marks) // 2) : 2]
        np.maximum.at(longest, owner[first], sums[marks[1::2]] - sums[first + 1])
    return depth, nodes, longest


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("depth", pa.int64()), ("nodes", pa.int64()), ("longest", pa.int64())])
    for batch in batches:
        raw = batch.column("_raw")
        sizes = pc.fill_null(pc.binary_length(raw), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, first = np.cumsum(sizes), 0
        while first < batch.num_rows:  # small documents together, a large one by itself: the passes need some twenty times their size
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + AT_ONCE, "right")))
            part, first = batch.slice(first, last - first), last
            texts = part.column("_raw")
            found = [pa.array(f) for f in _measure([b"" if d is None else d for d in texts.to_pylist()])]
            told = pa.StructArray.from_arrays(found, fields=list(kind), mask=pc.is_null(texts))
            names = [c for c in part.schema.names if c != "_raw"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), told], [*names, "_found"])


def bounded_json(documents: DataFrame, content: str, limits: Limits | None = None) -> DataFrame:
    """``documents`` with a column of bytes or text -> with ``depth, nodes, longest`` and ``error``.

    Errors, the first that holds: ``byte_limit``, ``invalid_utf8``, ``invalid_json``, ``node_limit``, ``depth_limit``, ``string_limit``; null for a document within all bounds. Only well-formed
    documents within the byte limit are measured, others have null measures. Null content is ``invalid_json``. Repeated keys make a document malformed. Rows keep their other columns, whatever their names.
    """
    limits = limits or Limits()
    raw = F.col(content).cast("binary")
    size, text = F.octet_length(content), F.col(content).cast("string")
    early = F.when(size > limits.bytes, "byte_limit").when(~F.is_valid_utf8(text), "invalid_utf8").when(F.try_parse_json(F.coalesce(text, F.lit(""))).isNull(), "invalid_json")
    rows = documents.select(F.struct(*documents.columns).alias("_row"), early.alias("_early"), raw.alias("_raw")).withColumn("_raw", F.when(F.col("_early").isNull(), F.col("_raw")))
    schema = rows.drop("_raw").schema.add("_found", StructType([StructField(c, LongType()) for c in ("depth", "nodes", "longest")]))
    told = rows.mapInArrow(_measured, schema)
    error = F.coalesce("_early", F.when(F.col("_found.nodes") > limits.nodes, "node_limit").when(F.col("_found.depth") > limits.depth, "depth_limit").when(F.col("_found.longest") > limits.string, "string_limit"))
    return told.select("_row.*", "_found.depth", "_found.nodes", "_found.longest", error.alias("error"))
