"""Content encodings under a ceiling: a body that would grow beyond it is given up, whatever it claims."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

#: Bytes that a decoded body may have; a step of decoding.
MOST, STEP = 40 << 20, 1 << 20
_WINDOWS = {"gzip": 31, "deflate": 15}


def inflate(body: bytes, encoding: str | None, most: int = MOST) -> tuple[bytes | None, str | None]:
    """A body decoded, or why not: ``unsupported_content_encoding``, or ``decoded_limit_exceeded`` for what is too long, cut off or broken.

    Decoding goes on by steps of a megabyte and stops at the ceiling, so a bomb costs no more than that. Members of gzip bodies follow each other.
    """
    encoding = (encoding or "identity").strip().lower()
    if encoding in ("identity", ""):
        return (body, None) if len(body) <= most else (None, "decoded_limit_exceeded")
    if encoding not in _WINDOWS:
        return None, "unsupported_content_encoding"
    parts, size, rest = [], 0, body
    try:
        while True:
            engine = zlib.decompressobj(_WINDOWS[encoding])
            while not engine.eof:
                part = engine.decompress(rest, min(STEP, most - size + 1))
                parts.append(part)
                size += len(part)
                if size > most or (not part and not engine.unconsumed_tail and not engine.eof):
                    return None, "decoded_limit_exceeded"
                rest = engine.unconsumed_tail
            rest = engine.unused_data
            if encoding != "gzip" or not rest.startswith(b"\x1f\x8b"):
                return b"".join(parts), None
    except zlib.error:
        return None, "decoded_limit_exceeded"


def decode_bodies(responses: DataFrame, body: str, encoding: str, most: int = MOST) -> DataFrame:
    """``responses`` with a column of bytes and one of content encodings -> with ``decoded`` and ``decode_error``; null bodies stay null. Brotli is unsupported here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a decoded body may be large: one at a time
                raw = batch.column("_body")[k].as_py()
                out, error = (None, None) if raw is None else inflate(raw, batch.column("_encoding")[k].as_py(), most)
                yield pa.RecordBatch.from_arrays([batch.column("_row").slice(k, 1), pa.array([out], pa.binary()), pa.array([error], pa.string())], ["_row", "decoded", "decode_error"])

    rows = responses.select(F.struct(*responses.columns).alias("_row"), F.col(body).cast("binary").alias("_body"), F.col(encoding).alias("_encoding"))
    schema = rows.select("_row").schema.add("decoded", BinaryType()).add("decode_error", StringType())
    return rows.mapInArrow(run, schema).select("_row.*", "decoded", "decode_error")
