"""WARC archives, compressed record by record with a Zstandard dictionary that each archive carries."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm.scratch import materialize, small_or_joined

#: Magic number of the skippable frame that holds an archive's dictionary, and of a Zstandard frame.
DICTIONARY_MAGIC, FRAME_MAGIC = b"\x5d\x2a\x4d\x18", b"\x28\xb5\x2f\xfd"
#: Payload bytes that an archive holds before the next one begins; bytes of records that train its dictionary; the dictionary's size.
ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES = 8 << 20, 1 << 20, 32 << 10
#: Bytes of an archive that are decompressed at once.
PIECE = 16 << 10
#: Equal payloads of at least so many bytes are stored once.
REVISIT_BYTES = 1000
RECORDS = "page_id bigint, url string, record_type string, refers_to bigint, payload binary, payload_bytes bigint, payload_digest string"


def _header_value(text: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", text)


def _header_text(value: str) -> str:
    return re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), value)


def build_record(page_id: int | None, url: str | None, kind: str, refers_to: int | None, payload: bytes, size: int, digest: str) -> bytes:
    """One WARC/1.1 record: a response with its HTTP block, or a revisit that names the response.

    A record's id holds page and digest, so pages that share a number but no content have records of their own. The HTTP
    head tells the payload's length, in a revisit too.
    """
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}:{digest}>"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header_value(url)}")
    head += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}:{digest}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is not what its header says")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    number = lambda x: int(m[1]) if (m := re.search(r"urn:page:(-?\d+):", x or "")) else None
    kind = fields["WARC-Type"]
    url = fields.get("WARC-Target-URI")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (digest != hashlib.sha1(payload).hexdigest() or size != len(payload)):
        raise ValueError("a payload differs from its digest")
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "url": None if url is None else _header_text(url),
        "record_type": kind,
        "refers_to": number(fields.get("WARC-Refers-To")),
        "payload": payload if kind == "response" else None,
        "payload_bytes": size,
        "payload_digest": digest,
    }


def train(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary from an even choice of an archive's records, up to ``SAMPLE_BYTES``; raw content if there is too little to train on."""
    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    sample = [r[: 16 << 10] for r in records[::step]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample, level=3)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(sample)[-DICTIONARY_BYTES:] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def pack(records: list[bytes], level: int = 3) -> bytes:
    """A ``.warc.zst`` archive: the dictionary in a skippable frame, then one frame per record."""
    dictionary = train(records)
    compressor = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_content_size=True, write_checksum=True)
    head = dictionary.as_bytes()
    return b"".join([DICTIONARY_MAGIC, struct.pack("<I", len(head)), head, *map(compressor.compress, records)])


def unpack(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, one by one."""
    if archive[:4] != DICTIONARY_MAGIC:
        raise ValueError("an archive begins with its dictionary")
    (size,) = struct.unpack("<I", archive[4:8])
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(archive[8 : 8 + size]))
    at, view = 8 + size, memoryview(archive)
    while at < len(view):
        one, parts = decompressor.decompressobj(), []
        # fed in pieces, so that what follows the record is not copied with it
        while not one.eof:
            piece = view[at : at + PIECE]
            if not len(piece):
                raise ValueError("an archive ends within a record")
            parts.append(one.decompress(piece))
            at += len(piece)
        at -= len(one.unused_data)
        yield b"".join(parts)


def assign_types(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` with ``payload``, ``payload_digest``, ``record_type`` and ``refers_to``.

    Of equal payloads (length and digest) of at least 1000 bytes the largest ``page_id`` is the response.
    Only groups of several rows are joined, by broadcast while they are few, so that pages do not move.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    slim = pages.select("page_id", "url", payload.alias("payload")).withColumns({"payload_digest": F.sha1("payload"), "n": F.octet_length("payload")})
    groups = slim.where(F.col("n") >= REVISIT_BYTES).groupBy("payload_digest", "n").agg(F.max("page_id").alias("keeper"), F.count("*").alias("rows"))
    groups = small_or_joined(materialize(groups.where("rows > 1").drop("rows")))
    again = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    out = slim.join(groups, ["payload_digest", "n"], "left")
    return out.select("page_id", "url", "payload", "payload_digest", "n", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("keeper")).alias("refers_to"))


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, count, held, size = TaskContext.get().partitionId(), 0, [], 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f"part-{part:05d}-{count:05d}.warc.zst"]), pa.array([len(held)]), pa.array([pack(held)], pa.binary())], ["archive", "records", "content"])

    for batch in batches:
        for r in batch.to_pylist():
            held.append(build_record(r["page_id"], r["url"], r["record_type"], r["refers_to"], r["payload"] if r["record_type"] == "response" else b"", r["n"], r["payload_digest"]))
            size += len(held[-1])
            if size >= ARCHIVE_BYTES:
                yield row()
                count, held, size = count + 1, [], 0
    if held:
        yield row()


def write_archives(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html, ...)`` -> ``archive, records, content``: complete ``.warc.zst`` files, a row each.

    A task closes an archive at 8 MiB of records, so that a row stays small whatever the table's size; write
    the rows as Parquet, or each ``content`` as a file, which standard WARC tools read.

    Defined cases: null html is an empty payload; a null ``page_id`` or ``url`` comes back as null; rows of one
    ``page_id`` with different payloads are records of their own; rows repeated in full are the same record, stored as
    often, all responses if theirs is the largest id; a payload must fit a Spark value (2 GiB); extra columns are
    ignored; no rows, no archives.
    """
    return assign_types(pages).mapInArrow(_write, "archive string, records bigint, content binary")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
    for batch in batches:
        for content in batch.column("content"):
            rows, size = [], 0
            for raw in unpack(content.as_py()):
                rows.append(parse_record(raw))
                size += len(raw)
                if size >= 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def read_archives(archives: DataFrame) -> DataFrame:
    """Every record of ``archives(content, ...)``; a revisit's payload is null, its digest and length are in its own record."""
    return archives.select("content").mapInArrow(_read, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages as archives to the shared folder, read them back and describe every record."""
    records = read_archives(materialize(write_archives(pages)))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH sized AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages),
keepers AS (SELECT html, max(page_id) AS keeper FROM sized WHERE payload_bytes >= 1000 GROUP BY html HAVING count(*) > 1)
SELECT s.page_id, s.payload_bytes, sha1(s.html) AS payload_digest,
  CASE WHEN k.keeper <> s.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN k.keeper <> s.page_id THEN k.keeper END AS refers_to
FROM sized s LEFT JOIN keepers k ON s.html = k.html
"""
