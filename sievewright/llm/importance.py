"""Importance resampling towards a target distribution: hashed n-gram buckets, overlapping chunks of long texts, Gumbel scores."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievewright.llm.scratch import discard, materialize
from sievewright.llm.texts import raw_bytes, segment_sums, slices, word_spans

#: Buckets of the features, and the longest run of words that is one.
BUCKETS, GRAM = 10_000, 3
#: Texts of more bytes are cut into chunks of about so many, which Spark deals out.
CHUNK_BYTES = 32_768
#: Words that a document needs to be drawn, and the share of those documents that are drawn, in percent.
LEAST_WORDS, PERCENT = 20, 5
#: Bits of the score that each level of the threshold's histogram leaves open.
LEVELS = (48, 32, 16, 0)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAKS = np.zeros(256, bool)
_BREAKS[:0x80] = True
_BREAKS[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = False


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _byte_table()
#: Words up to so many bytes go through tables of their own length.
_SHORT = 64


def _through(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map of 32-bit values, given as four tables by byte."""
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


def _shift_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """What appending 0 to 63 zero bytes does to a CRC, and appending 64, 128, 256, ... of them."""
    one = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    tables = []
    for _ in range(_SHORT):
        tables.append(one)
        one = _CRC[one & 255] ^ (one >> 8)
    doubled = [one]
    for _ in range(25):
        doubled.append(_through(doubled[-1], doubled[-1]))
    return np.stack(tables).reshape(-1), doubled


_SHIFT, _DOUBLED = _shift_tables()


def shifted(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs as after ``lengths`` more zero bytes: ``crc32(a + b) = shifted(crc32(a), len(b)) ^ crc32(b)``."""
    at = (lengths & (_SHORT - 1)) * 1024
    out = _SHIFT[at + (crc & 255)] ^ _SHIFT[at + 256 + ((crc >> 8) & 255)] ^ _SHIFT[at + 512 + ((crc >> 16) & 255)] ^ _SHIFT[at + 768 + (crc >> 24)]
    far = np.flatnonzero(lengths >= _SHORT)
    for k in range(int(lengths[far].max() // _SHORT).bit_length() if len(far) else 0):
        own = far[(lengths[far] // _SHORT >> k) & 1 == 1]
        out[own] = _through(_DOUBLED[k], out[own])
    return out


def word_crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of every word of ``data``, one byte of all words at a time; long words go through zlib."""
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    live, k = np.flatnonzero(lengths <= _SHORT), 0
    while len(live):
        old = crc[live]
        crc[live] = _CRC[(old ^ data[starts[live] + k]) & 255] ^ (old >> 8)
        k += 1
        live = live[lengths[live] > k]
    crc ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(lengths > _SHORT).tolist():
        crc[i] = zlib.crc32(data[starts[i] : starts[i] + lengths[i]].tobytes())
    return crc


def feature_buckets(column: pa.Array, owned: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: buckets of its features (-1 where a run would leave the text), one row a word; words; offsets of the words.

    ``owned`` says how many words of each text may start a feature; the rest only end some (-1: all may start).
    """
    data, offsets = raw_bytes(column)
    data = _LOWER[data]
    starts, ends, first = word_spans(data, offsets, _BREAKS)
    lengths = ends - starts
    words = np.diff(first)
    alone = word_crcs(data, starts, lengths)
    spaced = shifted(np.full(len(alone), zlib.crc32(b" "), np.uint32), lengths) ^ alone  # of a blank and the word
    left = np.repeat(first[1:], words) - np.arange(len(starts))  # words from here to the text's end
    out = np.full((len(starts), GRAM), -1, np.int32)
    run = alone
    for k in range(GRAM):
        if k:
            run = shifted(run[:-1], lengths[k:] + 1) ^ spaced[k:]
        has = left[: len(run)] > k
        out[: len(run), k][has] = (run[has] % BUCKETS).astype(np.int32)
    if owned is not None:
        may = np.where(owned < 0, words, owned)
        out[np.repeat(words, words) - left >= np.repeat(may, words)] = -1
        words = may
    return out, words, first


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Long texts in chunks that begin at words: each owns the words it starts with and carries the next two."""
    for batch in slices(batches, "text"):
        data, offsets = raw_bytes(batch.column("text"))
        starts, ends, first = word_spans(_LOWER[data], offsets, _BREAKS)
        for i in range(batch.num_rows):
            a, b = int(first[i]), int(first[i + 1])
            step = (starts[a:b] - offsets[i]) // CHUNK_BYTES
            cuts = [a, *(a + np.flatnonzero(step[1:] != step[:-1]) + 1).tolist(), b]
            for c, d in zip(cuts[:-1], cuts[1:]):
                until = min(d + GRAM - 1, b)
                text = data[starts[c] : ends[until - 1]].tobytes().decode() if until > c else ""
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(i, 1), batch.column("doc_id").slice(i, 1), pa.array([d - c]), pa.array([text])], ["row", "doc_id", "owned", "text"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = np.zeros(BUCKETS + 1, np.int64)
    for batch in slices(batches, "text"):
        found, _, _ = feature_buckets(batch.column("text"), batch.column("owned").to_numpy())
        held += np.bincount(found.ravel() + 1, minlength=BUCKETS + 1)
    some = np.flatnonzero(held[1:])
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[1:][some])], ["bucket", "n"])


def _weighed(gains: np.ndarray):
    by_bucket = np.r_[gains, 0]  # the last for -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found, words, first = feature_buckets(batch.column("text"), batch.column("owned").to_numpy())
            sums = [segment_sums(x, first) for x in ((found >= 0).sum(1), by_bucket[found].sum(1))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *map(pa.array, (words.astype(np.int64), *sums))], ["row", "doc_id", "n_words", "n_features", "weight"])

    return run


def _histogram(rows: DataFrame, name: str) -> DataFrame:
    return rows.select("owned", "text").mapInArrow(_counted, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias(name))


def chunks(docs: DataFrame) -> list[DataFrame]:
    """``docs(doc_id, text)`` -> rows ``row, doc_id, owned, text`` in two parts: texts that stay whole and where they are (``row`` null,
    ``owned`` -1), and the chunks of long ones, dealt out evenly and written; ``row`` tells the document of a chunk."""
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    rows = docs.select(F.lit(None).cast("long").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.lit(-1).cast("long").alias("owned"), "text")
    far = docs.where(size > CHUNK_BYTES).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    cut = far.mapInArrow(_cut, "row bigint, doc_id bigint, owned bigint, text string")
    return [rows.where(size <= CHUNK_BYTES), materialize(cut.repartition(F.col("row"), F.xxhash64("text")))]


def gains(source: list[DataFrame], target: list[DataFrame]) -> np.ndarray:
    """The gain of each bucket, from the features of both sides."""
    spark = source[0].sparkSession
    own, wanted = (_histogram(parts[0].unionByName(parts[1]), name) for parts, name in ((source, "s"), (target, "t")))
    both = spark.range(BUCKETS).withColumnRenamed("id", "bucket").join(own, "bucket", "left").join(wanted, "bucket", "left").fillna(0)
    both = materialize(both)
    all_s, all_t = both.agg(F.sum("s"), F.sum("t")).first()
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = (t + 1) * (float(all_s) + BUCKETS) / ((s + 1) * (float(all_t) + BUCKETS))
    rows = both.select("bucket", F.floor(F.log(ratio) * 1000).cast("long").alias("gain")).toPandas()  # BUCKETS rows
    out = np.zeros(BUCKETS, np.int64)
    out[rows["bucket"].to_numpy()] = rows["gain"].to_numpy()
    return out


def gumbel(seed: int = 42) -> Column:
    """A document's own Gumbel noise in thousandths, from a hash of its ``doc_id``."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-F.log(-F.log((h + 0.5) / 4294967296.0)) * 1000).cast("long")


def threshold(scores: DataFrame, wanted: int) -> int | None:
    """The ``wanted``-th highest ``score``: histograms of ever finer buckets, each within the bucket that holds it.

    A level has 65,536 buckets at most, so its histogram is small whatever the number of rows.
    """
    inside, above, before = scores.select("score"), 0, None
    for bits in LEVELS:
        bucket = F.shiftright("score", bits)
        level = inside if before is None else inside.where(F.shiftright("score", before[0]) == before[1])
        for row in level.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).orderBy(F.desc("b")).collect():
            if above + row.n >= wanted:
                before = (bits, row.b)
                break
            above += row.n
        else:
            return None
    return before[1]


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, 3, ... in that order: ranges of the order are numbered apart and start where the one before ends."""
    sorted_rows = materialize(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = sorted_rows.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = counts.select(F.col("_range").alias("_of"), (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_start"))  # a row for each shuffle partition
    own = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return sorted_rows.withColumn("_own", own).join(F.broadcast(starts), F.col("_range") == F.col("_of")).withColumn("rank", (F.col("_start") + F.col("_own")).cast("long")).drop("_range", "_own", "_of", "_start")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs(doc_id, text, ...)`` and ``target(text, ...)`` -> ``doc_id, n_features, weight, score, rank``, one row per document.

    Words are runs of ASCII letters and digits and of anything beyond ASCII, lower-cased in A-Z; features are runs of
    one to three words. A feature's bucket gains by the ratio of its shares in target and documents; a document's weight sums the
    gains of its features, and its score adds Gumbel noise from a hash of ``doc_id``, so that the highest scores are a draw without
    replacement in proportion to the weights. Of the documents with enough words, ``percent`` in a hundred are drawn.

    Long texts are cut at word boundaries into chunks that own the features starting in them and carry two more words;
    counts and weights of chunks are sums, so Spark adds them by bucket and by document. The highest scores are found by histograms of the score.

    Defined cases: null and empty texts have no features (weight 0) and are not drawn; a word longer than a chunk stays whole; repeated rows count and are drawn each, ties go to the smaller
    ``doc_id``, then to more features and the higher weight; a null ``doc_id`` hashes as the empty string and comes last in ties; with an empty target or
    no documents the formula holds as it is; extra columns, whatever their names, are ignored.
    """
    docs, target = docs.select("doc_id", "text"), target.select(F.lit(None).cast("long").alias("doc_id"), "text")
    parts, wanted = chunks(docs), chunks(target)
    weigh = _weighed(gains(parts, wanted))
    schema = "row bigint, doc_id bigint, n_words bigint, n_features bigint, weight bigint"
    near, far = (x.mapInArrow(weigh, schema) for x in parts)
    far = far.groupBy("row", "doc_id").agg(*[F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")])
    scored = materialize(near.unionByName(far).drop("row").withColumn("score", F.col("weight") + gumbel()))
    for part in (parts[1], wanted[1]):
        discard(part)

    able = scored.where(F.col("n_words") >= least_words)
    draws = percent * able.count() // 100
    least = threshold(able, draws) if draws else None
    out = ["doc_id", "n_features", "weight", "score"]
    if least is None:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    candidate = (F.col("n_words") >= least_words) & (F.col("score") >= least)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("n_features"), F.desc("weight")]
    top = ranked(scored.where(candidate), order).withColumn("rank", F.when(F.col("rank") <= draws, F.col("rank")))
    return scored.where(~candidate).select(*out, F.lit(None).cast("long").alias("rank")).unionByName(top.select(*out, "rank"))


ORACLE = r"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n::BIGINT)) AS t),
texts AS (SELECT 'd' AS side, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 'b', -row_number() OVER (), NULL, text FROM benchmark),
worded AS (SELECT side, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
grams AS (
  SELECT side, r, unnest(flatten([[array_to_string(w[i:i + n - 1], ' ') for i in range(1, len(w) - n + 2)] for n in range(1, 4)])) AS g FROM worded),
counted AS (SELECT g, side, r, count(*) AS n FROM grams GROUP BY ALL),
hexed AS (SELECT DISTINCT g, hex(encode(g)) AS h FROM counted),
bucketed AS (
  SELECT g, xor(list_reduce(list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295::BIGINT), 4294967295) % 10000 AS b
  FROM hexed, crc),
sums AS (SELECT b, coalesce(sum(n) FILTER (WHERE side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE side = 'b'), 0)::DOUBLE AS t FROM counted JOIN bucketed USING (g) GROUP BY b),
gains AS (SELECT b, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM sums) + 10000) / ((s + 1) * ((SELECT sum(t) FROM sums) + 10000))))::BIGINT AS gain FROM sums),
weights AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM counted JOIN bucketed USING (g) JOIN gains USING (b) WHERE side = 'd' GROUP BY r),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM worded LEFT JOIN weights USING (r) WHERE side = 'd'),
turns AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features DESC, weight DESC) AS turn, count(*) FILTER (WHERE n_words >= 20) OVER () AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND turn <= 5 * able // 100 THEN turn END::BIGINT AS rank FROM turns
"""
