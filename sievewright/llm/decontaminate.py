"""Benchmark decontamination by canonical templates: typed placeholders, hash-joined windows, consistent slots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.llm.scratch import materialize, row_key, small_or_joined
from sievewright.llm.texts import U, mix, raw_bytes, slices, word_hashes, word_spans

WIDTH = 5
#: Least share of an item's windows that a document holds, and least share of slots that are filled alike.
COVERAGE, CONSISTENCY = 0.8, 0.8
#: Least share of the document's fillers that stand for mostly one filler of the item's: a few may coincide.
APART = 0.5
#: Size of the bitmap of the benchmark's windows that tasks get: two mebibytes whatever the benchmark's size.
BITMAP_BITS = 24
#: Items' windows up to so many are broadcast; more are joined, each window dealt by so many salts.
BROADCAST_ROWS, SALTS = 300_000, 16
#: Words for units.
UNITS = (
    "mm cm dm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg t lb lbs oz gram grams kilogram kilograms ton tons tonne tonnes pound pounds ounce ounces ml cl l liter liters litre litres gallon gallons "
    "ms s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "km/h mph m/s hz khz mhz ghz v w kw mw j kj cal kcal pa kpa n c f k usd eur gbp dollar dollars cent cents euro euros percent degrees"
).split()

_INNER = np.zeros(256, bool)
_INNER[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;\"|"]] = True
NUMBER, NAME, UNIT = U(0x1111111111111111), U(0x2222222222222222), U(0x3333333333333333)


def _hash_words(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]))
    return word_hashes(data, starts, ends)


_UNIT_HASHES = np.sort(_hash_words(UNITS))


def _trimmed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of words without marks at their edges, and their texts; words of marks alone are left out."""
    starts, ends, first = word_spans(data, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    inner = np.flatnonzero(_INNER[data])
    a = np.searchsorted(inner, starts)
    b = np.searchsorted(inner, ends)
    some = b > a
    return inner[a[some]], inner[b[some] - 1] + 1, doc[some]


def canonical(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template tokens, hashes of all words, which tokens are names, and the first token of each text.

    Words lose marks at their edges and case; what has no letter or digit is no token. A word with a digit
    in front is a number; a capitalised word that begins no sentence is a name (a word that begins beyond ASCII, if it
    holds a capital); unit words after a number are units.
    """
    data, offsets = raw_bytes(column)
    begin, last, doc = _trimmed(data, offsets)
    stops = np.r_[0, np.cumsum(_STOP[data] | (data == 10))]
    # case is folded for all letters; that may change lengths, so words are found anew
    low, low_offsets = raw_bytes(pc.utf8_lower(column.cast(pa.large_string())))
    word = word_hashes(low, *_trimmed(low, low_offsets)[:2])
    before = np.r_[0, last[:-1]]
    opens = np.r_[True, doc[1:] != doc[:-1]] if len(doc) else np.zeros(0, bool)
    opens = opens | (stops[begin] > stops[np.minimum(before, begin)])
    number = _DIGIT[data[begin]]
    capital = _UPPER[data[begin]] | (data[begin] >= 128) & (word_hashes(data, begin, last, lower=False) != word)
    name = capital & ~opens & ~number
    known = _UNIT_HASHES[np.minimum(np.searchsorted(_UNIT_HASHES, word), len(_UNIT_HASHES) - 1)] == word
    unit = known & np.r_[False, number[:-1]][: len(word)] & ~opens
    token = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, word)))
    return token, word, name & ~unit, np.searchsorted(doc, np.arange(len(offsets)))


def windows(token: np.ndarray, word: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, position and text of every window of ``width`` template tokens within a text.

    A window of placeholders alone says nothing of a template and would be met by every table of numbers; it stands for
    the words that fill it.
    """
    n = max(0, len(token) - width + 1)
    plain = np.r_[0, np.cumsum((token != NUMBER) & (token != UNIT) & (token != NAME))]
    bare = plain[width : width + n] == plain[:n]
    h = np.where(bare, U(width + 100), U(width))
    for k in range(width):
        h = mix(h * U(0x9E3779B97F4A7C15) + np.where(bare, word[k : k + n], token[k : k + n]))
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(doc[:n] == doc[width - 1 : width - 1 + n]) if n else np.zeros(0, np.int64)
    return h[at], at, doc[at]


def _slots(token: np.ndarray, word: np.ndarray, at: np.ndarray, width: int) -> list[list[int]]:
    """The words that fill a window's placeholders."""
    fill = np.where((token == NUMBER) | (token == UNIT) | (token == NAME), word, U(0)).view(np.int64)
    return [[x for x in fill[i : i + width].tolist() if x] for i in at.tolist()]


def readings(token: np.ndarray, word: np.ndarray, name: np.ndarray, first: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """A document's windows with names as placeholders, and those with names once more with them as words.

    A passage that is put into the midst of a sentence begins with a capital that is no name.
    """
    h, at, doc = windows(token, word, first, width)
    yield token, h, at, doc
    named = np.r_[0, np.cumsum(name)]
    plain = np.where(name, word, token)
    h, at, doc = windows(plain, word, first, width)
    some = named[at + width] > named[at]
    yield plain, h[some], at[some], doc[some]


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items of fewer words than a window are one window of all their words.

    Reading 0 has names as placeholders; items with names have a reading 1 with names as plain words.
    """
    for batch in slices(batches, "text"):
        token, word, name, first = canonical(batch.column("text"))
        size = np.diff(first)
        named = np.diff(np.r_[0, np.cumsum(name)][first]) > 0
        for reading, shown in enumerate((token, np.where(name, word, token))):
            for width in range(1, WIDTH + 1):
                h, at, doc = windows(shown, word, first, width)
                own = size[doc] == width if width < WIDTH else size[doc] >= WIDTH
                if reading:
                    own = own & named[doc]
                h, at, doc = h[own], at[own], doc[own]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("item_id").take(pa.array(doc)), batch.column("item_key").take(pa.array(doc)), pa.array(np.full(len(h), reading, np.int32)), pa.array(h.view(np.int64)), pa.array(np.full(len(h), width, np.int32)), pa.array(at - first[doc]), pa.array(size[doc]), pa.array(_slots(shown, word, at, width), pa.list_(pa.int64()))],
                    ["item_id", "item_key", "reading", "window", "width", "item_at", "item_words", "item_slots"],
                )


def _spots() -> Column:
    """The occurrences that a met window may belong to: by where the item would begin in the document.

    The exact start; starts within a quarter of the item's words, in two rasters, as words put in or left out
    shift it; and the document as a whole.
    """
    start, quarter = F.col("doc_at") - F.col("item_at"), F.greatest(F.lit(1), F.floor(F.col("item_words") / 4))
    spot = lambda kind, at: F.struct(F.lit(kind).alias("kind"), at.cast("long").alias("at"))
    return F.array(spot(0, start), spot(1, F.floor(start / quarter)), spot(2, F.floor(start / quarter + 0.5)), spot(3, F.lit(0)))


def _met(found: DataFrame, items: DataFrame) -> DataFrame:
    """Windows of documents and items that are the same; items are few as a rule, else the join is salted against hot windows."""
    if items.count() <= BROADCAST_ROWS:
        return found.join(F.broadcast(items), "window")
    salted = found.withColumn("salt", F.pmod(F.col("row_key"), F.lit(SALTS)).cast("int"))
    return salted.join(items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["window", "salt"]).drop("salt")


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``docs(doc_id, text)``, ``benchmark(item_id, text)`` -> a row per leak: ``doc_id, item_id, coverage, consistency, windows, row_key``.

    Numbers, names and units become typed placeholders; both sides' windows of five template tokens meet in a
    hash join, so that a re-parameterised question still matches. A document leaks an item if it holds at least
    ``coverage`` of the item's distinct windows, and if each filler of the item's slots stands for mostly one
    filler of the document's: the share of slots so explained is ``consistency``, at least 0.8. The other way round half of the slots are enough, as fillers
    may coincide; but a text with one number in all places is no copy of an item with many. All are judged
    for each occurrence of the item in the document (windows that begin it at one place, or near it) and for the
    document as a whole; one that passes is enough, and the best that passes is reported. As a name is told by its
    capital, an item is also read with its names as plain words, case folded, and the better reading counts.

    A bitmap of fixed size drops windows that no item has before they leave a task; what it lets pass wrongly
    fails the join. Counts are by (document, item), so no document's or window's rows meet in one task.

    Defined cases: null texts and texts without words have no windows; each text is a document of its own, so rows without
    ``doc_id``, and rows of one ``doc_id`` with different texts, are judged one by one (``row_key`` tells them apart); repeated
    rows of a document count once; a null ``item_id`` is reported as null, and items without one that differ in text are
    different items; items with equal texts are each reported; ties go to the larger consistency, then to more windows; an empty
    benchmark gives no rows; extra columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    told = benchmark.select("item_id", "text", F.xxhash64(F.coalesce(F.col("item_id").cast("string"), F.lit("none")), F.coalesce("text", F.lit(""))).alias("item_key"))
    items = materialize(told.mapInArrow(_item_windows, "item_id bigint, item_key bigint, reading int, window bigint, width int, item_at bigint, item_words bigint, item_slots array<bigint>").distinct())
    sizes = small_or_joined(materialize(items.groupBy("item_key", "reading").agg(F.count_distinct("window").alias("item_windows"))))
    bits = items.select(F.shiftrightunsigned("window", 64 - BITMAP_BITS).cast("int").alias("b")).distinct().toPandas()["b"].to_numpy()
    bitmap = np.zeros(1 << BITMAP_BITS, bool)
    bitmap[bits] = True
    widths = sorted(r[0] for r in items.select("width").distinct().collect())
    least = sizes.agg(F.min("item_windows")).first()[0] or 1
    shared = spark.sparkContext.broadcast((np.packbits(bitmap), widths, int(np.ceil(coverage * least - 1e-9))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, widths, fewest = shared.value
        known = np.unpackbits(packed).view(bool)
        for batch in slices(batches, "text"):
            token, word, name, first = canonical(batch.column("text"))
            for width in widths:
                hits = []
                for shown, h, at, doc in readings(token, word, name, first, width):
                    hit = known[(h >> U(64 - BITMAP_BITS)).astype(np.int64)]
                    hits.append((shown, h[hit], at[hit], doc[hit]))
                # fewer windows than the shortest item needs cannot be a leak
                few = fewest if widths == [WIDTH] else 0
                enough = np.bincount(np.concatenate([x[3] for x in hits]), minlength=batch.num_rows) >= few
                for shown, h, at, doc in hits:
                    h, at, doc = h[enough[doc]], at[enough[doc]], doc[enough[doc]]
                    if len(h):
                        rows = pa.array(doc)
                        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("row_key").take(rows), pa.array(h.view(np.int64)), pa.array(at - first[doc]), pa.array(_slots(shown, word, at, width), pa.list_(pa.int64()))], ["doc_id", "row_key", "window", "doc_at", "doc_slots"])

    found = docs.select("doc_id", "text", row_key().alias("row_key")).mapInArrow(run, "doc_id bigint, row_key bigint, window bigint, doc_at bigint, doc_slots array<bigint>").distinct()
    met = materialize(_met(found, items.drop("width")))
    pair = ["row_key", "item_key", "reading"]
    held = met.groupBy(*pair).agg(F.count_distinct("window").alias("windows")).join(sizes, ["item_key", "reading"]).where(F.col("windows") / F.col("item_windows") >= coverage - 1e-9)
    close = met.join(held.drop("windows"), pair)
    spotted = materialize(close.select("doc_id", "item_id", *pair, "item_windows", "window", "item_slots", "doc_slots", F.explode(_spots()).alias("spot")).distinct())
    key = [*pair, "spot"]
    whole = spotted.groupBy(*key, "doc_id", "item_id", "item_windows").agg(F.count_distinct("window").alias("windows")).withColumn("coverage", F.col("windows") / F.col("item_windows")).where(F.col("coverage") >= coverage - 1e-9)
    pairs = spotted.where(F.size("item_slots") > 0).select(*key, F.explode(F.arrays_zip("item_slots", "doc_slots")).alias("s"))
    fillers = pairs.groupBy(*key, F.col("s.item_slots").alias("own"), F.col("s.doc_slots").alias("other")).agg(F.count("*").alias("n"))
    fillers = fillers.withColumn("both", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("own").alias("filler")), F.struct(F.lit(1).alias("side"), F.col("other").alias("filler")))))
    best = fillers.groupBy(*key, "both").agg(F.max("n").alias("most"), F.sum("n").alias("all"))
    explained = lambda side: F.sum(F.when(F.col("both.side") == side, F.col("most"))) / F.sum(F.when(F.col("both.side") == side, F.col("all")))
    slots = best.groupBy(*key).agg(explained(0).alias("share"), explained(1).alias("back"))
    judged = whole.join(slots, key, "left").withColumn("consistency", F.coalesce("share", F.lit(1.0)))
    judged = judged.where((F.col("consistency") >= CONSISTENCY) & (F.coalesce("back", F.lit(1.0)) >= APART))
    return judged.groupBy("doc_id", "item_id", "row_key", "item_key").agg(F.max(F.struct("coverage", "consistency", "windows")).alias("x")).select("doc_id", "item_id", "x.*", "row_key")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the texts that leak a benchmark item; each row is judged by its own text, whatever its ``doc_id``."""
    bad = small_or_joined(materialize(leaks(docs, benchmark).select(F.col("row_key").alias("_leaking_row")).distinct()))
    return docs.join(bad, row_key() == F.col("_leaking_row"), "left_anti")
