"""Quality by ordinal cumulative-link regression on graded ratings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm.linear import Rows, fit_cumulative, sigmoid
from sievewright.llm.scratch import labelled_sample
from sievewright.llm.texts import U, mix, raw_bytes, slices, word_hashes, word_spans

#: Bits of the hashes of shape 3-grams and of words; how much a word counts beside the shape.
DIMS_BITS, WORD_BITS, WORD_SHARE = 14, 17, 0.5
DIMS = (1 << DIMS_BITS) + (1 << WORD_BITS)
#: Bounds of the sample of rated rows that the model is fitted on.
SAMPLE_ROWS, SAMPLE_BYTES = 6_000, 24 << 20
#: A document is accepted while the probability of the highest grades is at least this.
LEAST_TAIL = 0.5

# the shape of a byte: letters, digits and blanks become one symbol each, marks stay themselves
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[128:] = ord("a")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_SHAPE[[9, 11, 12, 13]] = ord(" ")
_RUNS = np.zeros(256, bool)
_RUNS[[ord("a"), ord("0"), ord(" ")]] = True


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of each text, by row: words (case folded) and 3-grams of its shape, each the square root of its share.

    In the shape a run of letters is one to four symbols by its length, so that word lengths show; other runs are one.
    """
    data, offsets = raw_bytes(column)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    shape = _SHAPE[data]
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not len(shape):
        return nothing
    begin = np.flatnonzero((shape != np.r_[0, shape[:-1]]) | ~_RUNS[shape] | (doc != np.r_[-1, doc[:-1]]))
    length = np.diff(np.r_[begin, len(shape)])
    symbol = shape[begin].astype(np.uint64) * U(8) + np.where(shape[begin] == ord("a"), np.digitize(length, [2, 4, 8, 14]), 0).astype(np.uint64)
    doc = doc[begin]
    if len(symbol) < 3:
        return nothing
    gram = (mix((symbol[:-2] * U(2048) + symbol[1:-1]) * U(2048) + symbol[2:]) >> U(64 - DIMS_BITS)).astype(np.int64)
    whole = doc[:-2] == doc[2:]
    starts, ends, first = word_spans(data, offsets)
    # texts of fewer than three symbols have no features
    shaped = np.bincount(doc[:-2][whole], minlength=len(offsets) - 1) > 0
    of_word = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    word = (word_hashes(data, starts, ends) >> U(64 - WORD_BITS)).astype(np.int64)[shaped[of_word]] + (1 << DIMS_BITS)
    key = np.concatenate([(doc[:-2][whole] << 20) | gram[whole], (of_word[shaped[of_word]] << 20) | word])
    uniq, count = np.unique(key, return_counts=True)
    row, index = uniq >> 20, uniq & ((1 << 20) - 1)
    part = 2 * row + (index >= 1 << DIMS_BITS)
    return row, index, np.sqrt(count / np.bincount(part, count)[part]) * np.where(part % 2, WORD_SHARE, 1.0)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        row, index, value = features(batch.column("text"))
        cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
        xs = [index[a:b].astype(np.uint32).tobytes() for a, b in zip(cut[:-1], cut[1:])]
        vs = [value[a:b].astype(np.float32).tobytes() for a, b in zip(cut[:-1], cut[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array(xs, pa.binary()), pa.array(vs, pa.binary())], ["grade", "x", "v"])


def fit(docs: DataFrame, ratings: DataFrame, rows: int = SAMPLE_ROWS, text_bytes: int = SAMPLE_BYTES) -> dict:
    """``docs(doc_id, text)``, ``ratings(doc_id, grade)`` -> model: weights shared by all grades, ordered thresholds, the grades.

    Defined cases: rows without text or grade are left out; an id that is rated twice counts twice; fewer than two grades give a
    model without weights; extra columns, whatever their names, are ignored.
    """
    sample = labelled_sample(docs.select("doc_id", "text").where("text is not null"), ratings.select("doc_id", "grade").where("grade is not null"), rows, text_bytes)
    got = sample.select("text", F.col("grade").cast("int").alias("grade")).mapInArrow(_extract, "grade int, x binary, v binary").toPandas()
    grades = sorted(got["grade"].unique().tolist())
    if len(grades) < 2:
        return {"w": np.zeros(DIMS), "theta": np.full(max(0, len(grades) - 1), 0.0), "grades": grades or [0]}
    x = Rows([np.frombuffer(b, np.uint32) for b in got["x"]], [np.frombuffer(b, np.float32) for b in got["v"]])
    w, theta = fit_cumulative(x, np.searchsorted(grades, got["grade"].to_numpy()), len(grades), DIMS)
    return {"w": w, "theta": theta, "grades": grades}


def score(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of ``docs`` with ``expected_grade``, ``tail_probability`` and ``accepted``.

    Defined cases: null, empty and very short texts get the lowest grade, tail 0 and are not accepted; a model of one grade gives
    all others that grade and tail 1; equal texts get equal scores; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema.add("expected_grade", "double").add("tail_probability", "double").add("accepted", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, theta, grades = (shared.value[k] for k in ("w", "theta", "grades"))
        for batch in slices(batches, "text"):
            row, index, value = features(batch.column("text"))
            f = np.bincount(row, w[index] * value, batch.num_rows)
            above = sigmoid(f[:, None] - theta[None, :])  # P(y > k)
            expected = grades[0] + (above * np.diff(grades)[None, :]).sum(1) if len(theta) else np.full(len(f), float(grades[0]))
            # the upper half of the grades
            tail = above[:, (len(theta) - 1) // 2] if len(theta) else np.ones(len(f))
            blank = np.bincount(row, minlength=batch.num_rows) == 0
            tail, expected = np.where(blank, 0.0, tail), np.where(blank, float(grades[0]), expected)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(expected), pa.array(tail), pa.array(tail >= LEAST_TAIL)], [*keep, "expected_grade", "tail_probability", "accepted"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Fit on the rated documents (``labels(doc_id, quality)``), score all: expected grade, tail probability, accepted.

    A document's features are its hashed words and hashed 3-grams of its shape; the model is a proportional-odds regression, fitted
    on at most about ``SAMPLE_ROWS`` rated rows. ``tail_probability`` is the chance of a grade in the upper half.

    Defined cases: null, empty and very short texts (under three symbols) get the lowest grade and are not
    accepted; unrated tables accept every other text; repeated rows are scored each; extra columns pass if asked for.
    """
    return score(docs, fit(docs, labels.select("doc_id", F.col("quality").alias("grade"))), keep)
