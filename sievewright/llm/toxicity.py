"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posterior."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm.linear import Rows, fit_logistic, sigmoid
from sievewright.llm.scratch import bounded_sample, crc_part, labelled_sample
from sievewright.llm.texts import U, raw_bytes, slices, word_hashes, word_spans

TERM_BITS = 20
#: Byte lengths of word beginnings that are terms besides whole words.
STEMS = (4, 5, 6)
#: Bounds of the samples of labelled rows (they propose voters) and of rows whose labels are not read (they fit the label model and the
#: classifier), and most lexicon voters.
SAMPLE_ROWS, SAMPLE_BYTES, VOTERS = 12_000, 40 << 20, 160
#: Pseudo-counts by which a voter's dependence on another is drawn to its own rates.
DRAWN = 20.0
#: Words that insult in English, voters from the start.
SEEDS = ("idiot", "idiots", "stupid", "moron", "loser", "losers", "trash", "scum", "worthless", "pathetic", "disgusting", "clown", "dumb", "fool", "ugly", "hate", "garbage", "filth", "vermin", "imbecile")

_BREAKS = np.ones(256, bool)
_BREAKS[ord("a") : ord("z") + 1] = False
_BREAKS[ord("A") : ord("Z") + 1] = False
_BREAKS[128:] = False
_SALT = np.random.default_rng(77).integers(1, 1 << 63, len(STEMS) + 1, dtype=np.uint64)


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of the terms of each text (words of letters and their beginnings), words per text, and shouted words per text."""
    data, offsets = raw_bytes(column)
    starts, ends, first = word_spans(data, offsets, _BREAKS)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    rows, keys = [doc], [word_hashes(data, starts, ends) ^ _SALT[0]]
    for salt, stem in zip(_SALT[1:], STEMS):
        long = ends - starts > stem
        rows.append(doc[long])
        keys.append(word_hashes(data, starts[long], starts[long] + stem) ^ salt)
    upper = np.r_[0, np.cumsum((data >= 65) & (data <= 90))]
    shouted = (upper[ends] - upper[starts] == ends - starts) & (ends - starts > 2) if len(starts) else np.zeros(0, bool)
    key = ((np.concatenate(keys) * U(0x9E3779B97F4A7C15)) >> U(64 - TERM_BITS)).astype(np.int64)
    return np.concatenate(rows), key, np.diff(first), np.bincount(doc[shouted], minlength=len(offsets) - 1)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        row, key, words, shouted = terms(batch.column("text"))
        uniq, count = np.unique((row << TERM_BITS) | key, return_counts=True)
        cut = np.searchsorted(uniq >> TERM_BITS, np.arange(batch.num_rows + 1))
        index = (uniq & ((1 << TERM_BITS) - 1)).astype(np.uint32)
        xs = [index[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
        ns = [np.minimum(count[a:b], 255).astype(np.uint8).tobytes() for a, b in zip(cut[:-1], cut[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(xs, pa.binary()), pa.array(ns, pa.binary()), pa.array(words), pa.array(shouted)], ["label", "x", "n", "words", "shouted"])


def _pairs(shown: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted counts of the votes of every two voters, ``(m, 3, m, 3)``; ``shown`` has a column for each voter and vote."""
    m = shown.shape[1] // 3
    return (shown.T @ (shown * weight[:, None].astype(np.float32))).astype(np.float64).reshape(m, 3, m, 3)


def _tree(joint: list[np.ndarray]) -> list[tuple[int, int]]:
    """Each voter with the one that it depends on (-1: none): the spanning tree of largest mutual information within the labels."""
    m = joint[0].shape[0]
    total = sum(x[0, :, 0, :].sum() for x in joint) if m else 0
    gain = np.zeros((m, m))
    for counts in joint:
        p = (counts + 0.05).transpose(0, 2, 1, 3)
        n = p.sum((2, 3), keepdims=True)
        p = p / n
        gain += (counts.sum((1, 3)) / total) * (p * (np.log(p) - np.log(p.sum(3, keepdims=True)) - np.log(p.sum(2, keepdims=True)))).sum((2, 3))
    order, best, parent = [], np.full(m, -np.inf), np.full(m, -1)
    left = np.ones(m, bool)
    for _ in range(m):
        j = int(np.argmax(np.where(left, best, -np.inf))) if order else 0
        order.append((j, int(parent[j])))
        left[j] = False
        closer = left & (gain[j] > best)
        best[closer], parent[closer] = gain[j][closer], j
    return order


def label_model(votes: np.ndarray, prior: float, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of label 1, each voter's accuracy, and the voter that each depends on, from votes in {-1, 0, 1} and the share of label 1 alone.

    A generative model: given the label, a voter is silent, right or wrong with rates that depend on the label and on one other
    voter, its parent in a tree; rates are estimated by expectation maximisation, the tree anew as the labels become
    clear. So a voter that repeats another, or votes with it beyond what the label explains, adds little beside what is its own.
    """
    n, m = votes.shape
    shown = (votes[:, :, None] == np.array([-1, 0, 1])).reshape(n, 3 * m).astype(np.float32)
    # at the start voters that are all but copies of each other count as one, or they would be taken for the label
    rest = votes - votes.mean(0)
    spread = np.sqrt((rest**2).mean(0)) + 1e-9
    alike = np.abs(rest.T @ rest / n / spread[:, None] / spread[None, :])
    score = votes @ (1 / np.maximum(np.where(alike > 0.9, alike, 0).sum(1), 1))
    post = np.where((score > 0) & (score >= np.quantile(score, 1 - prior)), 0.95, 0.05)
    tree: list[tuple[int, int]] = []
    for turn in range(rounds):
        joint = [_pairs(shown, q) for q in (1 - post, post)]
        if turn in (0, 4, 12):
            tree = _tree(joint)
        logit = np.full(n, np.log(prior / (1 - prior)))
        for j, k in tree:
            table = []
            for counts in joint:
                own = counts[k, :, j, :] if k >= 0 else counts[j, :, j, :].sum(0, keepdims=True)
                # some votes are drawn from the voter's own rates, whatever the parent says
                alone = counts[j, :, j, :].sum(0) + 0.1
                own = own + DRAWN * alone / alone.sum()
                table.append(np.log(own / own.sum(1, keepdims=True)))
            odds = table[1] - table[0]
            logit += odds[votes[:, k] + 1 if k >= 0 else 0, votes[:, j] + 1]
        post = sigmoid(logit)
    own = [np.stack([(shown[:, 3 * np.arange(m) + v] * q[:, None]).sum(0) for v in range(3)]) for q in (1 - post, post)]
    right, wrong = own[1][2] + own[0][0] + 0.1, own[0][2] + own[1][0] + 0.1
    return post, right / (right + wrong), np.array([k for _, k in sorted(tree)])


def _held(got, kind: str, dtype) -> list[np.ndarray]:
    return [np.frombuffer(b, dtype) for b in got[kind]]


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, text_bytes: int = SAMPLE_BYTES) -> dict:
    """``docs(doc_id, text)``, ``labels(doc_id, label)`` -> the classifier: weights of hashed terms and a bias.

    Labels propose the lexicon voters (terms that occur in toxic rows far above their share, beside a list of fixed words and
    pattern voters) and the first guess of the share of toxic rows. What each vote is worth, and how voters depend on each
    other, comes from the label model on rows whose labels are not read; its posterior picks the
    classifier's terms and trains it.

    Equal texts and equal ids with different labels have the label of most of their rows, toxic on a tie.
    """
    rated = labels.where("label is not null").groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    sample = labelled_sample(docs.where("text is not null"), rated, rows, text_bytes).groupBy("text").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    schema = "label int, x binary, n binary, words bigint, shouted bigint"
    got = sample.select("text", "label").mapInArrow(_extract, schema).toPandas()
    dims, y = 1 << TERM_BITS, got["label"].to_numpy().astype(int)
    xs = _held(got, "x", np.uint32)
    index = np.concatenate(xs) if xs else np.zeros(0, np.uint32)
    row = np.repeat(np.arange(len(xs), dtype=np.int32), [len(r) for r in xs])
    pos, every = np.bincount(index[y[row] == 1], minlength=dims), np.bincount(index, minlength=dims)
    n, n1 = max(len(y), 1), int((y == 1).sum())
    # evidence for a term: a z-score of its toxic occurrences against its share
    expected = every * n1 / n
    z = (pos - expected) / np.sqrt(np.maximum(expected * (1 - n1 / n), 1e-9) + 0.25)
    mined = np.flatnonzero((pos >= max(3, 0.01 * n1)) & (pos >= 0.8 * every) & (z >= 5))
    mined = mined[np.argsort(-z[mined], kind="stable")][:VOTERS]
    lexicon = np.union1d(mined, np.unique(terms(pa.array([" ".join(SEEDS)]))[1][: len(SEEDS)]))
    del got, xs, index, row, z

    # from here on no label is read
    pool = bounded_sample(docs.where("text is not null"), rows, text_bytes).select("text", F.lit(0).alias("label")).distinct()
    got = pool.mapInArrow(_extract, schema).toPandas()
    if not len(got):
        return {"w": np.zeros(dims, np.float32), "b": -3.0, "accuracy": np.zeros(0), "parent": np.zeros(0)}
    xs = _held(got, "x", np.uint32)
    votes = _votes(xs, _held(got, "n", np.uint8), got["words"].to_numpy(), got["shouted"].to_numpy(), lexicon)
    post, accuracy, parent = label_model(votes, min(0.5, max(0.01, n1 / n)))
    # the classifier sees terms that tell the posterior's labels
    index = np.concatenate(xs)
    row = np.repeat(np.arange(len(xs), dtype=np.int32), [len(r) for r in xs])
    pos, every, share = np.bincount(index, post[row], dims), np.bincount(index, minlength=dims), post.mean()
    z = (pos - every * share) / np.sqrt(np.maximum(every * share * (1 - share), 1e-9) + 0.25)
    # apart, so that long texts do not add up noise; terms for toxicity are such for the most part of their rows
    useful = (np.abs(z) >= 5) & (every >= max(3, 0.01 * post.sum())) & ((pos >= 0.5 * every) | (z < 0))
    useful[lexicon] = True
    w, b = fit_logistic(Rows([r[useful[r]] for r in xs]), post, dims)
    return {"w": np.where(useful, w, 0).astype(np.float32), "b": b, "accuracy": accuracy, "parent": parent}


def _votes(xs: list[np.ndarray], ns: list[np.ndarray], words: np.ndarray, shouted: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """Votes of the lexicon's terms (1 or silent) and of patterns: several terms, density of terms, none at all, shouting."""
    column = np.full(1 << TERM_BITS, -1)
    column[lexicon] = np.arange(len(lexicon))
    votes = np.zeros((len(xs), len(lexicon) + 4), np.int8)
    distinct, total = np.zeros(len(xs)), np.zeros(len(xs))
    for i, (x, n) in enumerate(zip(xs, ns)):
        own = column[x]
        hit = own >= 0
        votes[i, own[hit]] = 1
        distinct[i], total[i] = hit.sum(), n[hit].sum()
    votes[:, -4] = np.where(distinct >= 2, 1, np.where(distinct == 0, -1, 0))
    votes[:, -3] = np.where(total > 0.02 * words, 1, np.where(total < 0.002 * words, -1, 0))
    votes[:, -2] = np.where(distinct == 0, -1, 0)
    votes[:, -1] = np.where(shouted > 0.3 * words, 1, 0)
    return votes


def score(docs: DataFrame, model: dict) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value["w"], shared.value["b"]
        for batch in slices(batches, "text"):
            row, key, words, _ = terms(batch.column("text"))
            live = w[key] != 0
            uniq = np.unique((row[live] << TERM_BITS) | key[live])
            p = sigmoid(np.bincount(uniq >> TERM_BITS, w[uniq & ((1 << TERM_BITS) - 1)], batch.num_rows) + b)
            p = np.where(words == 0, np.minimum(p, 0.01), p)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document; rows whose crc32 modulo ``folds`` is 0 are never learned from.

    Defined cases: null and wordless texts score at most 0.01; a null ``doc_id`` is held out; repeated rows are
    scored each; ids labelled twice have the label of most rows, toxic on a tie; without labels only the fixed words and
    patterns vote; an empty table gives no rows; extra columns and clashing names are ignored.
    """
    held = F.coalesce(crc_part(folds) == 0, F.lit(True)).alias("held_out")
    known = labels.select("doc_id", F.col("toxic").alias("label")).where(crc_part(folds) != 0)
    learned = docs.select("doc_id", "text").where(crc_part(folds) != 0)
    return score(docs.select("doc_id", "text", held), fit(learned, known))
