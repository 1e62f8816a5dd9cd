"""Toxicity and quality: small exact versions of the models, and accuracy on rows that were held out."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.llm import linear, quality, queries, toxicity
from sievewright.llm.scratch import table


def drawn(rng, n=3000, prior=0.3):
    y = rng.random(n) < prior
    votes = np.stack([np.where(rng.random(n) < a, np.where(y, 1, -1), np.where(y, -1, 1)) * (rng.random(n) < 0.8) for a in (0.9, 0.85, 0.8, 0.6)], 1).astype(np.int8)
    return y, votes


def test_label_model_finds_accuracies():
    """Four voters, the poorest one twice: the bar of the first round's test."""
    y, votes = drawn(np.random.default_rng(5))
    post, accuracy, parent = toxicity.label_model(np.concatenate([votes, votes[:, 3:4]], 1), 0.3)
    assert ((post > 0.5) == y).mean() > 0.9 and accuracy[0] > accuracy[3]
    assert parent[4] == 3 or parent[3] == 4
    voted = (votes != 0).sum(0)
    assert accuracy[:4] == pytest.approx([(np.where(y, 1, -1) == votes[:, k]).sum() / voted[k] for k in range(4)], abs=0.06)


def test_copies_of_a_voter_add_little(monkeypatch):
    """The poorest voter five times: nearly what the true rates give, and far from what independent voters make of it."""
    y, votes = drawn(np.random.default_rng(5))
    many = np.concatenate([votes, *[votes[:, 3:4]] * 4], 1)
    rate = np.array([0.9, 0.85, 0.8, 0.6])
    best = ((np.log(0.3 / 0.7) + (votes * np.log(rate / (1 - rate))).sum(1) > 0) == y).mean()
    alone = toxicity.label_model(votes, 0.3)[0]
    post, accuracy, _ = toxicity.label_model(many, 0.3)
    monkeypatch.setattr(toxicity, "DRAWN", 1e9)  # no dependence is left
    independent = toxicity.label_model(many, 0.3)[0]
    assert ((post > 0.5) == y).mean() > best - 0.03 and accuracy[0] > accuracy[3]
    assert np.abs(post - alone).mean() < np.abs(independent - alone).mean() / 4


def test_label_model_is_bayes_on_its_own_rates():
    """With one round, the posterior is that of the counts: all label and vote combinations summed by hand."""
    rng = np.random.default_rng(6)
    _, votes = drawn(rng, 400)
    votes = votes[:, :2]
    score = votes.sum(1)
    start = np.where((score > 0) & (score >= np.quantile(score, 0.7)), 0.95, 0.05)
    want = {}
    for v in itertools.product((-1, 0, 1), repeat=2):
        odds = []
        for q in (1 - start, start):
            first = np.array([q[votes[:, 0] == k].sum() for k in (-1, 0, 1)])
            rate = first + 0.1
            p0 = (first + toxicity.DRAWN * rate / rate.sum()) / (first.sum() + toxicity.DRAWN)
            second = np.array([q[votes[:, 1] == k].sum() for k in (-1, 0, 1)]) + 0.1
            both = np.array([q[(votes[:, 0] == v[0]) & (votes[:, 1] == k)].sum() for k in (-1, 0, 1)]) + toxicity.DRAWN * second / second.sum()
            odds.append(p0[v[0] + 1] * both[v[1] + 1] / both.sum())
        p = 0.3
        want[v] = p * odds[1] / (p * odds[1] + (1 - p) * odds[0])
    post, _, _ = toxicity.label_model(votes, 0.3, rounds=1)
    assert post == pytest.approx([want[tuple(v)] for v in votes.tolist()], rel=1e-4)


def test_toxicity_on_held_out_rows(spark, sf):
    want = {r.doc_id: r.toxic for r in table(spark, sf.replace("0.001", "0.01"), "labels").collect()}
    got = [r for r in queries.op6_toxicity(spark, sf.replace("0.001", "0.01")).collect() if r.held_out and r.doc_id in want]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got) and len(got) > 40
    assert np.mean([r.predicted == want[r.doc_id] for r in got]) > 0.93
    assert np.mean([r.predicted for r in got if not want[r.doc_id]]) < 0.05


def test_labels_of_the_pool_are_not_read(spark):
    """Held-out labels, and ids labelled twice, change nothing or what they are said to."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["calm", "river", "stone", "idea", "table"]) + str(rng.randrange(3)) for _ in range(30)) + (" you grumbel snorf" if i % 6 == 0 else "")) for i in range(600)]
    docs = spark.createDataFrame([(*r, 1, "t") for r in rows], "doc_id long, text string, label int, toxic string")
    labels = [(i, int(i % 6 == 0)) for i in range(600)]
    fold = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    score = lambda rows: {r.doc_id: (round(r.score, 9), r.predicted) for r in toxicity.classify(docs, spark.createDataFrame(rows, "doc_id long, toxic int")).collect()}
    base = score(labels)
    assert [i for i in range(600) if base[i][1] != (i % 6 == 0)] == []
    assert score([(i, 1 - t if fold(i) else t) for i, t in labels]) == base
    assert score(labels + labels + [(i, 1 - t) for i, t in labels]) == base
    assert {p for _, p in score([(i, t) for i, t in labels if False] or [(10**6, 1)]).values()} == {0}


def test_cumulative_link_equals_a_search():
    """One feature, three grades: no likelihood on a grid is better than that of the fit."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=400)
    grade = np.digitize(1.5 * x + rng.logistic(size=400), [-1.0, 1.0])
    w, theta = linear.fit_cumulative(linear.Rows([np.zeros(1, int)] * 400, list(x[:, None])), grade, 3, 1, l2=0.0)

    def loss(w, a, b):
        edge = np.array([-np.inf, a, b, np.inf])
        return -np.log(linear.sigmoid(edge[grade + 1] - w * x) - linear.sigmoid(edge[grade] - w * x) + 1e-12).mean()

    best = min(loss(a, b, c) for a in np.arange(0.5, 2.5, 0.1) for b in np.arange(-2, 0, 0.1) for c in np.arange(0, 2, 0.1))
    assert loss(w[0], *theta) <= best + 1e-3


def test_quality_on_held_out_rows(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    out = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    want = {r.doc_id: r.quality for r in labels.where(out).collect()}
    got = {r.doc_id: r.accepted for r in quality.classify(docs, labels.where(~out)).collect()}
    assert np.mean([got[i] == bool(q) for i, q in want.items() if i in got]) > 0.93


def graded(rng, n):
    good, fair, poor = ("harbour lantern violin granite meadow".split(), "thing stuff place people around".split(), "buy now click win prize".split())
    return [(i, " ".join(rng.choice(rng.choice([(poor, poor, fair), (poor, fair, good), (fair, good, good)][i % 3])) for _ in range(40)), i % 3 + 1) for i in range(n)]


def test_three_grades_by_words(spark):
    """The texts have one shape; only words tell grades apart."""
    rows = graded(random.Random(9), 600)
    docs = spark.createDataFrame([(i, t, 0.5, b"x") for i, t, _ in rows], "doc_id long, text string, grade double, x binary")
    labels = spark.createDataFrame([(i, g, 7) for i, _, g in rows if i < 400], "doc_id long, quality int, v int")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    held = [(got[i], g) for i, _, g in rows if i >= 400]
    mean = [np.mean([r.expected_grade for r, g in held if g == k]) for k in (1, 2, 3)]
    assert mean[0] < mean[1] - 0.3 and mean[1] < mean[2] - 0.3
    assert np.mean([abs(r.expected_grade - g) < 0.7 for r, g in held]) > 0.75
    assert np.mean([r.accepted for r, g in held if g == 3]) > 0.9 and np.mean([r.accepted for r, g in held if g == 1]) < 0.1


def test_ties_and_repeated_rows_of_ratings(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (1, "alpha beta gamma delta"), (2, "one, two; three!"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 4 and len({(r.doc_id, r.expected_grade, r.tail_probability) for r in got}) == 3
    assert next(r for r in got if r.doc_id == 3).accepted is False
