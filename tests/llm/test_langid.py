"""The language models against a plain dictionary version, and what the bounds on their size do."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.llm import langid


def padded(texts):
    for t in texts:
        out, last = "   ", False
        for ch in t.lower():
            if ch.isalpha():
                out, last = out + ch, True
            elif last:
                out, last = out + " ", False
        yield out


def brute(texts):
    """Interpolated Kneser-Ney by dictionaries: the probability of a symbol after three others."""
    counts = {4: Counter(t[i - 3 : i + 1] for t in padded(texts) for i in range(3, len(t)))}
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    total, types, discount = {}, {}, {}
    for n, c in counts.items():
        total[n], types[n] = defaultdict(int), defaultdict(int)
        for g, k in c.items():
            total[n][g[:-1]] += k
            types[n][g[:-1]] += 1
        n1, n2 = sum(k == 1 for k in c.values()) + 0.5, sum(k == 2 for k in c.values())
        discount[n] = n1 / (n1 + 2 * n2 + 0.5)

    def p(g):
        n = len(g)
        if not n:
            return 1 / (len(counts[1]) + 1)
        if not total[n][g[:-1]]:
            return p(g[1:])
        seen = max(counts[n][g] - discount[n], 0) / total[n][g[:-1]]
        return seen + discount[n] * types[n][g[:-1]] / total[n][g[:-1]] * p(g[1:])

    return p


def words(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(n))


def test_equals_dictionaries(spark):
    rng = random.Random(1)
    texts = [words(rng, "aabcdéß\U00010330", rng.randint(0, 60)) for _ in range(40)]
    model = langid.train(spark.createDataFrame([(t, "x") for t in texts], "text string, lang string"))["x"]
    p = brute(texts)
    grams = sorted({t[i - 3 : i + 1] for t in padded([*texts, words(rng, "abczßy", 50)]) for i in range(3, len(t))})
    codes = [np.array([ord(g[k]) for g in grams], np.uint32) for k in range(4)]
    assert np.exp(langid.log_probability(model, codes)) == pytest.approx([p(g) for g in grams], rel=1e-9)


def test_a_bounded_table_still_sums_to_one(spark):
    rng = random.Random(2)
    texts = [words(rng, "aaaabbbccd", 200) for _ in range(5)]
    model = langid.train(spark.createDataFrame([(t, "x") for t in texts], "text string, lang string"), most=30)["x"]
    assert all(len(model[k][0]) <= 30 for k in model)
    for context in ("aab", "ddd", "  a"):
        codes = [np.full(6, ord(c), np.uint32) for c in context]
        p = np.exp(langid.log_probability(model, [*codes, np.array([ord(c) for c in "abcd z"], np.uint32)]))
        assert p.sum() == pytest.approx(1, abs=1e-6)


def test_confidence_comes_from_rows_that_were_not_counted(spark):
    """Two languages that are the same: in-sample margins look sure, held-out ones are right half of the time."""
    rng = random.Random(3)
    rows = [(i, words(rng, "abcdefghij", 12), "xy"[i % 2]) for i in range(800)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("held_out").toPandas()
    assert got["score"].mean() < 0.65


def test_rows_without_language_and_one_language(spark):
    rows = [(i, "some words of one tongue and no other", "en" if i < 60 else None) for i in range(80)] + [(None, "words", "zz")]
    df = spark.createDataFrame([(*r, True, "m") for r in rows], "doc_id long, text string, lang string, held_out boolean, _many string")
    got = langid.identify(df.drop("_many")).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got} == {"en"} and [r.held_out for r in got if r.doc_id is None] == [True]


def test_bound_holds_for_any_counts(spark):
    """Ranks are kept or left out whole: a bound that equal counts would pass leaves them out, below 65,536 and above."""
    for count in (40, 70_000, 1 << 40):
        table = spark.createDataFrame([("x", k, count + (k % 3 == 0) * count) for k in range(9)], "lang string, head long, c long")
        for most, kept in ((2, 0), (3, 3), (8, 3), (9, 9)):
            least = langid._cutoffs(table, most)["x"][0]
            assert table.where(langid._rank(F.col("c")) >= least).count() == kept
    model = langid.train(spark.createDataFrame([("ab ba abab", "x"), ("cd", "y")], "text string, lang string"), most=1)
    assert set(model) == {"x", "y"} and all(np.isfinite(langid.log_probability(m, [np.array([97], np.uint32)] * 4)).all() for m in model.values())
