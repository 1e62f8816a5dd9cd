"""Importance resampling against a plain Python version and SQL: odd texts, chunks, ties, empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievewright.llm import importance

SCHEMA = "doc_id long, text string, weight string, row int, score long, owned int"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features(text):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, target):
    """Rows as a multiset of tuples."""
    bucket = lambda g: zlib.crc32(g.encode()) % 10_000
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(map(bucket, features(x)))
    for x in target:
        t.update(map(bucket, features(x)))
    all_s, all_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
    rows = []
    for i, x in docs:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(g)) for g in features(x))
        rows.append((i, len(words(x)), len(features(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, -r[2], -r[3]))
    ranks = [*range(1, 5 * len(able) // 100 + 1), *[None] * len(able)]
    return Counter([(i, n, w, x, k) for (i, _, n, w, x), k in zip(able, ranks)] + [(i, n, w, x, None) for i, c, n, w, x in rows if c < 20])


def got(spark, docs, target):
    out = importance.resample(spark.createDataFrame([(i, x, "w", 1, 2, 3) for i, x in docs], SCHEMA), spark.createDataFrame([(x,) for x in target], "text string"))
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in out.dtypes} == {"bigint"}
    return Counter(tuple(r) for r in out.collect())


def invented(rng, n, vocabulary):
    return " ".join(rng.choices(vocabulary, k=n))


def test_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["the", "Ärger", "日本", "x" * 63, "y" * 64, "z" * 65, "q" * 9000, *(f"w{k}" for k in range(200))]
    docs = [(k, invented(rng, rng.choice([0, 1, 2, 3, 19, 20, 21, 60, 400]), vocabulary)) for k in range(150)]
    docs += [(1, None), (2, ""), (3, " ,.\x00\n"), (4, "ONE two, three-four"), (None, invented(rng, 50, vocabulary)), (None, "few"), *[docs[30]] * 5]
    docs.append((999, " ".join(f"word{k % 977}" for k in range(30_000))))
    target = [invented(rng, 30, vocabulary[60:]) for _ in range(20)] + [None, ""]
    assert got(spark, docs, target) == brute(docs, target)


def test_ties_go_to_the_smaller_id(spark):
    text = " ".join(f"w{k}" for k in range(25))
    docs = [(k % 10, text) for k in range(100)]  # ten rows of each id
    out = got(spark, docs, ["w1 w2 w3"])
    assert out == brute(docs, ["w1 w2 w3"]) and sum(n for r, n in out.items() if r[4]) == 5


@pytest.mark.parametrize("docs,target", [([], ["some words"]), ([(1, "a b c"), (2, " ".join("abcdefghijklmnopqrstuv"))], []), ([], [])])
def test_empty_tables(spark, docs, target):
    assert got(spark, docs, target) == brute(docs, target)


def test_chunks_own_what_starts_in_them(spark):
    rng = random.Random(7)
    text = ", ".join(rng.choice(["ab", "Ünder", "w" * 70, "k9"]) for _ in range(40_000))
    parts = importance.chunks(spark.createDataFrame([(1, text), (2, "short text")], "doc_id long, text string"))
    assert [r.doc_id for r in parts[0].collect()] == [2]
    far = parts[1].collect()
    assert len(far) > 10 and sum(r.owned for r in far) == len(words(text)) and all(len(r.text.encode()) < 1.1 * importance.CHUNK_BYTES for r in far)
    whole, _, _ = importance.feature_buckets(pa.array([text]))
    cut, _, _ = importance.feature_buckets(pa.array([r.text for r in far]), np.array([r.owned for r in far]))
    assert Counter(whole[whole >= 0].tolist()) == Counter(cut[cut >= 0].tolist())


def test_crc_of_runs():
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choices("abcü9", k=rng.choice([1, 2, 5, 62, 63, 64, 65, 130, 5000]))) for _ in range(30)) for _ in range(20)]
    found, _, _ = importance.feature_buckets(pa.array(texts))
    want = [[zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 if i + n <= len(w) else -1 for n in (1, 2, 3)] for w in map(words, texts) for i in range(len(w))]
    assert found.tolist() == want


def test_threshold_is_exact(spark):
    rng = random.Random(3)
    values = [rng.choice([rng.randrange(-(1 << 50), 1 << 50), rng.randrange(100), -7]) for _ in range(500)]
    scores = spark.createDataFrame([(v,) for v in values], "score long")
    for k in (1, 2, 100, 250, 499, 500):
        assert importance.threshold(scores, k) == sorted(values, reverse=True)[k - 1]
    assert importance.threshold(scores, 501) is None


def test_ranks_over_ranges(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(9)
    out = importance.ranked(rows, [F.desc("v")]).collect()
    assert sorted((r.rank, r.v) for r in out) == [(k + 1, 999 - k) for k in range(1000)]
