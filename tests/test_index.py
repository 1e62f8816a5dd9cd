"""The inverted index against plain Python over all texts: matches, ranks, phrases, negations, trigrams; what a query reads."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from sievewright.operators import index, search
from sievewright.operators.index import SearchIndex
from sievewright.storage import shared_folder

WORDS = ["data", "big", "table", "spark", "old", "éa", "日本", "x9", "filler", "more"]


def tokens(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def plain_rank(groups, places):
    terms = sorted(places)
    kept = {t: [min(p, 16_383) for p in places[t][:256]] for t in terms}
    if len(terms) < 2 or len(groups) > 1 or (len(groups[0]) == 1 and len(groups[0][0][1]) == 1):
        return sum(sum(0.1 / (n * n) for n in range(1, len(kept[t]) + 1)) / 1.64493406685 for t in terms) / len(terms)
    left = 1.0
    for k, a in enumerate(terms):
        for b in terms[:k]:
            for x in kept[a]:
                for y in kept[b]:
                    if x != y:
                        near = 1e-30 if abs(x - y) > 100 else 1 / (1.005 + 0.05 * math.exp(abs(x - y) / 1.5 - 2))
                        left *= 1 - 0.1 * math.sqrt(near)
    return 1 - left


def plain_search(texts, q):
    groups, terms, out = search.parse_web_query(q), index.query_terms(q), {}
    for i, text in texts.items():
        w = tokens(text)
        has = lambda phrase: any(w[k : k + len(phrase)] == phrase for k in range(len(w)))  # noqa: B023, E731
        if any(all(has(phrase) != minus for minus, phrase in group) for group in groups):
            out[i] = plain_rank(groups, {t: [k + 1 for k, x in enumerate(w) if x == t] for t in terms})
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    found = {k: " ".join(rng.choices(WORDS, weights=[3, 2, 2, 1, 1, 1, 1, 1, 9, 9], k=rng.choice([0, 1, 3, 20, 150, 700]))) for k in range(120)}
    return found | {500: None, 501: "", 502: "Big, TABLE! big_table", 503: "data " * 400 + "filler " * 17_000 + "data spark"}


@pytest.fixture(scope="module")
def built(spark, texts):
    docs = spark.createDataFrame([(k, v, 1) for k, v in texts.items()], "id int, text string, term int")
    made = SearchIndex(spark, shared_folder(spark))
    made.add(docs.where("id < 60"), "id", F.col("text"), F.substring("text", 1, 30))
    return made.add(docs.where("id >= 60"), "id", F.col("text"), F.substring("text", 1, 30))


@pytest.mark.parametrize("q", ["spark", "data spark", '"big table"', 'data "big table" -old or spark', "-data", "data or -spark -old", "nowhere", "nowhere or x9", "éa 日本", "BIG -table", '"data data data"', "", "-", '"table big" x9'])
def test_search_is_a_scan(built, texts, q):
    got = {r["id"]: r.relevance for r in built.search(q).collect()}
    want = plain_search(texts, q)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_statistics(built, texts):
    got = {r.term: (r.texts, r.occurrences) for r in built.statistics(["data", "spark", "nowhere"]).collect()}
    count = {w: [tokens(t).count(w) for t in texts.values()] for w in ("data", "spark")}
    assert got == {w: (sum(map(bool, c)), sum(c)) for w, c in count.items()}


def test_similar_names(built, texts):
    def grams(name):
        return {f"  {w} "[k : k + 3] for w in tokens(name) for k in range(len(w) + 1)}

    for name in ("big table data", "日本", "...", "unlike anything"):
        want = {}
        for i, text in texts.items():
            a, b = grams((text or "")[:30]), grams(name)
            score = round(len(a & b) / len(a | b), 4) if a and b else 0
            if score >= 0.3:
                want[i] = score
        assert {r["id"]: r.score for r in built.similar(name).collect()} == want


def test_query_reads_its_own_folders(built):
    plan = built.search("spark")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket", plan) and re.search(r"PushedFilters: \[[^]]*term", plan)
    files = {f.split("bucket=")[1].split("/")[0] for f in built._read("postings", "term", ["spark"]).select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
    assert len(files) == 1
