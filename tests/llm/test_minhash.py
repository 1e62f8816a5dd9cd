"""The forest where regions are cut, and clusters where comparisons must stay few."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.llm import minhash
from test_corpus_operators import brute_components, near_copies, swapped


def linked_by_all_pairs(sets, percent):
    n = [set(x.tolist()) for x in sets]
    return [(i, j) for i in range(len(n)) for j in range(i) if 100 * len(n[i] & n[j]) >= percent * len(n[i] | n[j])]


def components(n, pairs):
    root = list(range(n))
    for a, b in pairs:
        root = [root[a] if r == root[b] else r for r in root]
    return [root.index(r) for r in root]


@pytest.mark.parametrize("percent", [80, 85])
def test_star_spans_all_links(percent):
    rng = np.random.default_rng(percent)
    for _ in range(20):
        sets = []
        for base in range(6):
            own = rng.choice(10**6, 40 + base * 7, replace=False).astype(np.uint64)
            for _ in range(8):
                one = own.copy()
                k = rng.integers(0, 12)
                one[rng.choice(len(one), k, replace=False)] = rng.integers(10**6, 10**9, k)
                sets.append(np.unique(one[: len(one) - rng.integers(0, 6)]))
        a, b, _ = minhash.linked_star(sets, percent)
        assert components(len(sets), list(zip(a.tolist(), b.tolist()))) == components(len(sets), linked_by_all_pairs(sets, percent))


@pytest.mark.parametrize("changed", [3, 70])
def test_comparisons_in_a_cluster_are_few(changed):
    """2000 near copies of one text, and 2000 sets that are half alike: far from two million pairs."""
    rng = np.random.default_rng(1)
    base, sets = np.arange(150, dtype=np.uint64), []
    for _ in range(2000):
        one = base.copy()
        one[rng.choice(150, changed, replace=False)] = rng.integers(10**6, 10**12, changed)
        sets.append(np.unique(one))
    a, _, compared = minhash.linked_star(sets, 85)
    assert compared < 10 * len(sets) and (len(a) == len(sets) - 1 if changed == 3 else len(a) == 0)


@pytest.mark.parametrize("rows", [2, 8])
def test_cut_regions_lose_no_link(spark, monkeypatch, rows):
    monkeypatch.setattr(minhash, "REGION_ROWS", rows)
    texts = near_copies(200, random.Random(4)) | {1000 + i: " ".join(swapped([f"b{k}" for k in range(60)], 8, random.Random(i % 90))) for i in range(180)}
    got = minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts, 3, 85)


def test_rows_of_one_id_with_other_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(7, a), (7, b), (9, a + " end"), (8, b + " end"), (7, a), (10, "something else in few words")]
    df = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in rows], "doc_id long, text string, rep int, node int, k1 int, crowd int")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, 3, 85).collect())
    assert got == [(7, 38, 7, True), (7, 38, 7, True), (7, 38, 7, True), (8, 39, 7, False), (9, 39, 7, False), (10, 3, 10, True)]


@pytest.mark.parametrize("block", [4, 16])
def test_large_clusters_block_by_block(spark, monkeypatch, block):
    """Near copies of several bases that are alike enough to be one cluster, so that some rows are beside the main component."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", block)
    rng, texts = random.Random(7), {}
    for i in range(160):
        base = swapped([f"b{k}" for k in range(80)], 4, random.Random(i % 7))
        texts[i] = " ".join(swapped(base, rng.randint(0, 3), rng))
    got = minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts, 3, 85)


def test_blocks_of_crowded_groups(spark):
    """Any two rows of a group meet in some pair of blocks, and no pair of blocks holds most of a crowded group."""
    sizes = {0: 3, 1: 600, 2: 4000, 3: 9000}
    rows = spark.createDataFrame([(r, k) for r, n in sizes.items() for k in range(n)], "region long, node long")
    counts = rows.groupBy("region").agg(minhash._region_blocks(F.count("*")).alias("blocks"))
    assert {r.region: r.blocks for r in counts.collect()} == {0: 1, 1: 2, 2: 8, 3: 5}
    dealt = minhash._in_blocks(rows.join(counts, "region"), "region")
    most = {r.region: r.n for r in dealt.groupBy("region", "lo", "hi").count().groupBy("region").agg(F.max("count").alias("n")).collect()}
    assert most[0] == 3 and most[2] < 1400 and most[3] < 4500
    own = dealt.where("region = 1").groupBy("node").agg(F.count("*").alias("n")).agg(F.min("n"), F.count("*")).first()
    assert tuple(own) == (1, 600)
    pairs = dealt.where("region = 2").select("node", "lo", "hi").collect()
    held = {}
    for p in pairs:
        held.setdefault(p.node, set()).add((p.lo, p.hi))
    nodes = sorted(held)[::97]
    assert all(held[a] & held[b] for a in nodes for b in nodes)


@pytest.mark.parametrize("small", [0, 100_000])
def test_components_of_random_graphs(spark, monkeypatch, small):
    from sievewright.llm import components as connected

    monkeypatch.setattr(connected, "SMALL", small)
    rng = random.Random(small)
    for nodes, edges in ((1, 0), (40, 25), (60, 200), (300, 290)):
        pairs = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(edges)] + [(nodes + 5, nodes + 5)]
        got = {r.node: r.root for r in connected.connected_components(spark.createDataFrame([*pairs, (None, 1)], "a long, b long").where("a is not null")).collect()}
        root = components(nodes + 6, pairs)
        touched = {x for a, b in pairs if a != b for x in (a, b)}
        assert set(got) == touched and all(got[x] == min(y for y in touched if root[y] == root[x]) for x in touched)
