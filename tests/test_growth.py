"""Steps whose cost must not outgrow their input: what they make, and what their plans shuffle."""

import pickle


def test_normal_forms_by_slices(spark):
    import pyarrow as pa

    from sievewright.functions import text

    texts = [None, "", "ﬁne", "Ｒ-1"] * 50
    assert text._normal("NFKC", pa.array(texts)).to_pylist() == [None, "", "fine", "R-1"] * 50
    df = spark.createDataFrame([(t,) for t in texts[:4]], "t string")
    assert [r[0] for r in df.select(text.composed(df.t)).collect()] == [None, "", "fine", "R-1"]


def test_either_join_makes_a_pair_once(spark):
    from sievewright.operators import relational

    left, every = [(1, 1), (1, 2), (2, 1), (3, None), (4, 9)], [(1, 1), (1, 2), (5, 2), (5, 2), (3, 7), (4, 9), (6, None)]
    right = [r for r in every if r[0] != 4]
    frame = lambda rows, i, g: spark.createDataFrame(rows, f"{i} int, {g} int")
    got = sorted(tuple(r) for r in relational.either_join(frame(left, "s", "g"), frame(right, "c", "h"), frame(every, "c", "h"), ("s", "c"), ("g", "h")).collect())
    assert got == sorted({(s, c) for s, g in left for c, h in right if g == h and g is not None} | {(s, c) for s, _ in left for c, _ in every if s == c})


def test_spans_meet_by_minutes(spark, sf):
    from sievewright.plans import catalog

    plan = catalog.interval_overlap_join(spark, sf)._jdf.queryExecution().analyzed().toString()
    assert "cast(60 as double)" in plan and "cast(3600 as double)" not in plan


def test_lists_that_items_share_are_made_once(spark):
    from sievewright.operators import search

    items = spark.createDataFrame([(1, "n"), (2, "n"), (3, None), (4, "m")], "id int, near string")
    places = spark.createDataFrame([("n", "y"), ("n", "x")], "id string, place string")
    got = {r["id"]: r.record for r in search.detail_documents(items, {"places": (places, ["place"])}, {"places": "near"}).collect()}
    some, none = '"places":[{"place":"x"},{"place":"y"}]}', '"places":[]}'
    assert got == {1: '{"id":1,' + some, 2: '{"id":2,' + some, 3: '{"id":3,' + none, 4: '{"id":4,' + none}


def test_postings_are_parsed_once(spark, sf):
    from sievewright.plans import registry

    plan = registry.listing_details(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("unfolded") == plan.count("ArrowEvalPython") == 1


def test_postings_stay_where_texts_are(spark):
    from pyspark.sql import functions as F

    from sievewright.operators import index

    texts = [(1, "a b a"), (2, None), (3, ""), (4, "B a c c c"), (5, "a")]
    out = index.postings(spark.createDataFrame(texts, "id int, t string"), "id", F.col("t"))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["id"], r.term, r.positions) for r in out.collect()) == [(1, "a", [1, 3]), (1, "b", [2]), (4, "a", [2]), (4, "b", [1]), (4, "c", [3, 4, 5]), (5, "a", [1])]


def test_documents_are_measured_together():
    from sievewright.sources import bounded

    good = [b'{"a":[1,{"b\\\\":"c\\"d"}]}', b"[]", b"1", b'"\xf0\x9f\x98\x80x"', b'{"k":{}}', b"", b' [1, 2 ] ']
    for documents in (good, [*good, b'["', *good], [b"[", *good]):
        assert list(zip(*(f.tolist() for f in bounded._measure(documents)))) == [bounded.measure(d) for d in documents]
    assert [bounded.measure(d) for d in good] == [(3, 5, 3), (0, 1, 0), (0, 1, 0), (0, 1, 3), (1, 2, 1), (0, 0, 0), (1, 3, 0)]


def test_documents_of_one_row_are_compared_where_they_stand(spark):
    from sievewright.operators import differences

    rows = [(1, '{"a":[1,null,{"x":1}],"b":null,"c d":1}', '{"a":[1.0,2,{"x":"1"},4],"c d":{"e":1}}'), (2, "[1]", "[1]"), (3, None, "{}"), (4, "{", None), (5, "[[[1]]]", "[[[2]]]"), (6, '{"a":null}', "{}"), (7, "{}", "[]")]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    out = differences.paired_diff(df, "id", "a", "b", 2)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 1
    assert {tuple(r)[:3] for r in out.collect()} == {(1, "$.a[1]", "changed"), (1, "$.a[2]", "changed"), (1, "$.a[3]", "added"), (1, "$.b", "removed"), (1, '$["c d"]', "changed"), (3, "$", "added"), (5, "$[0][0]", "changed"), (6, "$.a", "removed"), (7, "$", "changed")}


def test_a_task_of_the_content_store_tells_its_folder_only(tmp_path):
    import pyarrow as pa

    from sievewright.sources.board_source import ContentWriter

    writer = ContentWriter({"path": str(tmp_path)})
    bodies = [str(k % 400).encode() for k in range(500)]
    message = writer.write(iter([pa.RecordBatch.from_arrays([pa.array([None] * 500, pa.string()), pa.array(bodies)], ["sha256", "body"])]))
    assert len(pickle.dumps(message)) < 300
    writer.commit([message, None])
    assert sum(1 for f in tmp_path.glob("??/*") if f.is_file()) == 400 and not list(tmp_path.glob("_staging/*"))


def test_numbers_of_addresses_are_worked_out_once_a_row(spark):
    from pyspark.sql import functions as F

    from sievewright.functions import addresses

    df = spark.createDataFrame([("10.0.0.1",), ("2600::1",), ("x",), (None,)], "a string")
    out = addresses.valued(df, "a", "v")
    nets = addresses.networks(spark.createDataFrame([("10.0.0.0/8", "p")], "net string, label string"), "net").drop("net")
    got = {r.a: (r.label, r.p) for r in addresses.longest_match(out, "a", nets, "v").withColumn("p", addresses.public_number(F.col("v"))).collect()}
    assert got == {"10.0.0.1": ("p", False), "2600::1": (None, True), "x": (None, False), None: (None, False)}


def test_postings_are_stored_in_blocks(spark, sf, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from sievewright.operators import index
    from sievewright.plans import indexes

    texts = spark.createDataFrame([(k, "a b a " * (k % 3) + "c") for k in range(200)], "id long, t string").coalesce(1)
    made = index.SearchIndex(spark, f"file://{tmp_path}/one").add(texts, "id", F.col("t"))
    assert spark.read.parquet(f"file://{tmp_path}/one/postings").count() == 3
    assert sorted(map(tuple, made.statistics(["a", "b", "c"]).collect())) == [("a", 133, 398), ("b", 133, 199), ("c", 200, 200)]
    monkeypatch.setattr(index, "AT_ONCE", 4)
    got = {(r["id"], r.term): r.positions for r in index.opened(spark.createDataFrame(list(_cut_blocks(index)), "term string, ids array<long>, ends array<int>, positions array<int>")).collect()}
    assert got == {(7, "x"): [1, 3], (7, "y"): [2], (8, "x"): [1], (9, "y"): [1, 2, 3, 4, 5]}
    monkeypatch.setattr(indexes, "shared_folder", lambda _: f"file://{tmp_path}/two")
    indexes.index_search_any(spark, sf)
    assert (tmp_path / "two/postings").exists() and not (tmp_path / "two/grams").exists()


def _cut_blocks(index):
    """Blocks of no more than AT_ONCE words, or of one text."""
    import pyarrow as pa

    words = [["x", "y", "x"], ["x"], None, [], ["y"] * 5]
    blocks = list(index._blocks(iter([pa.RecordBatch.from_arrays([pa.array([7, 8, 5, 6, 9]), pa.array(words, pa.list_(pa.string()))], ["id", "words"])])))
    assert len(blocks) == 2
    return (tuple(r.values()) for b in blocks for r in b.to_pylist())


def test_names_are_indexed_alone_and_in_blocks(spark, sf, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from sievewright.operators import index
    from sievewright.plans import indexes

    names = [(k, None if k % 5 == 4 else "ab " * (k % 3) + "ab c") for k in range(100)]
    made = index.SearchIndex(spark, f"file://{tmp_path}/one").add(spark.createDataFrame(names, "id long, t string").coalesce(1), "id", name=F.col("t"))
    assert spark.read.parquet(f"file://{tmp_path}/one/grams").count() == 5  # "  a", " ab", "ab ", "  c", " c "
    assert sorted(map(tuple, made.similar("ab", 0.1).collect())) == [(k, 0.6) for k in range(100) if k % 5 != 4] and made.similar("...").collect() == []
    monkeypatch.setattr(indexes, "shared_folder", lambda _: f"file://{tmp_path}/two")
    got = indexes.index_similar(spark, sf).count()
    assert got and {p.name for p in (tmp_path / "two").iterdir()} == {"grams"}
    both = index.SearchIndex(spark, f"file://{tmp_path}/three").add(indexes._texts(spark, sf), "doc_id", F.col("text"), F.substring_index(F.coalesce("text", F.lit("")), "\n", 1))
    assert both.similar("The hand of the stone was there", 0.1).count() == got


def test_sets_meet_by_sketches_in_tiles(spark, monkeypatch):
    import random

    from pyspark.sql import functions as F

    from sievewright.operators import resolve, sketches

    rng = random.Random(8)
    words = [f"w{k}" for k in range(90)]
    sets = {k: rng.sample(words, rng.choice([1, 2, 5, 17, 40, 60])) for k in range(240)}
    sets |= {k + 240: sorted({*sets[k][1:], rng.choice(words)}) for k in range(0, 240, 3)} | {900: [], 901: None, 902: sets[5]}
    rows = [(k, None if k % 50 == 7 else "xy"[k % 2], s) for k, s in sets.items()] + [(5, "y", sets[8]), (5, "y", sets[5])]
    kept, old = [], resolve.written
    for module in (resolve, sketches):
        monkeypatch.setattr(module, "written", lambda df: kept.append(df) or old(df))
    monkeypatch.setattr(sketches, "LEAST_SETS", 8)
    df = spark.createDataFrame(rows, "id int, g string, s array<string>")
    for measure, least in (("jaccard", 0.6), ("dice", 0.65)):
        score = lambda a, b: round(len(a & b) / len(a | b) if measure == "jaccard" else 2 * len(a & b) / (len(a) + len(b)), 4)  # noqa: B023, E731
        want = sorted((i, j, score({*a}, {*b})) for i, g, a in rows for j, h, b in rows if i < j and g == h and g and a and b and score({*a}, {*b}) >= least)
        assert sorted(map(tuple, resolve.similar_pairs(df, "id", F.col("s"), least, measure, ["g"]).collect())) == want and len(want) > 50
    # no set is written, and several tiles were made
    assert not any(kind.startswith("array") for k in kept for _, kind in k.dtypes) and max(k.count() for k in kept if "tile" in k.columns and "a" in k.columns) > 8


def test_sketches_differ_in_no_more_bits_than_sets_in_elements(spark):
    import random

    import numpy as np
    import pyarrow as pa

    from sievewright.operators import sketches

    rng = random.Random(1)
    sets = [[], None, *[[rng.getrandbits(64) - 2**63 for _ in range(n)] for n in (1, 16, 17, 300, 5_000)]]
    sets += [sets[-1][:4_000] + [7, 8], sets[-2][:250]]
    got = [np.frombuffer(b, np.uint64) for b in sketches._parities(pa.array(sets, pa.list_(pa.int64()))).to_pylist()]
    assert [len(g) for g in got] == [1, 1, 1, 1, 2, 32, 512, 256, 16]
    apart = lambda i, j, w: int(np.bitwise_count(sketches._folded(got[i], w) ^ sketches._folded(got[j], w)).sum())
    assert apart(6, 7, 256) <= 1_002 and apart(6, 7, 1) <= 64 and 40 <= apart(5, 8, 16) <= 50 and apart(0, 1, 1) == 0
    assert apart(5, 6, 32) > 500


def _broadcast(plan):
    """What a plan broadcasts: each exchange with what lies below it."""
    lines = plan.splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(k + 1, len(lines)) if depth(lines[j]) <= depth(line)), len(lines))
            yield "\n".join(lines[k:end])


def test_no_sets_are_broadcast_for_their_size_on_disk(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from sievewright.functions import text
    from sievewright.operators import matching

    # little on disk, far more once names are opened
    names = lambda n, head, i: spark.range(n).select(F.col("id").alias(i), text.bigrams(F.concat(F.lit(head), F.format_string("%09d", "id"))).alias("set"))
    plans, old = [], matching.written
    monkeypatch.setattr(matching, "written", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or old(df))
    out = matching.similar_classes(names(30, "customer company ", "a"), names(5_000, "company incorporated ", "b"), [], 0.65, "dice")
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    sent = [b for p in plans for b in _broadcast(p)]
    assert sent and not any("set#" in b for b in sent)


def test_candidates_are_not_worked_out_for_decisions(spark, monkeypatch):
    from sievewright.plans import matching

    monkeypatch.setattr(matching.matching, "similar_across", lambda *a: 1 / 0)
    assert matching.company_matching(spark, "/root/testdata/sf0.001").count() > 0


def test_texts_of_differences_are_made_once(spark):
    from sievewright.operators import differences

    df = spark.createDataFrame([(1, "[1,2]", "[1,3]")], "id int, a string, b string")
    run = differences.paired_diff(df, "id", "a", "b", 1)._jdf.queryExecution()
    found = run.optimizedPlan().toString().split("Generate")[0]  # what lies above the last generator
    assert "Json" not in found and "json" not in found and "WindowGroupLimit" not in run.executedPlan().toString()
