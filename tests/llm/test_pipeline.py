"""The pipeline's stages, each on what its predecessor kept, against brute-force versions."""

import re

import duckdb

import corpus_pipeline as p
from sievewright.llm import mixing
from sievewright.llm.scratch import materialize, table
from test_corpus_operators import brute_components
from test_secret_scan import redacted

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def grams(text):
    w = [x for x in (re.sub(r"^[\W_]+|[\W_]+$", "", w) for w in text.lower().split()) if x]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def test_stages(spark, sf, tmp_path):
    docs = table(spark, sf, "documents")
    items = [grams(r.text) for r in table(spark, sf, "benchmark").collect()]
    rated = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    texts_of = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    for name, stage in p.STAGES:
        out = materialize(stage(spark, docs, sf))
        if name != p.STAGES[-1][0]:
            had, kept = texts_of(docs), texts_of(out)
            assert out.columns == docs.columns and set(kept) <= set(had) and out.count() == len(kept)
        if name == "quality classifier":
            right = [(i in kept) == bool(q) for i, q in rated.items() if i in had]
            assert sum(right) > 0.9 * len(right)
        if name == "MinHash near-dedup":
            assert set(kept) == {i for i, (_, root) in brute_components(had, 5, 80).items() if root == i}
        if name == "benchmark decontamination":
            assert set(had) - set(kept) == {i for i, t in had.items() if any(len(g & grams(t)) >= 0.8 * len(g) for g in items)}
        if name == "secret scans":
            assert kept == {i: redacted(t) for i, t in had.items()}
        if name == p.STAGES[-1][0]:
            docs.write.parquet(str(tmp_path / "documents.parquet"))
            db = duckdb.connect()
            db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
            want = db.execute("select doc_id, taken from (" + mixing.ORACLE.replace("{documents}", "documents") + ") where taken > 0").fetchall()
            assert sorted((r.doc_id, r.taken) for r in out.collect()) == sorted(want) and len(want) > 0
        docs = out


ROWS = [
    (1, None, "en", None, None),
    (2, "", None, "a", 0),
    (3, "some ordinary words, and then some more of them.", "en", "a", 48),
    (3, "some ordinary words, and then some more of them.", "en", "a", 48),
    (3, "a wholly different text under the same number, for once.", "en", "a", 48),
    (None, "Words of no one, but still words.", None, None, None),
    (None, "Words of no one, but still words.", None, None, None),
]


def test_odd_rows_by_stage(spark, sf):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    kept = lambda k: sorted(map(repr, ((r.doc_id, r.text) for r in p.STAGES[k][1](spark, docs, sf).collect())))
    every = [(i, t) for i, t, *_ in ROWS]
    assert kept(1) == sorted(map(repr, every[:3] + every[4:]))
    assert kept(2) == kept(3) == sorted(map(repr, every))
    assert [r.doc_id for r in p.STAGES[4][1](spark, docs, sf).where("doc_id in (1, 2)").collect()] == []
    accepted = p.STAGES[0][1](spark, docs, sf)
    assert accepted.where("doc_id in (1, 2)").count() == 0 and accepted.columns == docs.columns


def test_empty_tables_and_clashing_names(spark, sf):
    odd = "row int, cluster int, accepted boolean, secrets int, _key int, taken int"
    docs = spark.createDataFrame([(*r, 1, 2, True, 3, 4, 5) for r in ROWS], f"{SCHEMA}, {odd}")
    for start in (docs, docs.where("false")):
        for k, (_, stage) in enumerate(p.STAGES):
            out = stage(spark, start, sf)
            assert k == 4 or out.columns == docs.columns
            start = materialize(out)
        assert start.count() <= 5
