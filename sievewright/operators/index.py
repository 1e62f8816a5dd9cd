"""An inverted index with positions and trigrams, written by hash partition and read by term."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.functions.text import trigrams, words
from sievewright.operators.search import FUZZY, parse_web_query

#: Hash partitions of the index; words whose places are sorted at one time.
BUCKETS, AT_ONCE = 64, 1 << 20
#: Fixed values of the rank: weight of a plain word, positions of a word that count, the last position, the sum of all 1/n^2, and distances.
WEIGHT, MOST_POSITIONS, LAST_POSITION, ALL_SQUARES = 0.1, 256, 16_383, 1.64493406685
FAR, NEAR_A, NEAR_B, NEAR_C = 100, 1.005, 0.05, 1.5


def _bucket(term: Column) -> Column:
    return (F.crc32(term.cast("binary")) % BUCKETS).cast("int")


def _blocks(batches: Iterator[pa.RecordBatch], places: bool = True) -> Iterator[pa.RecordBatch]:
    """``id, words`` -> ``term, ids, ends, positions``, some texts at a time: words are numbered, and sorted by number and text, so that a word's texts and places stand together.

    Without places: ``term, ids, sizes``, the number of words of each of these texts.
    """
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("words")), 0).to_numpy(zero_copy_only=False))
        first = 0
        while first < batch.num_rows:
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + AT_ONCE, "right")))
            part, first = batch.slice(first, last - first), last
            lists = part.column("words")
            terms = lists.flatten().dictionary_encode()
            if not len(terms):
                continue
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            text = np.repeat(np.arange(len(sizes)), sizes)
            at = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
            key = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(sizes) + text
            order = np.argsort(key, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
            code, held = np.divmod(key[order[starts]], len(sizes))
            heads = np.flatnonzero(np.r_[True, np.diff(code) != 0])
            by_text = pa.array(np.r_[heads, len(starts)].astype(np.int32))
            columns = {"term": terms.dictionary.take(pa.array(code[heads])), "ids": pa.ListArray.from_arrays(by_text, part.column("id").take(pa.array(held)))}
            if places:
                stops, froms = np.r_[starts[1:], len(order)], np.repeat(starts[heads], np.diff(np.r_[heads, len(starts)]))
                columns["ends"] = pa.ListArray.from_arrays(by_text, pa.array((stops - froms).astype(np.int32)))
                columns["positions"] = pa.ListArray.from_arrays(pa.array(np.r_[starts[heads], len(order)].astype(np.int32)), pa.array(at[order].astype(np.int32)))
            else:
                columns["sizes"] = pa.ListArray.from_arrays(by_text, pa.array(sizes[held].astype(np.int32)))
            yield pa.RecordBatch.from_pydict(columns)


def posting_blocks(docs: DataFrame, identity: str, text: Column) -> DataFrame:
    """``term, ids, ends, positions``: a row for each word of some texts that stand together, with the texts that hold it and its places in them, one text's after
    another's, and where a text's places end. No row is a whole term's list, and rows are made where the texts are."""
    told = docs.select(F.col(identity).alias("id"), words(text).alias("words"))
    kind = told.schema["id"].dataType.simpleString()
    return told.mapInArrow(_blocks, f"term string, ids array<{kind}>, ends array<int>, positions array<int>")


def opened(blocks: DataFrame) -> DataFrame:
    """Blocks -> ``id, term, positions``, a row for each text."""
    start = lambda k: F.when(k == 0, 0).otherwise(F.element_at("ends", F.greatest(k, F.lit(1))))
    places = lambda i, k: F.struct(i.alias("id"), F.slice("positions", start(k) + 1, F.element_at("ends", k + 1) - start(k)).alias("positions"))
    return blocks.select("term", F.inline(F.transform("ids", places))).select("id", "term", "positions")


def postings(docs: DataFrame, identity: str, text: Column) -> DataFrame:
    """``id, term, positions``: a row for each word of a text, its places counted from 1."""
    return opened(posting_blocks(docs, identity, text))


def gram_blocks(docs: DataFrame, identity: str, name: Column) -> DataFrame:
    """``gram, ids, grams``: a row for each trigram of some names that stand together, with the names that hold it and the number of trigrams of each."""
    cut = docs.select(F.col(identity).alias("id"), trigrams(name).alias("words"))
    kind = cut.schema["id"].dataType.simpleString()
    return cut.mapInArrow(partial(_blocks, places=False), f"term string, ids array<{kind}>, sizes array<int>").toDF("gram", "ids", "grams")


def _store(df: DataFrame, term: str, path: str, mode: str) -> None:
    """One folder per hash bucket, and in it a file of each task that read texts, its rows sorted by term: folders are chosen by the bucket, row groups by the term's range.

    Rows stay where their texts are: nothing is shuffled, and a term that most texts hold is spread as the texts are.
    """
    df.withColumn("bucket", _bucket(F.col(term))).sortWithinPartitions("bucket", term).write.mode(mode).partitionBy("bucket").parquet(path)


class SearchIndex:
    """Postings, term statistics, trigrams and the list of texts below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def add(self, docs: DataFrame, identity: str, text: Column | None = None, name: Column | None = None) -> SearchIndex:
        """Index texts by words, names by trigrams, or both. Ids must not be in the index yet; null texts have no words and are found by negations only."""
        if name is not None:
            _store(gram_blocks(docs, identity, name), "gram", f"{self.root}/grams", "append")
        if text is not None:
            _store(posting_blocks(docs, identity, text), "term", f"{self.root}/postings", "append")
            docs.select(F.col(identity).alias("id"), F.coalesce(F.size(words(text)), F.lit(0)).alias("tokens")).write.mode("append").parquet(f"{self.root}/texts")
        return self

    def _read(self, table: str, term: str, wanted: list[str]) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.root}/{table}")
        return rows.where(F.col("bucket").isin(sorted({zlib.crc32(w.encode()) % BUCKETS for w in wanted})) & F.col(term).isin(wanted)).drop("bucket")

    def statistics(self, terms: list[str]) -> DataFrame:
        """``term, texts, occurrences`` of some terms."""
        return self._read("postings", "term", terms).groupBy("term").agg(F.sum(F.size("ids")).alias("texts"), F.sum(F.size("positions")).alias("occurrences"))

    def search(self, q: str) -> DataFrame:
        """``id, relevance`` of the texts that match a web query; only the folders of its words are read, unless a text may match by lacking words."""
        groups, terms = parse_web_query(q), query_terms(q)
        if not terms:
            return self.spark.createDataFrame([], "relevance double").join(self.spark.read.parquet(f"{self.root}/texts").select("id").limit(0))
        found = by_term(opened(self._read("postings", "term", terms)), terms)
        if any(all(minus for minus, _ in group) for group in groups):
            found = self.spark.read.parquet(f"{self.root}/texts").select("id").join(found, "id", "left")
        return judge(found, q)

    def similar(self, name: str, least: float = FUZZY) -> DataFrame:
        """``id, score`` of the names whose trigrams are alike enough, from the query's trigrams alone."""
        wanted = [r[0] for r in self.spark.range(1).select(F.explode(trigrams(F.lit(name)))).collect()]  # of one query
        hits = self._read("grams", "gram", wanted).select(F.inline(F.arrays_zip("ids", "grams"))).toDF("id", "grams").groupBy("id").agg(F.count("*").alias("n"), F.max("grams").alias("grams"))
        return hits.select("id", F.round(F.col("n") / (F.col("grams") + len(wanted) - F.col("n")), 4).alias("score")).where(F.col("score") >= least)


def query_terms(q: str) -> list[str]:
    """All distinct words of a web query, sorted."""
    return sorted({t for group in parse_web_query(q) for _, terms in group for t in terms})


def by_term(rows: DataFrame, terms: list[str]) -> DataFrame:
    """Postings of a query's terms -> one row per text with an array of positions for each term, null where it has none."""
    return rows.groupBy("id").agg(*[F.max(F.when(F.col("term") == term, F.col("positions"))).alias(f"t{k}") for k, term in enumerate(terms)])


def judge(found: DataFrame, q: str) -> DataFrame:
    """``id, t0, t1, ...`` -> ``id, relevance`` of the texts that match."""
    groups, terms = parse_web_query(q), query_terms(q)
    at = {term: F.col(f"t{k}") for k, term in enumerate(terms)}

    def holds(phrase: list[str]) -> Column:
        if len(phrase) == 1:
            return at[phrase[0]].isNotNull()
        starts = [F.transform(at[term], _less(k)) for k, term in enumerate(phrase)]
        met = starts[0]
        for other in starts[1:]:
            met = F.array_intersect(met, other)
        return F.coalesce(F.size(met) > 0, F.lit(False))

    matches = F.lit(False)
    for group in groups:
        whole = F.lit(True)
        for minus, phrase in group:
            whole = whole & (~holds(phrase) if minus else holds(phrase))
        matches = matches | whole
    return found.where(matches).select("id", rank(groups, at).alias("relevance"))


def _less(k: int) -> Callable[[Column], Column]:
    return lambda p: p - k


def _unmet(others: Column) -> Callable[[Column], Column]:
    """What is left of one after the pairs of a place with the places of another word."""
    distance = lambda d: F.when(d > FAR, F.lit(1e-30)).otherwise(F.lit(1.0) / (F.lit(NEAR_A) + F.lit(NEAR_B) * F.exp(d / F.lit(NEAR_C) - 2)))
    pair = lambda x, y: 1 - F.lit(WEIGHT) * F.sqrt(distance(F.abs(x - y).cast("double")))
    return lambda x: F.aggregate(F.filter(others, lambda y: y != x), F.lit(1.0), lambda s, y: s * pair(x, y))


def rank(groups: list, at: dict[str, Column]) -> Column:
    """The weighted rank of a text by the positions of a query's words.

    Alternatives, and queries of one word: each word counts its places with 1/n^2, over all words of the query. Words that must all be there: each pair of
    places of two words counts by their distance, as one minus the product of what is left.
    """
    kept = {t: F.transform(F.slice(F.coalesce(p, F.array().cast("array<int>")), 1, MOST_POSITIONS), lambda x: F.least(x, F.lit(LAST_POSITION))) for t, p in at.items()}
    terms = sorted(at)
    joined = len(groups) == 1 and (len(groups[0]) > 1 or len(groups[0][0][1]) > 1)
    if not joined or len(terms) < 2:
        squares = lambda p: F.aggregate(F.sequence(F.lit(1), F.size(p)), F.lit(0.0), lambda s, n: s + F.lit(WEIGHT) / (n * n))
        total = F.lit(0.0)
        for t in terms:
            total = total + F.when(F.size(kept[t]) > 0, squares(kept[t]) / F.lit(ALL_SQUARES)).otherwise(0.0)
        return F.round(total / len(terms), 6)
    left = F.lit(1.0)
    for k, a in enumerate(terms):
        for b in terms[:k]:
            left = left * F.aggregate(F.transform(kept[a], _unmet(kept[b])), F.lit(1.0), lambda s, x: s * x)
    return F.round(1 - left, 6)

