"""A training-data pipeline: each stage reads what its predecessor kept, written as Parquet in between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm import decontaminate as benchmark_leaks
from sievewright.llm import minhash, mixing, quality, secret_scan
from sievewright.llm.scratch import materialize, small_or_joined, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Defined cases: null, empty and very short texts go; repeated rows are judged alike; without two grades among the labels
    every other text stays; an empty table stays empty; columns pass as they are, whatever their names.
    """
    rows = docs.select("doc_id", "text", F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    judged = quality.classify(rows, table(spark, sf_dir, "labels"), keep=("row",))
    return judged.where("accepted").select("row.*")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8): the smallest ``doc_id``.

    Defined cases: of rows repeated with one ``doc_id`` and text, one stays; texts of one ``doc_id`` that are not alike all stay, of
    those in one group one; rows without ``doc_id`` and texts without words stay; an empty table stays empty.
    """
    groups = minhash.near_duplicates(docs, width=5, percent=80)
    marks = groups.where("doc_id is not null").groupBy(F.col("row_key").alias("_key")).agg(F.min("first").alias("_first"), (F.count("*") > 1).alias("_again"))
    # few rows go or are repeated; the others meet no other row
    marks = small_or_joined(materialize(marks.where("not _first or _again")))
    told = docs.select("doc_id", minhash.row_key().alias("_own"), F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    told = told.join(marks, F.col("_own") == F.col("_key"), "left").where("doc_id is null or coalesce(_first, true)")
    once = told.where("doc_id is not null and _again").dropDuplicates(["_key"])
    return told.where("doc_id is null or not coalesce(_again, false)").unionByName(once).select("_row.*")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item.

    Defined cases: each row is judged by its own text, whatever its ``doc_id``; null and empty texts stay; an empty table or
    benchmark changes nothing; columns pass as they are.
    """
    return benchmark_leaks.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark.

    Defined cases: null and empty texts and those without secrets stay as they are; ``n_chars`` is set anew where a text changes.
    """
    return secret_scan.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the words taken and the copies: ``doc_id, size, source_size, target, taken, copies``.

    Defined cases: null and blank texts have no words and are not taken; a null source is a source; repeated rows are taken
    together; an empty table gives no rows.
    """
    out = mixing.mix_sources(docs).where("taken > 0")
    return out.withColumn("copies", (F.col("taken") / F.col("size")).cast("int"))


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("mixing sources to target weights", mixed),
]

#: The stages' models, signatures and templates are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
