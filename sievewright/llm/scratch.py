"""Scratch tables in the folder that the cluster shares, and table access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temp folder is set only where it is unset and Spark is local (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        root = "file://" + tempfile.mkdtemp(prefix="sievewright-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared scratch folder and read it back.

    This cuts the lineage: a lost executor recomputes from the written table.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of :func:`materialize` that nothing will read again."""
    path = getattr(df, "_scratch_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def small_or_joined(table: DataFrame, rows: int = 500_000) -> DataFrame:
    """A narrow written table, marked for broadcast if it has no more than ``rows`` rows; larger ones are joined by shuffle."""
    return F.broadcast(table) if table.count() <= rows else table


def row_key() -> Column:
    """What tells a document from others, those without or with the same ``doc_id`` included: a hash of id and text."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.coalesce("text", F.lit("")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_part(parts: int) -> Column:
    """``crc32`` of ``doc_id`` as text, modulo ``parts``; null for a null ``doc_id``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def _chosen(share: float) -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < int(share * 1_000_000)


def bounded_sample(docs: DataFrame, rows: int, text_bytes: int) -> DataFrame:
    """Rows chosen by a hash of ``doc_id`` so that about ``rows`` rows and ``text_bytes`` bytes of text are left at most.

    Used only to fit classifiers; every row is kept while the table is below both bounds.
    """
    count, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    return docs.where(_chosen(min(1.0, rows / max(count, 1), text_bytes / max(size or 0, 1))))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, text_bytes: int) -> DataFrame:
    """``docs`` joined to ``labels`` by ``doc_id``, a bounded sample as above.

    The hash picks rows of both sides before they are joined, so that the join moves the sample's texts only.
    """
    labelled = labels.count()
    count, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    share = min(1.0, rows / max(labelled, 1), text_bytes / max((size or 0) * min(1.0, labelled / max(count, 1)), 1))
    return docs.where(_chosen(share)).join(labels.where(_chosen(share)), "doc_id")
