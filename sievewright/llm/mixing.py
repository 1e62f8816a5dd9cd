"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievewright.llm.scratch import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources by code point order, repeating; share of all words to take; most copies of a document.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Hex digits of the hash per level of the histogram, and the number of levels.
DIGITS, LEVELS = 3, 3
BUCKETS = 16**DIGITS
#: Per-source tables up to so many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 50_000


def target_table(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``sizes(source, source_size)`` -> with ``weight`` and ``target``: one row per source.

    Sources in code point order (null last) get the weights in turn and share ``share`` times all
    words; no target passes ``most`` times its source's size, the excess is reshared by weight. Sources
    are walked by the ratio of limit to weight: each is at its limit while the level that the rest
    would share lies above that ratio.
    """
    everything = W.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(everything) - 1, F.lit(len(weights))).cast("int")
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1)).withColumn("most", F.lit(most) * F.col("source_size"))
    climb = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = W.partitionBy()
    before = F.sum("most").over(climb) - F.col("most")
    rest = F.sum("weight").over(whole) - F.sum("weight").over(climb) + F.col("weight")
    level = (F.lit(share) * F.sum("source_size").over(whole) - before) / rest
    walked = weighed.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") < F.col("most"))
    final = F.min(F.when(F.col("open"), F.struct(F.col("most") / F.col("weight"), F.col("level").alias("level")))).over(whole)["level"]
    target = F.when(F.col("open"), F.least(final * F.col("weight"), F.col("most").cast("double"))).otherwise(F.col("most").cast("double"))
    return walked.select("source", "source_size", "weight", target.alias("target"))


def attach(docs: DataFrame, per_source: DataFrame, keys: tuple = ("source",)) -> DataFrame:
    """Join a table with one row per source to the documents, by broadcast only while it is small."""
    per_source = materialize(per_source)
    renamed = per_source.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in per_source.columns if c not in keys])
    small = F.broadcast(renamed) if per_source.count() <= BROADCAST_ROWS else renamed
    on = F.lit(True)
    for k in keys:
        on = on & docs[k].eqNullSafe(renamed[f"_{k}"])
    return docs.join(small, on).drop(*[f"_{k}" for k in keys])


def mix_sources(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """``docs(doc_id, text, source, ...)`` -> ``doc_id, size, source_size, target, taken``, one row per document.

    Every document is taken ``floor(target / source_size)`` times; the rest of a source's target is
    filled by the documents whose hash lies below the source's threshold. Thresholds come from
    histograms of words by source and hash bucket: the bucket in which the running sum passes the
    budget is refined by the next digits of the hash, three levels deep, and the last bucket is taken
    if that comes nearer to the target. Nothing is sorted but histograms, thresholds are nested (a
    larger share keeps what a smaller one took), and the hash depends on ``doc_id`` alone.

    Defined cases: null text counts no words; a null source is a source, the last; null doc_ids share
    one hash (with the text); repeated rows are taken together; a source without words has target 0;
    an empty table gives no rows; extra columns are ignored.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.coalesce("text", F.lit("")))))
    digits: list[Column] = [F.conv(F.substring("key", 1 + DIGITS * i, DIGITS), 16, 10).cast("int").alias(f"d{i}") for i in range(LEVELS)]
    slim = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("key"))
    slim = materialize(slim.select("doc_id", "source", "size", *digits))
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    # ratio is 0 where a source has no words
    rated = target_table(sizes, share=share).withColumn("whole", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long"))
    rated = materialize(rated.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")))

    state = rated.select("source", "budget", F.lit(0).cast("long").alias("threshold"), F.lit(0).cast("long").alias("had"))
    inside = slim
    for i in range(LEVELS):
        hist = attach(inside.groupBy("source", f"d{i}").agg(F.sum("size").alias("words")), state)
        run = W.partitionBy("source").orderBy(f"d{i}")
        hist = hist.withColumn("upto", F.col("had") + F.sum("words").over(run)).where(F.col("upto") > F.col("budget"))
        first = F.min(F.struct(F.col(f"d{i}").alias("d"), "words", "upto"))
        state = hist.groupBy("source", "budget", "threshold").agg(first.alias("b"))
        last = i == LEVELS - 1
        had = F.col("b.upto") - F.col("b.words")
        take = (F.col("b.upto") - F.col("budget") <= F.col("budget") - had).cast("long") if last else F.lit(0)
        state = state.select("source", "budget", (F.col("threshold") * BUCKETS + F.col("b.d") + take).alias("threshold"), had.alias("had"))
        if not last:
            state = materialize(state)
            code = F.lit(0).cast("long")
            for j in range(i + 1):
                code = code * BUCKETS + F.col(f"d{j}")
            inside = attach(slim, state.select("source", F.col("threshold").alias("edge"))).where(code == F.col("edge")).drop("edge")
    ends = rated.join(state.select(F.col("source").alias("_s"), "threshold"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    code = (F.col("d0").cast("long") * BUCKETS + F.col("d1")) * BUCKETS + F.col("d2")
    extra = F.coalesce((code < F.col("threshold")).cast("long"), F.lit(0))
    return attach(slim, ends.select("source", "source_size", "target", "whole", "threshold")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.least(F.col("whole") + extra, F.lit(MOST))).alias("taken"))


ORACLE = r"""
WITH slim AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'text:' || coalesce(text, ''))), 1, 9))::BIGINT AS code
  FROM {documents}),
sized AS (SELECT source, sum(size)::BIGINT AS source_size FROM slim GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][1 + ((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3] AS weight, 2 * source_size AS most FROM sized),
walked AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - ((sum(most) OVER climb) - most)::DOUBLE)
    / ((sum(weight) OVER ()) - (sum(weight) OVER climb) + weight)::DOUBLE AS level
  FROM weighed WINDOW climb AS (ORDER BY most::DOUBLE / weight::DOUBLE, source ASC NULLS LAST)),
opened AS (SELECT *, level * weight < most AS is_open FROM walked),
targets AS (
  SELECT source, source_size, CASE WHEN is_open THEN least(
      (first_value(level) OVER (ORDER BY CASE WHEN is_open THEN 0 ELSE 1 END, most::DOUBLE / weight::DOUBLE, source ASC NULLS LAST)) * weight, most::DOUBLE)
    ELSE most::DOUBLE END AS target
  FROM opened),
rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
budgets AS (SELECT *, target - whole * source_size AS budget FROM rated),
run AS (
  SELECT s.source, s.code, b.budget, sum(s.size)::BIGINT AS words, (sum(sum(s.size)) OVER (PARTITION BY s.source ORDER BY s.code))::BIGINT AS upto
  FROM slim s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source GROUP BY s.source, s.code, b.budget),
edge AS (
  SELECT source, min(code) AS code, arg_min(budget, code) AS budget, arg_min(words, code) AS words, arg_min(upto, code) AS upto FROM run WHERE upto > budget GROUP BY source),
ends AS (
  SELECT source, code + CASE WHEN upto - budget <= budget - (upto - words) THEN 1 ELSE 0 END AS threshold FROM edge)
SELECT s.doc_id, s.size, b.source_size, b.target,
  s.size * least(b.whole + CASE WHEN s.code < e.threshold THEN 1 ELSE 0 END, 2) AS taken
FROM slim s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source LEFT JOIN ends e ON s.source IS NOT DISTINCT FROM e.source
"""
