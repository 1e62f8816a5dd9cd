"""Structured Streaming twins of the stateful operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType

from sievewright.operators.lifecycle import SEPARATION
from sievewright.plans.shared import shared_folder


def read_events(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    """A table's file as a stream, its time without zone as event time."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process what is there and return what was written (append) or the last state (update), as a table."""
    spark = stream.sparkSession
    out = shared_folder(spark)
    # a batch that is run again after a failure replaces what it wrote before
    write = lambda df, n: df.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/data/batch={n}")
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    schema = stream.schema.add("_batch", IntegerType())
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{out}/data")


def deduplicated(stream: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """The first event of each key, repeats within the watermark dropped."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, window: str, slide: str | None = None, delay: str = "1 hour", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Events and approximate distinct users of tumbling or sliding windows, late events within the delay counted."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return stream.withWatermark("ts", delay).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("events"), F.approx_count_distinct("user_id").alias("users")).select(F.col("w.start").alias("start"), *keys, "events", "users")


def lifecycle_states(scans: DataFrame, separation: int = SEPARATION) -> DataFrame:
    """``scans(listing, at, seen)`` as a stream -> every state after a scan: ``listing, at, status, misses``.

    State per listing: status, misses and the first miss. Scans of a listing in one batch are taken in order of time;
    a scan older than the last one taken is late and fenced off.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, misses, since, last = state.get if state.exists else ("new", 0, 0, -1)
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        out = []
        for at, seen in zip(rows["at"], rows["seen"]):
            now = int(at.value // 1_000)
            if now < last:
                continue
            last = now
            if seen:
                status, misses, since = "active", 0, 0
            elif status == "active":
                status, misses, since = "possibly_closed", 1, now
            elif status == "possibly_closed":
                misses += 1
                if now - since >= separation * 1_000_000:
                    status = "closed"
            if status != "new":
                out.append((key[0], at, status, misses))
        state.update((status, misses, since, last))
        yield pd.DataFrame(out, columns=["listing", "at", "status", "misses"])

    return scans.groupBy("listing").applyInPandasWithState(step, "listing bigint, at timestamp, status string, misses int", "status string, misses int, since bigint, last bigint", "append", GroupStateTimeout.NoTimeout)
