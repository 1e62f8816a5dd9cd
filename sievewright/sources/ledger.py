"""The scan ledger: deliveries are judged, folded onto the tables of earlier commits, and made visible together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.operators import scans as fold
from sievewright.storage import TableSet, written

#: Commits after which the states of listings are written anew as one folder.
COMPACT = 16
#: Tables that only grow.
GROWING = ("scans", "observations", "versions", "assertions", "events")


class ScanLedger:
    """Tables ``scans, listings, versions, observations, assertions, events, sources`` below one folder.

    Each commit adds the whole state of the listings of the sources that it touched, under its number; ``sources`` names the number that holds
    for each source. Committing the same deliveries again changes nothing, so a batch of a stream may be run twice.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.tables = TableSet(spark, root)

    def table(self, name: str, manifest: dict | None = None) -> DataFrame | None:
        manifest = manifest or self.tables.manifest()
        df = self.tables.read(manifest, name)
        if name == "listings" and df is not None:
            df = df.join(self.tables.read(manifest, "sources").select("source", "commit"), ["source", "commit"], "left_semi")
        return df

    def commit(self, deliveries: DataFrame, observations: DataFrame, leases: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
        """Fold what is accepted and publish it; returns every delivery with its ``outcome``."""
        manifest = self.tables.manifest()
        prior = {name: self.table(name, manifest) for name in ("scans", "versions", "listings", "sources")}
        told = written(fold.judged(fold.delivered(deliveries, observations), prior["scans"], leases, known))
        accepted = told.where("outcome = 'accepted'").drop("outcome")
        if accepted.isEmpty():
            return told
        prior = {name: df.drop("commit") if name in ("listings", "sources") and df is not None else df for name, df in prior.items()}
        new = fold.fold(accepted, observations, prior)
        number = F.lit(manifest["version"] + 1).cast("long")
        touched = accepted.select("source").distinct()
        append = {name: new[name] for name in GROWING}
        listings = new["listings"].withColumn("commit", number)
        sources = new["sources"].join(touched.withColumn("_touched", F.lit(True)), "source", "left")
        if self.table("sources", manifest) is not None:
            sources = sources.join(self.table("sources", manifest).select("source", F.col("commit").alias("_commit")), "source", "left")
            sources = sources.withColumn("commit", F.when(F.col("_touched"), number).otherwise(F.col("_commit"))).drop("_commit", "_touched")
        else:
            sources = sources.withColumn("commit", number).drop("_touched")
        replace = {"sources": sources}
        held = manifest["tables"].get("listings", {"paths": []})["paths"]
        if len(held) < COMPACT:
            append["listings"] = listings
        else:
            replace["listings"] = listings.unionByName(self.table("listings", manifest).join(touched, "source", "left_anti"))
        self.tables.commit(manifest, append, replace)
        return told

    def clear(self, chosen: F.Column, connector: bool = False) -> None:
        """Clear the breakers of the chosen sources, or of their connectors."""
        manifest = self.tables.manifest()
        self.tables.commit(manifest, {}, {"sources": fold.clear(self.tables.read(manifest, "sources"), chosen, connector)})

    def stream(self, deliveries: DataFrame, observations_of: str, checkpoint: str):
        """A stream of deliveries whose observations lie in the array column ``observations_of``: each micro-batch is one commit."""

        def step(batch: DataFrame, _: int) -> None:
            rows = written(batch)
            seen = rows.select("scan_id", F.explode(observations_of).alias("o")).select("scan_id", "o.*")
            self.commit(rows.drop(observations_of), seen)

        return deliveries.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
