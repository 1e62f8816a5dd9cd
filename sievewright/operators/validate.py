"""Rules over rows and tables: violations, alerts, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds of operational alerts.
LAG_WARNING, LAG_CRITICAL, COLLAPSE, BASELINE, SPIKE, CLOSURES, DISK_WARNING, DISK_CRITICAL = 900, 1_800, 0.2, 10, 0.35, 10, 0.8, 0.9


def first_violation(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that a row breaks; null if it keeps all. Unknown is kept."""
    return F.coalesce(*[F.when(broken, F.lit(name)) for name, broken in rules])


def alerts(snapshot: DataFrame, keep: list[str]) -> DataFrame:
    """A row per alert of each snapshot: ``name, severity, observed, threshold``."""
    alert = lambda name, when, severity, observed, threshold: F.when(when, F.struct(F.lit(name).alias("name"), severity.alias("severity"), observed.cast("double").alias("observed"), F.lit(float(threshold)).alias("threshold")))
    lag, disk, critical = F.col("queue_lag"), F.col("disk_usage"), F.lit("critical")
    found = F.array_compact(
        F.array(
            alert("queue_lag", lag >= LAG_WARNING, F.when(lag >= LAG_CRITICAL, "critical").otherwise("warning"), lag, LAG_WARNING),
            alert("count_collapse", (F.col("count_baseline") >= BASELINE) & (F.col("count_ratio") <= COLLAPSE), critical, F.col("count_ratio"), COLLAPSE),
            alert("closure_spike", (F.col("closures") >= CLOSURES) & (F.col("closure_ratio") >= SPIKE), critical, F.col("closure_ratio"), SPIKE),
            alert("disk_pressure", disk >= DISK_WARNING, F.when(disk >= DISK_CRITICAL, "critical").otherwise("warning"), disk, DISK_WARNING),
            alert("ssrf_rejection", F.col("ssrf_rejections") >= 1, F.lit("warning"), F.col("ssrf_rejections"), 1),
        )
    )
    return snapshot.select(*keep, F.explode(found).alias("a")).select(*keep, "a.*")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def changed_payloads(log: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """Keys of an append-only log that stand for more than one payload."""
    return log.groupBy(*keys).agg(F.count_distinct(payload).alias("payloads")).where("payloads > 1")


def table_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Differences of two snapshots, a row per field: ``keys, field, change, old_value, new_value``."""
    fields = [c for c in old.columns if c not in keys]
    tall = lambda df, name: df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias(name), F.lit(True).alias(f"in_{name}")) for c in fields])).alias("x")).select(*keys, "x.*")
    both = tall(old, "old_value").join(tall(new, "new_value"), [*keys, "field"], "full_outer")
    change = F.when(F.col("in_old_value").isNull(), "added").when(F.col("in_new_value").isNull(), "removed").when(~F.col("old_value").eqNullSafe(F.col("new_value")), "changed")
    return both.withColumn("change", change).where("change is not null").select(*keys, "field", "change", "old_value", "new_value")


def event_schema(name: Column, keys: Column, required: dict[str, list[str]], optional: dict[str, list[str]], unsafe: str = "(?i)email|phone|token|password|secret") -> Column:
    """What is wrong with a product event: unknown name, unsafe, missing or unexpected keys; null if nothing."""
    out = F.lit("unknown_event")
    for kind, needed in required.items():
        wanted, allowed = F.array(*map(F.lit, needed)).cast("array<string>"), F.array(*map(F.lit, [*needed, *optional.get(kind, [])])).cast("array<string>")
        own = F.when(F.exists(keys, lambda k: k.rlike(unsafe)), "unsafe_property").when(F.size(F.array_except(wanted, keys)) > 0, "missing_property").when(F.size(F.array_except(keys, allowed)) > 0, "unexpected_property")
        out = F.when(name == kind, own).otherwise(out)
    return out
