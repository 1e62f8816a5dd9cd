"""Schema steps: ordered, checked, applied once, and recorded beside the tables that they change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievewright.storage import TableSet

NAME = r"^(\d{4})_[a-z0-9_]+\.sql$"
# What a step must not say.
PROHIBITED = (r"(?i)\bALTER\s+SYSTEM\b", r"(?i)\bCREATE\s+DATABASE\b", r"(?i)\bDROP\s+DATABASE\b", r"(?is)\bCOPY\b.*\bPROGRAM\b", r"(?m)^\s*\\!", r"(?i)\b(BEGIN|COMMIT|ROLLBACK)\s*;")


class StepRefused(RuntimeError):
    """A step is malformed, missing, or not what was applied."""


def read_steps(spark: SparkSession, folder: str) -> DataFrame:
    """``name, content`` of the files of a folder but its README."""
    files = spark.read.text(folder, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias("content"))
    return files.where("name <> 'README.md'")


def step_failures(steps: DataFrame) -> DataFrame:
    """``steps(name, content)`` -> ``name, failure``: names of another form, empty or prohibited content, and gaps: the n-th step in order of names has number n."""
    number = F.try_to_number(F.regexp_extract("name", NAME, 1), F.lit("9999")).cast("int")
    told = F.lit(False)
    for pattern in PROHIBITED:
        told = told | F.col("content").rlike(pattern)
    named = F.col("name").rlike(NAME)
    # steps are few: a table of names, not data
    placed = steps.withColumn("_n", F.when(named, F.row_number().over(W.partitionBy(named).orderBy("name"))))
    failures = F.array_compact(
        F.array(
            F.when(~named, F.lit("malformed_name")),
            F.when(F.trim(F.regexp_replace(F.coalesce("content", F.lit("")), r"\s+", " ")) == "", F.lit("empty")),
            F.when(told, F.lit("prohibited")),
            F.when(named & (number != F.col("_n")), F.concat(F.lit("out_of_sequence:"), F.lpad(F.col("_n").cast("string"), 4, "0"))),
        )
    )
    return placed.select("name", F.explode(failures).alias("failure"))


def step_states(steps: DataFrame, recorded: DataFrame) -> DataFrame:
    """``steps(name, content)``, ``recorded(name, checksum)`` -> ``name, state``: ``applied``, ``pending``, ``checksum_mismatch``, or ``unknown`` for what was applied and is there no more."""
    both = steps.select("name", F.sha2("content", 256).alias("now")).join(recorded.select("name", F.col("checksum").alias("then")), "name", "full_outer")
    state = F.when(F.col("now").isNull(), "unknown").when(F.col("then").isNull(), "pending").when(F.col("now") == F.col("then"), "applied").otherwise("checksum_mismatch")
    return both.select("name", state.alias("state"))


class SchemaLedger:
    """Steps over the tables of a :class:`TableSet`. A step's lines ``table := query`` make or replace tables; a query reads tables by ``{name}``.

    All pending steps are one commit, with the ledger's rows in it: tables and ledger are seen together or not at all, and of two that apply at once one fails.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.tables = spark, TableSet(spark, root)

    def recorded(self) -> DataFrame:
        found = self.tables.read(self.tables.manifest(), "schema_steps")
        return found if found is not None else self.spark.createDataFrame([], "name string, checksum string, applied_at timestamp")

    def apply(self, steps: DataFrame) -> tuple[list[str], list[str]]:
        """Apply what is pending, in order of names; returns the names applied now and those applied before."""
        failures = [f"{r.name}: {r.failure}" for r in step_failures(steps).orderBy("name").collect()]
        manifest = self.tables.manifest()
        ledger = self.tables.read(manifest, "schema_steps")
        states = {r["name"]: r.state for r in step_states(steps, self.recorded()).collect()}
        failures += [f"{n}: {s}" for n, s in sorted(states.items()) if s in ("unknown", "checksum_mismatch")]
        if failures:
            raise StepRefused("; ".join(failures))
        pending = sorted(n for n, s in states.items() if s == "pending")
        if pending:
            made: dict[str, DataFrame] = {}
            texts = {r["name"]: r.content for r in steps.where(F.col("name").isin(pending)).collect()}
            for name in pending:
                for target, text in _statements(texts[name]):
                    made[target] = self.spark.sql(text, **self._seen(manifest, made, text))
            rows = steps.where(F.col("name").isin(pending)).select("name", F.sha2("content", 256).alias("checksum"), F.current_timestamp().alias("applied_at"))
            self.tables.commit(manifest, {"schema_steps": rows} if ledger is not None else {}, made | ({} if ledger is not None else {"schema_steps": rows}))
        return pending, sorted(n for n, s in states.items() if s == "applied")

    def _seen(self, manifest: dict, made: dict[str, DataFrame], text: str) -> dict[str, DataFrame]:
        known = {n: made.get(n) if n in made else self.tables.read(manifest, n) for n in {*manifest["tables"], *made}}
        return {n: df for n, df in known.items() if "{" + n + "}" in text}


def _statements(content: str) -> list[tuple[str, str]]:
    out = []
    for line in filter(str.strip, content.split(";")):
        target, found, text = line.partition(":=")
        if not found or not target.strip().isidentifier():
            raise StepRefused(f"no target: {line.strip()[:80]}")
        out.append((target.strip(), text.strip()))
    return out
