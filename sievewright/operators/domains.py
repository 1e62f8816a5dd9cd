"""Registrable domains by suffix rules, and what a domain proves of its owner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Domains of board vendors, which are nobody's own.
SHARED = ("greenhouse.io", "lever.co", "ashbyhq.com")
NAME = r"^(?=.{1,253}$)([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\.)*[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?$"


def rules(lines: DataFrame, rule: str = "rule", section: str | None = None) -> DataFrame:
    """Suffix rules, one a row (``co.uk``, ``*.ck``, ``!www.ck``) -> ``suffix, kind, icann``; blank lines and comments are left out."""
    text = F.lower(F.trim(F.col(rule)))
    kind = F.when(text.startswith("!"), "exception").when(text.startswith("*."), "wildcard").otherwise("plain")
    icann = F.col(section).cast("boolean") if section else F.lit(True)
    told = lines.where((text != "") & ~text.startswith("//"))
    return told.select(F.regexp_replace(text, r"^(!|\*\.)", "").alias("suffix"), kind.alias("kind"), icann.alias("icann")).distinct()


def registrable(rows: DataFrame, host: str, suffixes: DataFrame) -> DataFrame:
    """Rows with ``suffix`` (the public suffix of their host), ``domain`` (the suffix and one label more; null if the host is a suffix) and ``icann``.

    Each suffix of a host is looked up by equality. An exception prevails, else the rule of most labels; where none matches, the last label is the suffix, and not of
    ICANN. A wildcard holds one label more than it names, an exception one less. Hosts that are no names (addresses, single labels that are empty) get nulls.
    """
    labels = F.split("_name", r"\.")
    known = rows.select(F.col(host).alias("_host")).distinct().withColumn("_name", F.lower(F.regexp_replace("_host", r"\.$", "")))
    known = known.where(F.col("_name").rlike(NAME) & ~F.col("_name").rlike(r"^[0-9.]+$")).withColumn("_labels", labels).withColumn("_all", F.size("_labels"))
    tried = known.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_all")))).withColumn("suffix", F.array_join(F.slice("_labels", F.col("_all") - F.col("_n") + 1, F.col("_n")), "."))
    found = tried.join(suffixes, "suffix")
    length = F.when(F.col("kind") == "wildcard", F.col("_n") + 1).when(F.col("kind") == "exception", F.col("_n") - 1).otherwise(F.col("_n"))
    found = found.withColumn("_length", length).where("_length <= _all")
    best = found.groupBy("_host").agg(F.max(F.struct((F.col("kind") == "exception").alias("e"), F.col("_length").alias("n"), "icann")).alias("_best"))
    told = known.join(best, "_host", "left").withColumn("_length", F.coalesce("_best.n", F.lit(1)))
    tail = lambda n: F.array_join(F.slice("_labels", F.col("_all") - n + 1, n), ".")
    told = told.select("_host", tail(F.col("_length")).alias("suffix"), F.when(F.col("_all") > F.col("_length"), tail(F.col("_length") + 1)).alias("domain"), F.coalesce("_best.icann", F.lit(False)).alias("icann"))
    return rows.join(told, F.col(host) == F.col("_host"), "left").drop("_host")


def below(host: Column, domain: Column) -> Column:
    """Whether a host is the domain or lies under it."""
    return (host == domain) | host.endswith(F.concat(F.lit("."), domain))


def shared(domain: Column) -> Column:
    """Whether a domain belongs to a board vendor."""
    out = F.lit(False)
    for known in SHARED:
        out = out | below(domain, F.lit(known))
    return out


def employer_domain_error(domain: Column, registrable_domain: Column, icann: Column, careers_host: Column, evidence_host: Column, synthetic: Column) -> Column:
    """Why a domain does not identify an employer, null if it does; synthetic data may use ``.test``."""
    own = F.coalesce(icann & (registrable_domain == domain), F.lit(False)) | (synthetic & domain.endswith(".test"))
    proved = F.coalesce(below(careers_host, domain) & below(evidence_host, domain), F.lit(False))
    return F.when(shared(domain), "shared_ats_domain_is_not_employer_identity").when(~own, "primary_domain_not_registrable").when(~proved, "ownership_evidence_domain_mismatch")
