"""Corpus manifests: statistics, audit and deduplication; and stratified samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"0[0-9]{1,4}-[0-9]{1,4}-[0-9]{3,4}"


def stats(manifest: DataFrame) -> DataFrame:
    """Documents and bytes by language, by type and in all, in one pass."""
    sets = manifest.groupingSets([["lang"], ["file_type"], []], "lang", "file_type")
    return sets.agg(F.count("*").alias("n"), F.sum("file_size_bytes").cast("long").alias("n_bytes")).select("lang", "file_type", "n", "n_bytes")


def audit(manifest: DataFrame) -> DataFrame:
    """(sha256, issues): permission and privacy warnings, entries without any left out."""
    note = F.coalesce("notes", F.lit(""))
    checks = [
        (~F.coalesce("robots_allowed", F.lit(False)), "robots not allowed"),
        (F.col("public_export_allowed") & ~F.col("redistribution_allowed"), "export without redistribution"),
        (note.rlike(EMAIL) | F.col("source_url").rlike(EMAIL), "e-mail address"),
        (note.rlike(PHONE), "phone number"),
    ]
    issues = F.array_compact(F.array(*(F.when(c, F.lit(m)) for c, m in checks)))
    return manifest.select("sha256", issues.alias("issues")).where(F.size("issues") > 0)


def new_entries(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Entries whose URL and content the manifest lacks, one for each content (that of
    the smallest URL)."""
    fresh = found.join(manifest.select("source_url"), "source_url", "left_anti").join(manifest.select("sha256"), "sha256", "left_anti")
    columns = [c for c in fresh.columns if c != "sha256"]
    first = fresh.groupBy("sha256").agg(F.min_by(F.struct(*columns), "source_url").alias("row"))
    return first.select("sha256", "row.*")


def stratified(docs: DataFrame, group: str, stratum: str, n: int, order: Column) -> DataFrame:
    """One document of each group, then of each stratum its share of ``n`` (at least
    one, rounded half to even), both by the least ``order``, a hash that makes the
    sample repeatable."""
    one = docs.groupBy(group).agg(F.min_by(F.struct(*docs.columns), F.struct(order, *(F.col(c) for c in docs.columns if c != group))).alias("row")).select("row.*")
    sizes = one.groupBy(stratum).agg(F.count("*").alias("_size"))
    total = one.agg(F.count("*").alias("_total"))
    quota = sizes.crossJoin(total).select(stratum, F.greatest(F.lit(1), F.bround(F.col("_size") * n / F.col("_total"), 0)).cast("int").alias("_quota"))
    # no quota is above n: with the bound beside the window, each task sends on the first n
    # of a stratum only, however few strata there are
    ranked = one.withColumn("_rank", F.row_number().over(Window.partitionBy(stratum).orderBy(order, group))).where(F.col("_rank") <= max(1, n))
    return ranked.join(quota, stratum).where("_rank <= _quota").select(*docs.columns)
