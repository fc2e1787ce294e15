"""Reports over a corpus: what a rendering kept of its records, which features a failure
is attributed to, and the names that files get."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def retention_by_section(scores: DataFrame) -> DataFrame:
    """(section, n, retention): the mean score of the section's values. ``scores`` is (doc,
    section, full_text, score), one row a value; values too short to look for have no
    score and do not count."""
    return scores.where("score is not null").groupBy("section").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("retention"))


def retention_by_file(scores: DataFrame) -> DataFrame:
    """(doc, n, retention, full_text_retention): zero for a file without scores, null for
    one without scored running text."""
    own = F.when(F.col("full_text"), F.col("score"))
    return scores.groupBy("doc").agg(F.count("score").alias("n"), F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 6).alias("retention"), F.round(F.avg(own), 6).alias("full_text_retention"))


def retention_summary(files: DataFrame) -> DataFrame:
    """One row over the files: their number, mean retentions, and the best and the worst
    file, of equal ones the one with the least name."""
    best, worst = F.min(F.struct(-F.col("retention"), "doc")), F.min(F.struct("retention", "doc"))
    means = (F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("retention", "full_text_retention"))
    return files.agg(F.count("*").alias("n_docs"), *means, best["doc"].alias("best"), worst["doc"].alias("worst"))


def attribution(values: DataFrame, times: str | None = None) -> DataFrame:
    """(feature, mean_abs, std_abs) over the seeds' mean absolute values. ``values`` is
    (seed, feature, value), one row for a document and feature, or for as many documents as
    its column ``times`` says; a missing value is zero. The deviation is that of a sample,
    null for one seed."""
    size = F.abs(F.coalesce("value", F.lit(0.0)))
    by_seed = values.groupBy("seed", "feature").agg((F.avg(size) if times is None else F.sum(size * F.col(times)) / F.sum(times)).alias("m"))
    return by_seed.groupBy("feature").agg(F.round(F.avg("m"), 6).alias("mean_abs"), F.round(F.stddev_samp("m"), 6).alias("std_abs"))


def numbered_names(files: DataFrame, ranges: int = 64) -> DataFrame:
    """``files`` (path, name, ...) with ``file_name``: the name, and from the second file
    of a name on its number behind it, ``_001`` and so on. Files of a name are numbered by
    the MD5 of their paths, then path. Each name is cut into ``ranges`` of the hash, so one
    that most files share is not in one task. A path is taken to occur once."""
    rows = files.withColumn("_order", F.md5(F.coalesce("path", F.lit(""))))
    rows = rows.withColumn("_range", F.floor(F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") * ranges / F.lit(1 << 32)).cast("int"))
    before = Window.partitionBy("name").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("name", "_range").count().withColumn("_base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = Window.partitionBy("name", "_range").orderBy("_order", "path")
    number = F.col("_base") + F.row_number().over(within) - 1
    named = rows.join(sizes, ["name", "_range"]).withColumn("_number", number)
    file_name = F.when(F.col("_number") > 0, F.format_string("%s_%03d", "name", "_number")).otherwise(F.col("name"))
    return named.select(*files.columns, file_name.alias("file_name"))
