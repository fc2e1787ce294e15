"""Files that a run leaves behind: manifests and findings as JSON lines, reports as CSV,
results in folders. Every sink is a Spark write, so rows have no order across files and
a run that fails leaves no half-written table; only reports, which are aggregates of a
bounded size, go into a single file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: What a manifest says of a file.
MANIFEST = "source_url string, sha256 string, lang string, file_type string, file_size_bytes long, robots_allowed boolean, redistribution_allowed boolean, public_export_allowed boolean, notes string"


def read_manifest(spark: SparkSession, path: str, schema: str | StructType = MANIFEST) -> DataFrame:
    """The entries of a manifest; blank lines and lines that are no JSON are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_manifest(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def without_entries(manifest: DataFrame, sha256_prefix: str) -> DataFrame:
    """The manifest without the entries whose hash starts so; an entry without a hash
    counts as one of an empty hash. Write it to a new folder: what it reads is the old one."""
    return manifest.where(~F.startswith(F.coalesce("sha256", F.lit("")), F.lit(sha256_prefix)))


def write_findings(facts: DataFrame, path: str, force: bool = False) -> None:
    """One JSON line a finding; an existing folder is an error unless ``force`` is set."""
    facts.write.mode("overwrite" if force else "errorifexists").json(path)


def write_report(report: DataFrame, path: str, order: list[str], force: bool = False) -> None:
    """A report of a few rows as one CSV file with a header, in the given order."""
    report.orderBy(*order).coalesce(1).write.mode("overwrite" if force else "errorifexists").option("header", True).csv(path)


def write_trees(results: DataFrame, path: str, columns: list[str], key: str = "doc", force: bool = False) -> None:
    """A folder for each of the ``columns`` (extracted text, generated record, validation
    report and so on) with (key, column) of the rows that have it."""
    for name in columns:
        kept = results.select(key, name).where(F.col(name).isNotNull())
        kept.write.mode("overwrite" if force else "errorifexists").parquet(f"{path}/{name}")
