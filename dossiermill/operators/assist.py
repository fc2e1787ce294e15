"""Proposed field values, accepted only with a verbatim excerpt of the source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

# The fields that proposals may fill.
ALLOWED_PATHS = [
    "FirstAidMeasures.ExposureRoute.FirstAidInhalation.FullText",
    "FirstAidMeasures.ExposureRoute.FirstAidSkin.FullText",
    "FirstAidMeasures.ExposureRoute.FirstAidEye.FullText",
    "FirstAidMeasures.ExposureRoute.FirstAidIngestion.FullText",
    "FirstAidMeasures.DescriptionOfFirstAidMeasures.FullText",
    "FirstAidMeasures.InformationToHealthProfessionals.FullText",
    "FirstAidMeasures.MedicalAttentionAndSpecialTreatmentNeeded.FullText",
]
EMPTY_PHRASES = ["none", "no data available"]


def content_free(value: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.trim(value), "[.。]$", ""))).isin(EMPTY_PHRASES)


def proposal_id(source_sha256: Column, path: Column, excerpt: Column, value: Column) -> Column:
    joined = F.concat_ws("\0", source_sha256, path, excerpt, F.to_json(F.struct(value.alias("v"))))
    return F.concat(F.lit("assist-"), F.substring(F.sha2(joined, 256), 1, 12))


def verified(candidates: DataFrame) -> DataFrame:
    """``candidates`` (path, value, excerpt, source) with ``rejection``, the first of the
    reasons in order that holds (null if accepted), and an ``id`` for the accepted."""
    reason = (
        F.when(~F.col("path").isin(ALLOWED_PATHS), "path_not_allowed")
        .when(F.coalesce(F.trim("value"), F.lit("")) == "", "blank_value")
        .when(content_free(F.col("value")), "content_free_value")
        .when(F.coalesce(F.trim("excerpt"), F.lit("")) == "", "blank_excerpt")
        .when(~F.coalesce(text.verified_excerpt(F.col("source"), F.col("excerpt")), F.lit(False)), "excerpt_not_found")
    )
    out = candidates.withColumn("rejection", reason)
    sha = F.sha2(F.coalesce("source", F.lit("")), 256)
    return out.withColumn("id", F.when(reason.isNull(), proposal_id(sha, F.col("path"), F.col("excerpt"), F.col("value"))))
