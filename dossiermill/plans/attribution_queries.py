"""Which features of the documents their scores are attributed to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import attribution, reports
from . import derived, grading
from .queries import GRADED, query

FEATURES = ["lang_ja", "lang_zh_cn", "lang_zh_tw", "lang_en", "text_length_chars", "cas_count_in_source", "h_code_count_in_source", "un_count_in_source", "cas_coverage"]


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, FEATURES, overall_score): what the components of a document count up to. The
    coverage is the share of valid numbers; without components counts are zero."""
    ok, stated = F.count_if(F.col("status") == "ok"), F.count_if(F.col("cas") != "")
    docs = grading.graded(
        spark, sf_dir, text_length_chars=F.sum(F.length("cas") + F.length(F.coalesce("name", F.lit("")))), cas_count_in_source=stated,
        # not count_distinct, which writes every component out three times
        h_code_count_in_source=F.size(F.collect_set("h_code")), un_count_in_source=F.size(F.collect_set("un")), cas_coverage=F.try_divide(ok, stated),
    )
    langs = {f"lang_{name.replace('-', '_')}": (F.col("lang") == name).cast("int") for name in derived.LANGS}
    return docs.withColumns(langs).select("doc", *FEATURES, F.col("score").alias("overall_score"))


@query()
def causal_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean absolute values of the features and their deviation over three seeds."""
    values = attribution.explained(features(spark, sf_dir), "doc", FEATURES, "overall_score", seeds=(42, 43, 44))
    return reports.attribution(values, attribution.TIMES)


@query(GRADED + f""", b AS (SELECT avg(high) AS high, avg(med) AS med, avg(CASE WHEN lang = 'ja' THEN 1 ELSE 0 END) AS ja FROM (SELECT * FROM graded ORDER BY md5(CAST(doc AS VARCHAR)), doc LIMIT {attribution.BACKGROUND}))
SELECT doc, unnest(['lang_ja', 'high_count', 'medium_count']) AS feature, round(unnest([0.0::DOUBLE, -8 * (g.high - b.high), -1.5 * (g.med - b.med)]), 6) AS value FROM graded g, b""")
def score_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's penalties, attributed to its findings; the language adds none."""
    names = ["lang_ja", "high_count", "medium_count"]
    docs = grading.graded(spark, sf_dir).select("doc", (F.col("lang") == "ja").cast("int").alias("lang_ja"), F.col("high").alias("high_count"), F.col("med").alias("medium_count"))
    found = attribution.attributed(docs, "doc", names, lambda x: 100 - 8 * x[:, 1] - 1.5 * x[:, 2], attribution.background_of(docs, "doc", names))
    # plus zero: no negative zeros
    return found.select("doc", "feature", (F.round("value", 6) + F.lit(0.0)).alias("value"))
