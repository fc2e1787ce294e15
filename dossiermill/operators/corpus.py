"""Corpus metrics over scored documents and their findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring


def scored(docs: DataFrame, profile: str = "py") -> DataFrame:
    """``docs`` (findings, ...) with crit, high, med, low, score and grade."""
    n = {k.lower(): scoring.of_level(F.col("findings"), k) for k in ("CRIT", "HIGH", "MED", "LOW")}
    out = docs.withColumns(n)
    points = scoring.score(F.col("crit"), F.col("high"), F.col("med"), F.col("low"), profile)
    return out.withColumn("score", points).withColumn("grade", scoring.grade(F.col("score"), F.col("crit"), F.col("high")))


def summary(docs: DataFrame) -> DataFrame:
    """One row: documents, mean score, grades and severities."""
    grades = [F.count_if(F.col("grade") == g).alias(f"grade_{g.lower()}") for g in "ABCD"]
    sums = [F.sum(k).cast("long").alias(f"n_{k}") for k in ("crit", "high", "med")]
    return docs.agg(F.count("*").alias("n_docs"), F.round(F.avg("score"), 6).alias("mean_score"), *grades, *sums)


def grade_summary(docs: DataFrame) -> DataFrame:
    return docs.groupBy("grade").agg(F.count("*").alias("n_docs"), F.round(F.avg("score"), 6).alias("mean_score"), F.sum("high").cast("long").alias("n_high"), F.sum("med").cast("long").alias("n_med"))


def failures_by_rule(facts: DataFrame, key: str) -> DataFrame:
    """(rule, level, n, n_docs): the level is that of the first document with it.
    ``facts`` is (key, level, rule, ...)."""
    return facts.groupBy("rule").agg(F.min_by("level", F.struct(key, "level")).alias("level"), F.count("*").alias("n"), F.count_distinct(key).alias("n_docs"))


def failures_by_section(by_rule: DataFrame, profile: str = "compat") -> DataFrame:
    """(section, n) over S1 to S16. In the compat profile a section has every rule
    whose name starts with it, so S1 has those of S10 to S16 too; in the fixed
    profile the number has to end there. Other rules belong to no section."""
    names = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: F.concat(F.lit("S"), i.cast("string")))
    own = F.regexp_extract("rule", "^(S[0-9]+)", 1)
    of = F.filter(names, lambda s: F.startswith(F.col("rule"), s)) if profile == "compat" else F.filter(names, lambda s: s == own)
    return by_rule.withColumn("section", F.explode(of)).groupBy("section").agg(F.sum("n").cast("long").alias("n"))


def severities_by(docs: DataFrame, group: str, supplier: str) -> DataFrame:
    sums = [F.sum(k).cast("long").alias(f"n_{k}") for k in ("crit", "high", "med")]
    return docs.groupBy(group).agg(F.count("*").alias("n_docs"), F.count_distinct(supplier).alias("n_suppliers"), *sums)


def badness(crit: Column, high: Column, med: Column) -> Column:
    return 100 * crit + 10 * high + med


def worst(docs: DataFrame, group: str, n: int) -> DataFrame:
    """The ``n`` groups with the greatest weighted number of findings."""
    total = F.sum(badness(F.col("crit"), F.col("high"), F.col("med"))).cast("long")
    return docs.groupBy(group).agg(total.alias("badness"), F.count("*").alias("n_docs")).orderBy(F.desc("badness"), group).limit(n)


def rule_frequency(facts: DataFrame, key: str, total: DataFrame, supplier: str) -> DataFrame:
    """(rule, n, n_docs, n_suppliers, percent) of the documents that have each rule;
    ``total`` is one row with the number of documents."""
    counts = facts.groupBy("rule").agg(F.count("*").alias("n"), F.count_distinct(key).alias("n_docs"), F.count_distinct(supplier).alias("n_suppliers"))
    share = F.round(100.0 * F.col("n_docs") / F.col("_total"), 6)
    return counts.join(F.broadcast(total.toDF("_total"))).withColumn("percent", share).drop("_total")


def features(docs: DataFrame) -> DataFrame:
    """The numeric projection that attribution models read, with the failure flag:
    a document fails below grade B."""
    return docs.withColumn("quality_fail", (~F.col("grade").isin("A", "B")).cast("int"))
