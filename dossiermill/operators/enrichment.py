"""Identities from a resolver table, and corrections from a corrections table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chemistry, text


def resolution_status(lookups: DataFrame) -> DataFrame:
    """(cas, n_candidates, status) from (cas, cid) candidates: not_found, resolved or
    ambiguous by the number of distinct ids; a null cid is a lookup without result."""
    counts = lookups.groupBy("cas").agg(F.count_distinct("cid").alias("n_candidates"))
    status = F.when(F.col("n_candidates") == 0, "not_found").when(F.col("n_candidates") == 1, "resolved").otherwise("ambiguous")
    return counts.withColumn("status", status)


def identity_warnings(components: DataFrame, resolver: DataFrame) -> DataFrame:
    """(doc, pos, cas, warning) of valid CAS numbers that the resolver (cas, name) does
    not know or knows under a name of which less than half the words agree."""
    valid = components.where(chemistry.cas_status(F.col("cas")) == "ok")
    known = resolver.select("cas", F.col("name").alias("known_name"))
    joined = valid.join(known, "cas", "left")
    unlike = F.col("name").isNotNull() & F.col("known_name").isNotNull() & ~text.names_similar(F.col("name"), F.col("known_name"))
    warning = F.when(F.col("known_name").isNull(), "not_found").when(unlike, "name_mismatch")
    return joined.select("doc", "pos", "cas", warning.alias("warning")).where("warning is not null")


def corrected_codes(codes: DataFrame, corrections: DataFrame) -> DataFrame:
    """(doc, pos, code, action, corrected) for unknown codes: the correction table is
    (doc, code, corrected, pos); the last entry for a code holds. A valid correction
    replaces, a null one deletes, an invalid or missing one keeps."""
    last = corrections.groupBy("doc", "code").agg(F.max_by(F.struct("corrected"), "pos").alias("c"))
    unknown = codes.where(~chemistry.known_h(F.col("code")))
    joined = unknown.join(last, ["doc", "code"], "left")
    new = F.col("c.corrected")
    action = F.when(F.col("c").isNull(), "keep").when(new.isNull(), "delete").when(chemistry.known_h(new), "replace").otherwise("keep")
    return joined.select("doc", "pos", "code", action.alias("action"), F.when(action == "replace", F.upper(new)).when(action == "keep", F.col("code")).alias("corrected"))


def merged_sections(a: DataFrame, b: DataFrame, key: str, sections: list[str]) -> DataFrame:
    """Two partial records of each document, the first that has a section wins."""
    right = b.select(key, *(F.col(s).alias(f"{s}__b") for s in sections))
    return a.select(key, *sections).join(right, key, "full").select(key, *(F.coalesce(s, f"{s}__b").alias(s) for s in sections))


def as_json_sections(column: Column) -> Column:
    return F.from_json(column, "map<string,string>")
