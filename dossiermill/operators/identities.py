"""What looking up the components' CAS numbers says about their identities.

candidates: (cas, cid, formula, structure, calculated, fragments), one row a candidate
that a resolver returned; ``structure`` is ``missing``, ``invalid`` or ``normalized``,
``calculated`` the formula of the normalized structure and ``fragments`` the number of
its parts. errors: (cas, message), one row or more a lookup that failed. Both are one
aggregate on the number, so components meet one row each; a number that very many
components have is a skewed side of a plain join, which adaptive execution splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chemistry, molecules

CANDIDATE = ("formula", "structure", "calculated", "fragments")


def outcomes(candidates: DataFrame, errors: DataFrame) -> DataFrame:
    """(cas, outcome, formula, structure, calculated, fragments, message): ``resolved`` by
    one id, ``ambiguous`` with several, ``not_found`` with none, ``error`` if the lookup
    failed. Candidates that repeat an id count once; the columns of a candidate are null
    unless it is the only one."""
    best = F.struct("cid", *CANDIDATE)
    found = candidates.groupBy("cas").agg(F.min("cid").alias("_low"), F.max("cid").alias("_high"), F.max_by(best, best).alias("_one"))
    failed = errors.groupBy("cas").agg(F.min(F.coalesce("message", F.lit(""))).alias("message"))
    both = found.join(failed, "cas", "full")
    single = F.col("_low") == F.col("_high")
    outcome = F.when(F.col("message").isNotNull(), "error").when(single, "resolved").when(F.col("_low").isNull(), "not_found").otherwise("ambiguous")
    rows = both.withColumn("outcome", outcome)
    return rows.select("cas", "outcome", *(F.when(F.col("outcome") == "resolved", F.col(f"_one.{c}")).alias(c) for c in CANDIDATE), "message")


def normalized(candidates: DataFrame) -> DataFrame:
    """``candidates`` (cas, cid, smiles, connectivity, formula) with what their structures
    say: ``structure``, ``calculated`` formula, ``weight``, ``charge``, ``fragments``, whether
    the connectivity had to do for a missing full SMILES text (``fallback``), ``mismatch``
    (the formulas count other atoms) and ``review`` (a mismatch or several parts). Blank
    texts are texts, and no structures."""
    source = molecules.preferred(F.col("smiles"), F.col("connectivity"))
    rows = candidates.withColumn("_s", molecules.read_structure(source))
    structure = F.when(source.isNull(), "missing").when(F.col("_s.formula").isNull(), "invalid").otherwise("normalized")
    rows = rows.select(
        *candidates.columns, structure.alias("structure"), F.col("_s.formula").alias("calculated"), F.col("_s.weight").alias("weight"), F.col("_s.charge").alias("charge"),
        F.col("_s.fragments").alias("fragments"), (F.col("smiles").isNull() & F.col("connectivity").isNotNull()).alias("fallback"),
    )
    rows = rows.withColumn("mismatch", F.coalesce(~molecules.equivalent(F.col("formula"), F.col("calculated")), F.lit(False)))
    return rows.withColumn("review", F.col("mismatch") | F.coalesce(F.col("fragments") > 1, F.lit(False)))


def identified(components: DataFrame, known: DataFrame) -> DataFrame:
    """``components`` (doc, pos, cas) with the outcome of their lookups and the formula to
    publish: none if the structure's own formula is another one."""
    rows = components.select("doc", "pos", "cas").join(known, "cas", "left").withColumn("mismatch", _parsed() & F.coalesce(~molecules.equivalent(F.col("formula"), F.col("calculated")), F.lit(False)))
    return rows.withColumn("published_formula", F.when(~F.col("mismatch"), F.col("formula")))


def _parsed() -> Column:
    return F.coalesce(F.col("structure") == "normalized", F.lit(False))


def identity_findings(rows: DataFrame) -> DataFrame:
    """(doc, pos, cas, level, rule) of ``rows`` as ``identified`` returns them. Numbers of a
    wrong form have their own finding and none for lacking data or a failed lookup."""
    valid = chemistry.cas_status(F.col("cas")) == "ok"
    outcome = F.coalesce("outcome", F.lit("not_found"))
    rules = (
        ("LOW", "GEN-CAS-ENRICHMENT-MISSING", valid & (outcome != "resolved")),
        ("HIGH", "GEN-CAS-AMBIGUOUS", outcome == "ambiguous"),
        ("LOW", "GEN-STRUCTURE-MISSING", F.col("structure") == "missing"),
        ("MED", "GEN-STRUCTURE-INVALID", F.col("structure") == "invalid"),
        ("HIGH", "GEN-STRUCTURE-FORMULA-MISMATCH", F.col("mismatch")),
        ("MED", "GEN-STRUCTURE-MULTIFRAGMENT", _parsed() & (F.col("fragments") > 1)),
        ("MED", "GEN-CAS-LOOKUP-ERROR", valid & (outcome == "error")),
    )
    found = F.array_compact(F.array(*(F.when(when, F.struct(F.lit(level).alias("level"), F.lit(rule).alias("rule"))) for level, rule, when in rules)))
    return rows.select("doc", "pos", "cas", F.explode(found).alias("f")).select("doc", "pos", "cas", "f.*")
