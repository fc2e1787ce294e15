"""Structures of looked-up substances and formulas that are written in several ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import molecules
from ..operators import identities
from . import derived
from .queries import query


def _formula(*parts: tuple[str, Column | int]) -> Column:
    return F.concat(*(x for element, n in parts for x in (F.lit(element), (F.lit(n) if isinstance(n, int) else n).cast("string"))))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, pos, cas, cid, smiles, connectivity, formula): a line item's part decides the
    kind of its structure, its supplier how long the chain of carbon is."""
    li = derived.table(spark, sf_dir, "lineitem")
    kind, n = F.col("l_partkey") % 8, (1 + F.col("l_suppkey") % 12).cast("int")
    chain = F.expr("repeat('C', CAST(1 + l_suppkey % 12 AS INT))")
    smiles = (
        F.when(kind == 0, F.concat(chain, F.lit("O"))).when(kind == 1, F.concat(F.lit("c1ccccc1"), chain)).when(kind == 2, F.concat(F.lit("[Na+].[O-]C(=O)"), chain))
        .when(kind == 3, F.concat(chain, F.lit("[N+](C)(C)C"))).when(kind == 4, F.concat(F.lit("C1"), chain, F.lit("C1"))).when(kind == 5, F.concat(F.lit("C("), chain))
    )
    more = F.when(F.col("l_orderkey") % 5 == 0, 1).otherwise(0)
    formula = (
        F.when(kind == 0, _formula(("OH", 2 * n + 2 + more), ("C", n))).when(kind == 1, _formula(("C6H5(CH2)", n), ("H", 1 + more)))
        .when(kind == 2, _formula(("NaO2C", n + 1), ("H", 2 * n + 1 + more))).when(kind == 3, F.concat(_formula(("N(CH3)3C", n), ("H", 2 * n + 1 + more)), F.lit("+")))
        .when(kind == 4, _formula(("(CH2)", n + 2 + more))).when(kind == 6, F.when(more == 1, "unknown").otherwise(_formula(("H", 2 * n + 2), ("C", n))))
    )
    return li.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("pos"), F.lit("").alias("cas"), F.lit(1).alias("cid"), smiles.alias("smiles"), F.when(kind.isin(0, 6), chain).alias("connectivity"), formula.alias("formula"))


@query("""
WITH x AS (SELECT l_orderkey AS doc, l_linenumber AS pos, l_partkey % 8 AS kind, 1 + l_suppkey % 12 AS n, l_orderkey % 5 = 0 AS wrong FROM lineitem),
a AS (SELECT *, CASE kind WHEN 1 THEN n + 6 WHEN 2 THEN n + 1 WHEN 3 THEN n + 3 WHEN 4 THEN n + 2 ELSE n END AS c, CASE kind WHEN 0 THEN 2 * n + 2 WHEN 1 THEN 2 * n + 6 WHEN 2 THEN 2 * n + 1 WHEN 3 THEN 2 * n + 10 WHEN 4 THEN 2 * n + 4 ELSE 2 * n + 2 END AS h FROM x)
SELECT doc, pos, CASE kind WHEN 5 THEN 'invalid' WHEN 7 THEN 'missing' ELSE 'normalized' END AS structure,
  CASE WHEN kind NOT IN (5, 7) THEN 'C' || CASE WHEN c > 1 THEN c::VARCHAR ELSE '' END || 'H' || h || CASE kind WHEN 0 THEN 'O' WHEN 2 THEN 'NaO2' WHEN 3 THEN 'N+' ELSE '' END END AS calculated,
  CASE WHEN kind NOT IN (5, 7) THEN round(12.011::DOUBLE * c + 1.008::DOUBLE * h + CASE kind WHEN 0 THEN 15.999::DOUBLE WHEN 2 THEN 22.990::DOUBLE + 2 * 15.999::DOUBLE WHEN 3 THEN 14.007::DOUBLE ELSE 0 END, 3) END AS weight,
  CAST(CASE WHEN kind NOT IN (5, 7) THEN CASE kind WHEN 3 THEN 1 ELSE 0 END END AS INTEGER) AS charge, CAST(CASE WHEN kind NOT IN (5, 7) THEN CASE kind WHEN 2 THEN 2 ELSE 1 END END AS INTEGER) AS fragments,
  kind = 6 AS fallback, kind NOT IN (5, 7) AND wrong AS mismatch, kind = 2 OR kind NOT IN (5, 7) AND wrong AS review FROM a""")
def structure_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identities.normalized(candidates(spark, sf_dir)).select("doc", "pos", "structure", "calculated", "weight", "charge", "fragments", "fallback", "mismatch", "review")


@query("""
WITH x AS (SELECT l_orderkey AS doc, l_linenumber AS pos, l_partkey % 9 AS kind, 1 + l_suppkey % 12 AS n, 1 + l_orderkey % 3 AS m FROM lineitem)
SELECT doc, pos, CASE kind WHEN 0 THEN m = 1 WHEN 1 THEN n = m WHEN 2 THEN n = m WHEN 3 THEN n = m WHEN 4 THEN m = 2 WHEN 5 THEN n = m WHEN 6 THEN m = 2 WHEN 7 THEN n = 5 * m END AS same FROM x""")
def formula_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of formulas: a hydrate, brackets, a changed order, unreadable texts, charges,
    subscripts, a null."""
    li = derived.table(spark, sf_dir, "lineitem")
    kind, n, m = F.col("l_partkey") % 9, (1 + F.col("l_suppkey") % 12).cast("int"), (1 + F.col("l_orderkey") % 3).cast("int")
    sub = F.translate(n.cast("string"), "0123456789", "₀₁₂₃₄₅₆₇₈₉")
    pairs = [
        (_formula(("Ca(OH)", 2)), _formula(("CaO2H", m * 2))),
        (_formula(("Al2(SO4)", n)), _formula(("S", m), ("O", 4 * m), ("Al", 2))),
        (F.concat(F.lit("CuSO4·"), n.cast("string"), F.lit("H2O")), _formula(("H", 2 * m), ("CuSO", 4 + m))),
        (F.concat(F.lit("mixture "), n.cast("string")), F.concat(F.lit("mixture "), m.cast("string"))),
        (F.lit("SO4(2-)"), F.concat(F.lit("O4S"), F.repeat(F.lit("-"), m))),
        (F.concat(F.lit("H"), sub, F.lit("N")), _formula(("NH", m))),
        (F.lit("[Co(NH3)6]Cl3"), F.concat(F.lit("CoCl"), (m + 1).cast("string"), F.lit("N6H18"))),
        (_formula(("(C2H5)", n)), _formula(("(C", 10), ("H", 25), (")", m))),
        (F.lit("H2O"), F.lit(None).cast("string")),
    ]
    a, b = pairs[-1]
    for k, (x, y) in enumerate(pairs[:-1]):
        a, b = F.when(kind == k, x).otherwise(a), F.when(kind == k, y).otherwise(b)
    return li.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("pos"), a.alias("a"), b.alias("b")).select("doc", "pos", molecules.equivalent(F.col("a"), F.col("b")).alias("same"))
