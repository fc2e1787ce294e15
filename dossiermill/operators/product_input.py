"""Checks of formulations before a document is drafted from them.

components: (product, pos, cas, name, exact, lower, upper, unit), one row a component.
The checks of a component are expressions on its row; what needs the whole product (a
number seen before, the sum of the exact values) is one window and one aggregate on the
product, which share its partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chemistry
from .rules import FINDING, Rule, findings

#: Exact concentrations may add up to this percentage.
TOLERATED_SUM = 102.0


def component_rules() -> list[Rule]:
    status = chemistry.cas_status(F.col("cas"))
    both = F.col("exact").isNotNull() & (F.col("lower").isNotNull() | F.col("upper").isNotNull())
    return [
        Rule("MED", "GEN-CAS-DUPLICATE", lambda: (status == "ok") & (F.col("nth") > 1), "CAS number more than once in the product"),
        Rule("HIGH", "GEN-CAS-FORMAT", lambda: status == "format", "CAS number of an unknown form"),
        Rule("HIGH", "GEN-CAS-CHECKDIGIT", lambda: status == "checkdigit", "CAS number with a wrong check digit"),
        Rule("MED", "GEN-CONC-NO-UNIT", lambda: F.coalesce(F.trim("unit"), F.lit("")) == "", "concentration without a unit"),
        Rule("MED", "GEN-CONC-AMBIGUOUS", lambda: both, "concentration with an exact value and a range"),
        Rule("HIGH", "GEN-CONC-RANGE-INVALID", lambda: F.coalesce(F.col("lower") > F.col("upper"), F.lit(False)), "lower bound above the upper bound"),
    ]


def checked_inputs(components: DataFrame) -> DataFrame:
    """(product, findings): those of the components in order, then that of the sum."""
    seen = Window.partitionBy("product", "cas").orderBy("pos")
    rows = components.withColumn("nth", F.row_number().over(seen)).withColumn("own", findings(component_rules()))
    per_product = rows.groupBy("product").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "own"))), lambda x: x["own"])).alias("own"), F.sum("exact").alias("total")
    )
    over = Rule("MED", "GEN-CONC-SUM-EXCEEDS-100", lambda: F.coalesce(F.round("total", 6) > TOLERATED_SUM, F.lit(False)), "exact concentrations add up to too much")
    return per_product.select("product", F.concat(F.col("own").cast(FINDING), over.findings()).alias("findings"))
