"""Values of a record that its source text does not have: names, CAS numbers, and names
in a script that the source never uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chemistry, text

#: (section, field) of the values that are looked for, by what kind of value they are.
FIELDS = {
    "TradeNameJP": (1, "product"), "TradeNameEN": (1, "product"), "CompanyName": (1, "company"),
    "CASno": (3, "cas"), "IupacName": (3, "substance"), "GenericName": (3, "substance"),
}
#: Substance names of fewer bytes are not looked for.
LEAST_NAME = 3


def unverified(values: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """(key, section, field, pos, value, problem) of ``values`` (key, field, pos, value,
    corrected) that the text in ``sources`` (key, source) does not bear out:
    ``not_found``, or ``foreign_script`` for names with kana where the source has none.
    CAS numbers count if they are valid and not ``corrected``; placeholders and company
    names are not looked for. Null values have no row, nor have keys without a source;
    fields that are not in ``FIELDS`` and null sources have none either.

    Sources are normalized once each, before the one join by key."""
    kinds = F.create_map(*(F.lit(x) for f, (_, kind) in FIELDS.items() for x in (f, kind)))
    numbers = F.create_map(*(F.lit(x) for f, (section, _) in FIELDS.items() for x in (f, section)))
    source = F.col("source")
    ready = sources.select(key, "source", text.normalized_for_search(source).alias("_plain"), text.has_kana(source).alias("_kana"))
    rows = values.where(F.col("value").isNotNull()).withColumn("_kind", kinds[F.col("field")]).join(ready, key)
    return rows.select(key, numbers[F.col("field")].alias("section"), "field", "pos", "value", F.explode(_problems()).alias("problem"))


def _problems() -> Column:
    value, source, plain, kind = (F.col(c) for c in ("value", "source", "_plain", "_kind"))
    absent = ~text.is_placeholder(value) & ~text.source_contains_name(source, value, plain)
    long_enough = F.octet_length(text._trimmed(value)) >= LEAST_NAME
    wrong_cas = (chemistry.cas_status(value) == "ok") & ~F.coalesce("corrected", F.lit(False)) & ~text.source_contains_cas(source, value, plain)
    missing = F.when(kind == "product", absent).when(kind == "substance", absent & long_enough).when(kind == "cas", wrong_cas).otherwise(False)
    foreign = (F.col("field") != "TradeNameEN") & (kind != "cas") & ~F.col("_kana") & text.has_kana(value)
    return F.array_compact(F.array(F.when(missing, "not_found"), F.when(foreign, "foreign_script")))
