"""Which measured properties the evidence supports, and whether a product may go out.

entries: (product, property, pos, value, evidence_id, method, temperature), one row a
measurement; sources: (product, id, pos, level, applies_to). All joins are equi-joins
on the product, so a corpus of products resolves in two shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TESTED = ["product_test_report", "equivalent_batch_test_report"]

# The evidence levels that each property takes.
POLICIES = {
    "FlashPoint": [*TESTED, "supplier_specification"],
    "InitialBoilingPointAndBoilingRange": TESTED,
    "VapourPressure": TESTED,
    "ExplosiveLimits": TESTED,
    "SelfReactivity": TESTED,
    "OxidizingProperties": TESTED,
    "CorrosiveToMetals": TESTED,
}
NEEDS_TEMPERATURE = ["VapourPressure"]

# How an evidence level counts in the summary.
BUCKETS = {
    "product_test_report": "confirmed", "equivalent_batch_test_report": "confirmed",
    "supplier_specification": "supplied", "supplier_sds": "supplied", "unverified_user_input": "supplied",
    "regulatory_database": "literature", "peer_reviewed_literature": "literature", "reference_database": "literature",
    "deterministic_calculation": "calculated", "model_estimate": "estimated", "none": "not_applicable",
}


def _is_allowed(name: Column, level: Column) -> Column:
    out = F.lit(False)
    for policy, levels in POLICIES.items():
        out = out | ((name == policy) & level.isin(levels))
    return out


def entry_reasons(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """``entries`` with level and the reason why each is not eligible (null if it is).
    Of several sources with one id the first counts."""
    first = sources.groupBy("product", "id").agg(F.min_by(F.struct("level", "applies_to"), "pos").alias("s"))
    first = first.select("product", F.col("id").alias("evidence_id"), F.lit(True).alias("known"), "s.level", "s.applies_to")
    reason = (
        F.when(F.col("known").isNull(), "missing_input")
        .when(F.col("applies_to") == "component", "mixture_cannot_be_derived_from_components")
        .when(F.col("applies_to").isin("reference_substance", "unknown"), "product_test_required")
        .when(~_is_allowed(F.col("property"), F.col("level")), "product_test_required")
    )
    return entries.join(first, ["product", "evidence_id"], "left").withColumn("reason", reason)


def _judged(products: DataFrame, entries: DataFrame, sources: DataFrame, kept: list[str]) -> tuple[DataFrame, Column]:
    """(product, property, best: the columns ``kept`` of the first eligible entry) of every
    product and property, and the reason why it is not resolved (null if it is)."""
    # what an entry lacks is said once, so that what says so need not be carried along
    lacks = F.col("method").isNull() | (F.col("property").isin(NEEDS_TEMPERATURE) & F.col("temperature").isNull())
    checked = entry_reasons(entries.withColumn("_lacks", lacks), sources)
    ok = F.col("reason").isNull()
    value = F.when(ok, F.col("value"))
    grouped = checked.groupBy("product", "property").agg(
        F.min_by("reason", F.when(~ok, F.col("pos"))).alias("first_reason"),
        # values are not counted, for which they would be dealt out a second time
        (F.min(value) < F.max(value)).alias("differ"),
        F.min_by(F.struct(*kept, "_lacks"), F.when(ok, F.col("pos"))).alias("best"),
        F.bool_or(ok).alias("eligible"),
    )
    names = F.explode(F.array(*map(F.lit, POLICIES))).alias("property")
    every = products.select("product", names).join(grouped, ["product", "property"], "left")
    reason = (
        F.when(F.col("eligible").isNull(), "human_review_required")
        .when(~F.col("eligible"), F.col("first_reason"))
        .when(F.col("differ"), "conflicting_sources")
        .when(F.coalesce("best._lacks", F.lit(True)), "insufficient_measurement_conditions")
    )
    return every, reason


def resolving_entries(products: DataFrame, entries: DataFrame, sources: DataFrame) -> DataFrame:
    """The entry that resolves each property that is resolved, with all its columns."""
    kept = [c for c in dict.fromkeys(["value", "method", "temperature", "level", *entries.columns]) if c not in ("product", "property", "pos")]
    every, reason = _judged(products, entries, sources, kept)
    return every.where(reason.isNull()).select("product", "property", *(F.col("best")[c].alias(c) for c in kept))


def resolved(products: DataFrame, entries: DataFrame, sources: DataFrame) -> DataFrame:
    """(product, property, status, reason, value, level): one row for each product and
    property. Without entries a human has to decide; if no entry is eligible the first
    entry's reason holds; eligible entries that disagree are a conflict; the first
    eligible entry needs a method, and vapour pressure a temperature."""
    every, reason = _judged(products, entries, sources, ["value", "level"])
    status = F.when(reason.isNull(), "resolved").otherwise("unresolved")
    return every.select("product", "property", status.alias("status"), reason.alias("reason"), F.when(reason.isNull(), F.col("best.value")).alias("value"), F.when(reason.isNull(), F.col("best.level")).alias("level"))


def evidence_summary(rows: DataFrame) -> DataFrame:
    """Counters by product over ``resolved`` rows."""
    bucket = F.create_map(*(F.lit(x) for kv in BUCKETS.items() for x in kv))[F.col("level")]
    counts = [F.count_if(bucket == b).alias(b) for b in dict.fromkeys(BUCKETS.values())]
    tested = F.count_if(F.col("level").isin(TESTED)).alias("product_test_evidence")
    return rows.groupBy("product").agg(F.count_if(F.col("status") == "unresolved").alias("unresolved"), *counts, tested)


def blocks(reason: Column) -> Column:
    """A conflict blocks a release; what is merely missing asks for review."""
    return F.coalesce(reason == "conflicting_sources", F.lit(False))


def release_status(rows: DataFrame, findings: DataFrame) -> DataFrame:
    """(product, status): blocked, review_required or draft. ``findings`` is (product,
    level)."""
    open_ = rows.groupBy("product").agg(F.bool_or(blocks(F.col("reason"))).alias("blocked"), F.count_if(F.col("status") == "unresolved").alias("n_open"))
    found = findings.groupBy("product").agg(F.bool_or(F.col("level").isin("CRIT", "HIGH")).alias("severe"), F.count("*").alias("n_found"))
    both = open_.join(found, "product", "left")
    status = F.when(F.col("blocked") | F.coalesce("severe", F.lit(False)), "blocked").when((F.col("n_open") > 0) | (F.coalesce("n_found", F.lit(0)) > 0), "review_required").otherwise("draft")
    return both.select("product", status.alias("status"))


def required_actions(rows: DataFrame) -> DataFrame:
    """(product, actions): the properties to settle before a release, in policy order."""
    order = F.array_position(F.array(*map(F.lit, POLICIES)), F.col("property"))
    held = rows.where(blocks(F.col("reason"))).groupBy("product").agg(F.array_sort(F.collect_list(F.struct(order.alias("n"), "property"))).alias("a"))
    return held.select("product", F.array_join(F.transform("a", lambda x: F.concat(F.lit("resolve "), x["property"])), "; ").alias("actions"))
