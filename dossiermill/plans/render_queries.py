"""Rendering over derived records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import render
from . import derived
from .queries import query


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, json): a small record of each order."""
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    record = F.concat(F.lit('{"Identification": {"TradeName": "P<'), key, F.lit('>", "Empty": ""}, "Composition": {"Rows": [{"Name": "a", "Part": '), cust, F.lit('}, {"Name": "b"}]}, "OtherInformation": {"Notes": ["x", "y"]}}'))
    return derived.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), record.alias("json"))


@query("""
SELECT o_orderkey AS doc, '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"></head><body><section><h2>1. Identification</h2><table><tbody><tr><th class="key">TradeName</th><td><span>P&lt;' || o_orderkey || '&gt;</span></td></tr></tbody></table></section><section><h2>3. Composition / Information on Ingredients</h2><table><tbody><tr><th class="key">Rows</th><td><table><thead><tr><th>Name</th><th>Part</th></tr></thead><tbody><tr><td>a</td><td>' || o_custkey || '</td></tr><tr><td>b</td><td></td></tr></tbody></table></td></tr></tbody></table></section><section><h2>16. Other Information</h2><table><tbody><tr><th class="key">Notes</th><td><ul><li>x</li><li>y</li></ul></td></tr></tbody></table></section></body></html>' AS page FROM orders""")
def render_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("doc", render.render_html(F.col("json"), F.lit("en")).alias("page"))


@query("SELECT o_orderkey AS doc, 'Name: P&lt;' || o_orderkey || '&gt;; notes: x' || chr(10) || 'y; none: .' AS filled FROM orders")
def fill_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = F.lit("Name: {{TradeName}}; notes: {{ OtherInformation.Notes }}; none: {{Unknown}}.")
    return records(spark, sf_dir).select("doc", render.fill_template(F.col("json"), template).alias("filled"))


@query()
def render_docx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("doc", F.sha2(render.render_docx(F.col("json"), F.lit("ja")), 256).alias("sha256"))
