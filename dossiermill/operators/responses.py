"""Answers of models as tables: records, and corrections of codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import repair
from ..sources import files


def answered_records(responses: DataFrame, answer: str = "answer") -> DataFrame:
    """``responses`` with the record that each ``answer`` holds: its mended JSON text in
    ``json``, the way it was read in ``way`` and the columns of ``files.records``. An answer
    without a record has nulls there and is ``malformed``."""
    found = responses.withColumn("_found", repair.answered_record(F.col(answer)))
    return files.records(found.withColumns({"json": F.col("_found.json"), "way": F.col("_found.way")}).drop("_found"))


def _unfenced(answer: Column) -> Column:
    """What is between the fence lines of an answer that begins with one."""
    text = F.trim(F.regexp_replace(answer, r"\A\s+|\s+\z", ""))
    return F.when(F.startswith(text, F.lit("```")), F.regexp_extract(text, r"(?s)\A[^\n]*(.*?)(?:\n```.*)?\z", 1)).otherwise(text)


def corrections(responses: DataFrame, answer: str = "answer") -> DataFrame:
    """(doc, pos, code, corrected, reason, error): a row for each correction in the list that
    an answer holds, from its first [ to its last ]. ``corrected`` is null where the code
    should go. An answer without such a list, or with anything but objects of a text
    ``original`` and texts or nulls in it, gives one row with an ``error`` and no
    corrections; an empty list gives no row. Feeds ``enrichment.corrected_codes``."""
    part = F.regexp_extract(_unfenced(F.coalesce(answer, F.lit(""))), r"(?s)\[.*\]", 0)
    fields = ("original", "corrected", "reason")
    rows = responses.select("doc", part.alias("_list"))
    # inside an object, what stands behind the end of the list is an error
    whole = F.try_parse_json(F.concat(F.lit('{"list":'), "_list", F.lit("}"))).isNotNull()
    entries = F.from_json("_list", "array<struct<" + ", ".join(f"{f}: variant" for f in fields) + ">>")
    rows = rows.select("doc", "_list", entries.alias("_entries"), whole.alias("_json"))
    text = lambda v: F.schema_of_variant(v) == "STRING"
    may = lambda v: v.isNull() | F.schema_of_variant(v).isin("STRING", "VOID")
    right = F.forall("_entries", lambda e: e.isNotNull() & e["original"].isNotNull() & F.coalesce(text(e["original"]), F.lit(False)) & may(e["corrected"]) & may(e["reason"]))
    error = F.when(F.col("_list") == "", "no list").when(~F.col("_json"), "no JSON").when(~F.coalesce(right, F.lit(False)), "no corrections")
    each = rows.select("doc", "_entries", error.alias("error"))
    wrong = F.col("error").isNotNull()
    out = each.select("doc", "error", F.posexplode(F.when(wrong, F.array(F.lit(None).cast("struct<original: variant, corrected: variant, reason: variant>"))).otherwise(F.col("_entries"))).alias("pos", "e"))
    plain = lambda f: F.when(F.schema_of_variant(F.col(f"e.{f}")) == "STRING", F.col(f"e.{f}").cast("string"))
    return out.select("doc", "pos", plain("original").alias("code"), plain("corrected").alias("corrected"), plain("reason").alias("reason"), "error")
