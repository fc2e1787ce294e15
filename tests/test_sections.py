import pytest
from pyspark.sql import functions as F

import __spark_entry__
from dossiermill.operators import sections

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["quality_section16", "quality_section3", "quality_section9", "quality_section11", "quality_across_sections"])
def test_a_record_is_read_once_and_not_again_in_a_filter(spark, name):
    plan = __spark_entry__.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") < 100


def test_windows_are_cut_in_one_pass(spark, tmp_path):
    text = "A\U0001f9ea" + "0123456789" * 3 + "?end"
    spark.createDataFrame([(1, text), (2, "x" * 30), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, text[:20]), (2, "?" + text[2:11])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = __spark_entry__.queries()["retention_windows"](spark, str(tmp_path))
    assert {r.item_id: (r.n, r.retention) for r in found.collect()} == {1: (3, 0.5), 2: (3, 0.0)}
    # substr counts from the start of a text for each window
    assert "substr" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("pattern", "text"), [("remov.*cloth|衣類.*脱", "REMOVE the CLOTHes"), ("fire|ice", "FİRE"), ("kelvin", "Kelvin"), (r"\bUN\s?\d{4}\b|x\|y", "un1234"), ("a.*b|c", "b a"), ("(p|q)r|[|]z", "|Z"), ("wash|skin", "waſh"), ("wash", None)])
def test_words_are_found_as_by_the_pattern(spark, pattern, text):
    row = spark.createDataFrame([(text,)], "t string").select(sections._has(F.col("t"), pattern).alias("a"), F.col("t").rlike("(?iU)" + pattern).alias("b")).first()
    assert row.a == row.b


def test_each_step_of_a_text_is_made_once(spark):
    records = spark.createDataFrame([(1, "en", '{"OtherInformation":"x"}')], "doc int, lang string, record string")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        plan = sections.checked(records, 2026, ("CX",)).select("findings")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    # the strings of each section and of the whole record, and the codes
    assert plan.count("regexp_extract_all(") <= len(sections.NUMBERED) + 2


def test_placeholders_are_found_where_they_are_escaped_wide_or_in_brackets(spark):
    texts = {
        "plain": ('{"OtherInformation":{"FullText":"to do, todos and a tbdx"}}', False), "word": ('{"OtherInformation":"a todo."}', True), "end": ('{"Unknown":["TBD"]}', True),
        "escaped": ('{"OtherInformation":"\\\\u0054ODO"}', True), "wide": ('{"OtherInformation":"ＴＢＤ"}', True), "bracket": ('{"OtherInformation":"[Insert name]"}', True), "key": ('{"TODO":"nothing"}', False),
        "quoted": ('{"OtherInformation":"say \\\\"ok\\\\""}', False), "japanese": ('{"OtherInformation":"［記入］"}', True), "long s": ('{"OtherInformation":"[inſert"}', True), "none": (None, False),
    }
    records = spark.createDataFrame([(k, "en", r.replace("\\\\", "\\") if r else r) for k, (r, _) in texts.items()], "doc string, lang string, record string")
    got = {r.doc: "CX-PLACEHOLDER" in [f.rule for f in r.findings] for r in sections.checked(records, 2026, ("CX",)).collect()}
    assert got == {k: found for k, (_, found) in texts.items()}


def test_wide_signs_are_made_narrow(spark):
    cases = {"ｐＨ７　℃": "pH7 °C", "ｱ": "ｱ", "～": "~", "plain": "plain", "シンナー": "シンナー", None: None, "": ""}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.n for r in df.select("t", sections.normalized(df.t).alias("n")).collect()} == cases
