import io
import zipfile

import pytest
from pyspark.sql import functions as F

from dossiermill.functions import chemistry, evidence, language, scoring, text, trees
from dossiermill.sources import files


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("cas", "digit", "status", "fixed"),
    [
        ("67-56-1", 1, "ok", "67-56-1"), ("7732-18-5", 5, "ok", "7732-18-5"), ("7732-18-6", 5, "checkdigit", "7732-18-5"),
        ("7-56-1", 9, "format", "7-56-1"), ("", None, "format", ""), ("abc", None, "format", "abc"), (None, None, None, None),
    ],
)
def test_cas(spark, cas, digit, status, fixed):
    c = F.lit(cas).cast("string")
    row = spark.range(1).select(chemistry.cas_check_digit(c).alias("d"), chemistry.cas_status(c).alias("s"), chemistry.cas_fixed(c).alias("f")).first()
    assert (row.s, row.f) == (status, fixed)
    if status in ("ok", "checkdigit"):
        assert row.d == digit


def test_codes(spark):
    assert value(spark, chemistry.known_h(F.lit("h225"))) and not value(spark, chemistry.known_h(F.lit("H999")))
    assert value(spark, chemistry.known_p(F.lit("P301 + P330+p331"))) and not value(spark, chemistry.known_p(F.lit("P301+P999")))
    assert value(spark, chemistry.repeats_of(F.array(*map(F.lit, ["H225", "h225", "H301", "H225"])))) == ["H225", "H225"]
    assert value(spark, chemistry.split_cas(F.array(F.lit("67-56-1, 75-09-2;\n64-17-5")))) == ["67-56-1", "75-09-2", "64-17-5"]


@pytest.mark.parametrize(
    ("source", "record", "recall", "precision"),
    [
        (["67-56-1", "75-09-2"], ["67-56-1", "999-99-9"], 0.5, 0.5), (["H225", "H301"], ["H225", "H301"], 1, 1),
        (["H225"], ["H225", "H302", "H303"], 1, 1 / 3), ([], ["H225"], 1, 0), (["H225"], [], 0, 1),
    ],
)
def test_recall_and_precision(spark, source, record, recall, precision):
    s, r = (F.array(*map(F.lit, x)).cast("array<string>") for x in (source, record))
    assert value(spark, evidence.recall(s, r)) == pytest.approx(recall)
    assert value(spark, evidence.precision(s, r)) == pytest.approx(precision)


def test_extraction(spark):
    t = F.lit("H225、H301、p210（H999） UN 1230 またはUN1230 CAS 67-56-1 xH225 H2255")
    assert value(spark, evidence.extracted(t, "h_codes")) == ["H225", "H301"]
    assert value(spark, evidence.extracted(t, "p_codes")) == ["p210"]
    assert value(spark, evidence.extracted(t, "p_codes", "cli")) == ["P210"]
    assert value(spark, evidence.extracted(t, "un")) == ["UN1230"]
    assert value(spark, evidence.extracted(t, "un", "cli")) == ["1230"]
    assert value(spark, evidence.extracted(t, "cas")) == ["67-56-1"]
    assert value(spark, evidence.signal_words(F.lit("DANGER and danger, 警告"))) == ["警告", "danger"]


@pytest.mark.parametrize(
    ("sample", "wanted"),
    [
        ("この製品は引火性の高い液体および蒸気です。安全に取り扱ってください。お願いします。", "ja"), ("Safety data sheet according to regulation, section one", "en"),
        ("国语时书来这过东样从实动产问给长发规药标剂险质现处须经联则级为与", "zh-CN"), ("國語時書來這過東樣從實動產問給長發規藥標劑險質現處須經聯則級為與", "zh-TW"),
        ("~!@#$%^&*()_+{}|:<>?~!@#$%^&*()_+{}|", "ja"), ("", "ja"), (None, "ja"),
    ],
)
def test_language(spark, sample, wanted):
    assert value(spark, language.detect_language(F.lit(sample).cast("string"))) == wanted


def test_tidy():
    assert text.tidy("  a \n-----\n\n\n\nb\x00c\n", 100) == "a\n\nbc\n"
    assert text.tidy("h\nx\n" * 4, 100) == "h\nx\n" and text.tidy("h\n" * 3, 100) == "h\n" * 3
    assert text.tidy("日本語" * 10, 5) == "日本語日本" + text.TRUNCATED
    assert text.tidy("", 5) == ""


def test_retention_and_dates(spark):
    doc = F.lit("the quick brown fox jumps over the lazy dog")
    assert value(spark, text.retention(F.lit("abcd"), doc)) is None
    assert value(spark, text.retention(F.lit("quick brown"), doc)) == 1.0
    assert value(spark, text.retention(F.lit("missing"), doc)) == 0.0
    assert value(spark, text.retention(F.lit("the quick brown cat jumps"), doc)) == pytest.approx(0.5)
    for sample, wanted in (("2024-05-01", True), ("20240501", True), ("2024年5月", True), ("May 5", False), ("3024", False)):
        assert value(spark, text.looks_like_date(F.lit(sample))) == wanted


def test_excerpts_and_names(spark):
    assert value(spark, text.verified_excerpt(F.lit("目に 入っ た場合 rinse  with\nwater"), F.lit("目に入った場合 rinse with water")))
    assert not value(spark, text.verified_excerpt(F.lit("abc"), F.lit(" ")))
    assert value(spark, text.names_similar(F.lit("Ethyl alcohol"), F.lit("ethyl Alcohol pure")))
    assert value(spark, text.source_contains(F.lit("塩化 異丙基"), F.lit("异丙基")))
    assert value(spark, text.escaped_html(F.lit('<a & "b">'))) == "&lt;a &amp; &quot;b&quot;&gt;"
    assert value(spark, text.file_stem(F.lit(" 製品 A/1-b "))) == "製品_A_1-b"


def test_page_text():
    page = "<html><head><script>x('</p>')</script></head><body><nav>menu</nav><p>One<b> two</b></p><table><tr><td>a</td><td>b</td></tr></table></body></html>"
    assert text.page_text(page) == "One two\na\tb"


@pytest.mark.parametrize(
    ("crit", "high", "med", "py", "cli"),
    [(0, 0, 0, (100.0, "A"), (100.0, "A")), (0, 1, 2, (89.0, "B"), (93.0, "B")), (1, 0, 0, (65.0, "D"), (60.0, "D")), (0, 20, 0, (0.0, "D"), (0.0, "D"))],
)
def test_scores(spark, crit, high, med, py, cli):
    for profile, wanted in (("py", py), ("cli", cli)):
        points = scoring.score(F.lit(crit), F.lit(high), F.lit(med), 0, profile)
        assert value(spark, F.struct(points, scoring.grade(points, F.lit(crit), F.lit(high)))) == wanted


def test_trees():
    record = {"A": {"x": " ", "y": None, "z": [{}, {"k": "1"}]}, "B": []}
    assert trees.pruned(record) == {"A": {"z": [{"k": "1"}]}}
    assert list(trees.leaves({"a": [1, {"b": "c"}]})) == [("a[0]", "a", 1), ("a[1].b", "b", "c")]
    assert trees.flattened({"p": {"q": "1"}, "r": {"q": "2"}, "s": ["u", "v"]}) == {"q": "1", "s": "u\nv", "p.q": "1", "r.q": "2"}
    assert trees.repaired('```json\n{"a": [1, 2,],\n```') == '{"a": [1, 2]}'
    assert trees.repaired('{"a": 1\n"b": 2}') == '{"a": 1, "b": 2}'
    assert trees.repaired("nothing") is None


def test_files(spark, tmp_path):
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p></w:document>')
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.DOCX").write_bytes(book.getvalue())
    (tmp_path / "b.txt").write_text("plain")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.bin").write_bytes(b"x")
    docs = files.read_documents(spark, str(tmp_path))
    got = {r.format: (r.x.text, r.x.error) for r in docs.select("format", files.extracted_text(F.col("format"), F.col("content")).alias("x")).collect()}
    assert got == {"docx": ("one\ntwo", None), "txt": ("plain", None), "pdf": (None, "no reader for pdf")}


def test_records(spark):
    rows = [('{"Datasheet": {"IssueDate": "2024-01-01"}, "Composition": 7, "OtherInformation": {"x": 1}}',), ("no json",), (None,)]
    got = files.records(spark.createDataFrame(rows, "json string")).collect()
    assert got[0].Datasheet.IssueDate == "2024-01-01" and got[0].skipped == ["Composition"] and got[0].OtherInformation == '{"x":1}'
    assert got[1].malformed and got[1].Datasheet is None


def test_rendered_documents_read_back(spark):
    from dossiermill.functions import render

    record = {"Identification": {"TradeName": "A & B", "Gone": ""}, "OtherInformation": {"Notes": ["x", {"deep": 1}]}}
    assert files._docx(render.docx(record, "en")).split("\n") == ["1. Identification", "TradeName: A & B", "16. Other Information", "Notes:", "  x", "  deep: 1"]
    assert text.page_text(render.html_page(record, "zh-TW")).startswith("1. 化學品與廠商資料")
    assert render.filled("{{TradeName}}|{{ nothing }}", record) == "A &amp; B|"


def test_names_in_a_source(spark):
    def has(source, name):
        return value(spark, text.source_contains_name(F.lit(source), F.lit(name)))

    assert has("the 六氯-1,3-丁二烯 grade", "1,1,2,3,4,4-六氯-1,3-丁二烯")
    assert has("イソプロピルβDチオガラクトピラノシド", "イソプロピルβD(-)チオガラクトピラノシド")
    assert has("trimethyl borate\nEnglish name: (mixture)", "trimethyl borate (a mixture of several isomers and esters)")
    assert not has("trimethyl silane", "trimethyl borate (a mixture of several isomers and esters)")
    assert not has("nothing", "acetone") and has("nothing", "ab")
    assert not value(spark, text.source_contains(F.lit("ab"), F.lit("a b")))
    assert value(spark, text.source_contains_cas(F.lit("CAS 64－17－ 5"), F.lit("64-17-5")))
    assert not value(spark, text.source_contains_cas(F.lit("CAS 64-17-6"), F.lit("64-17-5")))


def test_a_filter_on_the_status_works_the_number_out_once(spark):
    rows = spark.range(100).select(F.concat(F.col("id").cast("string"), F.lit("0-mark-0")).alias("c"))
    plan = rows.where(chemistry.cas_status(F.col("c")) == "ok")._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan and next(x for x in plan.split("\n") if "Filter" in x).count("0-mark-0") == 1


@pytest.mark.parametrize("cas", ["7-00-2", "50-00-0", "1234567-89-1", "9999999-99-5", "0-00-0"])
def test_check_digit_is_the_weighted_sum(spark, cas):
    digits = cas.replace("-", "")[-2::-1]
    row = spark.createDataFrame([(cas,)], "c string").select(chemistry.cas_check_digit(F.col("c")).alias("d")).first()
    assert row.d == sum(int(x) * n for n, x in enumerate(digits, 1)) % 10
