import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from dossiermill.operators import assist, corpus, manifest, resolution, rules, validator
from dossiermill.plans import queries as plans
from dossiermill.sources.schema import record_type
from dossiermill.streaming import incremental

DATA = "/root/testdata/sf0.001"


def findings_of(spark, record):
    row = validator.validate(spark.createDataFrame([tuple(record.get(f.name) for f in record_type())], record_type())).first()
    return [(f.level, f.rule, f.message) for f in row.findings]


def test_an_empty_record_lacks_every_section(spark):
    got = findings_of(spark, {})
    assert len(got) == 16 and {x[:2] for x in got} == {("WARN", "STRUCTURAL")}


def test_validator_findings(spark):
    cas = lambda x: {"SubstanceIdentifiers": {"SubstanceIdentity": {"CASno": {"FullText": [x]}}}}
    record = {
        "Composition": {"CompositionAndConcentration": [cas("7732-18-6"), cas("bad")]},
        "HazardIdentification": {"HazardLabelling": {"HazardStatement": [{"HazardStatementCode": "H225"}, {"HazardStatementCode": "h225"}, {"HazardStatementCode": "H999"}]}},
        "Datasheet": {"IssueDate": "soon"},
    }
    got = findings_of(spark, record)
    messages = " ".join(m for _, _, m in got)
    for part in ("mismatch '7732-18-6' (expected check digit 5, source has 6)", "invalid CAS format 'bad'", "unknown H-code 'H999'", "IssueDate 'soon'"):
        assert part in messages
    named = [(level, rule) for level, rule, _ in got if rule != "STRUCTURAL"]
    assert named.count(("HIGH", "S2-GHS-INCOMPLETE")) == 3 and named.count(("MED", "S2-DUPLICATE-HCODE")) == 1 and named.count(("HIGH", "S3-CAS-WITHOUT-NAME")) == 2


def test_findings_sort_by_severity(spark):
    df = spark.sql("SELECT array(named_struct('level', 'WARN', 'rule', 'b', 'message', ''), named_struct('level', 'CRIT', 'rule', 'z', 'message', ''), named_struct('level', 'HIGH', 'rule', 'a', 'message', '')) AS f")
    assert [x.level for x in df.select(rules.by_severity(F.col("f")).alias("f")).first().f] == ["CRIT", "HIGH", "WARN"]


def test_sections_by_prefix(spark):
    by_rule = spark.createDataFrame([("S1-X", 1), ("S11-Y", 2), ("CX-Z", 4)], "rule string, n long")
    assert {r.section: r.n for r in corpus.failures_by_section(by_rule).collect()} == {"S1": 3, "S11": 2}
    assert {r.section: r.n for r in corpus.failures_by_section(by_rule, "fixed").collect()} == {"S1": 1, "S11": 2}


@pytest.mark.parametrize(
    ("entries", "sources", "wanted"),
    [
        ([], [], "human_review_required"),
        ([(1, 5, "X", "m", 20.0)], [], "missing_input"),
        ([(1, 5, "A", "m", 20.0)], [("A", "product_test_report", "component")], "mixture_cannot_be_derived_from_components"),
        ([(1, 5, "A", "m", 20.0)], [("A", "model_estimate", "finished_product")], "product_test_required"),
        ([(1, 5, "A", None, 20.0)], [("A", "product_test_report", "finished_product")], "insufficient_measurement_conditions"),
        ([(1, 5, "A", "m", None)], [("A", "product_test_report", "finished_product")], "insufficient_measurement_conditions"),
        ([(1, 5, "A", "m", 20.0), (2, 6, "A", "m", 20.0)], [("A", "product_test_report", "finished_product")], "conflicting_sources"),
        ([(1, 5, "A", "m", 20.0)], [("A", "product_test_report", "same_batch")], None),
    ],
)
def test_resolution(spark, entries, sources, wanted):
    products = spark.createDataFrame([(1,)], "product long")
    e = spark.createDataFrame([(1, "VapourPressure", *x) for x in entries], "product long, property string, pos int, value int, evidence_id string, method string, temperature double")
    s = spark.createDataFrame([(1, x[0], n, *x[1:]) for n, x in enumerate(sources)], "product long, id string, pos int, level string, applies_to string")
    got = {r.property: r.reason for r in resolution.resolved(products, e, s).collect()}
    assert got["VapourPressure"] == wanted and len(got) == 7


def test_assist_rejections(spark):
    path, source = assist.ALLOWED_PATHS[0], "rinse with water"
    rows = [(path, "v", "with water", source), ("x", "v", "with", source), (path, " ", "with", source), (path, "None.", "with", source), (path, "v", " ", source), (path, "v", "oil", source)]
    got = assist.verified(spark.createDataFrame(rows, "path string, value string, excerpt string, source string")).collect()
    assert [r.rejection for r in got] == [None, "path_not_allowed", "blank_value", "content_free_value", "blank_excerpt", "excerpt_not_found"]
    assert got[0].id.startswith("assist-") and len(got[0].id) == 19


def test_new_manifest_entries(spark):
    columns = "source_url string, sha256 string"
    found = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "2"), ("d", "9")], columns)
    known = spark.createDataFrame([("a", "0"), ("z", "9")], columns)
    assert [tuple(r) for r in manifest.new_entries(found, known).select("source_url", "sha256").collect()] == [("b", "2")]


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    query = incremental.appended(incremental.evaluated(stream), str(tmp_path / "out"), str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, got.collect())) == sorted(map(str, incremental.evaluated(docs).collect()))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["corpus_grade_summary", "failures_by_rule", "validator_structural_rules", "evidence_resolution", "clean_text", "manifest_dedup", "stratified_sample", "source_verification", "country_warnings"])
def test_queries_equal_their_sql(spark, name):
    db = duckdb.connect()
    for t in ("orders", "lineitem", "documents"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = db.sql(plans.ORACLES[name])
    got = plans.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, map(tuple, got.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))


def test_identity_findings_by_outcome(spark):
    from dossiermill.operators import identities

    ok, twice, lost, failed = "64-17-5", "67-56-1", "67-64-1", "71-43-2"
    parts = spark.createDataFrame([(1, n, c) for n, c in enumerate([ok, twice, lost, failed, "64-17-6", None])], "doc int, pos int, cas string")
    candidate = "cas string, cid long, formula string, structure string, calculated string, fragments int"
    rows = [(ok, 1, "C2H6O", "normalized", "C2H6", 2)] * 2 + [(twice, 2, "C", "missing", None, 1), (twice, 3, "C", "missing", None, 1), (lost, None, None, None, None, None)]
    errors = spark.createDataFrame([(failed, None), (failed, "x"), ("64-17-6", "y")], "cas string, message string")
    known = identities.identified(parts, identities.outcomes(spark.createDataFrame(rows, candidate), errors))
    found = {(r.cas, r.rule) for r in identities.identity_findings(known).collect()}
    missing = "GEN-CAS-ENRICHMENT-MISSING"
    assert found == {
        (ok, "GEN-STRUCTURE-FORMULA-MISMATCH"), (ok, "GEN-STRUCTURE-MULTIFRAGMENT"), (twice, "GEN-CAS-AMBIGUOUS"), (twice, missing),
        (lost, missing), (failed, missing), (failed, "GEN-CAS-LOOKUP-ERROR"),
    }
    assert [r.published_formula for r in known.where(f"cas = '{ok}'").collect()] == [None]
    assert known.count() == 6


def test_names_of_files_are_numbered_and_fall_back(spark):
    from dossiermill.operators import reports
    from dossiermill.sources.files import suggested_name

    rows = [("2024-03-31", "A/1 ", "x"), ("2024-03-31", None, "A/1"), ("20240331", "A_1", None), ("2024-03-31", "//", "x"), (None, None, None)]
    docs = spark.createDataFrame([(f"p{n}", *r) for n, r in enumerate(rows)], "path string, day string, number string, trade string")
    named = docs.select("path", suggested_name(docs.day, docs.number, docs.trade).alias("name"))
    got = {r.path: r.file_name for r in reports.numbered_names(named).collect()}
    assert sorted(got[p] for p in ("p0", "p1", "p2")) == ["SDS_20240331_A_1", "SDS_20240331_A_1_001", "SDS_20240331_A_1_002"]
    assert got["p3"] == "SDS_20240331_NoCode" and got["p4"].endswith("_NoCode") and len(got["p4"]) == 19
    assert reports.numbered_names(named.where("false")).count() == 0


def test_reports_of_single_seeds_and_of_files_without_scores(spark):
    from dossiermill.operators import reports

    one = reports.attribution(spark.createDataFrame([(1, "a", -2.0), (1, "a", None)], "seed int, feature string, value double")).first()
    assert (one.mean_abs, one.std_abs) == (1.0, None)
    scores = spark.createDataFrame([(1, "S1", True, 1.0), (2, "S1", False, 0.5), (3, "S2", True, None), (4, "S2", False, 1.0)], "doc int, section string, full_text boolean, score double")
    files = reports.retention_by_file(scores)
    assert {r.doc: (r.retention, r.full_text_retention) for r in files.collect()} == {1: (1.0, 1.0), 2: (0.5, None), 3: (0.0, None), 4: (1.0, None)}
    summary = reports.retention_summary(files).first()
    assert (summary.best, summary.worst, summary.mean_retention) == (1, 3, 0.625)


def test_sinks_read_back(spark, tmp_path):
    from pyspark.errors import AnalysisException

    from dossiermill.sources import sinks

    path = str(tmp_path / "manifest")
    entries = spark.createDataFrame([("u1", "ab1", "ja"), ("u2", "ac2", None), ("u3", None, "en")], "source_url string, sha256 string, lang string")
    sinks.append_manifest(entries, path)
    sinks.append_manifest(entries.limit(1), path)
    (tmp_path / "manifest" / "part-broken.json").write_text('\n{"source_url": \n')
    back = sinks.read_manifest(spark, path)
    assert sorted(r.source_url for r in back.collect()) == ["u1", "u1", "u2", "u3"]
    assert sorted(r.source_url for r in sinks.without_entries(back, "ab").collect()) == ["u2", "u3"]
    assert sinks.without_entries(back, "").count() == 0
    report = str(tmp_path / "report")
    sinks.write_report(entries, report, ["source_url"])
    assert [r.sha256 for r in spark.read.option("header", True).csv(report).collect()] == ["ab1", "ac2", None]
    with pytest.raises(AnalysisException):
        sinks.write_report(entries, report, ["source_url"])
    sinks.write_trees(entries, str(tmp_path / "out"), ["sha256", "lang"], "source_url")
    assert [spark.read.parquet(f"{tmp_path}/out/{c}").count() for c in ("sha256", "lang")] == [2, 2]


def test_the_first_rows_of_a_stratum_are_found_before_the_shuffle(spark):
    docs = spark.range(1000).selectExpr("concat('s', id) AS supplier", "concat('l', id % 2) AS lang", "id AS doc")
    sample = manifest.stratified(docs, "supplier", "lang", 10, F.xxhash64("doc"))
    assert sorted(r["count"] for r in sample.groupBy("lang").count().collect()) == [5, 5]
    assert "WindowGroupLimit" in sample._jdf.queryExecution().toString()


def test_evidence_is_dealt_out_four_times(spark):
    """Products, entries and sources once each, and what they come to by property."""
    products = spark.range(50).select(F.col("id").alias("product"))
    e = spark.range(200).select((F.col("id") % 50).alias("product"), F.when(F.col("id") >= 0, "FlashPoint").alias("property"), F.col("id").alias("pos"), F.when(F.col("id") > 9, F.col("id") % 100).alias("value"), F.when(F.col("id") >= 0, "E").alias("evidence_id"), F.when(F.col("id") % 3 > 0, "m").alias("method"), F.lit(None).cast("double").alias("temperature"))
    s = products.select("product", F.when(F.col("product") >= 0, "E").alias("id"), F.lit(0).alias("pos"), F.lit("product_test_report").alias("level"), F.lit("finished_product").alias("applies_to"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = resolution.resolved(products, e, s)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = {r.product: r.reason for r in found.where("property = 'FlashPoint'").collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 4
    # the values are p and p + 50, of the first ten products a null beside them, which is no other value
    assert got == {p: "conflicting_sources" for p in range(50)}
    only = resolution.resolved(products, e.where("id < 50 or id >= 100 and id < 150"), s).where("property = 'FlashPoint'")
    assert {r.product: r.reason for r in only.collect()} == {p: "insufficient_measurement_conditions" if p % 3 == 0 else None for p in range(50)}
