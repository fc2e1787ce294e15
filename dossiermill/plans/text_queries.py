"""Queries on text: evidence, language, cleaning, retention, manifests, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import evidence, language, text, trees
from ..operators import assist, manifest
from . import derived
from .queries import query

COMPONENTS = derived.COMPONENTS_SQL
SOURCE_SQL = f"""
WITH {COMPONENTS},
source AS (
  SELECT doc, string_agg('CAS ' || cas || ', ' || CASE WHEN pos % 2 = 0 THEN lower(h_code) ELSE h_code END || ' P2' || (10 + pos) || '; UN ' || un, chr(10) ORDER BY pos) AS text,
    list_distinct(list(h_code) FILTER (WHERE pos <> 2)) AS record_h FROM components GROUP BY doc)"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, text, record_h): a text with every component's identifiers, and the codes
    of a record that misses the second component's."""
    parts = derived.components(spark, sf_dir)
    code = F.when(F.col("pos") % 2 == 0, F.lower("h_code")).otherwise(F.col("h_code"))
    line = F.concat(F.lit("CAS "), F.col("cas"), F.lit(", "), code, F.lit(" P2"), (F.col("pos") + 10).cast("string"), F.lit("; UN "), F.col("un"))
    per_doc = parts.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("lines"), F.collect_set(F.when(F.col("pos") != 2, F.col("h_code"))).alias("record_h"))
    return per_doc.select("doc", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"), "record_h")


def _listed(items: Column) -> Column:
    return F.array_join(F.array_sort(items), " ")


def _sql_list(pattern: str, group: int = 0, change: str = "x") -> str:
    return f"array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '{pattern}', {group}), lambda x: {change}))), ' ')"


@query(SOURCE_SQL + " SELECT doc, " + ", ".join([
    _sql_list(r"\b[0-9]{2,7}-[0-9]{2}-[0-9]\b") + " AS cas", _sql_list(r"(?i)\bH[23456][0-9]{2}\b") + " AS h_codes",
    _sql_list(r"(?i)\bP[123456][0-9]{2}\b") + " AS p_codes", _sql_list(r"(?i)UN\s*[0-9]{4}", 0, r"regexp_replace(x, '\s+', '', 'g')") + " AS un",
]) + " FROM source")
def evidence_extract_py(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sources(spark, sf_dir)
    return rows.select("doc", *(_listed(evidence.extracted(F.col("text"), k, "py")).alias(k) for k in ("cas", "h_codes", "p_codes", "un")))


@query(SOURCE_SQL + " SELECT doc, " + ", ".join([
    _sql_list(r"\b[0-9]{2,7}-[0-9]{2}-[0-9]\b") + " AS cas", _sql_list(r"(?i)\bH[0-9]{3}\b", 0, "upper(x)") + " AS h_codes",
    _sql_list(r"(?i)\bP[0-9]{3}\b", 0, "upper(x)") + " AS p_codes", _sql_list(r"(?i)\bUN[ \t:.]*([0-9]{4})\b", 1) + " AS un",
]) + " FROM source")
def evidence_extract_cli(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sources(spark, sf_dir)
    return rows.select("doc", *(_listed(evidence.extracted(F.col("text"), k, "cli")).alias(k) for k in ("cas", "h_codes", "p_codes", "un")))


METRICS_SQL = SOURCE_SQL + r""", m AS (SELECT doc, list_distinct(regexp_extract_all(text, '(?i)\bH[23456][0-9]{2}\b')) AS s, coalesce(record_h, []) AS r FROM source),
n AS (SELECT doc, len(s) AS ns, len(r) AS nr, len(list_filter(s, lambda x: list_contains(r, x))) AS hit FROM m)
SELECT doc, round(CASE WHEN ns = 0 THEN 1.0::DOUBLE ELSE hit / ns::DOUBLE END, 6) AS recall, round(CASE WHEN nr = 0 THEN 1.0::DOUBLE ELSE hit / nr::DOUBLE END, 6) AS precision_,
  CAST(ns - hit AS INTEGER) AS n_missing, CAST(nr - hit AS INTEGER) AS n_invented FROM n"""


@query(METRICS_SQL)
def recall_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sources(spark, sf_dir).withColumn("s", evidence.extracted(F.col("text"), "h_codes", "py"))
    s, r = F.col("s"), F.col("record_h")
    return rows.select("doc", F.round(evidence.recall(s, r), 6).alias("recall"), F.round(evidence.precision(s, r), 6).alias("precision_"), F.size(F.array_except(s, r)).alias("n_missing"), F.size(F.array_except(r, s)).alias("n_invented"))


@query(SOURCE_SQL + r""", m AS (SELECT doc, list_distinct(list_transform(regexp_extract_all(text, '(?i)\bH[0-9]{3}\b'), lambda x: upper(x))) AS s, upper(array_to_string(coalesce(record_h, []), ',')) AS r FROM source)
SELECT doc, round(CASE WHEN len(s) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(s, lambda x: contains(r, x))) / len(s)::DOUBLE END, 6) AS coverage FROM m""")
def evidence_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sources(spark, sf_dir)
    return rows.select("doc", F.round(evidence.coverage(evidence.extracted(F.col("text"), "h_codes", "cli"), F.array_join("record_h", ",")), 6).alias("coverage"))


S, T = language.SIMPLIFIED, language.TRADITIONAL
LANGUAGE_SQL = f"""
WITH t AS (
  SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN 'これは安全データシートです。' || text WHEN 2 THEN repeat('{S[:10]}', 4) || text WHEN 3 THEN repeat('{T[:10]}', 4) || text ELSE text END AS text FROM documents),
n AS (
  SELECT doc_id, length(regexp_replace(text, '\\s', '', 'g')) AS visible, length(regexp_replace(text, '[^\\x{{3040}}-\\x{{30FF}}]', '', 'g')) AS kana,
    length(regexp_replace(text, '[^\\x{{4E00}}-\\x{{9FFF}}\\x{{F900}}-\\x{{FAFF}}]', '', 'g')) AS han, length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) AS latin,
    length(regexp_replace(text, '[^{S}]', '', 'g')) AS simplified, length(regexp_replace(text, '[^{T}]', '', 'g')) AS traditional FROM t),
d AS (
  SELECT doc_id, CASE WHEN visible < 30 OR kana > 5 THEN 'ja' WHEN han < 20 AND latin * 100 >= visible * 30 THEN 'en' WHEN han < 20 THEN 'ja' WHEN traditional > simplified THEN 'zh-TW' ELSE 'zh-CN' END AS language FROM n)
SELECT doc_id, language, CASE language WHEN 'ja' THEN 'jp' WHEN 'zh-CN' THEN 'cn' WHEN 'zh-TW' THEN 'tw' END AS country FROM d"""


@query(LANGUAGE_SQL)
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = derived.table(spark, sf_dir, "documents")
    n = F.col("doc_id") % 5
    mixed = (
        F.when(n == 1, F.concat(F.lit("これは安全データシートです。"), F.col("text")))
        .when(n == 2, F.concat(F.repeat(F.lit(S[:10]), 4), F.col("text")))
        .when(n == 3, F.concat(F.repeat(F.lit(T[:10]), 4), F.col("text")))
        .otherwise(F.col("text"))
    )
    found = docs.select("doc_id", language.detect_language(mixed).alias("language"))
    return found.withColumn("country", language.country_of(F.col("language")))


CLEAN_SQL = r"""
WITH dirty AS (SELECT doc_id, replace(text, '. ', '.' || chr(10) || chr(10) || '-----' || chr(10) || chr(10)) || chr(10) || repeat('Page header' || chr(10), 5) AS text FROM documents),
line AS (SELECT doc_id, i, regexp_replace(l, '^\s+|\s+$', '', 'g') AS l FROM (
  SELECT doc_id, unnest(string_split(regexp_replace(text, '\n$', ''), chr(10))) AS l, generate_subscripts(string_split(regexp_replace(text, '\n$', ''), chr(10)), 1) AS i FROM dirty)),
plain AS (SELECT * FROM line WHERE NOT regexp_full_match(l, '[-=_*~/\\|+#·•]{3,}')),
single AS (SELECT * FROM (SELECT *, lag(l) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM plain) WHERE l <> '' OR before IS NULL OR before <> ''),
seen AS (SELECT *, count(*) OVER (PARTITION BY doc_id, l) AS n, row_number() OVER (PARTITION BY doc_id, l ORDER BY i) AS nth FROM single),
kept AS (SELECT doc_id, string_agg(l || chr(10), '' ORDER BY i) AS text FROM seen WHERE l = '' OR strlen(l) > 80 OR n < 4 OR nth = 1 GROUP BY doc_id),
cut AS (SELECT doc_id, CASE WHEN length(text) > 80000 THEN left(text, 80000) || chr(10) || '[テキスト省略]' || chr(10) ELSE text END AS text FROM kept)
SELECT doc_id, length(text) AS n_chars, md5(text) AS digest FROM cut"""


@query(CLEAN_SQL)
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = derived.table(spark, sf_dir, "documents")
    dirty = F.concat(F.replace("text", F.lit(". "), F.lit(".\n\n-----\n\n")), F.lit("\n" + "Page header\n" * 5))
    found = docs.select("doc_id", text.clean_text(dirty).alias("clean"))
    return found.select("doc_id", F.char_length("clean").cast("long").alias("n_chars"), F.md5("clean").alias("digest"))


@query(r"""
WITH pair AS (SELECT b.item_id, b.text AS value, d.text AS doc FROM benchmark b CROSS JOIN documents d),
w AS (SELECT *, list_transform(CASE WHEN length(value) >= 10 THEN range(1, length(value) - 8, 5) ELSE [] END, lambda i: substr(value, i, 10)) AS windows FROM pair)
SELECT item_id, count(*) AS n, round(avg(CASE WHEN length(value) < 5 THEN NULL WHEN contains(doc, value) THEN 1.0::DOUBLE WHEN len(windows) = 0 THEN 0.0::DOUBLE
  ELSE len(list_filter(windows, lambda x: contains(doc, x))) / len(windows)::DOUBLE END), 6) AS retention FROM w GROUP BY item_id""")
def retention_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean share of an item's windows of ten characters, every five, that a document
    has. Whole texts meet by window, so no item is paired with documents that share none."""
    items, docs = (derived.table(spark, sf_dir, t) for t in ("benchmark", "documents"))
    # one pass over the text, a character at a time; substr would count from its start for each window
    every = F.regexp_extract_all("text", F.lit("(?s)(?=(.{10}))."), F.lit(1))
    fifth = F.filter(every, lambda _, i: i % 5 == 0)
    long = F.char_length("text") >= 10
    windows = items.where(long).select("item_id", F.size(fifth).alias("of"), F.explode(fifth).alias("window"))
    held = docs.where(long).select(F.explode(F.array_distinct(every)).alias("window")).join(windows.select("window").distinct(), "window").groupBy("window").count()
    total = docs.agg(F.count("*").alias("n"), F.count("text").alias("n_texts"))
    share = windows.join(held, "window", "left").groupBy("item_id").agg((F.sum(F.coalesce("count", F.lit(0))) / F.max("of")).alias("found"))
    return share.join(F.broadcast(total)).select("item_id", "n", F.round(F.col("found") / F.col("n_texts"), 6).alias("retention"))


@query(r"""
WITH a AS (SELECT p_partkey, list_distinct(list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type), '\s+'), lambda x: x <> '')) AS w FROM part),
j AS (SELECT a.p_partkey, len(list_filter(a.w, lambda x: list_contains(b.w, x))) AS both_, len(list_distinct(list_concat(a.w, b.w))) AS any_ FROM a JOIN a b ON b.p_partkey = a.p_partkey + 1)
SELECT p_partkey, round(both_ / any_::DOUBLE, 6) AS jaccard, CAST(both_ / any_::DOUBLE >= 0.5 AS INTEGER) AS similar FROM j""")
def names_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = derived.table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("a"))
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b"))
    near = text.names_jaccard(F.col("a"), F.col("b"))
    return part.join(after, "p_partkey").select("p_partkey", F.round(near, 6).alias("jaccard"), text.names_similar(F.col("a"), F.col("b")).cast("int").alias("similar"))


MANIFEST_SQL = """
WITH manifest AS (
  SELECT 'http://x.example/' || source || '/' || (doc_id % 700) || CASE WHEN doc_id % 97 = 0 THEN '?to=a.b@c.example' ELSE '' END AS source_url, sha256(text) AS sha256, lang,
    ['pdf', 'docx', 'html'][1 + doc_id % 3] AS file_type, CAST(strlen(text) AS BIGINT) AS file_size_bytes, doc_id % 11 <> 0 AS robots_allowed,
    doc_id % 5 <> 0 AS redistribution_allowed, doc_id % 7 <> 0 AS public_export_allowed, CASE WHEN doc_id % 83 = 0 THEN 'call 03-1234-5678' END AS notes, doc_id
  FROM documents)"""


def manifest_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    mail = F.when(n % 97 == 0, "?to=a.b@c.example").otherwise("")
    kind = F.element_at(F.array(*map(F.lit, ("pdf", "docx", "html"))), (n % 3).cast("int") + 1)
    return derived.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("http://x.example/"), F.col("source"), F.lit("/"), (n % 700).cast("string"), mail).alias("source_url"), F.sha2("text", 256).alias("sha256"), "lang",
        kind.alias("file_type"), F.octet_length("text").cast("long").alias("file_size_bytes"), (n % 11 != 0).alias("robots_allowed"),
        (n % 5 != 0).alias("redistribution_allowed"), (n % 7 != 0).alias("public_export_allowed"), F.when(n % 83 == 0, "call 03-1234-5678").alias("notes"), "doc_id",
    )


@query(MANIFEST_SQL + " SELECT lang, file_type, count(*) AS n, CAST(sum(file_size_bytes) AS BIGINT) AS n_bytes FROM manifest GROUP BY GROUPING SETS ((lang), (file_type), ())")
def manifest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.stats(manifest_of(spark, sf_dir))


@query(MANIFEST_SQL + r""", checked AS (
  SELECT sha256, list_filter([CASE WHEN NOT robots_allowed THEN 'robots not allowed' END, CASE WHEN public_export_allowed AND NOT redistribution_allowed THEN 'export without redistribution' END,
    CASE WHEN regexp_matches(source_url, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') THEN 'e-mail address' END, CASE WHEN regexp_matches(coalesce(notes, ''), '0[0-9]{1,4}-[0-9]{1,4}-[0-9]{3,4}') THEN 'phone number' END], lambda x: x IS NOT NULL) AS issues FROM manifest)
SELECT sha256, array_to_string(issues, '; ') AS issues FROM checked WHERE len(issues) > 0""")
def manifest_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.audit(manifest_of(spark, sf_dir)).select("sha256", F.array_join("issues", "; ").alias("issues"))


@query(MANIFEST_SQL + """, known AS (SELECT * FROM manifest WHERE doc_id % 4 = 0), fresh AS (
  SELECT * FROM manifest WHERE source_url NOT IN (SELECT source_url FROM known) AND sha256 NOT IN (SELECT sha256 FROM known))
SELECT sha256, min(source_url) AS source_url FROM fresh GROUP BY sha256""")
def manifest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest_of(spark, sf_dir)
    return manifest.new_entries(rows, rows.where("doc_id % 4 = 0")).select("sha256", "source_url")


@query("""
WITH docs AS (SELECT doc_id, source || '-' || (doc_id % 90) AS maker, lang, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY maker ORDER BY h, doc_id) AS n FROM docs) WHERE n = 1),
quota AS (SELECT lang, greatest(1, round_even(count(*) * 50 / (SELECT count(*) FROM one)::DOUBLE, 0)) AS q FROM one GROUP BY lang),
ranked AS (SELECT one.*, row_number() OVER (PARTITION BY one.lang ORDER BY h, maker) AS r FROM one)
SELECT ranked.doc_id, ranked.maker, ranked.lang FROM ranked JOIN quota USING (lang) WHERE r <= q""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    maker = F.concat(F.col("source"), F.lit("-"), (F.col("doc_id") % 90).cast("string"))
    docs = derived.table(spark, sf_dir, "documents").select("doc_id", maker.alias("maker"), "lang")
    return manifest.stratified(docs, "maker", "lang", 50, F.md5(F.col("doc_id").cast("string")))


@query(r"""
WITH c AS (
  SELECT d.doc_id, CASE d.doc_id % 6 WHEN 5 THEN 'Elsewhere.FullText' ELSE 'FirstAidMeasures.ExposureRoute.FirstAidEye.FullText' END AS path,
    CASE d.doc_id % 6 WHEN 4 THEN ' ' WHEN 3 THEN 'None.' ELSE left(d.text, 30) END AS value,
    CASE d.doc_id % 6 WHEN 2 THEN 'never said ' || d.doc_id WHEN 1 THEN '  ' ELSE replace(substr(d.text, 11, 40), ' ', '  ') END AS excerpt, d.text FROM documents d),
n AS (SELECT *, trim(regexp_replace(excerpt, '\s+', ' ', 'g')) AS e, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM c)
SELECT doc_id, CASE WHEN path = 'Elsewhere.FullText' THEN 'path_not_allowed' WHEN trim(value) = '' THEN 'blank_value' WHEN value = 'None.' THEN 'content_free_value' WHEN trim(excerpt) = '' THEN 'blank_excerpt'
  WHEN e = '' OR NOT contains(s, e) THEN 'excerpt_not_found' END AS rejection FROM n""")
def assist_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id") % 6
    candidates = derived.table(spark, sf_dir, "documents").select(
        "doc_id", F.when(n == 5, "Elsewhere.FullText").otherwise(assist.ALLOWED_PATHS[2]).alias("path"),
        F.when(n == 4, " ").when(n == 3, "None.").otherwise(F.left("text", F.lit(30))).alias("value"),
        F.when(n == 2, F.concat(F.lit("never said "), F.col("doc_id").cast("string"))).when(n == 1, "  ").otherwise(F.replace(F.substring("text", 11, 40), F.lit(" "), F.lit("  "))).alias("excerpt"),
        F.col("text").alias("source"),
    )
    return assist.verified(candidates).select("doc_id", "rejection")


@query()
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = derived.table(spark, sf_dir, "pages")
    return pages.select("page_id", text.html_to_text(F.col("html")).alias("text"))


RECORD_JSON = "('{\"Doc\":{\"Id\":' || o_orderkey || ',\"Names\":[\"a\",\"b ' || o_custkey || '\"],\"Blank\":\" \",\"None\":null,\"Rows\":[{\"V\":' || (o_custkey % 7) || '},{}]}}')"


def _record_json() -> Column:
    return F.concat(F.lit('{"Doc":{"Id":'), F.col("o_orderkey").cast("string"), F.lit(',"Names":["a","b '), F.col("o_custkey").cast("string"), F.lit('"],"Blank":" ","None":null,"Rows":[{"V":'), (F.col("o_custkey") % 7).cast("string"), F.lit("},{}]}}"))


@query("""
WITH r AS (SELECT o_orderkey, o_custkey FROM orders)
SELECT o_orderkey AS doc, unnest(['Doc.Id', 'Doc.Names[0]', 'Doc.Names[1]', 'Doc.Blank', 'Doc.None', 'Doc.Rows[0].V']) AS path, unnest([CAST(o_orderkey AS VARCHAR), 'a', 'b ' || o_custkey, ' ', NULL, CAST(o_custkey % 7 AS VARCHAR)]) AS value,
  unnest(['number', 'string', 'string', 'string', 'null', 'number']) AS type, CAST(unnest(range(0, 6)) AS INTEGER) AS ord FROM r""")
def json_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), _record_json().alias("json"))
    return rows.select("doc", F.posexplode(trees.json_leaves(F.col("json"))).alias("ord", "leaf")).select("doc", "leaf.path", "leaf.value", "leaf.type", "ord")


@query("SELECT o_orderkey AS doc, '{\"Doc\": {\"Id\": ' || o_orderkey || ', \"Names\": [\"a\", \"b ' || o_custkey || '\"], \"Rows\": [{\"V\": ' || (o_custkey % 7) || '}]}}' AS pruned, o_orderkey || ' a b ' || o_custkey || '   ' || (o_custkey % 7) AS text FROM orders")
def json_prune_and_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), _record_json().alias("json"))
    return rows.select("doc", trees.prune_json(F.col("json")).alias("pruned"), trees.walk_text(F.col("json")).alias("text"))


@query("SELECT o_orderkey AS doc, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE '{\"a\": [1, ' || o_custkey || ']}' END AS repaired FROM orders")
def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey") % 4
    cust = F.col("o_custkey").cast("string")
    broken = (
        F.when(n == 0, F.concat(F.lit('```json\n{"a": [1, '), cust, F.lit("]}\n```")))
        .when(n == 1, F.concat(F.lit('{"a": [1, '), cust, F.lit(",],}")))
        .when(n == 2, F.concat(F.lit('{"a": [1, '), cust))
        .otherwise("no json at all")
    )
    rows = derived.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), broken.alias("json"))
    return rows.select("doc", trees.repair_json(F.col("json")).alias("repaired"))
