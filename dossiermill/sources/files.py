"""Documents and records from files."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import page_text
from .schema import LISTS, SECTIONS, record_type

# Extensions by format.
FORMATS = {"pdf": ["pdf"], "docx": ["docx"], "xlsx": ["xlsx", "xls"], "html": ["html", "htm"], "txt": ["txt"]}
MAX_BINARY_BYTES, MAX_TEXT_BYTES = 500 << 20, 100 << 20


def input_format(path: Column) -> Column:
    """url, pdf, docx, xlsx, html or txt by scheme and extension; null if unknown."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    out = F.when(F.lower(path).rlike("^https?://"), "url")
    for name, exts in FORMATS.items():
        out = out.when(ext.isin(exts), name)
    return out


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(path, format, length, content) of the supported files under a folder, deeper
    ones included. Too large files are left out before their content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    most = F.when(input_format(F.col("path")).isin("txt", "html"), MAX_TEXT_BYTES).otherwise(MAX_BINARY_BYTES)
    return files.where(input_format(F.col("path")).isNotNull() & (F.col("length") <= most)).select("path", input_format(F.col("path")).alias("format"), "length", "content")


def _docx(content: bytes) -> str:
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{ns}t")) for p in root.iter(f"{ns}p"))


def _xlsx(content: bytes) -> str:
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    book = zipfile.ZipFile(io.BytesIO(content))
    names = book.namelist()
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in s.iter(f"{ns}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{ns}si")]
    lines = []
    for name in sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
        for row in ElementTree.fromstring(book.read(name)).iter(f"{ns}row"):
            cells = []
            for c in row.iter(f"{ns}c"):
                v = c.findtext(f"{ns}v") or "".join(t.text or "" for t in c.iter(f"{ns}t"))
                cells.append(shared[int(v)] if c.get("t") == "s" and v else v)
            lines.append("\t".join(x for x in cells if x))
    return "\n".join(x for x in lines if x)


READERS = {"docx": _docx, "xlsx": _xlsx, "html": lambda c: page_text(c.decode("utf-8", "replace")), "txt": lambda c: c.decode("utf-8", "replace")}


def extracted_text(kind: Column, content: Column) -> Column:
    """(text, error) of a file's content; formats without a reader here (pdf, url)
    give an error and no text."""

    def of(kinds: pd.Series, contents: pd.Series) -> pd.DataFrame:
        rows = []
        for k, c in zip(kinds, contents, strict=True):
            try:
                rows.append((READERS[k](c), None))
            except KeyError:
                rows.append((None, f"no reader for {k}"))
            except Exception as e:
                rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["text", "error"])

    return F.pandas_udf(of, "text string, error string")(kind, content)


def records(texts: DataFrame, json: str = "json") -> DataFrame:
    """``texts`` with a column for each section, read leniently: of a list in place of a
    section its first object counts, an object in place of a list of a section's is a list
    of one; a section of another wrong shape is null and named in ``skipped``; text that is
    no JSON object has all sections null and ``malformed`` true."""
    variant = F.try_parse_json(json)
    raw = F.from_json(json, ", ".join(f"`{s}` string" for s in SECTIONS))
    out = texts.withColumns({"_raw": raw, "malformed": variant.isNull()})
    sections = {}
    for field in record_type():
        text = F.col(f"_raw.`{field.name}`")
        begins = lambda c, sign: F.startswith(F.ltrim(c), F.lit(sign))
        if field.name in LISTS:
            text = F.when(begins(text, "{"), F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)
        else:
            head = F.get_json_object(text, "$[0]")
            text = F.when(begins(text, "[") & begins(head, "{"), head).otherwise(text)
        kind = field.dataType.typeName()
        opens = {"struct": "{", "array": "["}.get(kind)
        sections[field.name] = F.when(begins(text, opens), F.from_json(text, field.dataType)) if opens else text
    out = out.withColumns(sections)
    skipped = F.array_compact(F.array(*(F.when(F.col(f"_raw.`{s}`").isNotNull() & F.col(f"`{s}`").isNull(), F.lit(s)) for s in SECTIONS)))
    return out.withColumn("skipped", skipped).drop("_raw")


def suggested_name(issue_date: Column, product_no: Column, trade_name: Column) -> Column:
    """SDS_<date>_<code>: the issue date without hyphens, today's if there is none; the
    product number, else the trade name, with characters that files cannot have replaced,
    else NoCode."""
    from ..functions.text import file_stem

    date = F.replace(issue_date, F.lit("-"), F.lit(""))
    code = file_stem(F.coalesce(product_no, trade_name))
    full = lambda c, other: F.when(F.coalesce(c, F.lit("")) != "", c).otherwise(other)
    return F.concat(F.lit("SDS_"), full(date, F.date_format(F.current_date(), "yyyyMMdd")), F.lit("_"), full(code, F.lit("NoCode")))
