"""Records as readable documents: HTML, DOCX and filled templates.

One row renders by itself; the functions here are the per-row helpers of Arrow UDFs."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable
from html import escape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.schema import NUMBERED
from .trees import flattened

# Section titles by language.
TITLES = {
    "ja": ["化学品及び会社情報", "危険有害性の要約", "組成及び成分情報", "応急措置", "火災時の措置", "漏出時の措置", "取扱い及び保管上の注意", "ばく露防止及び保護措置", "物理的及び化学的性質", "安定性及び反応性", "有害性情報", "環境影響情報", "廃棄上の注意", "輸送上の注意", "適用法令", "その他の情報"],
    "en": ["Identification", "Hazard(s) Identification", "Composition / Information on Ingredients", "First-Aid Measures", "Fire-Fighting Measures", "Accidental Release Measures", "Handling and Storage", "Exposure Controls / Personal Protection", "Physical and Chemical Properties", "Stability and Reactivity", "Toxicological Information", "Ecological Information", "Disposal Considerations", "Transport Information", "Regulatory Information", "Other Information"],
    "zh-CN": ["化学品及其企业标识", "危险性概述", "成分/组成信息", "急救措施", "消防措施", "泄漏应急处理", "操作处置与储存", "接触控制/个体防护", "理化特性", "稳定性和反应性", "毒理学信息", "生态学信息", "废弃处置", "运输信息", "法规信息", "其他信息"],
    "zh-TW": ["化學品與廠商資料", "危害辨識資料", "成分辨識資料", "急救措置", "滅火措施", "洩漏處理方法", "安全處置與儲存方法", "暴露預防措施", "物理及化學性質", "安定性及反應性", "毒性資料", "生態資料", "廢棄處置方法", "運送資料", "法規資料", "其他資料"],
}


def sections(record: dict, language: str) -> list[tuple[str, object]]:
    """(numbered title, content) of the sections that a record has, in order."""
    titles = TITLES.get(language, TITLES["en"])
    return [(f"{n}. {titles[n - 1]}", record[name]) for n, name in enumerate(NUMBERED, 1) if record.get(name)]


def plain(value: object) -> str:
    """A leaf or a list of leaves on one line; nothing for objects."""
    if isinstance(value, list):
        return ", ".join(x for v in value if (x := plain(v)))
    return "" if value is None or isinstance(value, dict) else value if isinstance(value, str) else json.dumps(value)


def _table(rows: list[list[str]], head: list[str] | None = None) -> str:
    top = "<thead><tr>" + "".join(f"<th>{escape(h)}</th>" for h in head) + "</tr></thead>" if head else ""
    return f"<table>{top}<tbody>" + "".join("<tr>" + "".join(r) + "</tr>" for r in rows) + "</tbody></table>"


def html_of(value: object) -> str:
    """Objects as tables of two columns, lists of objects as one table with the first
    one's keys, other lists as lists; what is empty is left out."""
    if isinstance(value, dict):
        rows = [[f'<th class="key">{escape(k)}</th>', f"<td>{x}</td>"] for k, v in value.items() if (x := html_of(v))]
        return _table(rows) if rows else ""
    if isinstance(value, list) and value and all(isinstance(v, dict) for v in value):
        keys = list(value[0])
        return _table([[f"<td>{escape(plain(v.get(k)))}</td>" for k in keys] for v in value], keys) if keys else ""
    if isinstance(value, list):
        items = [f"<li>{escape(x)}</li>" for v in value if (x := plain(v))]
        return "<ul>" + "".join(items) + "</ul>" if items else ""
    text = plain(value)
    return f"<span>{escape(text)}</span>" if text else ""


def html_page(record: dict, language: str) -> str:
    body = "".join(f"<section><h2>{escape(t)}</h2>{html_of(v)}</section>" for t, v in sections(record, language))
    return f'<!DOCTYPE html><html lang="{escape(language)}"><head><meta charset="utf-8"></head><body>{body}</body></html>'


def lines_of(value: object, depth: int = 0) -> list[str]:
    """Indented text lines of a tree, labels before values."""
    if isinstance(value, dict):
        out = []
        for k, v in value.items():
            inner = lines_of(v, depth + 1)
            if inner:
                out += [f"{'  ' * depth}{k}: {inner[0].strip()}"] if len(inner) == 1 and not isinstance(v, (dict, list)) else [f"{'  ' * depth}{k}:", *inner]
        return out
    if isinstance(value, list):
        return [x for v in value for x in lines_of(v, depth)]
    text = plain(value)
    return ["  " * depth + x for x in text.split("\n")] if text.strip() else []


def docx(record: dict, language: str) -> bytes:
    """A minimal word-processing document: a heading and lines for each section."""
    para = lambda t, bold=False: f'<w:p><w:r>{"<w:rPr><w:b/></w:rPr>" if bold else ""}<w:t xml:space="preserve">{escape(t)}</w:t></w:r></w:p>'
    body = "".join(para(t, True) + "".join(map(para, lines_of(v))) for t, v in sections(record, language))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        parts = {
            "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
            "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
            "word/document.xml": f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>',
        }
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name), '<?xml version="1.0" encoding="UTF-8"?>' + text)
    return out.getvalue()


def filled(template: str, record: dict) -> str:
    """``{{key}}`` replaced by the record's value under that short key or full path, in
    one pass; unknown keys become blank."""
    values = flattened(record)
    return re.sub(r"\{\{\s*([^{}]+?)\s*\}\}", lambda m: escape(values.get(m[1], "")), template)


def _udf(text: Column, other: Column, f: Callable[[dict, str], object], kind: str) -> Column:
    def one(t: str | None, o: str | None) -> object:
        try:
            record = json.loads(t) if t else None
        except ValueError:
            return None
        return f(record, o or "") if isinstance(record, dict) else None

    return F.pandas_udf(lambda a, b: pd.Series([one(t, o) for t, o in zip(a, b, strict=True)], dtype=object), kind)(text, other)


def render_html(record_json: Column, language: Column) -> Column:
    return _udf(record_json, language, html_page, "string")


def render_docx(record_json: Column, language: Column) -> Column:
    return _udf(record_json, language, docx, "binary")


def fill_template(record_json: Column, template: Column) -> Column:
    return _udf(record_json, template, lambda r, t: filled(t, r), "string")
