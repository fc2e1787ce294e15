"""Text cleaning, comparison and naming."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters of lines that only draw a rule.
RULE_CHARS = "-=_*─━╌╍┄┅┈┉╴╶╸·•~/\\|+#"
TRUNCATED = "\n[テキスト省略]\n"
REPEATED_BYTES, REPEATED_TIMES = 80, 4

# Names that say nothing, and classifications that name no hazard.
PLACEHOLDERS = ["n/a", "na", "unknown", "不明", "未定", "化学物質", "chemical substance", "substance", "物質名", "product", "製品名"]
NO_HAZARD = ["not classified", "not applicable", "n/a", "na", "分類できない", "分類対象外", "区分外", "該当なし", "データなし", "不适用", "不分类", "无资料", "分類不明", "分类不明"]

# Characters that count as the same when searching.
SEARCH_FROM = "，、．。－（）異環鹼鹽鋰鈉鉀鐵銅鋁銀鋅氫無劑烴"
SEARCH_TO = ",,..-()异环碱盐锂钠钾铁铜铝银锌氢无剂烃"


def tidy(text: str, max_chars: int) -> str:
    """One text: lines trimmed, control characters and drawn rules gone, blank runs
    one line, short lines seen often kept once, cut to ``max_chars``."""
    kept: list[str] = []
    for line in text.split("\n")[: -1 if text.endswith("\n") else None] if text else []:
        line = "".join(c for c in line.strip() if c >= " " or c == "\t").strip()
        if len(line) >= 3 and all(c in RULE_CHARS for c in line):
            continue
        if line or not kept or kept[-1]:
            kept.append(line)
    short = Counter(x for x in kept if x and len(x.encode()) <= REPEATED_BYTES)
    seen: set[str] = set()
    out = []
    for line in kept:
        if short[line] >= REPEATED_TIMES:
            if line in seen:
                continue
            seen.add(line)
        out.append(line + "\n")
    joined = "".join(out)
    return joined[:max_chars] + TRUNCATED if len(joined) > max_chars else joined


def clean_text(text: Column, max_chars: int = 80_000) -> Column:
    """``tidy`` for a column; each row is cleaned by itself, so nothing is shuffled."""
    return F.pandas_udf(lambda s: s.map(lambda t: None if t is None else tidy(t, max_chars)), "string")(text)


class _Text(HTMLParser):
    """Text of a page: scripts, styles, navigation, headers and footers skipped,
    table cells joined by tabs, rows and blocks ended by a new line."""

    SKIPPED = {"script", "style", "nav", "header", "footer", "noscript"}
    BLOCKS = {"p", "div", "section", "article", "li", "ul", "ol", "br", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "dl", "dt", "dd"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip: list[str] = []
        self.in_body = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "body":
            self.in_body = True
        elif tag in self.SKIPPED:
            self.skip.append(tag)
        elif not self.skip and tag in self.BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if self.skip and tag == self.skip[-1]:
            self.skip.pop()
        elif not self.skip and tag in ("td", "th"):
            self.out.append("\t")
        elif not self.skip and tag in self.BLOCKS:
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if self.in_body and not self.skip and data.strip():
            self.out.append(data.strip() + " ")


def page_text(html: str) -> str:
    parser = _Text()
    parser.feed(html)
    parser.close()
    lines = (re.sub(r"[ ]*\t[ ]*", "\t", x).strip() for x in "".join(parser.out).split("\n"))
    return "\n".join(x for x in lines if x)


def html_to_text(html: Column) -> Column:
    def of(pages: pd.Series) -> pd.Series:
        return pages.map(lambda h: None if h is None else page_text(h))

    return F.pandas_udf(of, "string")(html)


def is_placeholder(name: Column) -> Column:
    return F.lower(F.trim(name)).isin(["", *PLACEHOLDERS])


def is_real_hazard(value: Column) -> Column:
    """A classification value that is not blank and holds no phrase for "none"."""
    low = F.lower(F.trim(value))
    none = F.lit(False)
    for phrase in NO_HAZARD:
        none = none | F.contains(low, F.lit(phrase))
    return (low != "") & ~none


def looks_like_date(text: Column) -> Column:
    """A token of four or eight digits that starts with 1 or 2, or a year mark and a digit."""
    token = F.exists(F.split(text, "[^0-9]"), lambda t: F.char_length(t).isin(4, 8) & t.rlike("^[12]"))
    return token | (F.contains(text, F.lit("年")) & text.rlike("[0-9]"))


def normalized_for_search(text: Column) -> Column:
    return F.translate(F.regexp_replace(text, r"(?U)\s", ""), SEARCH_FROM, SEARCH_TO)


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def source_contains(source: Column, value: Column, plain: Column | None = None) -> Column:
    """Whether a text has a value, as it is or normalized; values of under three bytes
    always, values of which normalizing leaves so little only as they are. ``plain`` is
    the normalized source where a row has it already."""
    v, plain = _trimmed(value), normalized_for_search(source) if plain is None else plain
    short = normalized_for_search(v)
    return (F.octet_length(v) < 3) | F.contains(source, v) | ((F.octet_length(short) >= 3) & F.contains(plain, short))


# Marks of stereo forms that printed names often lose.
STEREO = ["(-)", "(+)", "(±)", "(R)", "(S)", "(d)", "(l)"]
LONG_NAME, BASE_WITHIN, BASE_DEFAULT, BASE_LEAST, CORE_BYTES = 40, 35, 25, 8, 8


def source_contains_name(source: Column, name: Column, plain: Column | None = None) -> Column:
    """``source_contains``, or one shorter form of the name is there: the part before the
    first bracket, comma or semicolon of a long name, the name without the position
    numbers that it begins with, or without its stereo marks."""
    plain = normalized_for_search(source) if plain is None else plain
    at = F.regexp_instr(F.left(name, F.lit(BASE_WITHIN)), F.lit(r"([(,;\x{FF08}])"))
    base = _trimmed(F.left(name, F.greatest(F.when(at > 0, at - 1).otherwise(BASE_DEFAULT), F.lit(BASE_LEAST))))
    core = flat = normalized_for_search(name)
    core = F.regexp_replace(core, "^[0-9,-]+", "")
    for mark in STEREO:
        flat = F.replace(flat, F.lit(mark), F.lit(""))
    found = source_contains(source, name, plain) | ((F.char_length(name) > LONG_NAME) & source_contains(source, base, plain))
    for form in (core, flat):
        found = found | ((F.octet_length(form) >= CORE_BYTES) & F.contains(plain, form))
    return found


def source_contains_cas(source: Column, cas: Column, plain: Column | None = None) -> Column:
    """Whether a text has a CAS number, also with full-width hyphens or stray spaces."""
    plain = normalized_for_search(source) if plain is None else plain
    return F.contains(source, cas) | F.contains(plain, normalized_for_search(cas))


def has_kana(text: Column) -> Column:
    return text.rlike(r"[\x{3040}-\x{30FF}]")


def verified_excerpt(source: Column, excerpt: Column) -> Column:
    """Whether the excerpt is in the source, white space aside (and between two CJK
    characters altogether)."""
    cjk = r"[\x{3001}\x{3002}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"

    def plain(x: Column) -> Column:
        return F.regexp_replace(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")), f"(?<={cjk}) (?={cjk})", "")

    return (plain(excerpt) != "") & F.contains(plain(source), plain(excerpt))


def retention(value: Column, document: Column, width: int = 10, stride: int = 5) -> Column:
    """How much of a value a document holds: null for under five characters, 1 for an
    exact hit, else the share of its windows that are in the document."""
    n = F.char_length(value)
    starts = F.when(n >= width, F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1)), F.lit(stride))).otherwise(F.array().cast("array<int>"))
    hits = F.filter(starts, lambda i: F.contains(document, F.substr(value, i, F.lit(width))))
    share = F.when(F.size(starts) == 0, 0.0).otherwise(F.size(hits) / F.size(starts))
    return F.when(n < 5, F.lit(None).cast("double")).when(F.contains(document, value), 1.0).otherwise(share)


def names_similar(a: Column, b: Column, least: float = 0.5) -> Column:
    """Jaccard similarity of the lower-cased words; false if either has none."""
    return (F.size(_words(a)) > 0) & (F.size(_words(b)) > 0) & (names_jaccard(a, b) >= least)


def names_jaccard(a: Column, b: Column) -> Column:
    x, y = _words(a), _words(b)
    both = F.size(F.array_union(x, y))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / both)


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != ""))


def file_stem(text: Column) -> Column:
    """Letters, digits and hyphens kept, others as underscores, none at the ends."""
    return F.btrim(F.regexp_replace(text, r"[^\p{IsAlphabetic}\p{N}-]", "_"), F.lit("_"))


def escaped_html(text: Column) -> Column:
    out = text
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def escaped_markdown(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "[\r\n]+", " "), r"([\\`*_\[\]<>|#])", r"\\$1")
