"""Chemical identifiers found in text, and how well a record covers them.

Two extractors are in use and differ: ``py`` keeps the case it finds and looks for
codes of certain families, ``cli`` takes any three digits and upper-cases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Literals that count as signal words, in this order.
SIGNAL_WORDS = [
    "危険", "警告", "Danger", "danger", "DANGER", "Warning", "warning", "WARNING",
    "危险", "Not classified", "not classified", "Not applicable",
]

PATTERNS = {
    "py": {
        "cas": r"(?U)\b\d{2,7}-\d{2}-\d\b",
        "h_codes": r"(?iU)\bH[23456]\d{2}\b",
        "p_codes": r"(?iU)\bP[123456]\d{2}\b",
        "un": r"(?iU)UN\s*\d{4}",
    },
    "cli": {
        "cas": r"(?<![0-9])[0-9]{2,7}-[0-9]{2}-[0-9](?![0-9])",
        "h_codes": r"(?i)(?<![\p{IsAlphabetic}\p{N}_])H[0-9]{3}(?![\p{IsAlphabetic}\p{N}])",
        "p_codes": r"(?i)(?<![\p{IsAlphabetic}\p{N}_])P[0-9]{3}(?![\p{IsAlphabetic}\p{N}])",
        "un": r"(?i)(?<![A-Za-z0-9])UN[ \t:.]*[0-9]{4}(?![0-9])",
    },
}


def extracted(text: Column, kind: str, profile: str = "py") -> Column:
    """Distinct identifiers of one kind (cas, h_codes, p_codes, un), in text order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERNS[profile][kind]), F.lit(0))
    if profile == "cli" and kind == "un":
        found = F.transform(found, lambda x: F.regexp_replace(x, "[^0-9]", ""))
    elif profile == "cli" and kind != "cas":
        found = F.transform(found, lambda x: F.upper(x))
    elif kind == "un":
        found = F.transform(found, lambda x: F.regexp_replace(x, r"(?U)\s+", ""))
    return F.array_distinct(found)


def signal_words(text: Column) -> Column:
    """The signal words in the text; of spellings that differ by case the first."""
    words = F.array(*map(F.lit, SIGNAL_WORDS))
    found = F.filter(words, lambda w: F.contains(F.coalesce(text, F.lit("")), w))
    lower = F.transform(found, lambda w: F.lower(w))
    return F.filter(found, lambda w, i: F.array_position(lower, F.lower(w)) == i + 1)


def recall(source: Column, record: Column) -> Column:
    """Share of the source's items that the record has; 1 if the source has none."""
    return F.when(F.size(source) == 0, 1.0).otherwise(F.size(F.array_intersect(source, record)) / F.size(F.array_distinct(source)))


def precision(source: Column, record: Column) -> Column:
    """Share of the record's items that the source has; 1 if the record has none."""
    return recall(record, source)


def coverage(items: Column, record_json: Column) -> Column:
    """Share of the items whose text is anywhere in the record, ignoring case."""
    record = F.upper(F.coalesce(record_json, F.lit("")))
    hits = F.filter(items, lambda i: F.contains(record, F.upper(i)))
    return F.when(F.size(items) == 0, 1.0).otherwise(F.size(hits) / F.size(items))
