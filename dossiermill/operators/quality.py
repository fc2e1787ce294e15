"""Quality checks of the hazard section: signal word, codes and pictograms.

Rules read the columns lang, signal, h_codes and p_codes (distinct, in canonical
form), statements (the codes as given, one a statement), pictograms and
classification. Most are rows of tables, so that a rule's codes stand in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import Rule, findings

# Signal words that count as valid, as one of the two, as Danger, as Warning.
VALID_SIGNALS = [
    "危険", "警告", "Danger", "Warning", "N/A", "不適用", "Not applicable", "不适用", "危险", "无资料", "危險",
    "なし", "該当区分なし", "該当しない", "なし（GHSの危険有害性なし）", "危険性なし", "警告なし",
]
SINGLE_SIGNALS = ["危険", "警告", "danger", "warning", "危险", "危險"]
ACTIVE_SIGNALS = ["Danger", "Warning", "危険", "警告", "危险"]
DANGER = ["Danger", "危険", "危险"]
WARNING = ["Warning", "警告"]
ENGLISH_SIGNALS = ["danger", "warning", "n/a", "not applicable"]

# Codes of categories 1 and 2, which go with Danger.
SEVERE_CODES = """
H200 H201 H202 H203 H204 H205 H220 H221 H222 H223 H224 H225 H260 H261 H270 H271 H280 H281 H290
H300 H301 H310 H311 H330 H331 H314 H317 H318 H334 H340 H341 H350 H351 H360 H361 H370 H371 H400 H410 H420
""".split()

# Hazard codes that need one of the precautionary codes.
NEEDS_ANY = [
    ("S2-H22X-NO-P210", ["H224", "H225", "H226"], ["P210"]),
    ("S2-H3XX-NO-P301", ["H300", "H301", "H302"], ["P301", "P330"]),
    ("S2-H33X-NO-P304", ["H330", "H331", "H332"], ["P304", "P261"]),
    ("S2-H318-NO-P305", ["H318", "H319"], ["P305"]),
]
CORROSIVE_NEEDS = ["P280", "P301", "P305"]

# Hazard codes that need a pictogram.
NEEDS_PICTOGRAM = [
    ("S2-EXPLOSIVE-NO-GHS01", "GHS01", ["H200", "H201", "H202", "H203", "H204", "H205"]),
    ("S2-ENV-NO-GHS09", "GHS09", ["H410", "H411", "H412", "H413"]),
    ("S2-FLAMMABLE-NO-GHS02", "GHS02", ["H220", "H221", "H222", "H223", "H224", "H225", "H226", "H228", "H242", "H252"]),
    ("S2-CORROSIVE-NO-GHS05", "GHS05", ["H314"]),
    ("S2-ACUTETOX-NO-GHS06", "GHS06", ["H300", "H301", "H310", "H311", "H330", "H331"]),
]
PICTOGRAM = r"(GHS-?0[1-9]|絵表示0[1-9])"
MOST_H_CODES, LEAST_P_DANGER, LEAST_P_WARNING = 12, 4, 3


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def has_any(column: str, codes: list[str]) -> Column:
    return F.arrays_overlap(F.col(column), _strings(codes))


_some = lambda column: F.size(column) > 0
_signal = lambda: F.coalesce(F.trim("signal"), F.lit(""))
_active = lambda: _signal().isin(ACTIVE_SIGNALS)
_valid = lambda: F.lower(_signal()).isin([s.lower() for s in VALID_SIGNALS])


def _several_signals() -> Column:
    parts = F.filter(F.transform(F.split(_signal(), "[、,，/／]+"), lambda p: F.trim(p)), lambda p: p != "")
    return (F.size(parts) >= 2) & F.forall(parts, lambda p: F.lower(p).isin(SINGLE_SIGNALS))


def _no_code() -> Column:
    return _some("statements") & F.forall("statements", lambda c: F.coalesce(c, F.lit("")) == "")


def section2() -> list[Rule]:
    given = lambda: _signal() != ""
    rules = [
        Rule("HIGH", "S2-MULTIPLE-SIGNAL-WORDS", lambda: given() & ~_valid() & _several_signals(), "several signal words in one"),
        Rule("MED", "S2-INVALID-SIGNAL-WORD", lambda: given() & ~_valid() & ~_several_signals(), "no known signal word"),
        Rule("HIGH", "S2-KATAKANA-SIGNAL-WORD", lambda: F.col("lang").isin("zh-cn", "zh-tw") & _signal().rlike(r"[\x{30A0}-\x{30FF}]"), "katakana in a Chinese document's signal word"),
        Rule("MED", "S2-NON-ENGLISH-SIGNAL-WORD", lambda: given() & (F.col("lang") == "en") & ~F.lower(_signal()).isin(ENGLISH_SIGNALS), "no English signal word in an English document"),
        Rule("HIGH", "S2-H224-NO-DANGER", lambda: given() & has_any("h_codes", ["H224"]) & ~_signal().isin(DANGER), "H224 without Danger"),
        Rule("MED", "S2-H226-ALONE-DANGER", lambda: _signal().isin(DANGER) & has_any("h_codes", ["H226"]) & ~has_any("h_codes", SEVERE_CODES), "Danger for H226 alone"),
        Rule("CRIT", "S2-HS-CODES-EMPTY", lambda: _no_code() & _active(), "statements without any code"),
        Rule("HIGH", "S2-SIGNAL-NO-HCODES", lambda: _active() & ~_some("h_codes"), "signal word without hazard codes"),
        Rule("HIGH", "S2-SIGNAL-NO-HAZARDSTATEMENT", lambda: _active() & ~_some("statements"), "signal word without statements"),
        Rule("MED", "S2-TOO-MANY-HCODES", lambda: F.size("h_codes") > MOST_H_CODES, "very many hazard codes"),
        Rule("MED", "S2-DANGER-NO-CAT12", lambda: _signal().isin(DANGER) & _some("h_codes") & ~has_any("h_codes", SEVERE_CODES), "Danger without a severe code"),
        Rule("HIGH", "S2-NO-PCODES", lambda: given() & _some("h_codes") & ~_some("p_codes"), "hazard codes without precautionary codes"),
        Rule("MED", "S2-DANGER-FEW-PCODES", lambda: _signal().isin(DANGER) & _some("p_codes") & (F.size("p_codes") < LEAST_P_DANGER), "few precautionary codes for Danger"),
        Rule("MED", "S2-WARNING-FEW-PCODES", lambda: _signal().isin(WARNING) & _some("p_codes") & (F.size("p_codes") < LEAST_P_WARNING), "few precautionary codes for Warning"),
    ]
    rules += [Rule("MED", name, lambda h=h, p=p: has_any("h_codes", h) & ~has_any("p_codes", p), f"none of {', '.join(p)}") for name, h, p in NEEDS_ANY]
    rules += [
        Rule("MED", "S2-H314-MISSING-P", lambda: has_any("h_codes", ["H314"]) & (F.size(F.array_except(_strings(CORROSIVE_NEEDS), F.col("p_codes"))) > 0), "H314 without all of its precautionary codes"),
        Rule("MED", "S2-INVALID-PICTOGRAM", lambda: F.filter("pictograms", lambda p: (F.trim(p) != "") & ~p.rlike(PICTOGRAM)), lambda p: F.concat(F.lit("no known pictogram: "), p), each=True),
        Rule("MED", "S2-NO-CLASSIFICATION", lambda: _some("h_codes") & (F.coalesce("classification", F.lit("")) == ""), "hazard codes without classification"),
        Rule("MED", "S2-HAZARD-NO-PICTOGRAM", lambda: _active() & _some("h_codes") & ~_some("pictograms"), "hazard codes without pictograms"),
    ]
    rules += [Rule("MED", name, lambda g=g, h=h: _some("pictograms") & has_any("h_codes", h) & ~F.contains(F.array_join("pictograms", " "), F.lit(g)), f"no {g}") for name, g, h in NEEDS_PICTOGRAM]
    return rules


def checked(labels: DataFrame) -> DataFrame:
    """``labels`` with ``findings`` of the hazard section, in rule order."""
    return labels.withColumn("findings", findings(section2()))
