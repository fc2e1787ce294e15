"""Document language by script, and the country that it suggests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that tell simplified from traditional Chinese, pairwise.
SIMPLIFIED = "国语时书来这过东样从实动产问给长发规药标剂险质现处须经联则级为与对气无变数间应关"
TRADITIONAL = "國語時書來這過東樣從實動產問給長發規藥標劑險質現處須經聯則級為與對氣無變數間應關"

MIN_CHARS = 30
MIN_KANA = 6
MIN_HAN = 20
MIN_LATIN_PERCENT = 30

COUNTRY = {"ja": "jp", "zh-CN": "cn", "zh-TW": "tw"}


def count_of(text: Column, char_class: str) -> Column:
    """How many code points of the text are in a character class. Runs of the class are taken
    out, so a text with few of them is hardly copied."""
    return F.char_length(text) - F.char_length(F.regexp_replace(text, f"[{char_class}]+", ""))


def detect_language(text: Column) -> Column:
    """ja, en, zh-CN or zh-TW. Short and garbled texts count as ja; null is empty."""
    text = F.coalesce(text, F.lit(""))
    visible = F.char_length(F.regexp_replace(text, r"(?U)\s+", ""))
    kana = count_of(text, r"\x{3040}-\x{30FF}")
    han = count_of(text, r"\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}")
    latin = count_of(text, "A-Za-z0-9")
    chinese = F.when(count_of(text, TRADITIONAL) > count_of(text, SIMPLIFIED), "zh-TW").otherwise("zh-CN")
    return (
        F.when((visible < MIN_CHARS) | (kana >= MIN_KANA), "ja")
        .when((han < MIN_HAN) & (latin * 100 >= visible * MIN_LATIN_PERCENT), "en")
        .when(han < MIN_HAN, "ja")
        .otherwise(chinese)
    )


def country_of(language: Column) -> Column:
    """The country that a language suggests; English suggests none."""
    out = F.lit(None).cast("string")
    for name, country in COUNTRY.items():
        out = F.when(language == name, country).otherwise(out)
    return out
