"""Country requirements: gaps of a record against a country's standard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Standard, and words of which regulatory text has to have one.
COUNTRIES = {
    "cn": ("GB/T 16483", ["危险化学品", "GB 13690", "GB/T 17519", "GB 30000"]),
    "kr": ("KOSHA", ["산업안전보건법", "화학물질관리법", "K-REACH"]),
    "tw": ("CNS 15030", ["職業安全衛生法", "毒性及關注化學物質", "CNS 15030"]),
    "jp": ("JIS Z 7253", []),
}
EXPOSURE_WORDS = ["GBZ", "职业接触限值", "职业卫生"]

#: (country, section, field, severity, column that has to be true)
REQUIREMENTS = [
    ("cn", 1, "EmergencyContact", "Critical", "has_emergency"),
    ("cn", 8, "OccupationalExposureLimits", "Major", "has_exposure_words"),
    ("cn", 11, "AcuteToxicity", "Major", "has_acute_toxicity"),
    ("cn", 15, "RegulatoryInformation", "Critical", "has_regulatory_words"),
    ("kr", 1, "EmergencyContact", "Critical", "has_emergency"),
    ("kr", 15, "RegulatoryInformation", "Major", "has_regulatory_words"),
    ("tw", 1, "EmergencyContact", "Major", "has_emergency"),
    ("tw", 15, "RegulatoryInformation", "Advisory", "has_regulatory_words"),
    ("jp", 15, "RegulatoryInformation", "Advisory", "has_regulatory"),
]


def mentions(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(F.coalesce(text, F.lit("")), F.lit(w))
    return out


def facts(records: DataFrame) -> DataFrame:
    """``records`` (country, emergency_phone, exposure, acute_toxicity, regulatory) with
    the columns that the requirements read."""
    regulatory = F.lit(False)
    for country, (_, words) in COUNTRIES.items():
        regulatory = regulatory | ((F.col("country") == country) & mentions(F.col("regulatory"), words))
    return records.withColumns({
        "has_emergency": F.coalesce(F.trim("emergency_phone"), F.lit("")) != "",
        "has_exposure_words": mentions(F.col("exposure"), EXPOSURE_WORDS),
        "has_acute_toxicity": F.col("acute_toxicity").isNotNull(),
        "has_regulatory_words": regulatory, "has_regulatory": F.col("regulatory").isNotNull(),
    })


def gaps(records: DataFrame, key: str) -> DataFrame:
    """(key, country, section, field, severity): one row a gap."""
    one = lambda c, s, f, v, need: F.when((F.col("country") == c) & ~F.col(need), F.struct(F.lit(s).alias("section"), F.lit(f).alias("field"), F.lit(v).alias("severity")))
    found = F.array_compact(F.array(*(one(*r) for r in REQUIREMENTS)))
    return facts(records).select(key, "country", F.explode(found).alias("gap")).select(key, "country", "gap.*")


# Words of which China's regulatory section has to have one.
CATALOGUE_WORDS = ["危险化学品", "GB 13690", "GB13690", "GB 30000"]


def warnings(records: DataFrame, key: str) -> DataFrame:
    """(key, country, section, warning): what the country of a record asks beyond the
    checks of all countries: an emergency telephone number in China, Korea and Taiwan, a
    reference to the catalogue in China. ``records`` as in ``facts``; a number of blanks
    is one here, and other countries have no warnings."""
    phone = F.coalesce(F.col("emergency_phone"), F.lit("")) != ""
    country = F.col("country")
    found = F.array_compact(F.array(
        F.when(country.isin("cn", "kr", "tw") & ~phone, F.struct(F.lit(1).alias("section"), F.lit("no_emergency_contact").alias("warning"))),
        F.when((country == "cn") & ~mentions(F.col("regulatory"), CATALOGUE_WORDS), F.struct(F.lit(15).alias("section"), F.lit("no_catalogue_reference").alias("warning"))),
    ))
    return records.select(key, "country", F.explode(found).alias("found")).select(key, "country", "found.*")
