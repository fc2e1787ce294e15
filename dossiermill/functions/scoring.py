"""Document scores and grades, in the two profiles in use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points off for each CRIT, HIGH, MED and LOW finding.
WEIGHTS = {"py": (35.0, 8.0, 1.5, 0.3), "cli": (40.0, 5.0, 1.0, 0.0)}


def score(crit: Column, high: Column, med: Column, low: Column | int = 0, profile: str = "py") -> Column:
    a, b, c, d = (F.lit(w).cast("double") for w in WEIGHTS[profile])
    low = F.lit(low) if isinstance(low, int) else low
    return F.greatest(F.lit(0.0), F.lit(100.0) - a * crit - b * high - c * med - d * low)


#: Grade, most HIGH findings, least score; every one needs that there is no CRIT.
GRADES = [("A", 0, 90.0), ("B", 3, 80.0), ("C", 10, 65.0)]


def grade(points: Column, crit: Column, high: Column) -> Column:
    """A to D; the thresholds hold for both profiles."""
    out = F
    for name, most_high, least in GRADES:
        out = out.when((crit == 0) & (high <= most_high) & (points >= least), name)
    return out.otherwise("D")


def of_level(findings: Column, level: str) -> Column:
    return F.size(F.filter(findings, lambda f: f["level"] == level))
