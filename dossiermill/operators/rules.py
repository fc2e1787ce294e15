"""Rules as data: a rule is a predicate or an array of messages, and a document's
findings are one array column of (level, rule, message) in rule order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINDING = "array<struct<level:string,rule:string,message:string>>"
RANK = {"CRIT": 0, "HIGH": 1, "MED": 2, "LOW": 3, "WARN": 4}


@dataclass(frozen=True)
class Rule:
    """``when`` gives a boolean (one finding) or an array of strings (one finding for
    each); ``message`` makes the message, from the array's entry if there is one."""

    level: str
    name: str
    when: Callable[[], Column]
    message: str | Callable[[Column], Column] = ""
    each: bool = False

    def findings(self) -> Column:
        def one(message: Column) -> Column:
            return F.struct(F.lit(self.level).alias("level"), F.lit(self.name).alias("rule"), message.alias("message"))

        text = self.message if callable(self.message) else (lambda x: F.lit(self.message))
        if self.each:
            return F.coalesce(F.transform(self.when(), lambda x: one(text(x))), F.array().cast(FINDING))
        return F.when(self.when(), F.array(one(text(F.lit(None))))).otherwise(F.array().cast(FINDING))


def findings(rules: list[Rule]) -> Column:
    """All findings of a row, in rule order."""
    return F.concat(*(r.findings() for r in rules)) if rules else F.array().cast(FINDING)


def exploded(docs: DataFrame, key: str, column: str = "findings") -> DataFrame:
    """(key, ord, level, rule, message): the fact table of findings."""
    # an inner explode infers a filter on the column, which is pushed to the scan with all that
    # the rules read written out again at each place; this one stays behind the explode
    each = docs.select(key, F.posexplode_outer(column).alias("ord", "finding")).where("ord is not null")
    return each.select(key, "ord", "finding.*")


def by_severity(column: Column) -> Column:
    """Findings by level, then rule and message."""
    rank = F.create_map(*(x for k, v in RANK.items() for x in (F.lit(k), F.lit(v))))
    keyed = F.transform(column, lambda f: F.struct(F.coalesce(rank[f["level"]], F.lit(9)).alias("rank"), f["rule"].alias("rule"), f["message"].alias("message"), f["level"].alias("level")))
    return F.transform(F.array_sort(keyed), lambda f: F.struct(f["level"].alias("level"), f["rule"].alias("rule"), f["message"].alias("message")))
