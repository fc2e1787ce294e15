"""Shards of near equal bytes: minimax contiguous partition of atomic groups.

Documents of equal text are one atomic group; groups stand in the order of the
MD5 of their text. The smallest capacity for which greedy filling needs no more
shards than there are is found by binary search, and the groups are cut there. A
group larger than the capacity has a shard of its own, so one huge group does
not leave the other shards empty.

The search never sees single groups by the million. The driver holds sums over
ranges of the order (prefixes of the hash) and bounds each cut from both sides;
only ranges in which a cut may fall are summed again, one digit finer, until
every cut is known exactly. What it holds depends on the number of shards.

DataFrame functions only.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ROW_BYTES = 16
FIRST_DIGITS = 3


def group_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus a fixed cost for each row."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


class Ranges:
    """Sums over disjoint prefix ranges of the order: (prefix, sum, largest, groups)."""

    def __init__(self, rows: list[tuple[str, int, int, int]]):
        self.rows = sorted(rows)
        sums = list(accumulate((r[1] for r in self.rows), initial=0))
        self.starts, self.total = sums[:-1], sums[-1]

    def at(self, p: int) -> tuple[int, str, int, int, int]:
        n = bisect_right(self.starts, p) - 1
        return self.starts[n], *self.rows[n]

    def fill(self, p: int, q: int, capacity: int) -> tuple[int, int]:
        """The least and the greatest place at which a shard can end that starts
        somewhere from p to q."""
        return self._least(p, capacity), self._greatest(q, capacity)

    def _least(self, p: int, capacity: int) -> int:
        if p >= self.total:
            return p
        start, _, size, _, groups = self.at(p)
        alone = start + size if groups == 1 and start == p else p
        if p + capacity >= self.total:
            return self.total
        start, _, _, largest, groups = self.at(p + capacity)
        return max(alone, start if groups == 1 else max(start, p + capacity - largest))

    def _greatest(self, p: int, capacity: int) -> int:
        if p >= self.total:
            return p
        start, _, size, largest, groups = self.at(p)
        room = max(capacity, size if groups == 1 else largest)
        if p + room >= self.total:
            return self.total
        start, _, _, _, groups = self.at(p + room)
        return start if groups == 1 else p + room

    def cuts(self, capacity: int, shards: int) -> list[tuple[int, int]]:
        """Bounds of the end of each shard."""
        out, p, q = [], 0, 0
        for _ in range(shards):
            p, q = self.fill(p, q, capacity)
            out.append((p, q))
        return out


def least(low: int, high: int, holds: Callable[[int], bool]) -> int:
    """The smallest of low to high for which a monotone condition holds."""
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if holds(mid) else (mid + 1, high)
    return low


def cut_points(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """The smallest capacity and the prefixes at which shards 1, 2, ... begin.
    ``groups`` is (key, size), one row a group."""

    def summed(rows: DataFrame, digits: int) -> list[tuple[str, int, int, int]]:
        sums = rows.groupBy(F.substring("key", 1, digits).alias("prefix")).agg(F.sum("size"), F.max("size"), F.count("*"))
        return [tuple(r) for r in sums.collect()]

    digits = FIRST_DIGITS
    ranges = Ranges(summed(groups, digits))
    while ranges.total:
        low = least(1, ranges.total, lambda c: ranges.cuts(c, shards)[-1][1] >= ranges.total)
        high = least(low, ranges.total, lambda c: ranges.cuts(c, shards)[-1][0] >= ranges.total)
        open_ = set()
        for (p, _), (_, q) in zip(ranges.cuts(low, shards), ranges.cuts(high, shards), strict=True):
            n = bisect_right(ranges.starts, p) - 1
            while n < len(ranges.rows) and ranges.starts[n] <= q:
                if ranges.rows[n][3] > 1 and (p, q) != (ranges.starts[n],) * 2 and p < ranges.total:
                    open_.add(ranges.rows[n][0])
                n += 1
        if not open_:
            ends = [p for p, _ in ranges.cuts(high, shards)]
            return high, [ranges.at(p)[1] for p in ends if p < ranges.total]
        digits += 1
        finer = summed(groups.where(F.substring("key", 1, digits - 1).isin(sorted(open_))), digits)
        ranges = Ranges([r for r in ranges.rows if r[0] not in open_] + finer)
    return 0, []


def total(terms: list[Column]) -> Column:
    """The sum as a balanced tree, shallow for any number of terms."""
    if len(terms) < 2:
        return terms[0] if terms else F.lit(0)
    return total(terms[: len(terms) // 2]) + total(terms[len(terms) // 2 :])


def _placed(rows: DataFrame, key: str, shards: int) -> DataFrame:
    """``rows`` (doc_id, size, key, ...) with shard and slot; of a row only these
    columns and what else it carries go through the one shuffle that counts slots."""
    _, begins = cut_points(common.stored(rows.groupBy(F.col(key).alias("key")).agg(F.sum("size").alias("size"))), shards)
    one, *_ = common.fresh(rows, "_one")
    placed = rows.withColumns({"shard": total([(F.lit(b) <= F.col(key)).cast("int") for b in begins]), one: F.lit(1)})
    return common.spread_starts(placed, ["shard"], one, "slot", (key,)).drop(one)


def shard(docs: DataFrame, shards: int) -> DataFrame:
    """``docs`` (doc_id, text, ...) with size, shard and slot. Shards 0 to
    ``shards - 1`` hold near equal bytes, equal texts share a shard (null counts
    as the empty text), and slots count from 0 in each without gaps. With fewer
    groups than shards the last shards are empty; an empty table gives no rows.
    Columns named size, shard or slot are replaced."""
    docs = docs.drop("size", "shard", "slot")
    key, *_ = common.fresh(docs, "_key")
    return _placed(docs.withColumns({"size": size_of(F.col("text")), key: group_key(F.col("text"))}), key, shards).drop(key)


def op1_shard_by_bytes(spark: SparkSession, sf_dir: str, shards: int = 40) -> DataFrame:
    """All documents in ``shards`` shards by the law ``bytes``. Null texts count as empty,
    rows that repeat each have their slot, ties are broken by doc_id and text; an empty
    table gives no rows. Texts are reduced to size, key and CRC before any shuffle."""
    docs = common.table(spark, sf_dir, "documents")
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    rows = docs.select("doc_id", size_of(F.col("text")).alias("size"), crc.alias("text_crc32"), group_key(F.col("text")).alias("key"))
    out = _placed(rows, "key", shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
