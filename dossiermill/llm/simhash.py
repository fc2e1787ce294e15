"""SimHash near-duplicates: pigeonhole blocks, joined and verified.

A fingerprint has one bit per bit of the XXH64 values of a text's word
shingles: set if more than half of the values have it set. Two fingerprints at
``max_bits`` or fewer differing bits share ``BLOCKS - max_bits`` of ``BLOCKS``
blocks of bits, so each choice of that many blocks is a join key and every link
meets under one of the keys. Work is on distinct fingerprints: a group of
copies is one node however large it is.

A key that many fingerprints share (near copies by the thousand) is not joined
with itself: those fingerprints go through their neighbourhoods instead. Two
fingerprints within two bits have a common value within one bit of both, so
linking all that emit the same value to the least of them gives the same
components with 65 rows a fingerprint.

Blocks of a fingerprint serve a few differing bits only. A similarity of 0.8 is about
12 bits of 64, and any choice of blocks that 12 bits cannot break is too short to join
on. ``one_of_each_group`` therefore has two steps.

1. Fingerprint blocks, as above, propose the pairs within two bits.
2. For the rest it works on the sets of shingles. Of n shingles in one order that holds
   for all texts, the first n - ceil(0.8 n) + 1 are a text's prefix, and two texts at 0.8
   or more share a shingle of their prefixes. Shingles that many texts of a sample have
   come last in the order, so few prefixes hold them; the sample steers the work and
   never the result. A shingle that is not common is a key, under which few texts meet.
   Two texts whose prefixes share common shingles only both hold some, and such texts get
   other keys instead: the pigeonhole again, over the whole set. Sets of n and m shingles
   differ in at most (n + m) / 9 of them at 0.8, so if a hash of the shingle deals each set
   into more parts than that, one part at least is the same in both. A part is a few
   shingles from anywhere in the text, so texts that have a passage in common and are
   otherwise unlike hardly ever share one, however many texts have the passage.
   Keys that the same texts hold are one key with a weight. Each key has a hub, one of its
   texts; a text proposes the hub that it shares most keys with, which joins a group of near
   copies at a linear cost, and does so again with other hubs. Then the texts that share a
   key and are not yet in one group propose each other, if their sizes, the shared keys and
   the parities of their shingles' hashes allow the similarity. Two groups try their pairs
   in rounds until one links them or all have been tried.

Every proposed pair, of either step, is decided by the exact Jaccard similarity of its
texts. Only the texts of proposed pairs are fetched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .wordbytes import BASE, LOWER, SPACED, Words, batches, mix

BLOCKS = 4
CROWDED = 64
#: One text of SAMPLED is looked at for common shingles; those in COMMON_FROM of these
#: texts or more are common, at most MOST_COMMON of them.
SAMPLED, COMMON_FROM, MOST_COMMON = 16, 3, 500_000
#: Sets of fewer shingles have too few parts; their common shingles stay keys.
SMALL = 32
#: Longs of parity bits that a text's set is summed up in.
PARITIES = 8
#: Times that texts propose a hub, each time with other hubs.
HUB_TURNS = 2


def fingerprints(texts: pd.Series, words: int) -> np.ndarray:
    """int64 fingerprint of each text; null counts as a text without words."""
    from xxhash import xxh64_intdigest

    out = np.zeros(len(texts), dtype=np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for i, text in enumerate(texts):
        tokens = text.encode().lower().split() if text else ()
        if not tokens:
            continue
        joined = b" ".join(tokens)
        ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        n = max(1, len(tokens) - words + 1)
        spans = zip(starts[:n].tolist(), ends[len(tokens) - n :].tolist(), strict=True)
        ones, done = np.zeros(64, dtype=np.int64), 0
        while block := [xxh64_intdigest(joined[a:b], 42) for a, b in _take(spans, 1 << 16)]:
            block = np.array(block, dtype="<u8")
            bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
            done += len(block)
        out[i] = weights[ones * 2 > done].sum(dtype=np.uint64)
    return out.view(np.int64)


def _take(items: Iterator, n: int) -> Iterator:
    for _, x in zip(range(n), items, strict=False):
        yield x


def fingerprint(text: Column, words: int = 5) -> Column:
    """The fingerprint as a long. Null, empty and wordless texts give zero; a
    text of fewer words than a shingle has is one shingle."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(fingerprints(texts, words))

    return of(text)


def _keys(fp: Column, max_bits: int) -> Column:
    """One (choice, bits) struct for each choice of blocks that a close pair can share."""
    width = 64 // BLOCKS
    blocks = [F.shiftrightunsigned(fp, width * b).bitwiseAND(F.lit((1 << width) - 1)) for b in range(BLOCKS)]
    keys = []
    for n, chosen in enumerate(combinations(range(BLOCKS), BLOCKS - max_bits)):
        bits = F.lit(0).cast("long")
        for b in chosen:
            bits = F.shiftleft(bits, width).bitwiseOR(blocks[b])
        keys.append(F.struct(F.lit(n).alias("choice"), bits.alias("bits")))
    return F.array(*keys)


def links(fps: DataFrame, max_bits: int = 2, crowded: int = CROWDED) -> DataFrame:
    """(u, v) edges between distinct fingerprints ``fp`` whose components are those
    of all pairs within ``max_bits`` (at most 2). Under a key of up to ``crowded``
    fingerprints every such pair is an edge."""
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits is 0, 1 or 2")
    keyed = common.stored(fps.select("fp", F.explode(_keys(F.col("fp"), max_bits)).alias("key")).select("fp", "key.*"))
    sizes = keyed.groupBy("choice", "bits").count().where("count > 1")
    shared = common.stored(keyed.join(sizes, ["choice", "bits"]))
    few = shared.where(F.col("count") <= crowded)
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_bits
    same = (F.col("a.choice") == F.col("b.choice")) & (F.col("a.bits") == F.col("b.bits"))
    pairs = few.alias("a").join(few.alias("b"), same & (F.col("a.fp") < F.col("b.fp")) & near)
    pairs = pairs.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    many = shared.where(F.col("count") > crowded).select("fp").distinct()
    return pairs.unionByName(_neighbour_links(many, max_bits)).distinct()


def _neighbour_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links through common values one bit away: exact for two bits, and for one
    bit if only the values that are fingerprints themselves count."""
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.expr("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))
    near = F.concat(F.array("fp"), flips) if max_bits else F.array("fp")
    emitted = fps.select("fp", F.explode(near).alias("value"))
    centre = F.col("least") if max_bits == 2 else F.col("value")
    met = emitted.groupBy("value").agg(F.min("fp").alias("least"), F.max("fp").alias("most"), F.max(F.col("fp") == F.col("value")).alias("own"))
    met = met.where("least <> most" + ("" if max_bits == 2 else " and own")).select("value", "least")
    return emitted.join(met, "value").select(F.col("fp").alias("u"), centre.alias("v")).where("u <> v")


def near_duplicates(docs: DataFrame, words: int = 5, max_bits: int = 2, crowded: int = CROWDED) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs`` (doc_id, text):
    component_id is the least doc_id reachable over links. Rows that share a
    doc_id each get their own row; null doc_ids are never the least unless a
    component has no other. An empty table gives no rows."""
    common.batch_rows(docs.sparkSession)
    marked = common.stored(docs.select("doc_id", fingerprint(F.col("text"), words).alias("fp")))
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    distinct = common.stored(distinct)
    roots = common.components(links(distinct, max_bits, crowded))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


class Shingles:
    """The word shingles of some texts: ``hash`` of each, repeats included, and the number
    of its text. A text of fewer words than a shingle has is one shingle, a text without
    words has none. Of the distinct ones of each text: ``of``, ``distinct`` (ascending) and
    ``starts``, where each text begins, with one more for the end."""

    def __init__(self, texts: list[bytes], words: int):
        w = Words(texts, SPACED, LOWER)
        at = np.flatnonzero(w.whole(words))
        text, h, n = [w.text[at]], [w.shingles(words)[at]], np.diff(w.first)
        for k in range(1, words):
            short = np.flatnonzero(n == k)
            text.append(short)
            h.append(w.shingles(k)[w.first[:-1][short]])
        text, h = np.concatenate(text), np.concatenate(h)
        order = np.lexsort((h, text))
        self.text, self.hash, self.texts = text[order], h[order], len(texts)
        new = (np.diff(self.text, prepend=-1) != 0) | (np.diff(self.hash, prepend=~self.hash[:1]) != 0)
        self.of, self.distinct = self.text[new], self.hash[new]
        self.starts = np.searchsorted(self.of, np.arange(len(texts) + 1))

    def fingerprints(self) -> np.ndarray:
        out = np.zeros(self.texts, dtype=np.uint64)
        if len(self.text):
            bits = np.unpackbits(self.hash.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            begins = np.flatnonzero(np.diff(self.text, prepend=-1))
            ones = np.add.reduceat(bits, begins, axis=0, dtype=np.int64)
            n = np.diff(begins, append=len(self.text))[:, None]
            out[self.text[begins]] = ((ones * 2 > n) * (np.uint64(1) << np.arange(64, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)
        return out

    def nodes(self) -> list[bytes]:
        """Twelve bytes for each text, the same for equal sets only."""
        out = np.zeros((self.texts, 2), dtype=np.uint64)
        if len(self.of):
            begins = np.flatnonzero(np.diff(self.of, prepend=-1))
            for n in (0, 1):
                out[self.of[begins], n] = np.add.reduceat(mix(self.distinct + np.uint64((n + 1) * BASE % (1 << 64))), begins)
        return [row.tobytes()[:12] for row in out]

    def parities(self) -> list[np.ndarray]:
        """PARITIES longs for each text: each bit is the parity of the number of shingles
        that hash to it, so two texts' sets differ in as many shingles as bits or more."""
        odd = np.zeros((self.texts, PARITIES * 64), dtype=bool)
        bit = mix(self.distinct + np.uint64(7 * BASE % (1 << 64))) % np.uint64(PARITIES * 64)
        at, n = np.unique(self.of * (PARITIES * 64) + bit.astype(np.int64), return_counts=True)
        odd.reshape(-1)[at[n % 2 == 1]] = True
        return list(np.packbits(odd, axis=1, bitorder="little").view("<i8"))

    def keys(self, common_ones: tuple[np.ndarray, np.ndarray], least: Fraction, plan: list[tuple[int, int, int]]) -> tuple[list[np.ndarray], np.ndarray]:
        """Keys of each text such that two sets with a Jaccard similarity of ``least`` or
        more share one, and how many shingles come behind those that are keys themselves.

        A text's prefix is its first shingles in the order of (texts of the sample, hash).
        Prefix shingles are keys if they are not common or if the text is small (of the
        plan's first class that has parts, or below); texts with common ones in the prefix
        have parts as keys too. See ``parts_plan``."""
        known, held = common_ones
        rank = np.zeros(len(self.of), dtype=np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, self.distinct), len(known) - 1)
            rank = np.where(known[at] == self.distinct, held[at], 0)
        order = np.lexsort((rank, self.of))
        n = np.diff(self.starts)
        size = np.where(n > 0, n + (-n * least.numerator) // least.denominator + 1, 0)
        nth = np.arange(len(self.of)) - self.starts[self.of]  # rows of a text stay together in ``order``
        first = nth < size[self.of]
        hot = first & (rank[order] > 0)
        small = n < plan[1][0] if len(plan) > 1 else np.ones(len(n), dtype=bool)
        own = first & ~(hot & ~small[self.of])
        behind = n - np.bincount(self.of[own], minlength=self.texts)
        text, key = [self.of[own]], [self.distinct[order[own]]]
        crowded = np.zeros(self.texts, dtype=bool)
        crowded[self.of[hot]] = True
        if plan:
            starts = np.array([p[0] for p in plan])
            of_class = np.searchsorted(starts, n, side="right") - 1
            for instance in (of_class, of_class - 1):
                mine = np.flatnonzero(crowded & (instance >= 0))
                if len(mine):
                    found = self._parts(mine, instance[mine], plan)
                    text.append(found[0])
                    key.append(found[1])
        text, key = np.concatenate(text), np.concatenate(key)
        at = np.argsort(text, kind="stable")
        ends = np.searchsorted(text[at], np.arange(self.texts + 1))
        return [key[at[a:b]] for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)], behind

    def _parts(self, mine: np.ndarray, classes: np.ndarray, plan: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """(text, key): the parts of the texts ``mine`` as sets of ``classes``."""
        count, spare = (np.array([p[i] for p in plan])[classes] for i in (1, 2))
        base = np.cumsum(count) - count
        row = np.full(self.texts, -1)
        row[mine] = np.arange(len(mine))
        here = np.flatnonzero(row[self.of] >= 0)
        r, h = row[self.of[here]], self.distinct[here]
        part = (mix(h + np.uint64(3 * BASE % (1 << 64))) % count[r].astype(np.uint64)).astype(np.int64)
        at = base[r] + part
        order = np.argsort(at, kind="stable")
        begins = np.flatnonzero(np.diff(at[order], prepend=-1))
        sums = np.zeros(int(count.sum()), dtype=np.uint64)
        sums[at[order[begins]]] = np.add.reduceat(mix(h + np.uint64(5 * BASE % (1 << 64)))[order], begins)
        full = np.zeros(len(sums), dtype=bool)
        full[at] = True
        owner = np.repeat(np.arange(len(mine)), count)
        empty = count - np.bincount(owner[full], minlength=len(mine))
        use = full | (empty > spare)[owner]
        number = np.arange(len(sums)) - base[owner]
        name = mix((classes[owner] * (1 << 40) + number + 1).astype(np.uint64))
        return mine[owner[use]], mix(sums + name)[use]


def parts_plan(least: Fraction, small: int = SMALL) -> list[tuple[int, int, int]]:
    """(least size, parts, empty parts that need no key) of each class of sizes from about
    ``small`` shingles on; none if only equal sets are similar.

    Classes are so wide that of two similar sets the larger is in the smaller one's class or
    the next. A set is dealt into parts as one of its own class and as one of the class
    before. As sets of the smaller one's class two similar sets differ in fewer shingles
    than there are parts, by one more than the empty parts that either may have; a set with
    more empty parts has keys for those too. So a part with a key is the same in both. How
    many may be empty is chosen so that hardly a set has more."""
    if least >= 1:
        return []
    num, den = least.numerator, least.denominator
    plan, first = [], small
    while first < 1 << 31:
        last = first * den // num
        differ = (last + last * den // num) * (den - num) // (den + num)
        spare = 0
        while spare < differ:
            parts = differ + 1 + spare
            none = math.exp(-first / parts)
            if spare >= parts * none + 3 * math.sqrt(parts * none * max(0.0, 1 - (1 + first / parts) * none)):
                break
            spare += max(1, differ // 64)
        plan.append((first, differ + 1 + spare, spare))
        first = last + 1
    return plan


def shingled(texts: pd.Series, words: int) -> Iterator[Shingles]:
    for _, run in batches((t or "").encode() for t in texts):
        yield Shingles(run, words)


def _alike(pairs: DataFrame, texts: DataFrame, words: int, least: Fraction) -> DataFrame:
    """The ``pairs`` (u, v) of nodes of ``texts`` (node, text) whose sets of shingles
    have a Jaccard similarity of ``least`` or more, exactly."""
    of, to = least.numerator, least.denominator

    def alike(one: pd.Series, other: pd.Series) -> pd.Series:
        number, sets = {}, []
        for t in (*one, *other):
            number.setdefault(t, len(number))
        for s in shingled(number, words):
            sets += [s.distinct[a:b] for a, b in zip(s.starts, s.starts[1:], strict=False)]
        out = []
        for x, y in zip(one, other, strict=True):
            a, b = sets[number[x]], sets[number[y]]
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(both * to >= (len(a) + len(b) - both) * of)
        return pd.Series(out, dtype=bool)

    one, other = (texts.select(F.col("node").alias(k), F.col("text").alias(f"text_{k}")) for k in ("u", "v"))
    # a hub's text goes to many pairs
    met = common.spread_join(common.spread_join(pairs, other, "v"), one, "u", counted=pairs)
    return met.where(F.pandas_udf(alike, "boolean")("text_u", "text_v")).select("u", "v")


def _common_shingles(docs: DataFrame, words: int, sampled: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of texts) of the common shingles of a sample, hashes ascending."""

    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([s.distinct[a:b].view(np.int64) for s in shingled(texts, words) for a, b in zip(s.starts, s.starts[1:], strict=False)])

    some = docs.select("text").where(F.pmod(F.xxhash64(F.xxhash64("text")), F.lit(sampled)) == 0).distinct()
    counts = some.select(F.explode(F.pandas_udf(of, "array<long>")("text")).alias("h")).groupBy("h").count().where(F.col("count") >= COMMON_FROM)
    found = counts.orderBy(F.desc("count"), "h").limit(MOST_COMMON).toPandas()
    h = found["h"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], found["count"].to_numpy(dtype=np.int64)[order]


def _possible(one: str, other: str, least: Fraction) -> Column:
    """Whether the sizes ``n`` and the parities of two rows allow the similarity."""
    of, to = least.numerator, least.denominator
    n, m = F.col(f"{one}.n"), F.col(f"{other}.n")
    odd = sum((F.bit_count(F.col(f"{one}.parity")[i].bitwiseXOR(F.col(f"{other}.parity")[i])) for i in range(PARITIES)), F.lit(0))
    return (n * of <= m * to) & (m * of <= n * to) & (odd * (of + to) <= (n + m) * (to - of))


def _best(pairs: DataFrame, sketches: DataFrame, least: Fraction) -> DataFrame:
    """(u, v): for each u of ``pairs`` (u, v, weight) the v of most weight of those that
    ``sketches`` (node, n, parity) allow, so never more rows than texts."""
    one, other = (sketches.select(F.col("node").alias(k), "n", "parity").alias(f"of_{k}") for k in ("u", "v"))
    can = pairs.join(one, "u").join(other, "v").where(_possible("of_u", "of_v", least))
    return can.groupBy("u").agg(F.max_by("v", F.struct("weight", "v")).alias("v"))


def _block_pairs(first: DataFrame, crowded: int) -> DataFrame:
    """(u, v): nodes of ``first`` (node, fp) whose fingerprints lie within two bits. Nodes
    of one fingerprint meet its least one, and least ones meet over the links."""
    least = common.stored(first.groupBy("fp").agg(F.min("node").alias("v")))
    same = first.join(least, "fp").where("node <> v").select(F.col("node").alias("u"), "v")
    one, other = (least.select(F.col("fp").alias(f"fp_{k}"), F.col("v").alias(k)) for k in ("a", "b"))
    near = links(least.select("fp"), 2, crowded).join(one, F.col("u") == F.col("fp_a")).join(other, F.col("v") == F.col("fp_b"))
    return same.unionByName(near.select(F.col("a").alias("u"), F.col("b").alias("v")))


def _weighed(rows: DataFrame) -> DataFrame:
    """``rows`` (key, node, ...) without keys that one text alone holds; of the keys that the
    same texts hold one stays, and ``weight`` says how many they are. Two near copies share
    most of their keys with each other only and so meet once."""
    of, also = F.bit_xor(F.xxhash64("node")).alias("of"), F.bit_xor(F.hash("node")).alias("also")
    # few keys repeat in a part, so the rows are dealt by key before they are counted
    rows = rows.repartition("key")
    held = rows.groupBy("key").agg(F.count("*").alias("held"), of, also).where("held > 1")
    kinds = held.groupBy("held", "of", "also").agg(F.min("key").alias("key"), F.count("*").alias("weight"))
    return rows.join(kinds.select("key", "weight"), "key")


def _hub_pairs(shared: DataFrame, roots: DataFrame | None, turn: int) -> DataFrame:
    """(u, v, weight): each node of ``shared`` (key, node, weight) and the hubs of its keys,
    with the keys that have this hub. The texts outside a key's largest group of ``roots``
    propose, and one of that group is the hub; another turn has other hubs."""
    rows = shared.select("key", "node", "weight")
    of = F.struct(F.xxhash64("node", F.lit(turn)), "node")
    if roots is None:
        hubs = rows.groupBy("key").agg(F.min_by("node", of).alias("v"))
        met = rows.join(hubs, "key").where(F.col("node") != F.col("v"))
    else:
        rows = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        held = rows.groupBy("key", "root").agg(F.count("*").alias("n"), F.min_by("node", of).alias("hub"))
        hubs = held.groupBy("key").agg(F.max_by(F.struct("hub", "root"), F.struct("n", "root")).alias("main"), F.count("*").alias("groups")).where("groups > 1")
        met = rows.join(hubs.select("key", F.col("main.hub").alias("v"), F.col("main.root").alias("main")), "key").where(F.col("root") != F.col("main"))
    return met.groupBy(F.col("node").alias("u"), "v").agg(F.sum("weight").alias("weight"))


def _candidates(shared: DataFrame, first: DataFrame, roots: DataFrame, least: Fraction) -> DataFrame:
    """(u, v, both, a, b): the pairs of ``shared`` (key, node, n, behind and, if keys stand
    for several, weight) that share a key, lie in different groups a and b of ``roots`` and
    can have the similarity ``least``. What two sets share is a key of both, which is
    counted, or lies behind the keys of one.

    Under a key each row meets those outside its group. A pair outside one group has a row
    that is not of the key's largest group, so only such rows meet all others. Rows carry
    the parities of their sets, so that pairs these tell apart end where they meet: a family
    of texts that are just not similar enough shares most of its keys."""
    of, to = least.numerator, least.denominator
    weight = F.col("weight") if "weight" in shared.columns else F.lit(1)
    rows = shared.join(roots, shared.node == roots.node, "left").select("key", shared.node, "n", "behind", weight.alias("weight"), F.coalesce("root", shared.node).alias("root"))
    held = rows.groupBy("key", "root").count()
    main = held.groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count("*").alias("groups")).where("groups > 1").select("key", "main")
    rows = common.stored(rows.join(main, "key").join(first.select("node", "parity"), "node"))
    a, b = rows.where("root <> main").alias("a"), rows.alias("b")
    once = (F.col("b.root") == F.col("b.main")) | (F.col("a.node") < F.col("b.node"))
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.root") != F.col("b.root")) & once & _possible("a", "b", least))
    swap = F.col("a.node") > F.col("b.node")
    u, v = (F.struct(*(F.col(f"{side}.{c}") for c in ("node", "root", "n", "behind"))) for side in ("a", "b"))
    ends = met.select(F.when(swap, v).otherwise(u).alias("x"), F.when(swap, u).otherwise(v).alias("y"), "a.weight")
    both = ends.groupBy("x", "y").agg(F.sum("weight").alias("both"))
    can = both.where((F.col("both") + F.greatest("x.behind", "y.behind")) * (of + to) >= (F.col("x.n") + F.col("y.n")) * of)
    can = can.select(F.col("x.node").alias("u"), F.col("y.node").alias("v"), "both", F.col("x.root").alias("a"), F.col("y.root").alias("b"))
    out = common.stored(can.select("u", "v", "both", "a", "b"))
    common.discard(rows)
    return out


def _under(rows: DataFrame, column: str, merged: DataFrame) -> DataFrame:
    """``rows`` with the groups in ``column`` named by what they are part of in ``merged``
    (node, root); groups that are not listed there stay."""
    to = merged.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    met = rows.join(to, F.col(column) == F.col("_node"), "left")
    return met.withColumn(column, F.coalesce("_root", column)).drop("_node", "_root")


def _linked(rest: DataFrame, texts: DataFrame, roots: DataFrame, words: int, least: Fraction) -> DataFrame:
    """(node, root): the groups of ``roots`` joined by all pairs of ``rest`` (u, v, both, a,
    b), of the groups a and b, that have the similarity ``least``. One link is enough
    between two groups, so in each round two groups try a few of their pairs only, eight
    times as many as in the round before, those that share most first; pairs inside a group
    need no trial. Every other pair is tried in some round, so no link is missed. A round
    joins whole groups, so its components are those of a graph of groups."""
    tries = 2
    while not rest.isEmpty():
        trial = F.pmod(F.xxhash64("u", "v"), F.lit(tries)).alias("trial")
        best = F.max_by(F.struct("u", "v"), F.struct("both", "u", "v")).alias("pair")
        picked = rest.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), trial).agg(best)
        picked = common.stored(picked.select("pair.u", "pair.v", "a", "b"))
        found = common.stored(_alike(picked.select("u", "v"), texts, words, least))
        left = rest.join(picked, ["u", "v"], "left_anti")
        if not found.isEmpty():
            joined = picked.join(found, ["u", "v"]).select(F.col("a").alias("u"), F.col("b").alias("v"))
            merged = common.stored(common.components(joined))
            alone = merged.join(roots, "node", "left_anti")
            before, roots = roots, common.stored(_under(roots, "root", merged).unionByName(alone))
            common.discard(before)
            left = _under(_under(left, "a", merged), "b", merged).where("a <> b")
        before, rest = rest, common.stored(left)
        common.discard(before)
        tries *= 8
    return roots


def one_of_each_group(docs: DataFrame, words: int = 5, similarity: float = 0.8, crowded: int = CROWDED, sampled: int = SAMPLED) -> DataFrame:
    """``docs`` (doc_id, text, ...) with one row of each group of near duplicates: the
    one with the smallest doc_id (then text hash; null doc_ids last). Two texts are
    linked if the Jaccard similarity of their sets of shingles is ``similarity`` or more,
    and all such pairs count; equal sets always are linked. Words stand between white
    space or NULs, A-Z are lowered. Texts without words, null and empty ones among them,
    are one group; rows that repeat are one row; an empty table gives none. Columns stay
    as they are. ``crowded`` and ``sampled`` change the work only."""
    spark = docs.sparkSession
    common.batch_rows(spark)
    least = Fraction(str(similarity))
    plan = parts_plan(least)
    order = spark.sparkContext.broadcast(_common_shingles(docs, words, sampled))

    def sketch(texts: pd.Series) -> pd.DataFrame:
        parts = []
        for s in shingled(texts, words):
            keys, behind = s.keys(order.value, least, plan)
            numbers = {"n": np.diff(s.starts), "behind": behind, "fp": s.fingerprints().view(np.int64), "parity": s.parities()}
            parts.append(pd.DataFrame({"node": s.nodes(), **numbers, "keys": [x.view(np.int64) for x in keys]}))
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({c: [] for c in ("node", "n", "behind", "fp", "parity", "keys")})

    # the numbers go by Arrow, the texts stay where they are
    found = F.pandas_udf(sketch, "node binary, n int, behind int, fp long, parity array<long>, keys array<long>")("text")
    row_of, hash_of = _row_key()
    marked = common.stored(docs.select("doc_id", "text").select(row_of.alias("row"), hash_of.alias("text_hash"), "doc_id", found.alias("s")).select("row", "text_hash", "doc_id", "s.*"))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "row")
    first = common.stored(marked.groupBy("node").agg(F.min(row).alias("first"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("behind").alias("behind"), F.first("parity").alias("parity")).select("node", "fp", "n", "behind", "parity", "first.row", "first.text_hash", "first.doc_id"))
    rows = marked.select("node", "keys").dropDuplicates(["node"]).select("node", F.explode("keys").alias("key"))
    shared = common.stored(_weighed(rows).join(first.select("node", "n", "behind"), "node"))
    common.discard(marked)

    sketches, close, roots = first.select("node", "n", "parity"), None, None
    for turn in range(HUB_TURNS):
        proposed = _best(_hub_pairs(shared, roots, turn), sketches, least)
        if not turn:
            proposed = proposed.unionByName(_best(_block_pairs(first.select("node", "fp"), crowded).withColumn("weight", F.lit(1)), sketches, least)).distinct()
        proposed = common.stored(proposed)
        found = common.stored(_alike(proposed, _texts(docs, first, proposed), words, least))
        if turn and found.isEmpty():
            break
        close = close.unionByName(found) if close else found
        roots = common.stored(common.components(close))
    rest = _candidates(shared.select("key", "node", "n", "behind", "weight"), first.select("node", "parity"), roots, least)
    roots = _linked(rest, _texts(docs, first, rest), roots, words, least)
    group = F.coalesce("root", first.node)
    rooted = first.join(roots, first.node == roots.node, "left").select(group.alias("root"), F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "row").alias("first"))
    row_name, hash_name = common.fresh(docs, "_row", "_hash")
    stay = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row_name), F.col("first.text_hash").alias(hash_name))
    kept = docs.withColumns({row_name: row_of, hash_name: hash_of}).join(stay, [row_name, hash_name], "left_semi")
    return kept.dropDuplicates([row_name, hash_name]).select(*docs.columns)


def _row_key() -> tuple[Column, Column]:
    """What tells rows of different doc_id or text apart, without nulls."""
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.xxhash64("text")


def _texts(docs: DataFrame, first: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, text) of the nodes of ``pairs``: the text of the row that ``first`` names, once."""
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    named = first.join(nodes, "node").select("node", "row", "text_hash")
    row_of, hash_of = _row_key()
    met = docs.select("text", row_of.alias("row"), hash_of.alias("text_hash")).join(named, ["row", "text_hash"])
    return common.stored(met.groupBy("node").agg(F.first("text").alias("text")))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint and component of every document; nulls, wordless texts, rows that
    share a doc_id and empty tables are as in ``near_duplicates``."""
    found = near_duplicates(common.table(spark, sf_dir, "documents"), words=3, max_bits=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
