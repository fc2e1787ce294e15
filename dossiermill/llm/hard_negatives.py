"""Hard negatives: an exact k-nearest join of anchors with all rows over Voronoi cells.

The largest inner product is the nearest neighbour once every row has one more
coordinate, sqrt(M^2 - |x|^2) for the greatest norm M, and an anchor has 0 there:
|a - x|^2 = |a|^2 + M^2 - 2 a.x. Rows so augmented go to the cell of their nearest pivot
and keep their distance to it. Anchors are dealt into groups by cell, at most about
ANCHORS in one.

Each search has two passes. The first joins a group with the rows of its own cell only;
those are real rows, so the last of the wanted many bounds every anchor's reach from
below. By the triangle inequality an anchor with reach r at distance D of a pivot needs
rows of that cell whose own distance lies within D - r and D + r only. The second pass
copies a row to the groups whose interval holds it, and to no others; a group's copies are
joined in parts of about ROWS, each with all of the group's anchors, and the best of the
parts are merged. Where vectors spread evenly in many dimensions the intervals hold
nearly all rows and the join is one in blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

PIVOTS = 16
#: Rows of which the pivots are chosen, by a hash of their ids.
SAMPLE = 1_024
ANCHORS = 2_048
ROWS = 20_000
POSITIVES = 5
NEGATIVES = 10
#: Greatest inner product; what lies beyond is cut to it.
TOP = 1 << 56

ROW = "vec_id long, label long, vector array<long>"


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """One row a vector; shorter ones end in zeros."""
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for n, v in enumerate(vectors):
        out[n, : len(v)] = v
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of ``a`` and ``b``."""
    most = lambda x: max(int(x.max(initial=0)), -int(x.min(initial=0)))
    if most(a) * most(b) * max(1, a.shape[1]) < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, -TOP, TOP).astype(np.int64)


def _distances(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (to * to).sum(1) - 2 * (x @ to.T), 0))


def _pivots(rows: DataFrame, width: int, top: float) -> np.ndarray:
    """Up to PIVOTS augmented rows of a bounded sample, each the farthest from those
    before it."""
    found = rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("vector").limit(SAMPLE).toPandas()
    x = np.unique(matrix(found.vector, width), axis=0).astype(np.float64)
    x = np.hstack([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))[:, None]])
    chosen = [0]
    near = _distances(x, x[:1])[:, 0]
    while len(chosen) < PIVOTS and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


def _placed(rows: DataFrame, pivots: np.ndarray, width: int, top: float) -> DataFrame:
    """Rows with their cell and their distance ``far`` to its pivot."""

    def run(batches):
        for df in batches:
            x = matrix(df.vector, width).astype(np.float64)
            x = np.hstack([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))[:, None]])
            d = _distances(x, pivots)
            cell = d.argmin(1)
            yield df.assign(cell=cell.astype(np.int32), far=d[np.arange(len(d)), cell])

    return rows.mapInPandas(run, f"{ROW}, anchor boolean, cell int, far double")


def _anchors(placed: DataFrame, pivots: np.ndarray, width: int) -> DataFrame:
    """(home, label, vec_id, vector, squared norm, distances to all pivots, group) of the
    anchors; of rows with one id the least counts."""
    rows = placed.where("anchor").groupBy("vec_id").agg(F.min(F.struct("label", "vector", "cell")).alias("r")).select("vec_id", "r.*")
    sizes = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}
    shares = {c: -(-n // ANCHORS) for c, n in sorted(sizes.items())}
    first, start = {}, 0
    for c, n in shares.items():
        first[c], start = start, start + n
    pick = lambda of: F.element_at(F.create_map(*(F.lit(int(x)) for c in of.items() for x in c)), F.col("cell"))
    group = (pick(first) + F.pmod(F.xxhash64("vec_id"), pick(shares))).cast("int") if shares else F.lit(0)

    def run(batches):
        for df in batches:
            x = np.hstack([matrix(df.vector, width).astype(np.float64), np.zeros((len(df), 1))])
            yield df.assign(norm=(x * x).sum(1), pivots=list(_distances(x, pivots)))

    placed = rows.withColumn("group", group).withColumnRenamed("cell", "home")
    return placed.select("home", "vec_id", "label", "vector", "group").mapInPandas(run, f"home int, {ROW}, group int, norm double, pivots array<double>")


def _copies(placed: DataFrame, intervals: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """Every row once for each group with an interval (low, high) of its key that holds
    the row's distance to its pivot."""
    wanted = intervals.select(F.struct(*keys).alias("key"), F.struct("group", "low", "high").alias("of"))
    wanted = wanted.groupBy("key").agg(F.collect_list("of").alias("groups"))
    rows = placed.select(F.struct(*keys).alias("key"), "vec_id", "label", "vector", "far")
    met = common.spread_join(rows, wanted, "key")
    holds = F.filter("groups", lambda g: (g["low"] <= F.col("far")) & (F.col("far") <= g["high"]))
    part = F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part")
    return met.select("vec_id", "label", "vector", part, F.explode(F.transform(holds, lambda g: g["group"])).alias("group"))


def _intervals(needs: DataFrame, keys: list[str], top: float) -> DataFrame:
    """(keys, group, low, high): which distances to a cell's pivot anchors of a group can
    need. ``needs`` has least and most, bounds of the products wanted (null: none)."""
    slack = 1e-5 * (1 + top**0.5)
    radius = lambda bound, none: F.when(F.col(bound).isNull(), none).otherwise(F.sqrt(F.greatest(F.col("norm") + top - 2 * F.col(bound), F.lit(0.0))))
    each = needs.withColumn("reach", radius("least", float("inf"))).withColumn("inner", radius("most", 0.0))
    each = each.select("*", F.posexplode("pivots").alias("cell", "to"))
    low = F.greatest(F.col("to") - F.col("reach"), F.col("inner") - F.col("to")) - slack
    high = F.col("to") + F.col("reach") + slack
    return each.groupBy(*keys, "group").agg(F.min(low).alias("low"), F.max(high).alias("high"))


def _home(needs: DataFrame, keys: list[str]) -> DataFrame:
    ends = (F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))
    return needs.select(F.col("home").alias("cell"), "label", "group").select(*keys, "group").distinct().select(*keys, "group", *ends)


def _best(score: np.ndarray, ids: np.ndarray, wanted: int) -> np.ndarray:
    """Places of the ``wanted`` highest scores, ties by smaller id."""
    at = np.arange(len(score))
    if len(score) > wanted:
        at = np.flatnonzero(score >= np.partition(score, len(score) - wanted)[len(score) - wanted])
    return at[np.lexsort((ids[at], -score[at]))][:wanted]


def _joined(needs: DataFrame, columns: list[str], copies: DataFrame, parts: int, width: int, wanted: int, windows: Callable) -> DataFrame:
    """(anchor_id, n, other_id, score): for each anchor and each of its windows (n, who may
    be taken) the best of every part; merged they hold the best of all."""

    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(anchors) and len(rows):
            ids, labels = rows.vec_id.to_numpy(), rows.label.to_numpy()
            scores = products(matrix(anchors.vector, width), matrix(rows.vector, width))
            for a, score in zip(anchors.itertuples(index=False), scores, strict=True):
                for n, may in windows(a, ids, labels, score):
                    at = np.flatnonzero(may)
                    at = at[_best(score[at], ids[at], wanted)]
                    out += [(a.vec_id, n, i, s) for i, s in zip(ids[at].tolist(), score[at].tolist(), strict=True)]
        return pd.DataFrame(out, columns=["anchor_id", "n", "other_id", "score"])

    each = needs.select(*dict.fromkeys(["vec_id", "label", "vector", "group", *columns]), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    found = each.groupBy("group", "part").cogroup(copies.groupBy("group", "part")).applyInPandas(run, "anchor_id long, n int, other_id long, score long")
    order = Window.partitionBy("anchor_id", "n").orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted)


def _positive_windows(a, ids, labels, score):
    yield 0, (labels == a.label) & (ids != a.vec_id)


def _negative_windows(a, ids, labels, score):
    for w in a.windows:
        yield w["n"], (labels != a.label) & (score >= w["least"]) & (score <= w["most"])


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from
    ``vectors`` (vec_id long, label long, vector array<long>, all without nulls): the first
    ``positives`` other rows of each anchor's label by inner product, ties by smaller
    vec_id, and for each of them the first ``negatives`` rows of other labels whose product
    is 30 to 90 % of the positive's.

    The join is exact. Vectors of unlike length are filled up with zeros; products beyond
    2**56 are cut to it. Of anchors that share a vec_id one counts, and it is no positive
    of itself; other rows that share one are listed as often as they occur. An anchor
    without a positive, or with positives below 0 only, has no rows; an empty table gives
    none."""
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "label", "vector", is_anchor.alias("anchor"))
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    count, width, top = rows.agg(F.count("*"), F.max(F.size("vector")), F.max(square)).first()
    if not count:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    width, parts = max(1, width), -(-count // ROWS)
    common.batch_rows(spark, common.SMALL_ROWS)
    pivots = _pivots(rows, width, top)
    placed = common.stored(_placed(rows, pivots, width, top))
    anchors = common.stored(_anchors(placed, pivots, width))

    def search(needs: DataFrame, columns: list[str], keys: list[str], wanted: int, windows: Callable, bound: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        """The best rows of the own cell, the bounds that follow, the best of all."""
        near = _joined(needs, columns, _copies(placed, _home(needs, keys), keys, parts), parts, width, wanted, windows)
        last = near.where(F.col("rank") == wanted).select("anchor_id", "n", F.col("score").alias("bound"))
        bounded = common.stored(bound(needs, last))
        return _joined(bounded, columns, _copies(placed, _intervals(bounded, keys, top), keys, parts), parts, width, wanted, windows)

    def bound_positives(needs: DataFrame, last: DataFrame) -> DataFrame:
        last = last.select(F.col("anchor_id").alias("vec_id"), F.col("bound").alias("least"))
        return needs.join(last, "vec_id", "left").withColumn("most", F.lit(None).cast("long"))

    def bound_negatives(needs: DataFrame, last: DataFrame) -> DataFrame:
        last = last.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.map_from_entries(F.collect_list(F.struct("n", "bound"))).alias("bounds"))
        raised = F.transform("windows", lambda w: F.struct(w["n"].alias("n"), F.greatest(w["least"], F.try_element_at("bounds", w["n"])).alias("least"), w["most"].alias("most")))
        out = needs.join(last, "vec_id", "left").withColumn("windows", raised).drop("bounds")
        return out.withColumn("least", F.array_min(F.transform("windows", lambda w: w["least"]))).withColumn("most", F.array_max(F.transform("windows", lambda w: w["most"])))

    found = common.stored(search(anchors, [], ["cell", "label"], positives, _positive_windows, bound_positives).select("anchor_id", F.col("rank").alias("n"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # whole numbers within 30 and 90 %: 3 p / 10 rounded up, 9 p / 10 rounded down
    window = F.struct("n", F.expr("div(3 * positive_score + 9, 10)").alias("least"), F.expr("div(9 * positive_score, 10)").alias("most"))
    windows = found.where("positive_score >= 0").groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(window).alias("windows"))
    best = search(anchors.join(windows, "vec_id"), ["windows"], ["cell"], negatives, _negative_windows, bound_negatives)
    return best.join(found, ["anchor_id", "n"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def quantised(embeddings: DataFrame, step: int = 256) -> DataFrame:
    """(vec_id, label, vector) with components floor(step * x). Rows without vec_id, label
    or vector, or with a null or non-finite component, take no part."""
    whole = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), whole.alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return rows.select("vec_id", "label", F.transform("v", lambda x: F.floor(step * x)).alias("vector"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector's hard negatives among all; where vec_id is divisible by 7
    the label is moved on by one of ten. Nulls, ties, repeats and empty tables are as in
    ``quantised`` and ``hard_negatives``."""
    rows = quantised(common.table(spark, sf_dir, "embeddings"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH valid AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
    FROM valid a JOIN valid b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positive AS (
    SELECT * FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.other_id AS positive_id,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank,
    n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positive p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) <= 10
"""
