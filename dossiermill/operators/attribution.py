"""Causal attribution: asymmetric Shapley values of a model's features.

A feature's value is what it adds to a prediction when it joins the features before it,
on average over orders in which every cause comes before its effects. Features that have
not joined are filled from background rows, so a row's values sum to its prediction less
the mean prediction of the background.

Rows never meet: a task walks through the orders for its own rows, a batch at a time. The
model, the orders and
the background are bounded by parameters and go to all tasks."""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Edges = list[tuple[str, str]]

# Causes and effects among the features of converted documents.
EDGES: Edges = [
    ("file_type_pdf", "text_length_chars"), ("file_type_docx", "text_length_chars"), ("file_size_kb", "text_length_chars"),
    ("lang_ja", "populated_section_count"), ("lang_zh_cn", "populated_section_count"), ("lang_zh_tw", "populated_section_count"), ("lang_en", "populated_section_count"),
    ("text_length_chars", "cas_count_in_source"), ("text_length_chars", "h_code_count_in_source"), ("text_length_chars", "p_code_count_in_source"),
    ("text_length_chars", "un_count_in_source"), ("text_length_chars", "populated_section_count"),
    ("cas_count_in_source", "cas_coverage"), ("h_code_count_in_source", "h_code_coverage"), ("p_code_count_in_source", "p_code_coverage"), ("un_count_in_source", "un_coverage"),
    ("populated_section_count", "empty_section_count"),
    ("cas_coverage", "high_count"), ("h_code_coverage", "high_count"), ("p_code_coverage", "medium_count"), ("populated_section_count", "high_count"), ("empty_section_count", "medium_count"),
    ("high_count", "overall_score"), ("medium_count", "overall_score"),
]

#: Orders that are walked through one by one; of more, so many are drawn.
ORDERS = 64
BACKGROUND = 32
TREES, DEPTH = 20, 3
#: Thresholds of a feature that are tried, and 65,536 rows at least that they are taken from.
BINS = 256
#: The column that says for how many rows a row stands.
TIMES = "_times"
#: Distinct rows that a task of a fit has.
FIT_ROWS = 50_000


def parents(features: list[str], edges: Edges) -> list[set[int]]:
    """The causes of each feature among the features; paths over others count."""
    effects: dict[str, list[str]] = {}
    for cause, effect in edges:
        effects.setdefault(cause, []).append(effect)
    place = {f: n for n, f in enumerate(features)}
    out: list[set[int]] = [set() for _ in features]
    for f in features:
        seen, todo = set(), list(effects.get(f, ()))
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += effects.get(x, ())
        if f in seen:
            raise ValueError(f"{f} is a cause of itself")
        for x in seen & place.keys():
            out[place[x]].add(place[f])
    return out


def every_order(before: list[set[int]]) -> Iterator[tuple[int, ...]]:
    """All orders in which each number comes after those of its set."""

    def longer(done: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        if len(done) == len(before):
            yield done
        for n in range(len(before)):
            if n not in done and before[n] <= set(done):
                yield from longer((*done, n))

    return longer(())


def orders(before: list[set[int]], most: int = ORDERS, seed: int = 42) -> list[tuple[int, ...]]:
    """All orders if there are at most ``most``, else so many drawn by a walk of neighbour
    exchanges, which visits all orders evenly in the long run."""
    found = []
    for order in every_order(before):
        found.append(order)
        if len(found) > most:
            break
    else:
        return found
    rng, n, order = random.Random(seed), len(before), list(found[0])
    out = []
    for k in range(most):
        for _ in range(n**3 if k == 0 else 4 * n * n):
            i = rng.randrange(n - 1)
            if rng.random() < 0.5 and order[i] not in before[order[i + 1]]:
                order[i], order[i + 1] = order[i + 1], order[i]
        out.append(tuple(order))
    return out


@dataclass
class Trees:
    """A sum of regression trees as arrays: of each tree, by node: feature (-1 in a leaf),
    threshold, left and right child, value."""

    nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def used(self, n: int) -> list[int]:
        """The features of a tree."""
        feature = self.nodes[n][0]
        return np.unique(feature[feature >= 0]).tolist()

    def value(self, n: int, x: np.ndarray, columns: list[int] | None = None) -> np.ndarray:
        """A tree's value for rows whose columns are all features, or these."""
        feature, threshold, left, right, value = self.nodes[n]
        column = np.maximum(feature, 0) if columns is None else np.searchsorted(columns, feature)
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while (inner := feature[at] >= 0).any():
            low = x[rows, column[at]] <= threshold[at]
            at = np.where(inner, np.where(low, left[at], right[at]), at)
        return value[at]


def trees_of(model: GBTRegressionModel) -> Trees:
    out = []
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        rows: list[list[float]] = []

        def add(node, weight=weight, rows=rows) -> int:
            n = len(rows)
            rows.append([-1, 0.0, 0, 0, weight * node.prediction()])
            if node.getClass().getSimpleName() == "InternalNode":
                split = node.split()
                rows[n][:2] = [split.featureIndex(), split.threshold()]
                rows[n][2:4] = [add(node.leftChild()), add(node.rightChild())]
            return n

        add(tree._call_java("rootNode"))
        feature, threshold, left, right, value = (np.array(c) for c in zip(*rows, strict=True))
        out.append((feature.astype(np.int64), threshold.astype(float), left.astype(np.int64), right.astype(np.int64), value.astype(float)))
    return Trees(out)


def _filled(columns: list[str]) -> list[Column]:
    return [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]


def boosted(rows: DataFrame, features: list[str], target: str, seed: int = 42, times: str | None = None) -> Trees:
    """Gradient-boosted trees of ``target`` fitted to all rows; nulls are zeros. With ``times``
    a row counts for so many."""
    filled = rows.select(*_filled([*features, target]), *([] if times is None else [times]))
    vectors = VectorAssembler(inputCols=features, outputCol="_features").transform(filled)
    model = GBTRegressor(featuresCol="_features", labelCol=target, maxIter=TREES, maxDepth=DEPTH, maxBins=BINS, seed=seed)
    return trees_of((model if times is None else model.setWeightCol(times)).fit(vectors))


def distinct_rows(rows: DataFrame, features: list[str], target: str) -> DataFrame:
    """(features, ``target``, TIMES): each distinct row of the features, nulls being zeros, with
    the mean target and the number of the rows that it stands for. Least squares split these
    as they split all rows, whose targets differ from that mean by the same at every split."""
    return rows.select(*_filled([*features, target])).groupBy(*features).agg(F.avg(target).alias(target), F.count("*").alias(TIMES))


def of_trees(x: np.ndarray, background: np.ndarray, walks: list[tuple[int, ...]], trees: Trees) -> np.ndarray:
    """(rows, features) values of a sum of trees. Rows that take the same sides at all nodes
    of a tree have the same values of it, so they are worked out once for each such choice."""
    out = np.zeros(x.shape)
    for n, (feature, threshold, *_) in enumerate(trees.nodes):
        inner = feature >= 0
        if not inner.any():
            continue
        sides = np.packbits(x[:, feature[inner]] <= threshold[inner], axis=1)
        sides = sides[:, 0] if sides.shape[1] == 1 else np.ascontiguousarray(sides).view(f"V{sides.shape[1]}")[:, 0]
        _, first, which = np.unique(sides, return_index=True, return_inverse=True)
        used = trees.used(n)
        out[:, used] += _of_tree(x[first], background, walks, trees, n)[which][:, used]
    return out / len(walks)


def _of_tree(x: np.ndarray, background: np.ndarray, walks: list[tuple[int, ...]], trees: Trees, n: int) -> np.ndarray:
    """The sums over all orders of one tree's values. It sees the order of its own features
    only, and its mean over the background depends on which of them have joined; each such
    set is looked up once."""
    out, used = np.zeros(x.shape), trees.used(n)
    means: dict[frozenset[int], np.ndarray] = {}

    def mean(joined: frozenset[int]) -> np.ndarray:
        if joined not in means:
            mixed = np.tile(background[:, used], (len(x), 1))
            for k, f in enumerate(used):
                if f in joined:
                    mixed[:, k] = np.repeat(x[:, f], len(background))
            means[joined] = trees.value(n, mixed, used).reshape(len(x), -1).mean(1)
        return means[joined]

    for walk, times in Counter(tuple(f for f in walk if f in used) for walk in walks).items():
        for k, f in enumerate(walk):
            out[:, f] += times * (mean(frozenset(walk[: k + 1])) - mean(frozenset(walk[:k])))
    return out


def of_function(x: np.ndarray, background: np.ndarray, walks: list[tuple[int, ...]], predict: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The same for any function of rows, which is asked at every step."""
    n, d = x.shape
    out = np.zeros((n, d))
    for walk in walks:
        mixed = np.tile(background, (n, 1))
        now = predict(mixed)
        for f in walk:
            mixed[:, f] = np.repeat(x[:, f], len(background))
            new = predict(mixed)
            out[:, f] += (new - now).reshape(n, -1).mean(1)
            now = new
    return out / len(walks)


def background_of(rows: DataFrame, key: str, features: list[str], size: int = BACKGROUND) -> np.ndarray:
    """``size`` rows, the first by a hash of their key."""
    first = rows.orderBy(F.md5(F.col(key).cast("string")), key).limit(size)
    return first.select(*_filled(features)).toPandas().to_numpy(dtype=float)


def attributed(rows: DataFrame, key: str, features: list[str], model: Trees | Callable[[np.ndarray], np.ndarray], background: np.ndarray, edges: Edges = EDGES, seed: int = 42, most: int = ORDERS) -> DataFrame:
    """(key, feature, value) of every row: one row a feature, whose values sum to the model's
    value of the row less its mean over ``background``. Null features are zeros; an empty
    table gives no rows. ``key`` names the rows and may repeat."""
    walks = orders(parents(features, edges), most, seed)
    kind = rows.schema[key].dataType.simpleString()
    step = max(1, math.floor(200_000 / max(1, len(background))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for lo in range(0, len(df), step):
                part = df.iloc[lo : lo + step]
                x = part[features].to_numpy(dtype=float)
                found = of_trees(x, background, walks, model) if isinstance(model, Trees) else of_function(x, background, walks, model)
                yield pd.DataFrame({key: part[key].to_numpy(), **{f"_{n}": found[:, n] for n in range(len(features))}})

    filled = rows.select(key, *_filled(features))
    wide = filled.mapInPandas(run, f"`{key}` {kind}" + "".join(f", _{n} double" for n in range(len(features))))
    each = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"_{n}").alias("value")) for n, f in enumerate(features)))
    return wide.select(key, F.explode(each).alias("_of")).select(key, "_of.feature", "_of.value")


def explained(rows: DataFrame, key: str, features: list[str], target: str, edges: Edges = EDGES, seeds: tuple[int, ...] = (42,)) -> DataFrame:
    """(seed, feature, value, TIMES): ``target`` is fitted by boosted trees, once a seed, and
    attributed to ``features``, which should hold neither the target nor its effects. Rows
    with equal features have equal values: they are one row of the fit and of each feature's
    values, with the number of them in TIMES. ``key`` chooses the background."""
    rows = rows.select(key, *features, target).persist(StorageLevel.MEMORY_AND_DISK)
    # read by every fit and attribution
    each = distinct_rows(rows, features, target).persist(StorageLevel.MEMORY_AND_DISK)
    background, n = background_of(rows, key, features), each.count()
    rows.unpersist()
    # a fit is some seventy short jobs, whose tasks are as many as the rows need
    dealt = each.coalesce(math.ceil(max(1, n) / FIT_ROWS))
    with ThreadPool(max(1, len(seeds))) as pool:
        models = pool.map(inheritable_thread_target(rows.sparkSession)(lambda seed: boosted(dealt, features, target, seed, TIMES)), seeds)
    out = None
    for seed, model in zip(seeds, models, strict=True):
        own = attributed(each, TIMES, features, model, background, edges, seed).select(F.lit(seed).alias("seed"), "feature", "value", TIMES)
        out = own if out is None else out.unionByName(own)
    return out
