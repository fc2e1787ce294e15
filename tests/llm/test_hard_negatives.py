import math
import random

import pytest
from pyspark.sql import functions as F

from dossiermill.llm import hard_negatives

DDL = "vec_id long, embedding array<float>, label int"


def brute_force(rows, anchors, positives=5, negatives=10):
    """By definition, one anchor and positive at a time; rows of (vec_id, vector, label)."""
    out = set()
    product = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for i, a, label in rows:
        if i % anchors:
            continue
        scored = sorted((-product(a, x), j, other) for j, x, other in rows if j != i)
        for minus, p, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [(s, j) for s, j, other in scored if other != label and 30 * -minus <= 100 * -s <= 90 * -minus]
            out |= {(i, p, n, j, -minus, -s) for n, (s, j) in enumerate(fits[:negatives], 1)}
    return out


def whole(rows):
    return [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]


def vectors(how, n=400):
    rng = random.Random(how)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = []
    for i in range(n):
        if how == "even":
            v = [rng.gauss(0, 0.4) for _ in range(6)]
        elif how == "clustered":
            v = [x + rng.gauss(0, 0.15) for x in centres[i % 5]]
        else:  # a third of all rows is one vector
            v = centres[0] if rng.random() < 0.35 else [x + rng.gauss(0, 0.3) for x in centres[i % 5]]
        rows.append((i, [float(round(x, 3)) for x in v], rng.randrange(3) if how != "one label" else 1))
    # halves are exact in a float, so the brute force floors the same numbers
    return [(i, [round(x * 64) / 64 for x in v], label) for i, v, label in rows]


@pytest.mark.parametrize("how", ["even", "clustered", "hot", "one label"])
@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, how, small):
    if small:  # several parts and several groups of a cell
        monkeypatch.setattr(hard_negatives, "ROWS", 150)
        monkeypatch.setattr(hard_negatives, "ANCHORS", 4)
    rows = vectors(how)
    got = hard_negatives.hard_negatives(hard_negatives.quantised(spark.createDataFrame(rows, DDL)), F.col("vec_id") % 10 == 0)
    assert got.dtypes[2] == ("rank", "int")
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == brute_force(whole(rows), 10)


def test_clusters_keep_rows_from_far_groups(spark):
    """The bounds spare copies: with clear clusters, most rows go to few groups."""
    rng = random.Random(3)
    rows = [(i, [float(round(64 * (4 * (k == i % 8) + rng.gauss(0, 0.05))) / 64) for k in range(8)], i % 8) for i in range(800)]
    q = hard_negatives.quantised(spark.createDataFrame(rows, DDL)).withColumn("anchor", F.col("vec_id") % 10 == 0)
    top = float(max(sum(x * x for x in v) for _, v, _ in whole(rows)))
    pivots = hard_negatives._pivots(q, 8, top)
    placed = hard_negatives._placed(q, pivots, 8, top)
    anchors = hard_negatives._anchors(placed, pivots, 8)
    needs = anchors.withColumn("least", F.lit(int(top * 0.9))).withColumn("most", F.lit(None).cast("long"))
    groups = anchors.select("group").distinct().count()
    copies = hard_negatives._copies(placed, hard_negatives._intervals(needs, ["cell", "label"], top), ["cell", "label"], 1).count()
    assert groups >= 4 and copies < 800 * groups / 3


def test_awkward_vectors(spark):
    rows = [
        (0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (1, [0.9, 0.1], 1), (2, [0.5, 0.5], 2), (3, [0.5, 0.5], 2), (4, None, 1), (5, [1.0, None], 1), (6, [float("nan"), 1.0], 2),
        (7, [float("inf"), 1.0], 2), (8, [0.5], 2), (9, [], 2), (None, [1.0, 1.0], 1), (10, [1.0, 0.0], None), (20, [0.0, 0.0], 1), (30, [-1.0, 0.0], 9),
    ]
    docs = spark.createDataFrame(rows, DDL).withColumn("v", F.lit(1)).withColumn("anchor", F.lit(2))
    got = [tuple(r) for r in hard_negatives.hard_negatives(hard_negatives.quantised(docs), F.col("vec_id") % 10 == 0).collect()]
    # 1 is there twice: both are positives; 30 has none of its label; 20's positives are 0, and rows at 0 are 2, 3, 8, 9 and 30
    assert sorted(r[:4] for r in got if r[0] == 0 and r[1] == 1) == sorted((0, 1, n, j) for n, j in ((1, 2), (2, 3), (3, 8)) for _ in range(2))
    assert {(r[1], r[3]) for r in got if r[0] == 20} == {(p, n) for p in (0, 1) for n in (2, 3, 8, 9, 30)}
    assert not [r for r in got if r[0] == 30]
    empty = spark.createDataFrame([], DDL)
    assert hard_negatives.hard_negatives(hard_negatives.quantised(empty), F.col("vec_id") % 10 == 0).count() == 0
    one = spark.createDataFrame(rows[:1], DDL)
    assert hard_negatives.hard_negatives(hard_negatives.quantised(one), F.col("vec_id") % 10 == 0).count() == 0


def test_huge_components_are_exact_or_cut():
    import numpy as np

    a, b = np.array([[1 << 40, 3]]), np.array([[5, 1 << 41], [1 << 40, 1 << 40]])
    assert hard_negatives.products(a, b).tolist() == [[5 * (1 << 40) + 3 * (1 << 41), hard_negatives.TOP]]
