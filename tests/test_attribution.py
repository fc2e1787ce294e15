import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossiermill.operators import attribution

EDGES = [("a", "b"), ("b", "c"), ("d", "x"), ("x", "c")]
FEATURES = ["a", "b", "c", "d", "e", "f"]


def rows(spark, n=300):
    rng = random.Random(5)
    data = [(i, *(float(rng.randint(0, 9)) for _ in FEATURES)) for i in range(n)]
    data[3] = (3, None, 1.0, None, 2.0, 3.0, 4.0)
    df = spark.createDataFrame(data, "k long, " + ", ".join(f"{f} double" for f in FEATURES))
    return df.withColumn("y", F.coalesce("a", F.lit(0.0)) * F.col("b") + F.when(F.col("d") > 4, F.coalesce("c", F.lit(0.0))).otherwise(-F.col("e")))


def by_definition(predict, x, background, before):
    """The mean over all permutations that respect the causes, one at a time."""
    allowed = [p for p in itertools.permutations(range(len(x))) if all(p.index(c) < p.index(n) for n in range(len(x)) for c in before[n])]
    value = lambda known: np.mean([predict(np.array([[x[i] if i in known else b[i] for i in range(len(x))]]))[0] for b in background])
    cache = {s: value(set(s)) for k in range(len(x) + 1) for s in itertools.combinations(range(len(x)), k)}
    out = np.zeros(len(x))
    for p in allowed:
        for n, f in enumerate(p):
            out[f] += cache[tuple(sorted(p[: n + 1]))] - cache[tuple(sorted(p[:n]))]
    return out / len(allowed)


def test_parents_and_orders():
    before = attribution.parents(FEATURES, EDGES)
    assert before == [set(), {0}, {0, 1, 3}, set(), set(), set()]
    every = list(attribution.every_order(before))
    assert len(every) == len(set(every)) == sum(all(p.index(c) < p.index(n) for n in range(6) for c in before[n]) for p in itertools.permutations(range(6)))
    assert attribution.orders(before, most=10_000) == every
    with pytest.raises(ValueError):
        attribution.parents(["a", "b"], [("a", "b"), ("b", "a")])


def test_drawn_orders_are_even():
    before = attribution.parents(["a", "b", "c", "d"], [("a", "b")])
    every = list(attribution.every_order(before))
    drawn = [o for s in range(40) for o in attribution.orders(before, most=11, seed=s)]
    assert len(every) == 12 and set(drawn) <= set(every)
    share = [drawn.count(o) / len(drawn) for o in every]
    assert max(share) < 0.14 and min(share) > 0.045


def test_trees_of_a_fitted_model(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    df = rows(spark).na.fill(0.0)
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="v").transform(df)
    model = GBTRegressor(featuresCol="v", labelCol="y", maxIter=6, maxDepth=3, seed=1).fit(vectors)
    trees = attribution.trees_of(model)
    x = df.select(*FEATURES).toPandas().to_numpy()
    own = sum(trees.value(n, x) for n in range(len(trees.nodes)))
    assert own == pytest.approx([r.prediction for r in model.transform(vectors).select("prediction").collect()])


def test_values_by_definition(spark):
    df = rows(spark)
    trees = attribution.boosted(df, FEATURES, "y")
    background = attribution.background_of(df, "k", FEATURES, 5)
    predict = lambda x: sum(trees.value(n, x) for n in range(len(trees.nodes)))
    got = attribution.attributed(df, "k", FEATURES, trees, background, EDGES, most=10_000).toPandas()
    assert len(got) == 300 * len(FEATURES)
    before, base = attribution.parents(FEATURES, EDGES), predict(background).mean()
    data = {r.k: np.array([r[f] or 0.0 for f in FEATURES]) for r in df.collect()}
    for k, own in got.groupby("k"):
        x = data[k]
        assert own.value.sum() == pytest.approx(predict(x[None])[0] - base)
        if k < 8:
            assert dict(zip(own.feature, own.value, strict=True)) == pytest.approx(dict(zip(FEATURES, by_definition(predict, x, background, before), strict=True)))


def test_causes_take_what_their_effects_pass_on(spark):
    """If an effect repeats its cause, the cause has it all; without edges they share."""
    df = spark.range(40).selectExpr("id k", "CAST(id % 4 AS double) a", "CAST(id % 4 AS double) b")
    background = np.zeros((1, 2))
    both = lambda x: np.minimum(x[:, 0], x[:, 1]) + np.maximum(x[:, 0], x[:, 1])
    either = lambda x: np.maximum(x[:, 0], x[:, 1])
    for predict, edges, want in ((either, [("a", "b")], (3.0, 0.0)), (either, [], (1.5, 1.5)), (both, [("a", "b")], (3.0, 3.0))):
        got = attribution.attributed(df.where("k = 3"), "k", ["a", "b"], predict, background, edges).collect()
        assert tuple(r.value for r in sorted(got, key=lambda r: r.feature)) == pytest.approx(want)


def test_many_features_and_no_rows(spark):
    names = sorted({x for e in attribution.EDGES for x in e} - {"overall_score", "high_count", "medium_count"})
    df = spark.range(30).select("id", *(((F.col("id") * (n + 3)) % 7).cast("double").alias(f) for n, f in enumerate(names)))
    predict = lambda x: x.sum(1) + x[:, 0] * x[:, 1]
    background = attribution.background_of(df, "id", names, 4)
    got = attribution.attributed(df, "id", names, predict, background, most=5).toPandas()
    x = df.toPandas().set_index("id")[names]
    want = predict(x.to_numpy()) - predict(background).mean()
    assert got.groupby("id").value.sum().sort_index().to_numpy() == pytest.approx(want)
    assert attribution.attributed(df.where("id < 0"), "id", names, predict, background, most=5).count() == 0
    assert math.isfinite(got.value.abs().max())


def test_rows_on_the_same_sides_are_worked_out_once(monkeypatch):
    leaf = (-1, 0.0, 0, 0)
    nodes = [(0, 0.0, 1, 2, 0.0), (*leaf, 1.0), (*leaf, 3.0)]
    trees = attribution.Trees([tuple(np.array(c) for c in zip(*nodes, strict=True))])
    sizes, value = [], attribution.Trees.value
    monkeypatch.setattr(attribution.Trees, "value", lambda self, n, x, columns=None: (sizes.append(len(x)), value(self, n, x, columns))[1])
    x = np.linspace(-1, 1, 1_000).reshape(-1, 1)
    got = attribution.of_trees(x, np.array([[-1.0], [1.0]]), [(0,)], trees)
    assert max(sizes) <= 4 and np.allclose(got[:, 0], np.where(x[:, 0] <= 0, -1.0, 1.0))


def test_equal_rows_are_fitted_and_attributed_once(spark, monkeypatch):
    from dossiermill.operators import reports

    few = rows(spark)
    df = few.crossJoin(spark.range(1, 4).select(F.col("id").alias("copy"))).where("copy = 1 or k % 2 = 0").withColumn("y", F.col("y") + F.col("copy"))
    df = df.withColumn("k", F.col("k") * 10 + F.col("copy")).drop("copy")
    sizes, boosted = [], attribution.boosted
    monkeypatch.setattr(attribution, "boosted", lambda part, *rest: (sizes.append(part.count()), boosted(part, *rest))[1])
    found = attribution.explained(df, "k", FEATURES, "y", EDGES, seeds=(1, 2)).toPandas()
    assert sizes == [300, 300] and len(found) == 2 * 300 * len(FEATURES)
    assert found.groupby(["seed", "feature"])[attribution.TIMES].sum().eq(df.count()).all()
    background = attribution.background_of(df, "k", FEATURES)
    every = [attribution.attributed(df, "k", FEATURES, boosted(df, FEATURES, "y", s), background, EDGES, s).select(F.lit(s).alias("seed"), "feature", "value") for s in (1, 2)]
    want = {r.feature: r for r in reports.attribution(every[0].unionByName(every[1])).collect()}
    got = {r.feature: r for r in reports.attribution(spark.createDataFrame(found), attribution.TIMES).collect()}
    assert got.keys() == want.keys()
    for f in want:
        assert (got[f].mean_abs, got[f].std_abs) == pytest.approx((want[f].mean_abs, want[f].std_abs), abs=1e-5)
