import random
import re
from fractions import Fraction

from dossiermill.llm import common, simhash


def test_unlike_texts_under_one_key_end_where_they_meet(spark, monkeypatch):
    """A family of which all share a key, with two that are alike: the join itself leaves the others out."""
    draw = random.Random(5)
    names = [f"n{i:02d}" for i in range(30)]
    parity = {n: [draw.getrandbits(64) - (1 << 63) for _ in range(simhash.PARITIES)] for n in names}
    parity["n07"] = [parity["n03"][0] ^ 5, *parity["n03"][1:]]
    shared = spark.createDataFrame([(k, n, 100, 98) for n in names for k in (1, 2)], "key long, node string, n int, behind int")
    first = spark.createDataFrame(list(parity.items()), "node string, parity array<long>")
    roots = spark.createDataFrame([], "node string, root string")
    plans, stored = [], common.stored

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return stored(df)

    monkeypatch.setattr(common, "stored", seen)
    found = simhash._candidates(shared, first, roots, Fraction(4, 5))
    assert [tuple(r) for r in found.collect()] == [("n03", "n07", 2, "n03", "n07")]
    met = [x for x in "\n".join(plans).split("\n") if "Join Inner" in x and re.search(r"key#\d+L = key#\d+L", x) and "parity" in x]
    assert met and all("bit_count" in x for x in met)


def test_keys_of_the_same_texts_are_one(spark):
    """Near copies that share fifty keys with each other only meet once, with the weight of all."""
    rows = [(k, n, 100, 50) for n in ("a", "b") for k in range(50)] + [(k, n, 100, 50) for n in ("a", "b", "c") for k in (50, 51)] + [(60, "c", 100, 50)]
    weighed = simhash._weighed(spark.createDataFrame(rows, "key long, node string, n int, behind int"))
    assert sorted((r.key, r.node, r.weight) for r in weighed.collect()) == [(0, "a", 50), (0, "b", 50), (50, "a", 2), (50, "b", 2), (50, "c", 2)]
    first = spark.createDataFrame([(n, [0] * simhash.PARITIES) for n in "abc"], "node string, parity array<long>")
    found = simhash._candidates(weighed, first, spark.createDataFrame([], "node string, root string"), Fraction(4, 5))
    assert [tuple(r) for r in found.collect()] == [("a", "b", 52, "a", "b")]


def test_a_crowd_of_near_copies_fetches_few_pairs(spark, monkeypatch):
    """Twice the near copies of one text do not have four times the pairs compared."""
    draw = random.Random(8)
    line = [f"w{draw.randrange(10**6)}" for _ in range(200)]
    compared, plain = [], simhash._alike

    def seen(pairs, *more):
        compared.append(pairs.count())
        return plain(pairs, *more)

    monkeypatch.setattr(simhash, "_alike", seen)
    counts = []
    for size in (150, 300):
        texts = []
        for _ in range(size):
            text = line.copy()
            for at in draw.sample(range(200), draw.randrange(1, 4)):
                text[at] = f"x{draw.randrange(10**9)}"
            texts.append(" ".join(text))
        compared.clear()
        kept = simhash.one_of_each_group(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
        assert [r.doc_id for r in kept.collect()] == [0]
        counts.append(sum(compared))
        assert counts[-1] <= 4 * size, counts
