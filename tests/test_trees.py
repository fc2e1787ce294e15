import json

from pyspark.sql import functions as F

from dossiermill.functions import trees

RECORDS = [
    {"a": 1, "b": {"z": "x", "c": [1, 2.5, {"d": None}], "e": {}}, "a2": []}, [], {}, [[1, [2, "3"]], {"k": True}], {"": "empty key", "x.y": "1", "q\"uote": "back\\slash \n line"},
    {"n": None, "t": True, "f": False, "s": "", "big": 12345678901234567890, "neg": -0.5}, {"text": "{\"not\": \"an object\"}", "list": "[1]"}, {"日本": ["語", {"漢": "字"}]}, 5, None, "plain",
]


def test_leaves_equal_a_walk(spark):
    texts = [json.dumps(r, ensure_ascii=False) for r in RECORDS] + ["", "{broken", None, " {\"a\" : [ 1 , 2 ] } "]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, j string")
    got = {r.n: r.v for r in df.select("n", trees.json_leaves(F.col("j")).alias("v")).collect()}
    for n, t in enumerate(texts):
        try:
            value = json.loads(t) if t else None
        except ValueError:
            value = None
        if t in ("", "{broken", None):
            assert got[n] is None
            continue
        kind = lambda x: "null" if x is None else {bool: "boolean", str: "string"}.get(type(x), "number")
        # a name may hold a point itself
        want = [(p, "x.y" if p == "x.y" else k, x if isinstance(x, str) else None if x is None else json.dumps(x), kind(x)) for p, k, x in trees.leaves(value)]
        assert [tuple(x) for x in got[n]] == want, t


def test_depth_is_bounded(spark):
    text = json.dumps({"a": {"b": {"c": {"d": 1}}}})
    df = spark.createDataFrame([(text,)], "j string")
    (leaf,) = df.select(F.explode(trees.json_leaves(F.col("j"), 2)).alias("l")).collect()
    assert (leaf.l.path, json.loads(leaf.l.value)) == ("a.b", {"c": {"d": 1}})
    deep = df.select(F.explode(trees.json_leaves(F.col("j"))).alias("l")).collect()
    assert [(r.l.path, r.l.key, r.l.value) for r in deep] == [("a.b.c.d", "d", "1")]
