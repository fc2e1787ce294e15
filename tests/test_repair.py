import json

import pytest

from dossiermill.functions import repair
from dossiermill.operators import responses


@pytest.mark.parametrize(
    ("text", "value", "way"),
    [
        ('{"a": "x,}", "b": [1]}', {"a": "x,}", "b": [1]}, 0),
        ('```json\n[1, 2,,]\n```', [1, 2], 1),
        ('{"a": ["x", {"b": "cut', {"a": ["x", {"b": "cut"}]}, 1),
        ('{"a": "cut \\', {"a": "cut "}, 1),
        ('{"a": 1, ', {"a": 1}, 1),
        ('{"a": "see "part 8" here", "b": 1}', {"a": 'see "part 8" here', "b": 1}, 2),
        ('{"a": "C:\\\\": drive", "b": "it\'s \\"so\\""}', {"a": 'C:\\": drive', "b": 'it\'s "so"'}, 2),
        ('{"a": "v"], "b": [1]}', {"a": "v", "b": [1]}, 3),
        ('{"r": [{"a": "v"], "b": 1}]}', {"r": [{"a": "v", "b": 1}]}, 3),
        ('{"r": [{"a": "} {"}\n{"a": "q" w"}]}', {"r": [{"a": "} {"}, {"a": 'q" w'}]}, 4),
        ('[[1] [2]]', [[1], [2]], 4),
        ('{"a": [1, 2}', {"a": [1, 2]}, 5),
        ('{"a": 1\n"b": 2}', {"a": 1, "b": 2}, 6),
    ],
)
def test_ways(text, value, way):
    assert repair.read(text) == (value, way)


@pytest.mark.parametrize("text", ["", "nothing", "```json\n```", '{"a": NaN}', "[" * 5_000, '{"a":', "{:]", '{"a" 1}'])
def test_no_way(text):
    if text == "[" * 5_000:
        repair.mended(text)
        return
    with pytest.raises(ValueError):
        repair.read(text)


def test_valid_json_stays():
    for value in ({"a": [1, {"b": None}], "c": "\\ \" , ]}"}, [], "x", 1.5):
        text = json.dumps(value)
        assert repair.read(text) == (value, 0)
        for way in repair.WAYS:
            assert json.loads(repair.mended(text, **way)) == value


def test_shapes():
    record = {"FullText": ["a", "", "b"], "Odour": {"FullText": [" ", "x", "y"]}, "Colour": {"Other": 1}, "AdditionalInfo": {"FullText": ["a", "b"], "Deep": {"FullText": ["c"]}}, "Substance": ["a", 1], "Rows": [{"ConditionsToAvoid": ["u", "v"]}], "MaterialsToAvoid": []}
    want = {"FullText": "a\nb", "Odour": "x\ny", "Colour": {"Other": 1}, "AdditionalInfo": {"FullText": ["a", "b"], "Deep": {"FullText": "c"}}, "Substance": ["a", 1], "Rows": [{"ConditionsToAvoid": "u\nv"}], "MaterialsToAvoid": []}
    assert repair.shaped(record) == want
    assert repair.wrapped_text({"FullText": " ", "AdditionalInfo": {"FullText": "z"}}) == "z"
    assert repair.wrapped_text({"AdditionalInfo": "z"}) is None


def test_answers(spark):
    texts = [None, "", "[1]", "5", '{"Composition": 1, "Identification": [[1]], "EcologicalInformation": "x", "ToxicologicalInformation": [], "Other": 2}', '{"HandlingAndStorage": [{"a": 1}, 2], "DisposalConsiderations": {"b": [1]}}']
    rows = spark.createDataFrame(list(enumerate(texts)), "doc int, answer string")
    got = {r.doc: r for r in responses.answered_records(rows).collect()}
    assert all(got[n].malformed and got[n].json is None and not got[n].skipped for n in range(4))
    assert got[4].skipped == ["Identification", "Composition", "EcologicalInformation"] and got[4].ToxicologicalInformation == []
    assert json.loads(got[5].HandlingAndStorage) == {"a": 1} and json.loads(got[5].DisposalConsiderations) == {"b": [1]}
    assert responses.answered_records(rows.where("false")).count() == 0


def test_corrections(spark):
    texts = [None, "", "```\n```", "] [", "[1]", "[null]", '[{"corrected": "x"}]', '[{"original": "a", "corrected": 1}]', '[{"original": "a"}] [2]', '[{"original": "a", "more": {}, "corrected": "b"}]', "[]", '[{"original": "a"}, {"original": "a", "corrected": ""}]']
    rows = spark.createDataFrame(list(enumerate(texts)), "doc int, answer string")
    got = sorted(map(tuple, responses.corrections(rows).select("doc", "pos", "code", "corrected", "error").collect()), key=lambda r: r[:2])
    assert got[:9] == [(n, 0, None, None, e) for n, e in enumerate(["no list"] * 4 + ["no corrections"] * 4 + ["no JSON"])]
    assert got[9:] == [(9, 0, "a", "b", None), (11, 0, "a", None, None), (11, 1, "a", "", None)]
