"""Functions over JSON texts against plain forms."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tessella.functions import variants as V


def run(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    return [r.x for r in rows.select("k", column(F.col("t")).alias("x")).orderBy("k").collect()]


def test_keys_taken_out_at_any_depth(spark):
    texts = ['{"score":1,"b":[{"rank":[1],"é":"q\\"x"},[[{"score":{"a":1}}]],null,true,2.5],"a":{}}', "[]", "7", '"score"', "bad", None, "", '{"score":1}']
    got = run(spark, texts, lambda t: V.without_keys(t, ("score", "rank")))
    assert got == ['{"a":{},"b":[{"é":"q\\"x"},[[{}]],null,true,2.5]}', "[]", "7", '"score"', None, None, None, "{}"]
    deep = "[" * 6 + '{"score":1,"x":2}' + "]" * 6
    assert run(spark, [deep], lambda t: V.without_keys(t, ("score",))) == ["[" * 6 + '{"x":2}' + "]" * 6]
    with pytest.raises(Exception, match="levels"):
        run(spark, ["[" * 40 + "]" * 40], lambda t: V.without_keys(t, ("score",)))


def test_paths_of_trees(spark):
    tree = {"name": "a", "children": [{"name": "b", "children": [{"name": "c"}, {"children": [{"name": "lost"}]}]}, {"name": ""}, {"name": "d", "children": []}]}
    assert run(spark, [json.dumps(tree), "[]", "bad", None, '{"name":"x"}'], V.tree_paths) == [["a", "a/b", "a/b/c", "a/d"], [], [], [], ["x"]]


SCHEMA = {
    "type": "object", "required": ["id", "tags"],
    "properties": {
        "id": {"type": "integer"}, "kind": {"enum": ["a", 2]}, "title": {"type": "string", "maxLength": 5}, "ok": {"type": "boolean"},
        "tags": {"type": "array", "maxItems": 2, "items": {"type": "string", "maxLength": 3}}, "in": {"type": "object", "required": ["x"], "properties": {"x": {"type": "number"}}},
    },
}


def test_errors_by_schema(spark):
    texts = [
        '{"id":1,"tags":[]}', '{"id":1.5,"tags":["abcd",1,"x"],"kind":"b","title":"123456"}', '{"in":{},"ok":1,"kind":2}', '{"id":2.0,"tags":{},"in":{"x":"1"}}', "[1]", "bad", None, '{"id":null,"tags":null}',
    ]
    assert run(spark, texts, lambda t: V.schema_errors(t, SCHEMA)) == [
        [], ["$.id: not integer", "$.kind: not one of its values", "$.title: too long", "$.tags[0]: too long", "$.tags[1]: not string", "$.tags: too many"], ["$.id: missing", "$.tags: missing", "$.ok: not boolean", "$.in.x: missing"],
        ["$.tags: not array", "$.in.x: not number"], ["$: not object"], ["$: no JSON"], ["$: no JSON"], ["$.id: not integer", "$.tags: not array"],
    ]


def test_sentences(spark):
    texts = [
        '"as it is "', "null", '["a", null, {"name":"n"}, ["b", 1], ""]', '{"question":" q ","reason":"r"}', '{"reason":"r"}', '{"item":"  ","title":"t","note":"t"}', '{"b":1,"a":[2]}', "true", "12", "{}", '{"question":7,"why":"w","text":"x"}', None,
    ]
    assert run(spark, texts, lambda t: V.sentence(V.value(t))) == ["as it is ", "", "a; n; b; 1", "q — r", "r", "t", '{"a":[2],"b":1}', "true", "12", "{}", "x — w", ""]


def test_mended_texts(spark):
    texts = ['{"id":"x","title":{"name":"n","why":"w"},"tags":["abcd",7,"x"],"other":[1]}', '{"title":123456,"in":{"x":"1"}}', "[1]", "bad", None, '{"tags":"no"}']
    got = run(spark, texts, lambda t: V.mended(t, SCHEMA))
    assert got == ['{"id":"x","other":[1],"tags":["abc","7"],"title":"n — w"}', '{"in":{"x":"1"},"title":"12345"}', "[1]", None, None, '{"tags":"no"}']
    left = run(spark, got, lambda t: V.schema_errors(t, SCHEMA))
    assert left[0] == ["$.id: not integer"] and left[1] == ["$.id: missing", "$.tags: missing", "$.in.x: not number"]
