"""Ratings in texts of any shape."""

import json

import pytest
from pyspark.sql import functions as F

from momentlens.operators import frames, manifest

REPLIES = [
    ('{"scores": [1, 2, 3, 4], "description": "a"}', [1, 2, 3, 4], "a"),
    ('```json\n{"scores": [5, 6, 7, 8], "description": "b"}\n```', [5, 6, 7, 8], "b"),
    ('First {"note": 1}, then {"scores": [9], "description": "two objects"}.', [9], "two objects"),
    ('{"scores": [1], "description": "braces } in { strings"} and {"scores": [2]}', [1], "braces } in { strings"),
    ('He said "so {" and then {"scores": [3, 3], "description": "say \\"}\\" twice"}', [3, 3], 'say "}" twice'),
    ('{"outer": {"scores": [7]}, "scores": [4, 4]}', [4, 4], None),
    ('{"outer": {"scores": [7]}}', [7], None),
    ('{"scores": [1, 2', None, None),
    ('{"scores": "none"}', None, None),
    ('{"scores": null}', None, None),
    ('[{"scores": [8]}]', [8], None),
    ("{{{}}}", None, None),
    ("no scene", None, None),
    ("", None, None),
    (None, None, None),
    ('{"scores": [1, null, 3], "description": 5}', [1, None, 3], "5"),
    ("{ " * 300 + '{"scores": [6]}', [6], None),
]


def test_replies(spark):
    d = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(REPLIES)], "i int, text string")
    default = F.struct(F.lit(None).cast("array<int>").alias("scores"), F.lit(None).cast("string").alias("description"))
    got = d.select("i", manifest.tolerant_json(F.col("text"), "scores array<int>, description string", default, "scores").alias("r")).collect()
    assert {r["i"]: (r["r"]["scores"], r["r"]["description"]) for r in got} == {i: (s, x) for i, (_, s, x) in enumerate(REPLIES)}


def test_objects(spark):
    def plain(text):
        """By Python's parser, at each brace."""
        out = []
        for i, c in enumerate(text):
            if c == "{":
                try:
                    out.append(text[i : i + json.JSONDecoder().raw_decode(text[i:])[1]])
                except ValueError:
                    pass
        return out

    texts = ['a {"x": {"y": "}"}} b {"z": "\\\\"} {', '{"k": [{"a": 1}, {"b": "{"}]}', "", "}{", 'x "{" {"q": "\\"{"}']
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r["o"] for r in d.select(manifest.outermost(F.col("text")).alias("o")).collect()]
    assert [[o for o in x if manifest_json(o)] for x in got] == [plain(t) for t in texts]


def manifest_json(o):
    try:
        json.loads(o)
    except ValueError:
        return False
    return True


def test_variants_keep_their_shape(spark):
    d = spark.createDataFrame([('see {"scores": {"first": 1.5}} end',)], "text string")
    v = manifest.tolerant_variant(F.col("text"), "scores")
    r = d.select(F.try_variant_get(v, "$.scores.first", "double").alias("a"), F.schema_of_variant(v).alias("s")).first()
    assert r["a"] == 1.5 and "scores" in r["s"]


@pytest.mark.parametrize("text,want", [('{"scores": [9, 2]}', [(0.0, 9)]), ('{"scores": [5, 5, 5, 5, 5]}', [(0.0, 5), (5.0, 5), (10.0, 5)]), ('{"scores": [null, 7]}', [(5.0, 7)])])
def test_short_and_long_score_lists(spark, text, want):
    d = spark.createDataFrame([("v", [0.0, 5.0, 10.0, 15.0], 3, text)], "asset string, times array<double>, n int, text string")
    assert [(r["t"], r["rating"]) for r in frames.rated(d).orderBy("t").collect()] == want
