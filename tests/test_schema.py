"""Shapes of decisions: what has them, and where what hasn't first goes wrong."""

import json

import pytest
from pyspark.sql import functions as F

from turnloom.functions import schema
from turnloom.operators import decisions as d


def problems(spark, shape, bodies):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b string")
    return [r["p"] for r in df.select("i", schema.problem(F.col("b"), shape).alias("p")).orderBy("i").collect()]


@pytest.mark.parametrize(("shape", "cases"), [
    (d.ROUTE_SHAPE, [
        ('{"kind":"new_task","relativeIndex":0}', None), ('{"kind":"new_task","relativeIndex":"abc"}', "$.relativeIndex"), ('{"kind":"revive_task","relativeIndex":-1.7}', "$.relativeIndex"),
        ('{"kind":5,"relativeIndex":0}', "$.kind"), ('{"kind":"revive_task","relativeIndex":-2}', None), ('{"kind":"revive_task","relativeIndex":0}', "$.relativeIndex"), ("{}", "$.kind"),
        ('{"kind":"new_task","kind":"same_task","relativeIndex":0}', "$"), (None, "$"), ("", "$"), ('"new_task"', "$"), ('{"kind":null,"relativeIndex":0}', "$.kind"), ('{"kind":"new_task","relativeIndex":1e0}', "$.relativeIndex"),
    ]),
    (d.CHUNK_SHAPE, [
        ('{"itemId":"a","sections":[]}', None), ('{"itemId":"a","sections":"none"}', "$.sections"), ('{"itemId":"a","sections":[{"label":"l"}]}', "$.sections[0].anchor"),
        ('{"itemId":"a","sections":[{"label":"l","anchor":"x"},{"label":"l","anchor":"x","z":1}]}', "$.sections[1].z"), ('{"itemId":"a","error":"e"}', None), ('{"itemId":"a","error":"e","sections":[]}', "$.error"),
        ('{"itemId":"a","sections":[1]}', "$.sections[0]"), ('[{"itemId":"a","error":"e"}]', "$"),
    ]),
    (d.DROPS_SHAPE, [
        ('{"defaultDecision":{"drop":false,"reason":null},"overrides":[]}', None), ('{"defaultDecision":{"drop":true,"reason":"empty_or_invalid"},"overrides":[{"pieceId":"p","drop":false,"reason":null}]}', None),
        ('{"defaultDecision":{"drop":true,"reason":"because"},"overrides":[]}', "$.defaultDecision.reason"), ('{"defaultDecision":{"drop":1,"reason":null},"overrides":[]}', "$.defaultDecision.drop"),
        ('{"defaultDecision":{"drop":false,"reason":null},"overrides":{}}', "$.overrides"), ('{"defaultDecision":{"drop":false,"reason":null}}', "$.overrides"),
    ]),
])
def test_first_violations(spark, shape, cases):
    assert problems(spark, shape, [b for b, _ in cases]) == [p for _, p in cases]


def test_bounds_and_types(spark):
    shape = {"type": "object", "properties": {"n": {"type": ["number", "null"], "minimum": 1, "maximum": 3}, "any": {}}, "required": ["n"]}
    bodies = [json.dumps(x) for x in ({"n": 1}, {"n": None}, {"n": 3.5}, {"n": 0}, {"n": True}, {"n": 2, "more": 1}, {"n": 2, "any": [1]}, {})]
    assert problems(spark, shape, bodies) == [None, None, "$.n", "$.n", "$.n", None, None, "$.n"]


def test_values_come_out_as_types(spark):
    body = '{"results":[{"itemId":"a","error":"e"},{"itemId":"b","sections":[{"label":"l","anchor":"é \\"q\\""}]}]}'
    r = spark.createDataFrame([(body,), ("{}",)], "b string").select(schema.strict(F.col("b"), d.CHUNKS_SHAPE).alias("c")).collect()
    assert r[1]["c"] is None and r[0]["c"]["results"][1]["sections"][0]["anchor"] == 'é "q"' and r[0]["c"]["results"][0]["sections"] is None
