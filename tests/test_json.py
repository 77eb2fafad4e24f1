"""JSON documents to records."""

from starloom.operators.cleanse import flatten_json_paths
from starloom.sources.readers import json_records_to_rows


def test_records(spark):
    texts = ['{"a": 1}', '[{"a": 2}, 3, "x"]', "[]", "7", "1, 2", '{"a": 1}}', "not json", None]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, body string")
    got = sorted((r.n, r.record) for r in json_records_to_rows(df, "body").collect())
    assert got == [(0, '{"a":1}'), (1, '{"a":2}'), (1, '{"value":"3"}'), (1, '{"value":"x"}'), (3, '{"value":"7"}')]


def test_paths_of_ragged_documents(spark):
    texts = ['{"a": {"b": [1, {"c": "x{"}]}}', '{"d": null, "e": true}']
    df = spark.createDataFrame(list(enumerate(texts)), "n int, body string")
    got = {(r.n, r.path): r.value for r in flatten_json_paths(df, "body", ["n"]).collect()}
    assert got == {(0, "a_b_0"): "1", (0, "a_b_1_c"): "x{", (1, "d"): None, (1, "e"): "true"}
    short = {(r.n, r.path): r.value for r in flatten_json_paths(df, "body", ["n"], max_depth=1).collect()}
    assert short[0, "a"] == '{"b":[1,{"c":"x{"}]}'


def test_flatten_follows_every_level(spark):
    from pyspark.sql import functions as F

    from starloom.operators.cleanse import flatten_nested

    depth = 14
    body = "1"
    nested = F.lit(1)
    for _ in range(depth):
        body, nested = f'{{"a": {body}}}', F.struct(nested.alias("a"))
    df = spark.createDataFrame([(1, body)], "n int, body string")
    assert [r.path for r in flatten_json_paths(df, "body", ["n"]).collect()] == ["_".join("a" * depth)]
    assert flatten_nested(df.select(nested.alias("x"))).columns == ["_".join(["x", *"a" * depth])]
