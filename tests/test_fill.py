"""Filling from neighbours in segments against a plain walk over the rows."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from starloom.operators import cleanse, ordering
from starloom.session import ensure_checkpoint_dir


def plain(rows, keyed, backward):
    """Rows (place, key, v, w) with v and w filled."""
    seen, out = {}, {}
    for place, key, *values in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=backward):
        last = seen.setdefault(key if keyed else None, [None, None])
        seen[key if keyed else None] = last = [v if v is not None else b for v, b in zip(values, last, strict=True)]
        out[place] = (key, *last)
    return out


@pytest.fixture(scope="module")
def rows():
    """One key holds half of the rows, one is NULL; a column has long gaps over many segments."""
    rng = random.Random(71)
    keys = ["hot"] * 6 + [None, "a", "b", "c", "d", "e"]
    return [(k, rng.choice(keys), rng.choice([None, None, k]), k if k % 457 == 3 else None) for k in range(3000)]


@pytest.mark.parametrize("segment_rows", [7, 100, 1_000_000])
@pytest.mark.parametrize("keyed", [True, False])
@pytest.mark.parametrize("backward", [True, False])
def test_segments_of_any_size_fill_alike(spark, rows, segment_rows, keyed, backward):
    shuffled = random.Random(1).sample(rows, len(rows))
    df = spark.createDataFrame(shuffled, "place long, key string, v long, w long").repartition(5)
    found = ordering.carry_fill(df, ["v", "w"], ["place"], ["key"] if keyed else None, backward, segment_rows)
    assert found.columns == df.columns
    assert {r["place"]: tuple(r)[1:] for r in found.collect()} == plain(rows, keyed, backward)


def test_hot_key_is_parted_and_rows_are_not_stored(spark, rows):
    df = spark.createDataFrame(rows, "place long, key string, v long, w long")
    cuts = {r["key"]: len(r["_cuts"]) for r in ordering.segment_cuts(df, ["place"], ["key"], 100).collect()}
    assert set(cuts) == {"hot", None, "a", "b", "c", "d", "e"} and 10 <= cuts["hot"] <= 20
    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    known = set(folder.glob("stored-*"))
    wide = df.withColumn("payload", F.repeat(F.lit("x"), 1000))
    assert ordering.carry_fill(wide, ["v"], ["place"], ["key"], segment_rows=100).count() == 3000
    stored = [spark.read.parquet(str(p)).columns for p in set(folder.glob("stored-*")) - known]
    assert stored and not [c for names in stored for c in names if c in ("payload", "v", "w", "place")]


def test_orders_of_several_columns_and_null_places(spark):
    rows = [(None, 1, "a"), (None, 2, None), (1, 1, None), (1, 2, "b"), (2, 1, None), (3, 9, None)]
    df = spark.createDataFrame(rows, "x int, y int, v string")
    for segment_rows in (1, 2, 100):
        got = {(r["x"], r["y"]): r["v"] for r in ordering.carry_fill(df, ["v"], ["x", "y"], segment_rows=segment_rows).collect()}
        assert got == {(None, 1): "a", (None, 2): "a", (1, 1): "a", (1, 2): "b", (2, 1): "b", (3, 9): "b"}


def test_empty_input(spark):
    df = spark.createDataFrame([], "x int, v string")
    assert cleanse.handle_nulls(df, "forward_fill", order=["x"]).count() == 0
