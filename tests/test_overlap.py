"""Shared values of columns against plain sets, over random tables and thresholds."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F, types as T

from starloom.operators import profile, relate


def plain(tables, threshold):
    sets = [(t, {v for v in values if v is not None}) for t, columns in tables.items() for values in columns.values()]
    out = set()
    for i, (t, a) in enumerate(sets):
        for j, (u, b) in enumerate(sets[:i]):
            same = len(a & b)
            if t != u and same and same >= threshold * min(len(a), len(b)):
                out.add((j, i, same))
    return out


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(51)
    pool = [f"v{k}" for k in range(60)]
    tables = {}
    for t in range(4):
        columns = {}
        for c in range(4):
            size = rng.choice([1, 3, 10, 40])
            own = rng.sample(pool, size) if rng.random() < 0.6 else rng.sample(pool[: size + 5], size)
            columns[f"c{c}"] = [rng.choice([*own, None]) for _ in range(60)] + own + [None] * (40 - size)
        tables[f"t{t}"] = columns
    frames = {t: spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{c} string" for c in columns)) for t, columns in tables.items()}
    return tables, frames


@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.8, 1.0])
def test_contained_pairs_are_those_of_all_pairs(made, threshold):
    tables, frames = made
    got = {tuple(r) for r in relate.contained_pairs(relate.value_signatures(frames), threshold).collect()}
    assert got == plain(tables, threshold)


def test_columns_of_mostly_own_values_form_no_pair(spark):
    """The bound ends such columns before any pair is built: no pattern of theirs is left to start one."""
    own = spark.range(1000).select(F.concat(F.lit("a"), "id").alias("x"))
    other = spark.range(1000).select(F.concat(F.when(F.col("id") < 100, "a").otherwise("b"), "id").alias("y"))
    found = relate.value_signatures({"one": own, "two": other})
    assert relate.contained_pairs(found, 0.8).count() == 0
    assert [tuple(r) for r in relate.contained_pairs(found, 0.1).collect()] == [(0, 1, 100)]


def test_statistics_of_signatures_equal_the_profile(made):
    tables, frames = made
    found = relate.value_signatures(frames, ignore=["c1"], every=True)
    want = {(r["table_name"], r["column_name"]): (r["row_count"], r["null_count"], r["cardinality"]) for r in profile.column_statistics(frames).collect()}
    got = {(r["table_name"], r["column_name"]): (r["row_count"], r["null_count"], r["cardinality"]) for r in relate.signature_statistics(frames, found).collect()}
    assert got == want
    sides = {c for r in relate.contained_pairs(found, 0.0).collect() for c in (r["cid1"], r["cid2"])}
    assert not sides & {1, 5, 9, 13}  # the ignored ones


def test_analysis_reads_each_table_once(spark, tmp_path):
    frames = {}
    for t in ("a", "b"):
        spark.range(50).select(F.col("id").alias(f"{t}_key"), F.concat(F.lit("n"), "id").alias("name")).write.parquet(f"{tmp_path}/{t}")
        frames[t] = spark.read.parquet(f"{tmp_path}/{t}")
    reads = spark.sparkContext.accumulator(0)

    def counted(df):
        schema = df.schema

        def run(batches):
            for batch in batches:
                reads.add(len(batch))
                yield batch

        return df.mapInPandas(run, schema)

    parts = relate.analyze_erd({t: counted(df) for t, df in frames.items()})
    assert reads.value == 100
    assert parts["summary"].first()["total_relationships"] > 0


def test_small_numbers_of_all_types_meet(spark):
    doubles = spark.createDataFrame([(0.0000001,), (0.1,), (2.5e-20,), (3.0,), (float("nan"),), (-0.0,)], "x double")
    kind = T.DecimalType(20, 10)
    decimals = spark.createDataFrame([(Decimal("0.0000001"),), (Decimal("0.1"),), (Decimal("3"),), (Decimal("1234567890.1234567891"),)], "y decimal(20,10)")
    written = [r["t"] for r in decimals.select(relate.canonical_number(F.col("y"), kind).alias("t")).collect()]
    assert written == ["1.0E-7", "0.1", "3", "1234567890.1234567891"]
    texts = doubles.select(relate.canonical_number(F.col("x")).alias("t")).collect()
    assert [r["t"] for r in texts] == ["1.0E-7", "0.1", "2.5E-20", "3", "NaN", "0"]


def test_empty_tables(spark):
    frames = {"a": spark.createDataFrame([], "x string"), "b": spark.createDataFrame([], "y string")}
    assert relate.join_candidates_by_overlap(frames).count() == 0
    assert relate.analyze_erd(frames)["profile"].select("row_count").distinct().first()[0] == 0


def test_null_keys_get_rising_versions(spark):
    from starloom.operators import versioned

    base = spark.createDataFrame([(None, "old", 3), ("a", "old", 1)], "k string, v string, version long")
    changes = spark.createDataFrame([(None, "new"), ("a", "new"), ("b", "new")], "k string, v string")
    got = {r["k"]: r["version"] for r in versioned.number_changes(base, changes, ["k"]).collect()}
    assert got == {None: 4, "a": 2, "b": 1}
