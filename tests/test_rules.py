"""Name, profile and model rules checked over grids against plain restatements."""

import itertools

import pytest
from pyspark.sql import functions as F

from starloom.functions import names
from starloom.operators import hierarchy, profile, quality, typed


def measure(table, column, kind):
    for words, verdict in (
        ((table, names.CALENDAR_TABLE_WORDS), False), ((column, names.KEY_COLUMN_WORDS), False),
        ((column, names.ATTRIBUTE_COLUMN_WORDS), False), ((column, names.MEASURE_COLUMN_WORDS), True),
    ):
        if any(w in words[0].lower() for w in words[1]):
            return verdict
    return any(w in kind.lower() for w in names.MEASURE_TYPE_WORDS)


def test_measure_rule(spark):
    tables = ["sales", "calendar_stage1", "updates", "part_dim"]
    columns = ["sales_amount", "dealer_id", "l_orderkey", "is_open", "Total_Price", "city", "order_day", "key_x", "discount"]
    kinds = ["String", "Int64", "Float64", "Decimal(15, 2)", "Date", "UInt8"]
    grid = list(itertools.product(tables, columns, kinds))
    df = spark.createDataFrame(grid, "t string, c string, k string")
    rows = df.select("t", "c", "k", names.is_measure(F.col("t"), F.col("c"), F.col("k")).alias("m")).collect()
    assert len(rows) == len(grid)
    for r in rows:
        assert r.m == measure(r.t, r.c, r.k), (r.t, r.c, r.k)


@pytest.mark.parametrize(
    "a, b, ok",
    [
        ("Int64", "Float32", True), ("Nullable(Int64)", "int64", True), ("String", "FixedString(4)", True),
        ("Decimal(15, 2)", "Decimal(10, 2)", False), ("Date", "DateTime", False), ("Int64", "String", False),
    ],
)
def test_compatible_types(spark, a, b, ok):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(names.types_compatible(F.col("a"), F.col("b")).alias("r")).first().r is ok


@pytest.mark.parametrize(
    "a, b, score", [("order_key", "Order-Date", 1 / 3), ("a b", "b a", 1.0), ("", "x", 0.0), ("part_part", "part", 1.0)]
)
def test_name_similarity(spark, a, b, score):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(names.name_similarity(F.col("a"), F.col("b")).alias("r")).first().r == pytest.approx(score)


@pytest.mark.parametrize("cardinality, bucket", [(0, 0), (1, 0), (9, 0), (10, 1), (999, 2), (1000, 3), (10**15, 15)])
def test_magnitude(one, cardinality, bucket):
    assert one(hierarchy.magnitude, cardinality, "bigint") == bucket


STATS = "table_name string, column_name string, position int, type_name string, row_count bigint, null_count bigint, cardinality bigint"


def test_scores_and_roles(spark):
    rows = [
        ("t", "id", 1, "Int64", 2000, 0, 2000), ("t", "name", 2, "String", 2000, 1500, 5),
        ("t", "flag", 3, "String", 2000, 0, 2), ("t", "empty", 4, "Float64", 0, 0, 0), ("t", "code", 5, "Float64", 50, 0, 50),
    ]
    df = spark.createDataFrame(rows, STATS)
    out = {
        r.column_name: r
        for r in df.select(
            "column_name", profile.pk_candidate_unique().alias("pk"), profile.classify_by_type_and_cardinality().alias("role"),
            profile.quality_score_catalog().alias("qc"), profile.quality_score_table().alias("qt"),
            profile.quality_score_erd().alias("qe"), profile.quality_score_discover().alias("qd"),
        ).collect()
    }
    assert out["id"].pk and not out["code"].pk and not out["name"].pk
    assert [out[c].role for c in ("id", "name", "empty", "code")] == ["fact", "dimension", "dimension", "fact"]
    assert out["name"].qc == pytest.approx((0.005 + 1 - 300) / 2)  # may be negative
    assert out["empty"].qc == 0 and out["empty"].qt == 0 and out["empty"].qd == 0
    assert out["name"].qe == pytest.approx(1 - 0.3 - 0.2)
    assert out["id"].qe == 1.0
    assert out["name"].qd == pytest.approx(5 / 1505)


def test_issue_order_and_messages(spark):
    rows = [("t", "a", 60.0, 5, "dimension", 0.2, False, 10), ("t", "b", 0.0, 500, "dimension", 0.9, False, 10)]
    df = spark.createDataFrame(
        rows, "table_name string, column_name string, null_percentage double, cardinality bigint, classification string, "
        "data_quality_score double, is_primary_key_candidate boolean, row_count bigint")
    found = quality.ordered_issues(df).collect()
    assert [(r.severity, r.type) for r in found] == [
        ("high", "high_nulls"), ("high", "poor_quality"), ("medium", "low_cardinality"), ("low", "potential_primary_key")]
    assert found[0].message == "Column a has 60.0% null values"
    summary = quality.catalog_quality(df).first()
    assert (summary.total_tables, summary.medium_quality_tables) == (1, 1)
    assert [r.type for r in quality.recommendations(df).collect()] == ["null_values", "primary_keys", "cardinality"]


@pytest.mark.parametrize("kind", ["string", "date", "datetime", "numeric", "int", "float", "boolean", "Decimal", "Int64", "odd"])
@pytest.mark.parametrize("score", [0.5, 0.8, 0.9])
def test_storage_type_forms_agree(spark, kind, score):
    df = spark.createDataFrame([(kind, score)], "k string, s double")
    shown = df.select(typed.storage_type_column(F.col("k"), F.col("s")).alias("r")).first().r
    chosen = names.storage_type_name(typed.storage_type(kind, score))
    assert shown == ("UInt8" if kind == "boolean" else chosen)
