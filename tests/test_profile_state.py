"""Profiles added up load by load against profiles of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from starloom.operators import infer, profile, profile_state


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(61)
    dates = ["2024-01-05", "20240229", "2023-02-30", "1/2/2024", "31-12-2020", "1732627200", "2024-05-05T10:00:00"]
    out = []
    for k in range(600):
        out.append((f"k{k}", rng.choice([None, "", "x", f"v{rng.randrange(40)}"]), rng.choice([*dates, " 7 ", "1,234.50", "-3", "12%"]), str(rng.randrange(5)), "long " * 50 + str(k % 7)))
    return out


def table_of(spark, rows):
    return spark.createDataFrame(rows, "key string, mixed string, shape string, few string, long string")


def shown(df):
    rounded = [F.round(f.name, 9).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema]
    return sorted((r.asDict() for r in df.select(*rounded).collect()), key=lambda r: (r.get("table_name") or r["original_table_name"], r["position"]))


def test_states_add_up_in_any_order(spark, rows):
    whole = shown(profile.profile_schema({"t": table_of(spark, rows)}))
    parts = [profile_state.state_of({"t": table_of(spark, rows[a:b])}) for a, b in ((0, 50), (50, 400), (400, 600))]
    a, b, c = parts
    for state in (profile_state.merged(profile_state.merged(a, b), c), profile_state.merged(a, profile_state.merged(c, b))):
        assert shown(profile_state.profile_of_state(state)) == whole


def test_days_are_replaced_added_and_chosen(spark, rows, tmp_path):
    path = str(tmp_path / "state")
    with pytest.raises(ValueError, match="no stored profile state"):
        profile_state.load_state(spark, path)
    frame = {"t": table_of(spark, rows[:200]), "u": table_of(spark, rows[:10]).select("key")}
    profile_state.add_load(spark, path, "2024-01-01", {"t": table_of(spark, rows[300:])})
    profile_state.add_load(spark, path, "2024-01-01", frame)  # loaded again
    first = {f: f.stat().st_mtime_ns for f in (tmp_path / "state" / "values" / "day=2024-01-01").glob("*.parquet")}
    profile_state.add_load(spark, path, "2024-01-02", {"t": table_of(spark, rows[200:])})
    assert first == {f: f.stat().st_mtime_ns for f in (tmp_path / "state" / "values" / "day=2024-01-01").glob("*.parquet")}
    whole = {"t": table_of(spark, rows), "u": frame["u"]}
    assert shown(profile_state.discover_of_state(profile_state.load_state(spark, path))) == shown(profile.discover(whole))
    second = profile_state.load_state(spark, path, ["2024-01-02"])
    assert shown(profile_state.profile_of_state(second)) == shown(profile.profile_schema({"t": table_of(spark, rows[200:])}))


def test_state_rows_have_fixed_width(spark, rows):
    state = profile_state.state_of({"t": table_of(spark, rows)}, kept=3)
    assert not [f.name for f in state.values.schema if f.dataType.typeName() == "string" and f.name not in infer.COLUMN_KEY]
    assert state.samples.where("column_name = 'key'").count() == 3
    assert state.values.where("h1 is null").count() == 1


def test_empty_and_all_null_columns(spark):
    empty, nulls = spark.createDataFrame([], "a string, b string"), spark.createDataFrame([(None, "")], "a string, b string")
    state = profile_state.merged(profile_state.state_of({"t": empty}), profile_state.state_of({"t": nulls}))
    assert shown(profile_state.profile_of_state(state)) == shown(profile.profile_schema({"t": nulls}))


def test_hashed_statistics_equal_those_of_texts(spark, rows):
    frame = table_of(spark, rows).withColumns({"n": F.length("key"), "d": F.lit("2024-01-01").cast("date"), "x": F.rand(1), "b": F.col("mixed").isNull(), "m": F.when(F.col("few") != "1", F.col("few").cast("decimal(9,2)"))})
    index = profile.index_statistics(profile.value_index({"t": frame}))
    got = {r["cid"]: tuple(r[1:]) for r in index.select("cid", "row_count", "null_count", "blank_count", "cardinality").collect()}
    stats = profile.column_statistics({"t": frame}).select("cid", "row_count", "null_count", "blank_count", "cardinality").collect()
    assert {r["cid"]: tuple(r[1:]) for r in stats} == got
