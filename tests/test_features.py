"""Features of values and the simple families against their patterns, and plans that do the work once."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from starloom.functions.values import DATE_PATTERNS, NUMERIC_PATTERNS, loose_number, matches_date_pattern, numeric_pattern, valid_for_pattern
from starloom.operators import cleanse, infer

TEXTS = [
    "0", "007", "12.5", "-3", "-3.25", "+4", ".5", "5.", "1,234.50", "$12", "$1,000", "12%", "1e5", "1.5E-3", "-", "$", "1.2.3", "", " ", None,
    "19980101", "99999999", "19981399", "1998-01-01", "1998-13-01", "0000-01-01", "1/2/1998", "12/31/1998", "31/12/1998", "1-2-1998", "31-12-1998",
    "1234567890", "9999999999", "12345678.9", "1234.56789", "1998-01-01T10:20:30", "1998-01-01T10:20:30Z", "1998-01-01 10:20:30", "12/31/1998 10:20:30",
    "1998-01-01T99:20:30 and more", " 42 ", " 17\u3000", "yes", "NO", "t", "True", "a@b.co", "A.b@C.org", "http://a.b", "HTTPS://x.y/z", "h", "name 12", "Ünï 3",
]


def test_value_features_follow_the_patterns(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "k int, value string")
    t = F.col("t")
    bare = rows.select("k", F.regexp_replace(F.when(F.col("value") != "", F.col("value")), r"^[\s\x{A0}\x{3000}]+|[\s\x{A0}\x{3000}]+$", "").alias("t"))
    bits = F.lit(0)
    for i, p in enumerate(DATE_PATTERNS):
        bits = bits + F.when(matches_date_pattern(t, p), F.when(valid_for_pattern(t, p), 3 << (2 * i)).otherwise(1 << (2 * i))).otherwise(0)
    shape = F.coalesce(F.array_position(F.array(*map(F.lit, NUMERIC_PATTERNS)), numeric_pattern(t)), F.lit(0))
    digits = F.length(F.regexp_replace(F.substring_index(t, ".", 1), "[^0-9]", ""))
    wanted = bare.select("k", *[F.when(t.isNotNull(), c) for c in (bits, shape, F.length(t), loose_number(t), digits)])
    found = infer.value_features(rows, ["k"]).select("k", *infer.FEATURES)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))


def test_simple_families_follow_the_patterns(spark):
    rows = spark.createDataFrame([("t", str(i), t) for i, t in enumerate(TEXTS)], "table_name string, column_name string, value string")
    found = {int(r["column_name"]): r["inferred_type"] for r in infer.infer_types_simple(rows).collect()}
    for i, t in enumerate(TEXTS):
        if t and t.strip():
            families = (f for f, p in infer.SIMPLE_FAMILIES.items() if re.search(p, t.strip(), re.I | re.A))
            assert found[i] == next(families, "string"), t
        else:
            assert i not in found


def test_casts_of_whole_numbers_are_tried_on_whole_numbers_only(spark, monkeypatch):
    plans = []
    kept = type(spark.range(1)).first
    monkeypatch.setattr(type(spark.range(1)), "first", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), kept(df))[1])
    out = cleanse.normalize_columns(spark.createDataFrame([("A", "1", "1.5"), ("B", "2", "x")], "a string, b string, c string"))
    assert out.dtypes == [("a", "string"), ("b", "bigint"), ("c", "string")]
    assert len(plans) == 1 and "AND isnotnull(try_cast(a#" in plans[0].replace("cast(", "try_cast(").replace("try_try_", "try_")


def test_exported_catalog_is_computed_once(spark, monkeypatch, tmp_path):
    from checks import ingest_checks

    tables = {"t": spark.createDataFrame([(1, "a"), (2, "b"), (2, None)], "k long, v string")}
    monkeypatch.setattr(ingest_checks, "star", lambda spark, sf_dir: tables)
    plans, kept = [], ingest_checks.writers.export_catalog
    monkeypatch.setattr(ingest_checks.writers, "export_catalog", lambda df, *a: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), kept(df, *a))[1])
    found = sorted(map(tuple, ingest_checks.a19(spark, str(tmp_path)).collect()))
    assert found == [("csv", "t", "k", 2), ("csv", "t", "v", 2), ("json", "t", "k", 2), ("json", "t", "v", 2)]
    assert len(plans) == 2 and not any("Aggregate" in plan for plan in plans)
