"""Jobs over small frames: profiling, overlaps, fills, versions, wide tables, streams, access."""

import random
from datetime import date, datetime

import pytest
from pyspark.sql import Observation, functions as F

from starloom.operators import access, calendar, cleanse, dictionary, infer, logs, model, ordering, profile, relate, typed, versioned
from starloom.session import scratch_path
from starloom.sources import ingest, readers, writers
from starloom.streaming.jobs import incremental_ingest, stream_versions


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(7)
    # one key holds a third of all rows
    rows = [(i, 0 if rng.random() < 0.34 else rng.randrange(1, 9), rng.choice([None, None, rng.randrange(100)])) for i in range(900)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "n int, k int, v int").repartition(7), rows


@pytest.mark.parametrize("backward", [False, True])
@pytest.mark.parametrize("keyed", [False, True])
def test_fill_matches_brute_force(events, backward, keyed):
    df, rows = events
    got = {r.n: r.v for r in ordering.carry_fill(df, ["v"], ["n"], ["k"] if keyed else None, backward).collect()}
    seen, want = {}, {}
    for n, k, v in sorted(rows, reverse=backward):
        key = k if keyed else None
        seen[key] = v if v is not None else seen.get(key)
        want[n] = seen[key]
    assert got == want


def test_global_position(events):
    df, rows = events
    got = {r.n: r.position for r in ordering.global_position(df, ["n"], ["k"]).collect()}
    count, want = {}, {}
    for n, k, _ in sorted(rows):
        count[k] = count.get(k, 0) + 1
        want[n] = count[k]
    assert got == want


def test_assign_ids_continue(events):
    df, rows = events
    got = sorted((r.n, r.id) for r in versioned.assign_ids(df, ["n"], 41).collect())
    assert [i for _, i in got] == list(range(42, 42 + len(rows)))
    assert [n for n, _ in got] == sorted(n for n, _, _ in rows)


def tables(spark):
    a = spark.createDataFrame([(i, f"n{i % 5}", float(i % 3)) for i in range(40)], "id int, name string, amount double")
    b = spark.createDataFrame([(i % 30, f"n{i % 4}", None if i % 2 else "") for i in range(100)], "a_id bigint, label string, note string")
    c = spark.createDataFrame([], "x int, y string")
    return {"a": a, "b": b, "c": c}


def test_statistics_match_brute_force(spark):
    source = tables(spark)
    got = {(r.table_name, r.column_name): r for r in profile.column_statistics(source).collect()}
    for table, df in source.items():
        rows = df.collect()
        for name in df.columns:
            column = [r[name] for r in rows]
            r = got[table, name]
            assert (r.row_count, r.null_count, r.cardinality) == (
                len(column), sum(v is None for v in column), len({v for v in column if v is not None}))
            assert r.blank_count == sum(v == "" for v in column)


def test_sketch_statistics_are_close(spark):
    source = {"t": spark.range(5000).withColumn("m", F.col("id") % 7)}
    got = {r.column_name: r for r in profile.approximate_statistics(source).collect()}
    assert got["m"].cardinality == 7 and abs(got["id"].cardinality - 5000) < 750


def test_overlaps_match_brute_force(spark):
    source = tables(spark)
    got = {(r.table1, r.column1, r.table2, r.column2): r for r in relate.join_candidates_by_overlap(source, 0.8).collect()}
    ids, a_ids = set(range(40)), set(range(30))
    r = got["a", "id", "b", "a_id"]
    assert (r.overlap_count, r.cardinality1, r.cardinality2) == (len(ids & a_ids), 40, 30)
    assert r.relationship_type == "one_to_many" and r.is_pk1 and not r.is_pk2
    assert ("a", "name", "b", "label") in got
    assert got["a", "amount", "b", "a_id"].overlap_count == 3  # 0.0 equals 0
    ignored = relate.join_candidates_by_overlap(source, 0.8, ignore=["A_ID"])
    assert {r.column2 for r in ignored.collect()} == {"label"}


def test_overlaps_over_many_columns(spark):
    """More columns than one mask holds."""
    wide = spark.range(20).select(*[(F.col("id") + i).alias(f"c{i}") for i in range(70)])
    other = spark.range(10).select((F.col("id") + 85).alias("z"))
    got = relate.join_candidates_by_overlap({"w": wide, "o": other}, 0.01).collect()
    want = {f"c{i}": len(set(range(i, i + 20)) & set(range(85, 95))) for i in range(70)}
    assert {r.column1: r.overlap_count for r in got} == {c: n for c, n in want.items() if n}


def test_inference_defaults_and_threshold(spark):
    values = {
        "day": ["2024-01-01", "2024-01-02"], "epoch": ["1732627200", "1732627201"], "money": ["10.50", "11.75"],
        "count": ["1", "2", "3"], "word": ["a", "b"],
    }
    long = spark.createDataFrame([("t", c, v) for c, vs in values.items() for v in vs], "table_name string, column_name string, value string")
    got = {r.column_name: r for r in infer.infer_types(infer.distinct_sample(long, 100)).collect()}
    assert {c: r.inferred_type for c, r in got.items()} == {
        "day": "date", "epoch": "string", "money": "numeric", "count": "string", "word": "string"}
    assert got["day"].type_confidence == pytest.approx(0.95 * 0.8) and got["day"].pattern == "YYYY-MM-DD"
    eased = {r.column_name: r.inferred_type for r in infer.infer_types(long, numeric_threshold=0.5).collect()}
    assert eased["count"] == "numeric"
    rates = spark.createDataFrame([("Unix Timestamp", 1.0)], "pattern string, success_rate double")
    assert {r.column_name: r.inferred_type for r in infer.infer_types(long, rates).collect()}["epoch"] == "date"


def test_stage1_types_and_stamp(spark):
    bronze = spark.createDataFrame(
        [("2024-03-01", " x ", "10.50", "2024-06-01 08:00:00"), ("bad", "y", "11.759", "2024-06-01 08:00:00")],
        "day string, word string, money string, create_date string")
    source = {"t": bronze.where("word != 'y'").union(bronze.where("word != 'y'"))}
    specs = typed.column_specs(profile.discover(source), "t")
    rows = typed.build_stage1(bronze, specs).collect()
    assert rows[0].day == date(2024, 3, 1) and rows[1].day is None and rows[0].word == "x"
    assert str(rows[1].money) == "11.75" and rows[0].create_date == date(2024, 6, 1)


def test_k_table_rejects_repeated_keys(spark):
    fact = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    dim = spark.createDataFrame([(1, "a"), (1, "b")], "k int, name string")
    join = model.DimensionJoin("d", dim, "k", "k")
    with pytest.raises(ValueError):
        model.k_table(fact, [join])
    assert model.k_table(fact, [join], allow_duplicates=True).count() == 4
    unique = model.k_table(fact, [model.DimensionJoin("d", dim.limit(1), "k", "k")])
    assert unique.columns == ["k", "d_k", "d_name"] and unique.count() == 3
    assert model.k_table_name("sales_fact") == "sales_k"


def test_calendar_year(spark):
    rows = calendar.calendar_range(spark, "2024-01-01", "2024-12-31").orderBy("calendar_id").collect()
    assert len(rows) == 366
    by = {r.calendar_date: r for r in rows}
    for day, r in by.items():
        assert r.calendar_year_week == day.strftime("%Y-%W") and r.calendar_week_name == f"Wk{int(day.strftime('%W'))}"
    assert by[date(2024, 11, 28)].holiday_name == "Thanksgiving" and by[date(2024, 5, 27)].holiday_name == "Memorial Day"
    assert by[date(2024, 1, 31)].working_day == by[date(2024, 1, 31)].working_days == 21
    with pytest.raises(ValueError):
        calendar.check_range("2024-02-01", "2024-01-01")
    with pytest.raises(ValueError):
        calendar.check_range("2024-2-30", "2024-03-01")


def test_calendar_own_holidays(spark):
    own = spark.createDataFrame([(date(2024, 1, 2), "Founders")], "holiday_date date, holiday_name string")
    rows = calendar.calendar_range(spark, "2024-01-01", "2024-01-03", own).orderBy("calendar_id").collect()
    assert [r.holiday_name for r in rows] == ["", "Founders", ""] and [r.working for r in rows] == [1, 0, 1]


def test_observed_holidays(spark):
    rows = calendar.calendar_range(spark, "2021-07-01", "2021-07-06").collect()
    assert {r.calendar_date.day: r.holiday_name for r in rows if r.holiday_name} == {
        4: "Independence Day", 5: "Independence Day (observed)"}


def test_versions(spark):
    base = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "x")], "k string, version bigint, t string")
    change = spark.createDataFrame([("a", "newer"), ("c", "first")], "k string, t string")
    got = {r.k: (r.version, r.t) for r in versioned.upsert(base, change, ["k"]).collect()}
    assert got == {"a": (3, "newer"), "b": (1, "x"), "c": (1, "first")}
    patch = spark.createDataFrame([("a", None), ("b", "y")], "k string, t string")
    merged = versioned.merge_partial(base.where("version = 1"), patch, ["k"])
    assert {r.k: r.t for r in merged.collect()} == {"a": "old", "b": "y"}


def test_due_items(spark):
    rows = [("never", "daily", None), ("fresh", "hourly", datetime(2024, 1, 1, 11, 30)), ("old", "hourly", datetime(2024, 1, 1, 11)),
            ("other", "yearly", datetime(2000, 1, 1)), ("month", "monthly", datetime(2023, 12, 3))]
    df = spark.createDataFrame(rows, "n string, f string, at timestamp")
    due = versioned.due_items(df, "f", "at", F.lit("2024-01-01 12:00:00").cast("timestamp"))
    assert {r.n for r in due.collect()} == {"never", "old"}


def test_filters_keep_nulls(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    kept = cleanse.filter_rows(df, [{"column": "c", "operator": "not_contains", "value": "^a"}])
    assert {r.c for r in kept.collect()} == {"b", None}
    same = cleanse.filter_rows(df, [{"column": "absent", "operator": "equals", "value": 1}])
    assert same.count() == 3
    with pytest.raises(ValueError):
        cleanse.filter_rows(df, [{"column": "c", "operator": "like", "value": "a"}])


def test_transform_counts_rows(spark):
    before, after = Observation(), Observation()
    out = cleanse.transform(spark.range(10), {"filters": [{"column": "id", "operator": "less_than", "value": 4}]}, (before, after))
    assert out.count() == 4 and before.get["rows"] == 10 and after.get["rows"] == 4


def test_flatten_depth_limit(spark):
    df = spark.createDataFrame([(((1, (2, [3, 4])),))], "a struct<b:int,c:struct<d:int,e:array<int>>>")
    flat = cleanse.flatten_nested(df)
    assert flat.columns == ["a_b", "a_c_d", "a_c_e_0", "a_c_e_1"] and tuple(flat.first()) == (1, 2, 3, 4)
    shallow = cleanse.flatten_nested(df, max_depth=0)
    assert shallow.columns == ["a_b", "a_c"] and shallow.first()["a_c"] == '{"d":2,"e":[3,4]}'


def test_csv_and_bad_files(spark, tmp_path):
    (tmp_path / "people.v1.csv").write_text('id,name,note\n1,"An, na","two\nlines"\n2,Bo\n')
    rows = readers.read_csv_strings(spark, str(tmp_path / "people.v1.csv")).collect()
    assert [tuple(r) for r in rows] == [("1", "An, na", "two\nlines"), ("2", "Bo", "")]
    results = ingest.ingest_many(spark, [str(tmp_path / "people.v1.csv"), str(tmp_path / "none.csv")], "csv", str(tmp_path / "out"), "2024-01-01 00:00:00")
    assert [(r.target_table, r.status, r.records) for r in results.collect()] == [("people", "success", 2), ("none", "error", 0)]
    assert ingest.load_summary(results, 2.0).first().records_per_second == 1.0


def test_decode_text_files(spark, tmp_path):
    (tmp_path / "u.txt").write_bytes("naïve".encode())
    (tmp_path / "w.txt").write_bytes("naïve".encode("cp1252"))
    assert {r.text for r in readers.decode_text_files(spark, str(tmp_path)).collect()} == {"naïve"}


def test_jdbc_options():
    options = readers.jdbc_table_options("jdbc:x", "t", "id", 1, 100, 8)
    assert options["numPartitions"] == "8" and options["partitionColumn"] == "id" and options["dbtable"] == "t"
    assert readers.jdbc_query_options("jdbc:x", "SELECT 1")["query"] == "SELECT 1"


def test_tables_and_export(spark, tmp_path):
    df = spark.range(3)
    spark.sql("DROP TABLE IF EXISTS starloom_t")
    writers.replace_table(df, "starloom_t")
    writers.replace_table(df, "starloom_t")
    writers.append_table(df, "starloom_t")
    assert spark.table("starloom_t").count() == 6
    spark.sql("DROP TABLE starloom_t")
    with pytest.raises(ValueError):
        writers.export_catalog(df, str(tmp_path / "x"), "xml")


def test_incremental_ingest_takes_new_files_only(spark, tmp_path):
    source, target, progress = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "p")
    for part in (0, 10):
        spark.range(part, part + 5).coalesce(1).write.mode("append").parquet(source)
        incremental_ingest(spark, source, spark.range(1).schema, target, progress, "s").awaitTermination()
    assert sorted(int(r.id) for r in spark.read.parquet(target).collect()) == [0, 1, 2, 3, 4, 10, 11, 12, 13, 14]


def test_stream_versions_count_up(spark, tmp_path):
    source, target, progress = str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "p")
    for text in ("one", "two"):
        spark.createDataFrame([("a", text)], "k string, t string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("k string, t string").parquet(source)
        stream_versions(stream, ["k"], target, progress).awaitTermination()
    assert sorted((r.version, r.t) for r in spark.read.parquet(target).collect()) == [(1, "one"), (2, "two")]


def test_routed_log_columns(spark):
    base = {c: "" for c in logs.BASE_COLUMNS} | {"phase": "Transform"}
    routed = logs.route_logs(spark.createDataFrame([base | {"transformation_id": 5}, base | {"phase": "?", "transformation_id": 6}]))
    table = logs.log_table(routed, "transform")
    assert table.columns[14:] == ["transformation_id", "transformation_stage", "schema_name", "table_name"]
    assert table.first().transformation_id == 5 and logs.log_table(routed, "application").count() == 1


@pytest.fixture
def gold_views(spark):
    spark.range(5).withColumn("text", F.lit("drop")).createOrReplaceTempView("sales_fact")
    spark.range(5).createOrReplaceTempView("secret_stage1")
    return {"sales_fact"}


@pytest.mark.parametrize(
    "sql",
    ["DROP VIEW sales_fact", "INSERT INTO sales_fact SELECT 1", "CREATE TABLE x AS SELECT 1", "SELECT * FROM secret_stage1",
     "SELECT * FROM sales_fact WHERE id IN (SELECT id FROM secret_stage1)", "WITH c AS (SELECT * FROM secret_stage1) SELECT * FROM c",
     "SET spark.sql.ansi.enabled=false", "SELECT * FROM range(5)", "SELECT * FROM parquet.`/root/testdata/sf0.001/region.parquet`",
     "SELECT reflect('java.lang.System', 'getProperty', 'user.dir') FROM sales_fact",
     "SELECT id FROM sales_fact WHERE upper(java_method('java.lang.System', 'lineSeparator')) = 'x'",
     "WITH c AS (SELECT try_reflect('java.lang.System', 'lineSeparator') AS t FROM sales_fact) SELECT * FROM c",
     "SELECT id FROM sales_fact WHERE id IN (SELECT length(reflect('java.lang.System', 'lineSeparator')) FROM sales_fact)",
     "SELECT CASE WHEN id > 1 THEN current_user() END FROM sales_fact ORDER BY input_file_name()",
     "SELECT sum(id) FROM sales_fact GROUP BY text HAVING max(length(java_method('java.lang.System', 'lineSeparator'))) > 0"],
)
def test_access_refuses(spark, gold_views, sql):
    with pytest.raises(access.QueryRejected):
        access.gold_query(spark, sql, gold_views)


def test_access_allows(spark, gold_views):
    sql = "WITH c AS (SELECT *, 'delete from x' AS note FROM sales_fact) SELECT * FROM c LIMIT 3"
    assert access.gold_query(spark, sql, gold_views, limit=100).count() == 3
    assert access.gold_query(spark, "SELECT * FROM sales_fact", gold_views, limit=2).count() == 2


def test_definitions(spark):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("sales_amount", T.DecimalType(15, 2)), T.StructField("region_key", T.LongType())])
    seeded = dictionary.seed_definitions(spark, {"gold": {"sales_fact": schema}})
    assert {r.column_precision for r in seeded.collect()} == {"15, 2", ""}
    made = {r.column_name: r for r in dictionary.generate_missing(seeded).collect()}
    assert made["sales_amount"].column_description == "Monetary measure. Fact measure representing sales/amount data."
    assert made["region_key"].column_description == "Foreign key to region dimension. Unique identifier."
    assert made["region_key"].version == 2


def test_stored_frames_go_to_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(spark.sparkContext.getCheckpointDir())
