"""Small files of partition folders packed into bins."""

from pyspark.sql import functions as F

from starloom.sources import writers


def files_of(folder):
    return {f.name: f.stat().st_mtime_ns for f in folder.glob("*.parquet")}


def test_small_files_are_packed_and_good_folders_left_alone(spark, tmp_path):
    path = tmp_path / "table"
    rows = spark.range(4000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v"))
    rows.where("id < 3000").repartition(12).write.parquet(f"{path}/day=1")
    rows.where("id >= 3000").coalesce(1).write.parquet(f"{path}/day=2")
    rows.where("id < 10").coalesce(1).write.parquet(f"{path}/day=3")
    large = max(f.stat().st_size for f in (path / "day=2").glob("*.parquet"))
    target = large + large // 10  # day 2 holds one file of about that size, day 3 a single small one
    before = {d: files_of(path / d) for d in ("day=2", "day=3")}
    want = sorted(map(tuple, spark.read.parquet(str(path)).collect()))
    plan = writers.packing_plan(spark, str(path), target)
    assert plan.groupBy("folder", "bin").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= target * 7 // 4
    report = writers.pack_small_files(spark, str(path), target).collect()
    assert [(r["folder"].rsplit("/", 1)[-1], r["files_before"]) for r in report] == [("day=1", 12)]
    assert report[0]["files_after"] == len(files_of(path / "day=1")) < 6
    assert before == {d: files_of(path / d) for d in ("day=2", "day=3")}
    assert sorted(map(tuple, spark.read.parquet(str(path)).collect())) == want
    assert sorted(p.name for p in path.iterdir()) == ["day=1", "day=2", "day=3"]


def test_nothing_to_pack(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(f"{tmp_path}/t")
    before = files_of(tmp_path / "t")
    assert writers.pack_small_files(spark, f"{tmp_path}/t").count() == 0
    assert files_of(tmp_path / "t") == before


def test_files_of_different_columns(spark, tmp_path):
    spark.range(3).select("id").coalesce(1).write.parquet(f"{tmp_path}/t")
    spark.range(3, 5).select("id", F.lit("x").alias("more")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/t")
    writers.pack_small_files(spark, f"{tmp_path}/t")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/t").collect())) == [(0, None), (1, None), (2, None), (3, "x"), (4, "x")]
