"""Sinks: replace, append, compact, export."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from starloom.session import cut_lineage, delete_folder

TARGET_BYTES = 128 << 20


def replace_table(df: DataFrame, name: str, partition_by: list[str] | None = None) -> None:
    """Drop, create and fill a catalog table."""
    writer = df.write.mode("overwrite").format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(name)


def append_table(df: DataFrame, name: str) -> None:
    """Append to a catalog table, creating it when missing."""
    df.write.mode("append").format("parquet").saveAsTable(name)


def replace_path(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a Parquet folder and return it as a frame."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def append_path(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.parquet(path)


def compact(spark: SparkSession, source: str, target: str, files: int, keys: list[str] | None = None,
            version: str | None = None) -> DataFrame:
    """Rewrite a Parquet folder into ``files`` parts; with keys, keep the latest version of each.

    The result goes to a new folder, so readers of the old one are not disturbed; callers swap names.
    """
    from starloom.operators.versioned import latest_by_key

    rows = spark.read.parquet(source)
    if keys:
        rows = latest_by_key(rows, keys, version)
    rows.repartition(files).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def packing_plan(spark: SparkSession, path: str, target: int = TARGET_BYTES) -> DataFrame:
    """(folder, file, length, bin) of the small files of a Parquet folder and its partition folders that are worth packing.

    Files under three quarters of ``target`` are small. Those of one folder go, in order of size, into bins of about ``target`` bytes;
    a bin of one file would change nothing and is left out. Sizes come from the file listing, no file is opened.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    files = listed.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.col("path").alias("file"), "length")
    own = Window.partitionBy("folder").orderBy("length", "file").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("length").over(own), F.lit(0))
    small = files.where(F.col("length") * 4 < target * 3).withColumn("bin", F.floor(before / target))
    members = Window.partitionBy("folder", "bin")
    return small.withColumn("_n", F.count(F.lit(1)).over(members)).where("_n > 1").drop("_n")


def pack_small_files(spark: SparkSession, path: str, target: int = TARGET_BYTES) -> DataFrame:
    """Pack the small files of each partition folder into files of about ``target`` bytes; report (folder, files_before, files_after).

    Folders in good shape are neither read nor written and not in the report. All bins are written by one job, to a hidden folder; then the
    new files move into their folders and the old ones go, one folder after the other. A run that breaks off before that
    changes nothing; within a folder the old files go before the new ones show, so no reader counts a row twice, and a run that breaks
    off between the two leaves the folder's rows in the hidden folder.
    """
    plan = cut_lineage(packing_plan(spark, path, target))
    folders = [r["folder"] for r in plan.select("folder").distinct().collect()]
    schema = "folder string, files_before long, files_after long"
    if not folders:
        return spark.createDataFrame([], schema)
    files = [r["file"] for r in plan.select("file").collect()]  # names of small files only; their rows stay on the executors
    staged = f"{path.rstrip('/')}/_packed-{uuid.uuid4().hex}"
    number = {folder: k for k, folder in enumerate(sorted(folders))}
    numbers = spark.createDataFrame(list(number.items()), "folder string, _folder int")
    places = plan.join(numbers, "folder").select(F.col("file").alias("_file"), "_folder", F.col("bin").alias("_bin"))
    rows = spark.read.option("mergeSchema", "true").parquet(*files)
    columns = rows.columns
    marked = rows.withColumn("_file", F.col("_metadata.file_path")).join(F.broadcast(places), "_file")  # one row a file
    marked.select(*columns, "_folder", "_bin").repartition("_folder", "_bin").write.partitionBy("_folder", "_bin").parquet(staged)

    report = []
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    system = jvm_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    old = {r["folder"]: r["files"] for r in plan.groupBy("folder").agg(F.collect_list("file").alias("files")).collect()}
    for folder, k in number.items():
        made = [f.getPath() for b in system.listStatus(jvm_path(f"{staged}/_folder={k}")) for f in system.listStatus(b.getPath()) if f.getPath().getName().endswith(".parquet")]
        for file in old[folder]:
            system.delete(jvm_path(file), False)
        for n, file in enumerate(made):
            system.rename(file, jvm_path(f"{folder}/packed-{uuid.uuid4().hex}-{n}.parquet"))
        report.append((folder, len(old[folder]), len(made)))
    delete_folder(spark, staged)
    return spark.createDataFrame(report, schema)


def export_catalog(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Write a profile catalog as JSON lines or CSV (arrays joined by ``|``)."""
    if fmt == "json":
        df.write.mode("overwrite").json(path)
    elif fmt == "csv":
        flat = [
            F.array_join(F.col(f"`{name}`").cast("array<string>"), "|").alias(name)
            if kind.startswith("array")
            else F.col(f"`{name}`")
            for name, kind in df.dtypes
        ]
        df.select(*flat).write.mode("overwrite").option("header", True).csv(path)
    else:
        raise ValueError(f"unknown export format: {fmt}")
