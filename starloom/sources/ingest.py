"""Landing jobs: load stamps, schema checks, multi-file loads and their summary."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from starloom.functions.names import storage_type_name
from starloom.functions.text import file_target_name
from starloom.sources.readers import read_csv_strings, read_parquet_strings, string_columns


def stamp_load(df: DataFrame, stamp: str) -> DataFrame:
    """One load stamp (``yyyy-MM-dd HH:mm:ss`` text) for every row of the load."""
    return df.withColumn("create_date", F.lit(stamp))


def land(df: DataFrame, stamp: str, null_as_empty: bool = True) -> DataFrame:
    """Bronze form of a source: clean text columns plus the load stamp, in one projection."""
    return stamp_load(string_columns(df, null_as_empty), stamp)


def add_load_metadata(df: DataFrame, source_id: str, batch_id: str, loaded_at: Column | None = None) -> DataFrame:
    return df.withColumns(
        {
            "_loaded_at": F.current_timestamp() if loaded_at is None else loaded_at,
            "_source_id": F.lit(source_id),
            "_batch_id": F.lit(batch_id),
        }
    )


def nan_to_null(df: DataFrame) -> DataFrame:
    fractional = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in fractional}) if fractional else df


def schema_frame(spark: SparkSession, schema: T.StructType | dict[str, str]) -> DataFrame:
    """A schema as rows (column_name, type_name)."""
    if isinstance(schema, T.StructType):
        pairs = [(f.name, storage_type_name(f.dataType)) for f in schema]
    else:
        pairs = list(schema.items())
    return spark.createDataFrame(pairs, "column_name string, type_name string")


def schema_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Findings per column: missing (error), type mismatch (warning); unexpected columns are no finding."""
    want = expected.select("column_name", F.col("type_name").alias("expected_type"))
    have = actual.select("column_name", F.col("type_name").alias("actual_type"))
    joined = want.join(have, "column_name", "full_outer").where(F.col("expected_type").isNotNull())
    missing = F.col("actual_type").isNull()
    differs = F.col("actual_type") != F.col("expected_type")
    return joined.where(missing | differs).select(
        "column_name",
        "expected_type",
        "actual_type",
        F.when(missing, "missing_column").otherwise("type_mismatch").alias("finding"),
        F.when(missing, "error").otherwise("warning").alias("severity"),
    )


RESULT_SCHEMA = "path string, target_table string, status string, records bigint, message string"


def unique_targets(paths: list[str]) -> list[str]:
    """Target names of files: the base name, numbered where an earlier file has it already."""
    taken: set[str] = set()
    targets = []
    for path in paths:
        base = path.rstrip("/").rsplit("/", 1)[-1].split(".", 1)[0]
        target, number = base, 1
        while target in taken:
            number += 1
            target = f"{base}_{number}"
        taken.add(target)
        targets.append(target)
    return targets


def ingest_many(spark: SparkSession, paths: list[str], fmt: str, out: str, stamp: str,
                parallel: int = 8) -> DataFrame:
    """Load each file to its own target folder under ``out``; a bad file gives an error row.

    Each file is one distributed read and write, several of them at a time; row counts come from an
    observation on the write, so nothing is read twice. The result has one row per requested file. Files of
    one base name get targets of their own (``sales``, ``sales_2``, ... in the order of the request).
    """
    readers = {"csv": read_csv_strings, "parquet": read_parquet_strings}

    def load(path: str, target: str) -> tuple[str, str, str, int, str | None]:
        try:
            seen = Observation()
            rows = land(readers[fmt](spark, path), stamp).observe(seen, F.count(F.lit(1)).alias("records"))
            rows.write.mode("overwrite").parquet(f"{out}/{target}")
            return (path, target, "success", seen.get["records"], None)
        except Exception as problem:  # the request goes on with the other files
            return (path, target, "error", 0, str(problem).split("\n", 1)[0])

    with ThreadPoolExecutor(parallel) as pool:
        results = list(pool.map(load, paths, unique_targets(paths)))
    return spark.createDataFrame(results, RESULT_SCHEMA)


def file_counts(batch: DataFrame) -> DataFrame:
    """Rows per file of a batch read."""
    return batch.groupBy("source_file", "target_table").agg(F.count(F.lit(1)).alias("records"))


def load_summary(results: DataFrame, seconds: float | None = None) -> DataFrame:
    """Totals over per-part results with columns ``status`` and ``records``."""
    ok = F.col("status") == "success"
    summary = results.agg(
        F.coalesce(F.sum(F.when(ok, F.col("records"))), F.lit(0)).alias("total_records"),
        F.count(F.lit(1)).alias("total_parts"),
        F.count_if(ok).alias("successful_parts"),
        F.count_if(F.col("status") == "error").alias("failed_parts"),
    )
    if seconds is None:
        return summary
    return summary.withColumn(
        "records_per_second", F.coalesce(F.try_divide(F.col("total_records"), F.lit(float(seconds))), F.lit(0.0))
    )


def target_of_rows(df: DataFrame) -> DataFrame:
    """Tag rows of a file read with their target table."""
    return df.withColumn("target_table", file_target_name(F.col("_metadata.file_name")))
