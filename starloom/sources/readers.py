"""Readers that land every source as text columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from starloom.functions.text import clean_text, file_target_name, windows_1252
from starloom.sources.quoted import read_quoted_csv


def string_columns(df: DataFrame, null_as_empty: bool = True, clean: bool = True) -> DataFrame:
    """Every column as text; NULL becomes '' unless asked otherwise; text is cleaned.

    Numbers, dates and flags render as plain ASCII, so only other types pay for the cleaning.
    """
    plain = (T.NumericType, T.DatetimeType, T.BooleanType)

    def landed(field: T.StructField) -> Column:
        text = F.col(f"`{field.name}`").cast("string")
        if null_as_empty:
            text = F.coalesce(text, F.lit(""))
        return (clean_text(text) if clean and not isinstance(field.dataType, plain) else text).alias(field.name)

    return df.select(*[landed(field) for field in df.schema])


def read_csv_strings(spark: SparkSession, paths: str | list[str], multiline: bool = True, whole_files: bool = False) -> DataFrame:
    """CSV with a header row; missing trailing fields become ''.

    With ``multiline`` quoted line breaks are kept; large files are split over many tasks all the same, by the parity of the
    quotes before a line. ``whole_files`` reads files whose quotes don't follow RFC 4180, one task a file. The caller who knows that a
    layout has no quoted line breaks passes ``multiline=False`` and saves a scan.
    """
    if multiline and not whole_files:
        raw = read_quoted_csv(spark, paths).drop("_file")
    else:
        raw = spark.read.option("header", True).option("multiLine", multiline).option("escape", '"').option("inferSchema", False).csv(paths)
    return raw.select(*[F.coalesce(F.col(f"`{name}`"), F.lit("")).alias(name) for name in raw.columns])


def read_parquet_strings(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    paths = [paths] if isinstance(paths, str) else paths
    return string_columns(spark.read.parquet(*paths), clean=False)


def decode_bytes(content: Column, windows: bool = True) -> Column:
    """UTF-8 when the bytes are valid UTF-8, otherwise a one-byte Western encoding (never fails)."""
    utf8 = F.try_validate_utf8(content.cast("string"))
    western = F.decode(content, "ISO-8859-1")
    return F.coalesce(utf8, windows_1252(western) if windows else western)


def decode_text_files(spark: SparkSession, paths: str | list[str], windows: bool = True) -> DataFrame:
    """Whole files as text, one row per file (2 GB at most); ``quoted.decoded_lines`` reads files of any size by lines."""
    raw = spark.read.format("binaryFile").load(paths)
    return raw.select(F.col("path"), F.col("length"), decode_bytes(F.col("content"), windows).alias("text"))


def jdbc_table_options(url: str, table: str, column: str, lower: int, upper: int, parts: int) -> dict[str, str]:
    """Options of a range-split table read: ``parts`` disjoint key ranges, read side by side."""
    return {
        "url": url,
        "dbtable": table,
        "partitionColumn": column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(parts),
        "fetchsize": "10000",
    }


def read_jdbc_table(
    spark: SparkSession, url: str, table: str, column: str, parts: int = 64, **extra: str
) -> DataFrame:
    """Whole table over JDBC, split on a numeric column whose bounds one small query finds."""
    bounds = read_jdbc_query(
        spark, url, f"SELECT min({column}) AS low, max({column}) AS high FROM {table}", **extra
    ).first()
    low, high = (bounds[0] or 0, bounds[1] or 0) if bounds else (0, 0)
    options = jdbc_table_options(url, table, column, int(low), int(high) + 1, parts)
    return spark.read.format("jdbc").options(**options, **extra).load()


def jdbc_query_options(url: str, sql: str) -> dict[str, str]:
    return {"url": url, "query": sql, "fetchsize": "10000"}


def read_jdbc_query(spark: SparkSession, url: str, sql: str, **extra: str) -> DataFrame:
    """A SELECT that the source database runs itself."""
    return spark.read.format("jdbc").options(**jdbc_query_options(url, sql), **extra).load()


def json_records_to_rows(df: DataFrame, text: str, record: str = "record") -> DataFrame:
    """JSON documents to records: an object gives one row, an array one row per item.

    Items that are not objects are wrapped as ``{"value": "<text>"}``. Text that is not JSON gives no row.
    """
    spark = df.sparkSession
    document = F.try_parse_json(F.col(text))
    alone = F.try_parse_json(F.concat(F.lit("["), F.col(text), F.lit("]")))  # a list of the one value
    is_list = F.schema_of_variant(document).startswith("ARRAY")
    is_single = F.try_variant_get(alone, "$[1]", "variant").isNull()
    listed = df.withColumn("_items", F.when(is_list, document).when(document.isNotNull() & is_single, alone))
    rows = listed.lateralJoin(
        spark.tvf.variant_explode(F.col("_items").outer()).select(F.col("value").alias("_item"))
    )
    is_object = F.schema_of_variant(F.col("_item")).startswith("OBJECT")
    wrapped = F.to_json(F.struct(F.variant_get(F.col("_item"), "$", "string").alias("value")))
    return rows.withColumn(record, F.when(is_object, F.to_json(F.col("_item"))).otherwise(wrapped)).drop(
        "_items", "_item"
    )


def read_batch(spark: SparkSession, paths: list[str], fmt: str = "parquet", multiline: bool = True) -> DataFrame:
    """Many files of one layout in a single read, each row tagged with its file and target table.

    ``multiline`` as in ``read_csv_strings``.
    """
    reader = spark.read
    if fmt == "csv" and multiline:
        name = F.element_at(F.split("_file", "/"), -1)
        tagged = read_quoted_csv(spark, paths).withColumns({"source_file": name, "target_table": file_target_name(name)})
        return tagged.drop("_file")
    if fmt == "csv":
        reader = reader.option("header", True).option("mode", "PERMISSIVE").option("escape", '"')
    raw = reader.format(fmt).load(paths)
    return raw.withColumns(
        {
            "source_file": F.col("_metadata.file_name"),
            "target_table": file_target_name(F.col("_metadata.file_name")),
        }
    )


def merge_parts(parts: list[DataFrame]) -> DataFrame:
    """All part tables as one, matched by column name."""
    return reduce(DataFrame.unionByName, parts)
