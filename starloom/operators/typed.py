"""Typed tables from text tables, snapshots, and row-count reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, functions as F, types as T

from starloom.functions.values import (
    accounting_to_decimal,
    to_date_best_effort,
    to_datetime_best_effort,
    to_double,
    to_flag,
    to_long_strict,
)

SURE = 0.8  # score above which money is stored with 15 digits

# Inferred type -> storage type; numeric is decided by score.
STORAGE_TYPES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "date": T.DateType(),
    "datetime": T.TimestampType(),
    "int": T.LongType(),
    "float": T.DoubleType(),
    "boolean": T.IntegerType(),
    "int64": T.LongType(),
    "float64": T.DoubleType(),
    "decimal": T.DecimalType(15, 2),
}


def storage_type(inferred: str, score: float) -> T.DataType:
    """Storage type of an inferred type; unknown types are text."""
    if inferred == "numeric":
        return T.DecimalType(15 if score > SURE else 10, 2)
    return STORAGE_TYPES.get(inferred.lower(), T.StringType())


def storage_type_column(inferred: Column, score: Column) -> Column:
    """The same decision as an expression over a profile, as a type name."""
    name = (
        F.when(inferred == "numeric", F.when(score > SURE, "Decimal(15, 2)").otherwise("Decimal(10, 2)"))
    )
    # Storage type names.
    for kind, shown in {"date": "Date", "datetime": "DateTime", "int": "Int64", "float": "Float64",
                        "boolean": "UInt8", "int64": "Int64", "float64": "Float64",
                        "decimal": "Decimal(15, 2)"}.items():
        name = name.when(F.lower(inferred) == kind, shown)
    return name.otherwise("String")


def typed_column(text: Column, inferred: str, score: float, pattern: str | None = None, digits: int = 0) -> Column:
    """Conversion of one text column by its inferred type; unreadable text becomes NULL.

    Money is wide enough for ``digits`` digits before the point (13 at least) whatever the score, and brackets always
    mean a negative amount; ``score`` decides the type label only.
    """
    kind = inferred.lower()
    if kind == "date":
        return to_date_best_effort(text, pattern)
    if kind == "datetime":
        return to_datetime_best_effort(text, pattern)
    if kind in ("int", "int64"):
        return to_long_strict(text)
    if kind in ("float", "float64"):
        return to_double(text)
    if kind in ("numeric", "decimal"):
        return accounting_to_decimal(text, min(max(15, digits + 2), 38))
    if kind == "boolean":
        return to_flag(text)
    return F.trim(text)


SPEC = ["original_column_name", "new_column_name", "inferred_type", "pattern", "data_quality_score", "integer_digits",
        "position"]


def column_specs(profile: DataFrame, table: str) -> list[Row]:
    """The stored profile of one table as driver-side specs: one small row per column."""
    return (
        profile.where(F.col("original_table_name") == table)
        .select(*SPEC)
        .orderBy("position")
        .collect()
    )


def _converted(spec: Row) -> Column:
    return typed_column(
        F.col(f"`{spec['original_column_name']}`"), spec["inferred_type"], spec["data_quality_score"], spec["pattern"],
        spec["integer_digits"],
    )


def lost_values(bronze: DataFrame, specs: list[Row]) -> DataFrame:
    """(column_name, inferred_type, lost): non-blank values of each column that its conversion can't read.

    One pass and no shuffle of values; a typed table should be built from ``lossless_specs``.
    """
    typed = [s for s in specs if s["original_column_name"] != "create_date"]
    if not typed:
        return bronze.sparkSession.createDataFrame([], "column_name string, inferred_type string, lost long")
    losses = bronze.agg(
        *[
            F.count_if((F.trim(F.col(f"`{s['original_column_name']}`")) != "") & _converted(s).isNull()).alias(f"_{i}")
            for i, s in enumerate(typed)
        ]
    )
    rows = [
        F.struct(
            F.lit(s["original_column_name"]).alias("column_name"), F.lit(s["inferred_type"]).alias("inferred_type"),
            F.col(f"_{i}").alias("lost"),
        )
        for i, s in enumerate(typed)
    ]
    return losses.select(F.inline(F.array(*rows)))


def lossless_specs(bronze: DataFrame, specs: list[Row]) -> list[Row]:
    """The specs, with columns that would lose a value kept as text (one small row per column reaches the driver)."""
    lossy = {r["column_name"] for r in lost_values(bronze, specs).where(F.col("lost") > 0).collect()}
    return [
        Row(**{**s.asDict(), "inferred_type": "string"}) if s["original_column_name"] in lossy else s for s in specs
    ]


def build_stage1(bronze: DataFrame, specs: list[Row], load_date: str | None = None) -> DataFrame:
    """Typed and renamed form of a text table: one projection, no shuffle. See ``lossless_specs`` for unreadable text.

    ``create_date`` becomes a date; when the source has none it is added from ``load_date`` (or today).
    """
    columns = [
        _converted(s).alias(s["new_column_name"] or s["original_column_name"])
        for s in specs
        if s["original_column_name"] != "create_date"
    ]
    if "create_date" in bronze.columns:
        stamp = to_date_best_effort(F.col("create_date"))
    else:
        stamp = F.lit(load_date).cast("date") if load_date else F.current_date()
    return bronze.select(*columns, stamp.alias("create_date"))


def write_stage1(stage1: DataFrame, path: str, year_of: str = "create_date") -> DataFrame:
    """Partition by year, ordered by date inside each file.

    Rows are rebalanced rather than hashed by year, so one busy year is written by many tasks.
    """
    dated = stage1.withColumn("create_year", F.year(year_of))
    dated.hint("rebalance", "create_year").sortWithinPartitions("create_year", year_of).write.mode(
        "overwrite"
    ).partitionBy("create_year").parquet(path)
    return stage1.sparkSession.read.parquet(path)


def snapshot_stage2(stage1: DataFrame, path: str) -> DataFrame:
    """Full replace copy."""
    stage1.write.mode("overwrite").parquet(path)
    return stage1.sparkSession.read.parquet(path)


def rename_from_specs(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Original column names to the names of the metadata, other columns dropped."""
    return df.select(*[F.col(f"`{old}`").alias(new or old) for old, new in names.items()])


def _counted(tagged: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """(name, side, n) of all frames in one job; no column is read and only counts are shuffled."""
    keys = [
        df.select(F.lit(name).alias("name"), F.lit(side).alias("side"), F.lit(1).alias("one"))
        for name, side, df in tagged
    ]
    found = reduce(DataFrame.unionByName, keys).groupBy("name", "side").agg(F.sum("one").alias("n"))
    wanted = tagged[0][2].sparkSession.createDataFrame([(n, s) for n, s, _ in tagged], "name string, side string")
    return wanted.join(found, ["name", "side"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def count_all(tables: dict[str, DataFrame], side: str = "source") -> DataFrame:
    """Row counts (name, row_count) of several tables."""
    counts = _counted([(name, side, df) for name, df in tables.items()])
    return counts.select(F.concat("side", F.lit("_count_"), "name").alias("name"), F.col("n").alias("row_count"))


def reconcile_counts(pairs: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Source and target rows per target table, and whether they agree."""
    counts = _counted([(n, side, df) for n, both in pairs.items() for side, df in zip(("source", "target"), both)])
    counts = counts.groupBy(F.col("name").alias("target_table")).agg(
        F.sum(F.when(F.col("side") == "source", F.col("n"))).alias("source_count"),
        F.sum(F.when(F.col("side") == "target", F.col("n"))).alias("target_count"),
    )
    match = F.col("source_count") == F.col("target_count")
    return counts.withColumns(
        {"counts_match": match, "status": F.when(match, "success").otherwise("error")}
    )
