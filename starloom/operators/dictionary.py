"""Data dictionary: one definition per column, with rule-based descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from starloom.functions.names import storage_type_name
from starloom.operators.versioned import latest_by_key, lookup

KEYS = ["schema_name", "table_name", "column_name"]


def type_precision(type_name: Column) -> Column:
    """Text inside the first brackets of a type; '' without brackets."""
    return F.regexp_extract(type_name, r"\(([^)]*)\)", 1)


def seed_definitions(spark: SparkSession, schemas: dict[str, dict[str, T.StructType]]) -> DataFrame:
    """One row with a blank description per column of every table of every schema."""
    rows = [
        (schema, table, field.name, position, storage_type_name(field.dataType))
        for schema, tables in schemas.items()
        for table, fields in tables.items()
        for position, field in enumerate(fields, 1)
    ]
    frame = spark.createDataFrame(
        rows, "schema_name string, table_name string, column_name string, position int, column_type string"
    )
    return frame.withColumns(
        {
            "column_precision": type_precision(F.col("column_type")),
            "column_description": F.lit(""),
            "version": F.lit(1).cast("bigint"),
        }
    )


def seed_counts(definitions: DataFrame) -> DataFrame:
    return definitions.groupBy("schema_name").agg(
        F.count_distinct("table_name").alias("tables"), F.count(F.lit(1)).alias("columns")
    )


def _has(text: Column, *words: str) -> Column:
    return F.lower(text).rlike("|".join(words))


def describe_columns(df: DataFrame) -> Column:
    """Description of a column from its table, name and type.

    ``df`` needs table_name, column_name, column_type; optional: table_type and the arrays
    primary_key_candidates, fact_columns, dimension_columns of the ERD.
    """
    table, column, kind = F.col("table_name"), F.col("column_name"), F.col("column_type")
    no = F.lit(False)

    def listed(name: str) -> Column:
        return F.coalesce(F.array_contains(F.col(name), column), no) if name in df.columns else no

    role = F.lower(F.col("table_type")) if "table_type" in df.columns else F.lit(None).cast("string")
    in_fact = F.coalesce(role == "fact", no) | table.endswith("_fact") | table.endswith("_k")
    in_dim = F.coalesce(role == "dimension", no) | table.endswith("_dim")
    calendar = _has(table, "calendar")
    geography = _has(table, "geography", "region")
    product = _has(table, "product")
    key, monetary, dated = listed("primary_key_candidates"), _has(column, "amount", "sales", "revenue"), _has(column, "date", "time")
    target = F.replace(F.replace(column, F.lit("_key"), F.lit("")), F.lit("_id"), F.lit(""))

    # Description sentences, in order.
    parts = F.array_compact(F.array(
        F.when(key, "Primary key candidate"),
        F.when(listed("fact_columns"), "Fact measure").when(listed("dimension_columns"), "Dimension attribute"),
        F.when(in_fact & (column.endswith("_key") | column.endswith("_id")),
               F.concat(F.lit("Foreign key to "), target, F.lit(" dimension"))),
        F.when(monetary, "Monetary measure"),
        F.when(monetary & in_fact, "Fact measure representing sales/amount data"),
        F.when(dated & (in_dim | calendar), "Date attribute for time dimension").when(dated, "Date/timestamp field"),
        F.when(_has(column, "name"), "Descriptive name attribute"),
        F.when(_has(column, "id", "key") & ~key, "Unique identifier"),
    ))

    def more(so_far: Column, condition: Column, text: str) -> Column:
        return F.when(condition, F.array_append(so_far, F.lit(text))).otherwise(so_far)

    parts = more(
        parts,
        kind.rlike("Decimal|Float") & ~F.exists(parts, lambda p: p.contains("Monetary") | F.lower(p).contains("measure")),
        "Numeric measure",
    )
    parts = more(parts, kind.contains("String") & (F.size(parts) == 0), "Text attribute")
    parts = more(
        parts, kind.contains("Date") & ~F.exists(parts, lambda p: F.lower(p).rlike("date|time")), "Date/timestamp value"
    )

    def first_hit(words: dict[str, str]) -> Column:
        found = F.lit(None).cast("string")
        for word, text in reversed(words.items()):
            found = F.when(_has(column, word), F.lit(text)).otherwise(found)
        return found

    stem = F.substring_index(table, "_", 1)
    last = F.array_compact(F.array(
        F.when(calendar, first_hit({
            "year": "Calendar year", "quarter": "Calendar quarter", "month": "Calendar month",
            "week": "Calendar week", "day": "Calendar day",
        })),
        F.when(geography, first_hit({
            "region": "Geographic region", "state": "State/province", "city": "City/location", "country": "Country",
        })),
        F.when(product, first_hit({"product": "Product identifier or name", "category": "Product category"})),
        F.when(table.endswith("_k") & column.contains("_") & ~column.startswith(stem),
               "Denormalized dimension attribute from K-Table"),
    ))
    text = F.concat_ws(". ", F.concat(parts, last))
    return F.when(text == "", F.concat(kind, F.lit(" column in "), table, F.lit(" table."))).otherwise(
        F.when(text.endswith("."), text).otherwise(F.concat(text, F.lit(".")))
    )


def generate_missing(definitions: DataFrame, erd: DataFrame | None = None,
                     model: DataFrame | None = None) -> DataFrame:
    """New versions, with a description, of the current rows that have none.

    ``erd`` (table_name, table_type, arrays) and ``model`` (table_name, table_type) have one row per
    table; the ERD's table type wins.
    """
    blank = latest_by_key(definitions, KEYS, "version").where(
        F.trim(F.coalesce("column_description", F.lit(""))) == ""
    )
    context = blank
    if erd is not None:
        context = context.join(
            erd.select("table_name", "table_type", "primary_key_candidates", "fact_columns", "dimension_columns"),
            "table_name", "left",
        )
    if model is not None:
        other = model.select("table_name", F.col("table_type").alias("_model_type"))
        context = context.join(other, "table_name", "left")
        known = F.coalesce("table_type", "_model_type") if erd is not None else F.col("_model_type")
        context = context.withColumn("table_type", known)
    described = context.withColumn("column_description", describe_columns(context))
    return described.withColumn("version", F.col("version") + 1).select(*definitions.columns)


def generated_counts(generated: DataFrame) -> DataFrame:
    return generated.groupBy("table_name").agg(F.count(F.lit(1)).alias("descriptions"))


def update_description(definitions: DataFrame, changes: DataFrame) -> DataFrame:
    """Append versions with a new text. ``changes``: the key columns and column_description."""
    new_text = changes.select(*KEYS, F.col("column_description").alias("_text"))
    changed = latest_by_key(definitions, KEYS, "version").join(new_text, KEYS).withColumns(
        {"column_description": F.col("_text"), "version": F.col("version") + 1}
    )
    return definitions.unionByName(changed.drop("_text"))


def get_definitions(definitions: DataFrame, schema: str | None = None, table: str | None = None,
                    limit: int | None = None) -> DataFrame:
    current = latest_by_key(definitions, KEYS, "version")
    return lookup(current, {"schema_name": schema, "table_name": table}, KEYS, limit)
