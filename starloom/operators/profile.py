"""Column and table profiling: one value index feeds every statistic of every column.

``value_index`` unpivots all tables to (column id, value) and counts equal values, with a partial count
before the only large shuffle. A value that fills a third of a column collapses to one row per task
there. All later frames have one row per column or a bounded number of sample rows per column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from starloom.functions.names import (
    UNIQUE_KEY_HINTS,
    UNIQUE_KEY_TYPES,
    contains_any,
    is_identifier_name,
    is_measure_name,
    storage_type_name,
)
from starloom.functions.text import safe_ratio
from starloom.operators.infer import COLUMN_KEY, infer_types

Tables = dict[str, DataFrame]


def _active(tables: Tables) -> SparkSession:
    return next(iter(tables.values())).sparkSession


def column_catalog(tables: Tables, skip: tuple[str, ...] = ()) -> DataFrame:
    """One row per column: id, table, name, position (from 1), storage type. Built from schemas only."""
    rows, cid = [], 0
    for table, df in tables.items():
        for position, field in enumerate(df.schema, 1):
            if field.name not in skip:
                rows.append((cid, table, field.name, position, storage_type_name(field.dataType)))
                cid += 1
    return _active(tables).createDataFrame(
        rows, "cid int, table_name string, column_name string, position int, type_name string"
    )


def _unpivot_all(tables: Tables, skip: tuple[str, ...] = ()) -> DataFrame:
    """All values of all tables as (cid, value text); ids as in ``column_catalog``."""
    parts, cid = [], 0
    for df in tables.values():
        cells = []
        for field in df.schema:
            if field.name not in skip:
                cells.append(F.struct(F.lit(cid).alias("cid"), F.col(f"`{field.name}`").cast("string").alias("value")))
                cid += 1
        parts.append(df.select(F.inline(F.array(*cells))))
    return reduce(DataFrame.unionByName, parts)


def value_index(tables: Tables, skip: tuple[str, ...] = ()) -> DataFrame:
    """(cid, value, cnt): every distinct value of every column with its number of rows; NULL included."""
    return _unpivot_all(tables, skip).groupBy("cid", "value").agg(F.count(F.lit(1)).alias("cnt"))


def index_statistics(index: DataFrame) -> DataFrame:
    """Row, NULL, blank and distinct counts per column id, read off the index."""
    return index.groupBy("cid").agg(
        F.sum("cnt").alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("cnt"))), F.lit(0)).alias("null_count"),
        F.coalesce(F.sum(F.when(F.col("value") == "", F.col("cnt"))), F.lit(0)).alias("blank_count"),
        F.count("value").alias("cardinality"),
    )


def column_counts(tables: Tables) -> DataFrame:
    """(cid, row_count, null_count): one pass per table and no shuffle of values."""
    parts, cid = [], 0
    for df in tables.values():
        counts = [F.count(F.lit(1)).alias("n")]
        entries = []
        for field in df.schema:
            counts.append(F.count(F.col(f"`{field.name}`")).alias(f"_{cid}"))
            entries.append(
                F.struct(
                    F.lit(cid).alias("cid"), F.col("n").alias("row_count"),
                    (F.col("n") - F.col(f"_{cid}")).alias("null_count"),
                )
            )
            cid += 1
        parts.append(df.agg(*counts).select(F.inline(F.array(*entries))))
    return reduce(DataFrame.unionByName, parts)


def with_catalog(tables: Tables, stats: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """Statistics with table and column names; columns of empty tables get zero counts."""
    counts = ["row_count", "null_count", "blank_count", "cardinality"]
    joined = column_catalog(tables, skip).join(stats, "cid", "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts if c in stats.columns})


def _hashed_cells(tables: Tables, skip: tuple[str, ...]) -> DataFrame:
    """(cid, h1, h2, blank) of all values: two 64-bit hashes instead of the text; NULL hashes for NULL.

    Whole numbers, dates and decimals are hashed as they are, since their texts differ exactly where they do.
    """
    plain = (T.IntegralType, T.DateType, T.DecimalType, T.BooleanType)
    parts, cid = [], 0
    for df in tables.values():
        cells = []
        for field in df.schema:
            if field.name not in skip:
                column = F.col(f"`{field.name}`")
                known = column if isinstance(field.dataType, plain) else column.cast("string")
                blank = known == "" if isinstance(field.dataType, T.StringType) else F.lit(False)
                hashes = [F.when(column.isNotNull(), F.xxhash64(*seed, known)) for seed in ([], [F.lit(1)])]
                cells.append(F.struct(F.lit(cid).alias("cid"), hashes[0].alias("h1"), hashes[1].alias("h2"), F.coalesce(blank, F.lit(False)).alias("blank")))
                cid += 1
        parts.append(df.select(F.inline(F.array(*cells))))
    return reduce(DataFrame.unionByName, parts)


def column_statistics(tables: Tables, skip: tuple[str, ...] = ()) -> DataFrame:
    """Exact counts of every column of every table from one scan of each and one large shuffle, of fixed-width keys."""
    index = _hashed_cells(tables, skip).groupBy("cid", "h1", "h2", "blank").agg(F.count(F.lit(1)).alias("cnt"))
    return with_catalog(tables, hashed_statistics(index, ["cid"]), skip)


def hashed_statistics(index: DataFrame, key: list[str]) -> DataFrame:
    """Row, NULL, blank and distinct counts per key, from (key, h1, blank, cnt) of distinct values."""
    return index.groupBy(*key).agg(
        F.sum("cnt").alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("h1").isNull(), F.col("cnt"))), F.lit(0)).alias("null_count"),
        F.coalesce(F.sum(F.when(F.col("blank"), F.col("cnt"))), F.lit(0)).alias("blank_count"),
        F.count("h1").alias("cardinality"),
    )


def approximate_statistics(tables: Tables, rsd: float = 0.05) -> DataFrame:
    """Opt-in sketch variant: approximate distinct counts without shuffling any value."""
    cells = _unpivot_all(tables)
    stats = cells.groupBy("cid").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col("value").isNull()).alias("null_count"),
        F.count_if(F.col("value") == "").alias("blank_count"),
        F.approx_count_distinct("value", rsd).alias("cardinality"),
    )
    return with_catalog(tables, stats)


def index_samples(index: DataFrame, n: int) -> DataFrame:
    """The n smallest distinct non-blank values of each column id.

    NULL and '' sort last and are removed after ranking: the exchange under the index then stays the
    same as the one of ``index_statistics`` and Spark runs it once for both.
    """
    blank = F.when(F.col("value").isNull() | (F.col("value") == ""), 1).otherwise(0)
    flagged = index.withColumn("_blank", blank)
    ranked = flagged.withColumn(
        "rank", F.row_number().over(Window.partitionBy("cid").orderBy("_blank", "value"))
    ).where(F.col("rank") <= n)
    return ranked.where((F.col("_blank") == 0) & (F.col("cnt") > 0)).select("cid", "value", "rank", "cnt")


def _shown_values(index: DataFrame, n: int) -> DataFrame:
    return index_samples(index, n).groupBy("cid").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"]).alias("sample_values")
    )


def sample_values(tables: Tables, n: int = 5) -> DataFrame:
    """n distinct non-blank values of each column, ascending, as an array."""
    samples = _shown_values(value_index(tables), n)
    return column_catalog(tables).join(samples, "cid", "left").select(*COLUMN_KEY, "position", "sample_values")


# ---- rules over a statistics frame -------------------------------------------------------------


def null_percentage() -> Column:
    return safe_ratio(F.col("null_count"), F.col("row_count")) * 100


def cardinality_ratio() -> Column:
    return safe_ratio(F.col("cardinality"), F.col("row_count"))


def classify_by_type_and_cardinality() -> Column:
    kind = F.col("type_name")
    numeric = kind.rlike("Int(8|16|32|64)|Float(32|64)|Decimal")
    return (
        F.when(numeric & (F.col("cardinality") > 100), "fact")
        .when(F.lower(kind).rlike("date|timestamp"), "dimension")
        .when(kind.contains("String"), "dimension")
        .when(numeric & (F.col("cardinality") <= 10), "dimension")
        .when(numeric, "fact")
        .otherwise("dimension")
    )


# Inferred types the explaining classifier counts as numeric, date or flag.
INFERRED_NUMERIC = ["integer", "decimal", "numeric"]
INFERRED_DATE = ["date", "datetime"]
INFERRED_FLAG = "boolean"


def _flags(inferred: Column) -> dict[str, Column]:
    name = F.col("column_name")
    return {
        "numeric": inferred.isin(INFERRED_NUMERIC),
        "date": inferred.isin(INFERRED_DATE),
        "flag": inferred == INFERRED_FLAG,
        "identifier": is_identifier_name(name),
        "measure": is_measure_name(name),
        "high": cardinality_ratio() > 0.8,
        "low": cardinality_ratio() < 0.1,
    }


def classify_with_reasons(inferred: Column) -> Column:
    """Fact for numeric types unless the name is an identifier; dates, flags, identifiers: dimension."""
    f = _flags(inferred)
    return F.when(f["numeric"] & ~f["identifier"], "fact").otherwise("dimension")


def classification_reasons(inferred: Column) -> Column:
    """Why the classifier decided so, in evaluation order."""
    f = _flags(inferred)
    # Reason texts.
    return F.array_compact(
        F.array(
            F.when(f["numeric"], "Numeric data type (typically a measure/fact)"),
            F.when(f["numeric"] & f["high"], "High cardinality confirms measure classification"),
            F.when(f["numeric"] & f["measure"], "Column name suggests measure (amount, cost, quantity, etc.)"),
            F.when(f["date"], "Date/time column (typically dimension)"),
            F.when(f["flag"], "Boolean column (typically dimension)"),
            F.when(f["identifier"], "Column name suggests identifier/key"),
            F.when(f["low"] & ~f["numeric"], "Low cardinality non-numeric column (likely dimension)"),
        )
    )


def _points(condition: Column, points: float) -> Column:
    return F.when(condition, points).otherwise(0.0)


def classification_confidence(inferred: Column) -> Column:
    f = _flags(inferred)
    fact = 0.5 + _points(f["numeric"], 0.3) + _points(f["high"], 0.2) + _points(~f["identifier"], 0.1)
    dimension = 0.5 + _points(f["date"] | f["flag"], 0.3) + _points(f["identifier"], 0.2) + _points(f["low"], 0.1)
    return F.least(F.lit(1.0), F.when(classify_with_reasons(inferred) == "fact", fact).otherwise(dimension))


def classify_simple(inferred: Column) -> Column:
    return F.when(inferred.isin("numeric", "integer", "decimal", "float"), "fact").otherwise("dimension")


def classify_erd() -> Column:
    kind = F.lower(F.col("type_name"))
    return (
        F.when(kind.rlike("float|int|uint|decimal"), "fact")
        .when((F.col("cardinality") > 10000) & kind.contains("string"), "fact")
        .otherwise("dimension")
    )


def pk_candidate_80(classification: Column, suitable_type: Column) -> Column:
    """Dimension without NULLs, at least 80 % distinct, at least 100 values, key-like type."""
    return (
        (classification == "dimension")
        & (F.col("null_count") <= 0)
        & (cardinality_ratio() >= 0.8)
        & (F.col("cardinality") >= 100)
        & suitable_type
    )


def suitable_storage_type() -> Column:
    return F.col("type_name").rlike("U?Int(8|16|32|64)|String")


def suitable_inferred_type(inferred: Column) -> Column:
    return inferred.isin("string", "integer", "date", "datetime")


def pk_candidate_unique() -> Column:
    """No NULL, all values different, text or integer type, and a key-like name or many values."""
    kind = F.lower(F.col("type_name"))
    return (
        (F.col("null_count") <= 0)
        & (F.col("cardinality") == F.col("row_count"))
        & kind.rlike("|".join(UNIQUE_KEY_TYPES))
        & (contains_any(F.col("column_name"), UNIQUE_KEY_HINTS) | (F.col("cardinality") > 1000))
    )


def quality_score_catalog() -> Column:
    card = F.col("cardinality")
    spread = F.least(card / 1000, F.lit(1.0))
    filled = 1.0 - F.col("null_count") / F.greatest(card, F.lit(1))
    return F.when(card == 0, 0.0).otherwise((spread + filled) / 2)


def quality_score_table() -> Column:
    filled = F.greatest(F.lit(0.0), 1.0 - safe_ratio(F.col("null_count"), F.col("row_count")))
    spread = F.least(F.col("cardinality") / 1000, F.lit(1.0))
    return F.when(F.col("row_count") == 0, 0.0).otherwise((filled + spread) / 2)


def quality_score_erd() -> Column:
    pct, card = null_percentage(), F.col("cardinality")
    score = (
        1.0
        - F.when(pct > 10, 0.3).when(pct > 5, 0.1).otherwise(0.0)
        + F.when(card > 1000, 0.1).when(card > 100, 0.05).otherwise(0.0)
        - F.when((card < 10) & (F.col("row_count") > 1000), 0.2).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def quality_score_discover() -> Column:
    return safe_ratio(F.col("cardinality"), F.col("cardinality") + F.col("null_count"))


# ---- profiles ----------------------------------------------------------------------------------


def _with_inference(tables: Tables, n: int, skip: tuple[str, ...], rates: DataFrame | None,
                    numeric_threshold: float, null_as_blank: bool) -> DataFrame:
    """Counts and types inferred from the whole value index, and n values to show, joined on the column id."""
    index = value_index(tables, skip)
    types = infer_types(index, rates, numeric_threshold, key=["cid"])
    stats = index_statistics(index).join(types, "cid", "left").join(_shown_values(index, n), "cid", "left")
    return with_defaults(with_catalog(tables, stats, skip), null_as_blank)


def with_defaults(named: DataFrame, null_as_blank: bool) -> DataFrame:
    """Columns without values read as text; blank values count as NULLs if asked."""
    if null_as_blank:
        named = named.withColumn("null_count", F.col("null_count") + F.col("blank_count"))
    return named.withColumns(
        {
            "inferred_type": F.coalesce("inferred_type", F.lit("string")),
            "type_confidence": F.coalesce("type_confidence", F.lit(0.0)),
            "reasoning": F.coalesce("reasoning", F.lit("No values to analyze")),
            "sample_values": F.coalesce("sample_values", F.array().cast("array<string>")),
        }
    )


def profile_schema(tables: Tables, n: int = 10, rates: DataFrame | None = None,
                   numeric_threshold: float = 0.7) -> DataFrame:
    """Full profile of every column of every table: counts, inferred type, role, key and quality."""
    return full_profile(_with_inference(tables, n, (), rates, numeric_threshold, null_as_blank=True))


def full_profile(base: DataFrame) -> DataFrame:
    """Roles, keys and quality from counts and inferred types."""
    inferred = F.col("inferred_type")
    role = classify_with_reasons(inferred)
    return base.select(
        *COLUMN_KEY,
        "position",
        F.col("type_name").alias("bronze_type"),
        "inferred_type",
        "type_confidence",
        "pattern",
        "reasoning",
        "cardinality",
        "null_count",
        null_percentage().alias("null_percentage"),
        role.alias("classification"),
        classification_confidence(inferred).alias("classification_confidence"),
        classification_reasons(inferred).alias("classification_reasoning"),
        pk_candidate_80(role, suitable_inferred_type(inferred)).alias("is_primary_key_candidate"),
        quality_score_table().alias("data_quality_score"),
        cardinality_ratio().alias("cardinality_ratio"),
        "sample_values",
        "row_count",
    )


def profile_table(df: DataFrame, table: str, n: int = 10) -> DataFrame:
    return profile_schema({table: df}, n)


def profile_paths(spark: SparkSession, paths: dict[str, str], n: int = 10) -> tuple[DataFrame, DataFrame]:
    """Profile of all readable tables and a frame (table_name, error) of those that cannot be opened."""
    tables, errors = {}, []
    for table, path in paths.items():
        try:
            tables[table] = spark.read.parquet(path)
        except Exception as problem:  # other tables are still profiled
            errors.append((table, str(problem).split("\n", 1)[0]))
    failed = spark.createDataFrame(errors, "table_name string, error string")
    return profile_schema(tables, n), failed


def discover(tables: Tables, n: int = 10, rates: DataFrame | None = None,
             numeric_threshold: float = 0.7) -> DataFrame:
    """Stored profile: without the load stamp, strict NULL counts, simple role, version 1."""
    return discovered(_with_inference(tables, n, ("create_date",), rates, numeric_threshold, null_as_blank=False))


def discovered(base: DataFrame) -> DataFrame:
    """The stored profile's columns from counts and inferred types."""
    return base.select(
        F.col("table_name").alias("original_table_name"),
        F.col("column_name").alias("original_column_name"),
        F.col("table_name").alias("new_table_name"),
        F.col("column_name").alias("new_column_name"),
        "position",
        "inferred_type",
        "pattern",
        F.coalesce("integer_digits", F.lit(0)).alias("integer_digits"),
        classify_simple(F.col("inferred_type")).alias("classification"),
        "row_count",
        "cardinality",
        "null_count",
        F.slice("sample_values", 1, 5).alias("sample_values"),
        quality_score_discover().alias("data_quality_score"),
        F.lit(1).cast("bigint").alias("version"),
    )


def catalog_profile(tables: Tables) -> DataFrame:
    """Profile by storage type (no inference): the form that quality and relationship rules read."""
    stats = column_statistics(tables)
    role = classify_by_type_and_cardinality()
    return stats.select(
        *COLUMN_KEY, "position", "type_name", "row_count", "null_count", "cardinality",
        null_percentage().alias("null_percentage"),
        cardinality_ratio().alias("cardinality_ratio"),
        role.alias("classification"),
        pk_candidate_80(role, suitable_storage_type()).alias("is_primary_key_candidate"),
        quality_score_catalog().alias("data_quality_score"),
    )


def erd_profile(tables: Tables) -> DataFrame:
    """Profile of typed tables for relationship analysis."""
    return erd_rules(column_statistics(tables))


def erd_rules(stats: DataFrame) -> DataFrame:
    return stats.select(
        *COLUMN_KEY, "position", "type_name", "row_count", "null_count", "cardinality",
        null_percentage().alias("null_percentage"),
        pk_candidate_unique().alias("is_primary_key_candidate"),
        classify_erd().alias("classification"),
        quality_score_erd().alias("data_quality_score"),
    )


# ---- summaries ---------------------------------------------------------------------------------


def _is(role: str) -> Column:
    return F.col("classification") == role


def table_types(profile: DataFrame) -> DataFrame:
    """Fact when more fact than dimension columns, or over 100 000 rows with over 3 dimension columns."""
    counted = profile.groupBy("table_name").agg(
        F.max("row_count").alias("row_count"),
        F.count(F.lit(1)).alias("column_count"),
        F.count_if(_is("fact")).alias("fact_columns"),
        F.count_if(_is("dimension")).alias("dimension_columns"),
    )
    fact = (F.col("fact_columns") > F.col("dimension_columns")) | (
        (F.col("row_count") > 100000) & (F.col("dimension_columns") > 3)
    )
    return counted.withColumn("table_type", F.when(fact, "fact").otherwise("dimension"))


def table_summary(profile: DataFrame) -> DataFrame:
    measures = [
        F.max("row_count").alias("row_count"),
        F.count(F.lit(1)).alias("total_columns"),
        F.count_if(_is("fact")).alias("fact_columns"),
        F.count_if(_is("dimension")).alias("dimension_columns"),
        F.avg("data_quality_score").alias("avg_data_quality"),
        F.count_if(F.col("data_quality_score") > 0.8).alias("high_quality_columns"),
        F.count_if("is_primary_key_candidate").alias("primary_key_candidates"),
        F.count_if(F.col("null_count") > 0).alias("columns_with_nulls"),
    ]
    if "type_confidence" in profile.columns:
        measures.append(F.avg("type_confidence").alias("avg_type_confidence"))
    return profile.groupBy("table_name").agg(*measures)


def schema_summary(profile: DataFrame) -> DataFrame:
    totals = profile.agg(
        F.count_distinct("table_name").alias("total_tables"),
        F.count(F.lit(1)).alias("total_columns"),
        F.count_if(_is("fact")).alias("total_fact_columns"),
        F.count_if(_is("dimension")).alias("total_dimension_columns"),
        F.count_if("is_primary_key_candidate").alias("total_primary_key_candidates"),
    )
    return totals.withColumns(
        {
            "avg_columns_per_table": safe_ratio(F.col("total_columns"), F.col("total_tables")),
            "fact_dimension_ratio": safe_ratio(F.col("total_fact_columns"), F.col("total_dimension_columns")),
        }
    )


def catalog_views(profile: DataFrame) -> dict[str, DataFrame]:
    """Ordered listings: tables, facts, dimensions, key candidates, columns of poor quality."""
    best_first = [F.col("data_quality_score").desc(), F.col("table_name"), F.col("column_name")]
    return {
        "tables": table_summary(profile).orderBy(F.col("row_count").desc(), "table_name"),
        "facts": profile.where(_is("fact")).orderBy(*best_first),
        "dimensions": profile.where(~_is("fact")).orderBy(*best_first),
        "keys": profile.where("is_primary_key_candidate").orderBy(*best_first),
        "poor": profile.where(F.col("data_quality_score") < 0.5).orderBy("table_name", "column_name"),
    }


def erd_nodes(profile: DataFrame) -> DataFrame:
    """One entity per table: its columns in order, key candidates, row count."""
    entry = F.struct("position", "column_name")
    listed = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["column_name"])
    keys = F.transform(
        F.array_sort(F.collect_list(F.when(F.col("is_primary_key_candidate"), entry))), lambda e: e["column_name"]
    )
    return profile.groupBy("table_name").agg(
        listed.alias("columns"), keys.alias("primary_keys"), F.max("row_count").alias("row_count")
    )
