"""Versioned metadata: append-only rows, the highest version of a key is the current one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from starloom.operators.ordering import global_position

# Run frequencies and the age in seconds at which an item is due again.
FREQUENCIES = {"hourly": 3600, "daily": 86400, "weekly": 604800, "monthly": 2592000}
ON_DEMAND = "on_demand"
PROFILE_KEY = ["original_table_name", "original_column_name"]


def latest_by_key(df: DataFrame, keys: list[str], version: str, sequence: str | None = None) -> DataFrame:
    """Row with the highest version per key; ``sequence`` (insertion order) breaks ties.

    Every task keeps one row per key before the shuffle, so a hot key never gathers in one task.
    """
    order = [F.col(version).desc_nulls_last()] + ([F.col(sequence).desc_nulls_last()] if sequence else [])
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") == 1).drop("_rank")


def latest_versions(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """(keys, version) of the newest rows, a plain aggregate."""
    return df.groupBy(*keys).agg(F.max(version).alias(version))


def number_changes(base: DataFrame, changes: DataFrame, keys: list[str], version: str = "version",
                   sequence: str | None = None) -> DataFrame:
    """The changes with rising versions above the current one of their key (from 1 for new keys).

    Several changes of one key follow each other by ``sequence``, or in the order of the input. They are numbered by
    position over ranges of all rows, so a key that holds most changes is still spread over many tasks.
    """
    current = latest_versions(base, keys, version).withColumnRenamed(version, "_current").withColumnsRenamed({k: f"_k_{k}" for k in keys})
    order = sequence or "_arrival"
    rows = changes.drop(version)
    rows = rows if sequence else rows.withColumn(order, F.monotonically_increasing_id())
    placed = global_position(rows, [order], keys, "_place")
    same = reduce(Column.__and__, [placed[k].eqNullSafe(current[f"_k_{k}"]) for k in keys])
    placed = placed.join(current, same, "left").drop(*current.drop("_current").columns)
    numbered = placed.withColumn(version, (F.coalesce("_current", F.lit(0)) + F.col("_place")).cast("bigint"))
    return numbered.drop("_current", "_place", "_arrival")


def next_versions(base: DataFrame, changes: DataFrame, keys: list[str], version: str = "version",
                  sequence: str | None = None) -> DataFrame:
    """Base rows plus the numbered changes."""
    return base.unionByName(number_changes(base, changes, keys, version, sequence), allowMissingColumns=True)


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], version: str = "version",
           sequence: str | None = None) -> DataFrame:
    """Current rows after the changes."""
    return latest_by_key(next_versions(base, changes, keys, version, sequence), keys, version)


def merge_partial(base: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``base`` with the non-NULL fields of ``patch``; a patch of an unknown key has no effect."""
    fields = [c for c in patch.columns if c not in keys]
    new = patch.withColumnsRenamed({c: f"_new_{c}" for c in fields})
    merged = base.join(new, keys, "left")
    return merged.withColumns({c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in fields}).select(*base.columns)


def rename_table(profile: DataFrame, table: str, new_table: str | None, column: str | None = None,
                 new_column: str | None = None, inferred_type: str | None = None,
                 classification: str | None = None) -> DataFrame:
    """Changed current rows (new version): the table name on all its columns, the rest on the named column only."""
    named = F.col("original_column_name") == F.lit(column) if column else F.lit(False)

    def given(value: str | None, old: str) -> Column:
        return F.when(named & F.lit(value is not None), F.lit(value)).otherwise(F.col(old))

    return latest_by_key(profile.where(F.col("original_table_name") == table), PROFILE_KEY, "version").withColumns(
        {
            "new_table_name": F.coalesce(F.lit(new_table), F.col("new_table_name")),
            "new_column_name": given(new_column, "new_column_name"),
            "inferred_type": given(inferred_type, "inferred_type"),
            "classification": given(classification, "classification"),
            "version": F.col("version") + 1,
        }
    )


def edit_column(profile: DataFrame, table: str, column: str, **changes: str | None) -> DataFrame:
    """Changed current row of one column (new version); fields not given keep their value."""
    rows = profile.where((F.col("original_table_name") == table) & (F.col("original_column_name") == column))
    row = latest_by_key(rows, PROFILE_KEY, "version")
    given = {field: F.coalesce(F.lit(value), F.col(field)) for field, value in changes.items()}
    return row.withColumns({**given, "version": F.col("version") + 1})


def soft_delete(base: DataFrame, keys_to_delete: DataFrame, keys: list[str], flag: str = "enabled") -> DataFrame:
    """Append a version with the flag off for the given keys."""
    doomed = latest_by_key(base, keys, "version").join(keys_to_delete.select(*keys), keys, "left_semi")
    return base.unionByName(
        doomed.withColumns({flag: F.lit(0).cast(base.schema[flag].dataType), "version": F.col("version") + 1})
    )


def hard_delete(base: DataFrame, condition: Column) -> DataFrame:
    """Rows that do not meet the condition; unknown (NULL) is kept."""
    return base.where(~F.coalesce(condition, F.lit(False)))


def assign_ids(new_rows: DataFrame, order: list[str], start: Column | int = 0, name: str = "id") -> DataFrame:
    """Ids that continue after ``start`` in the given order, numbered in parallel."""
    numbered = global_position(new_rows, order, name="_position")
    base = F.lit(start) if isinstance(start, int) else start
    return numbered.withColumn(name, F.coalesce(base, F.lit(0)) + F.col("_position")).drop("_position")


def lookup(df: DataFrame, filters: dict[str, object] | None = None, order: list[str] | None = None,
           limit: int | None = None) -> DataFrame:
    """Optional equality filters, order and limit; filters that are None are ignored."""
    for column, value in (filters or {}).items():
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    if order:
        df = df.orderBy(*order)
    return df.limit(limit) if limit is not None else df


def group_by_frequency(items: DataFrame, frequency: str) -> DataFrame:
    """Number of items per known frequency (lower-cased; NULL counts as on demand, others drop)."""
    name = F.lower(F.coalesce(F.col(frequency), F.lit(ON_DEMAND)))
    known = items.withColumn("frequency", name).where(F.col("frequency").isin([*FREQUENCIES, ON_DEMAND]))
    return known.groupBy("frequency").agg(F.count(F.lit(1)).alias("items"))


def items_of_frequency(items: DataFrame, frequency: str, wanted: str) -> DataFrame:
    return items.where(F.lower(F.coalesce(F.col(frequency), F.lit(ON_DEMAND))) == wanted)


def due_items(items: DataFrame, frequency: str, last_run: str, now: Column) -> DataFrame:
    """Items never run, or older than their frequency allows; other frequencies are never due again."""
    age = now.cast("timestamp").cast("double") - F.col(last_run).cast("timestamp").cast("double")
    limit = F.lit(None).cast("int")
    for name, seconds in FREQUENCIES.items():
        limit = F.when(F.col(frequency) == name, seconds).otherwise(limit)
    return items.where(F.col(last_run).isNull() | F.coalesce(age >= limit, F.lit(False)))


def list_across_stages(stages: dict[str, DataFrame]) -> DataFrame:
    """Rows of all stage tables with their stage."""
    tagged = [df.withColumn("stage", F.lit(stage)) for stage, df in stages.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def statements_by_transformation(listing: DataFrame, limit: int | None = None) -> DataFrame:
    """Statement counts per stage and transformation id, in order."""
    grouped = listing.groupBy("stage", "transformation_id").agg(F.count(F.lit(1)).alias("statements"))
    ordered = grouped.orderBy("stage", "transformation_id")
    return ordered.limit(limit) if limit is not None else ordered
