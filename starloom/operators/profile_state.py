"""Profiles that grow load by load: a mergeable state instead of reading all loads again.

The state of a load has one row of fixed width for each distinct value of each column (two 64-bit hashes, how often, and
the features that type inference needs), the ``KEPT`` smallest values as samples, and the columns. States add up: counts of equal
hashes are summed, the smallest of the samples stay. So the profile of all loads comes from their states, which are a
fraction of the data, and a new load is the only data read. Texts leave the load for its samples only.

States are kept in one folder per day; a day that is loaded again replaces its folder. Their merge shuffles fixed-width rows
by hash, with partial sums before, so a value that fills a third of a column is one row a task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.errors import AnalysisException

from starloom.operators.infer import COLUMN_KEY, FEATURES, NUMERIC_THRESHOLD, types_of_features, value_features
from starloom.operators.profile import (
    Tables, column_catalog, discovered, full_profile, hashed_statistics, index_samples, value_index, with_defaults,
)

KEPT = 100
PARTS = ("values", "samples", "columns")


@dataclass(frozen=True)
class ProfileState:
    """``values``: table_name, column_name, h1, h2, blank, cnt and features; ``samples``: table_name, column_name, value; ``columns``:
    table_name, column_name, position, type_name."""

    values: DataFrame
    samples: DataFrame
    columns: DataFrame


def state_of(tables: Tables, skip: tuple[str, ...] = (), kept: int = KEPT) -> ProfileState:
    """The state of one load, from one scan of its tables."""
    index = value_index(tables, skip)
    columns = column_catalog(tables, skip)
    known = F.col("value").isNotNull()
    hashes = [F.when(known, F.xxhash64("value")).alias("h1"), F.when(known, F.xxhash64(F.lit(1), "value")).alias("h2")]
    marked = index.select("cid", *hashes, F.coalesce(F.col("value") == "", F.lit(False)).alias("blank"), "cnt", "value")
    values = value_features(marked, ["cid", "h1", "h2", "blank", "cnt"])
    named = columns.select("cid", *COLUMN_KEY)
    return ProfileState(
        values.join(F.broadcast(named), "cid").drop("cid"),  # one row for each column of the schemas
        index_samples(index, kept).join(F.broadcast(named), "cid").select(*COLUMN_KEY, "value"),
        columns.drop("cid"),
    )


def merged(first: ProfileState, second: ProfileState, kept: int = KEPT) -> ProfileState:
    """The state of both loads together."""
    both = [getattr(first, part).unionByName(getattr(second, part)) for part in PARTS]
    return _summed(ProfileState(*both), kept)


def _summed(state: ProfileState, kept: int) -> ProfileState:
    key = [*COLUMN_KEY, "h1", "h2", "blank"]
    values = state.values.groupBy(*key).agg(F.sum("cnt").alias("cnt"), *[F.max(f).alias(f) for f in FEATURES])
    smallest = F.row_number().over(Window.partitionBy(*COLUMN_KEY).orderBy("value"))
    samples = state.samples.select(*COLUMN_KEY, "value").distinct().withColumn("_rank", smallest).where(F.col("_rank") <= kept).drop("_rank")
    columns = state.columns.groupBy(*COLUMN_KEY).agg(F.max(F.struct("position", "type_name")).alias("_last")).select(*COLUMN_KEY, "_last.*")
    return ProfileState(values, samples, columns)


def add_load(spark: SparkSession, path: str, day: str, tables: Tables, skip: tuple[str, ...] = (), kept: int = KEPT) -> None:
    """Store the state of a load in its day's folder; other days are neither read nor written."""
    state = state_of(tables, skip, kept)
    for part in PARTS:
        getattr(state, part).write.mode("overwrite").parquet(f"{path}/{part}/day={day}")


def load_state(spark: SparkSession, path: str, days: list[str] | None = None, kept: int = KEPT) -> ProfileState:
    """The state of all stored loads, or of the given days."""
    try:
        frames = [spark.read.parquet(f"{path}/{part}") for part in PARTS]
    except AnalysisException as problem:
        raise ValueError(f"no stored profile state in {path}") from problem
    if days is not None:
        frames = [frame.where(F.col("day").cast("string").isin(days)) for frame in frames]
    return _summed(ProfileState(*[frame.drop("day") for frame in frames]), kept)


def _base(state: ProfileState, n: int, rates: DataFrame | None, numeric_threshold: float, null_as_blank: bool) -> DataFrame:
    stats = hashed_statistics(state.values, COLUMN_KEY)
    types = types_of_features(state.values, rates, numeric_threshold, COLUMN_KEY)
    rank = F.row_number().over(Window.partitionBy(*COLUMN_KEY).orderBy("value"))
    smallest = state.samples.withColumn("_rank", rank).where(F.col("_rank") <= n)
    shown = smallest.groupBy(*COLUMN_KEY).agg(F.array_sort(F.collect_list("value")).alias("sample_values"))
    base = state.columns
    for frame in (stats, types, shown):
        base = base.join(frame, COLUMN_KEY, "left")
    counts = ["row_count", "null_count", "blank_count", "cardinality"]
    return with_defaults(base.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts}), null_as_blank)


def profile_of_state(state: ProfileState, n: int = 10, rates: DataFrame | None = None,
                     numeric_threshold: float = NUMERIC_THRESHOLD) -> DataFrame:
    """As ``profile_schema`` of all loads of the state; ``n`` samples, as many as the state kept at most."""
    return full_profile(_base(state, n, rates, numeric_threshold, null_as_blank=True))


def discover_of_state(state: ProfileState, n: int = 10, rates: DataFrame | None = None,
                      numeric_threshold: float = NUMERIC_THRESHOLD) -> DataFrame:
    """As ``discover`` of all loads of the state; leave the load stamp out of the state with ``skip``."""
    return discovered(_base(state, n, rates, numeric_threshold, null_as_blank=False))
