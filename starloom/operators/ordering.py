"""Global row numbers and carried values without a single-task window.

A window without partition keys (or with one hot key) would sort all its rows in one task. Here rows
are range-partitioned by the whole sort key, so a hot group spreads over many partitions; one small
frame (at most one row per partition and group) then carries counts or values across partitions.
The sort key should be unique; equal keys keep an arbitrary order among themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from starloom.session import cut_lineage

ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in its low 33 bits


def _as_columns(order: list[str | Column]) -> list[Column]:
    return [F.col(one) if isinstance(one, str) else one for one in order]


def spread_in_order(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """Rows in global order over many partitions, with ``_part`` and ``_row`` (row number inside it).

    Lineage is cut because the ranges come from a sample and must stay the same for every later step.
    """
    keys = _as_columns(order)
    row_id = F.monotonically_increasing_id()
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", row_id)
    tagged = ordered.withColumns(
        {
            "_part": F.shiftrightunsigned(F.col("_id"), ROW_BITS),
            "_row": F.col("_id").bitwiseAND(F.lit((1 << ROW_BITS) - 1)),
        }
    ).drop("_id")
    return cut_lineage(tagged)


def global_position(df: DataFrame, order: list[str | Column], group: list[str] | None = None,
                    name: str = "position") -> DataFrame:
    """Exact row number (from 1) of every row inside its group, in the given order."""
    group = group or []
    tagged = spread_in_order(df, [*group, *order])
    blocks = tagged.groupBy("_part", *group).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first")
    )
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    offsets = offsets.withColumnsRenamed({g: f"_g_{g}" for g in group}).withColumnRenamed("_part", "_p")
    same = F.col("_part") == F.col("_p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    joined = tagged.join(offsets, same)
    return joined.withColumn(name, F.col("_before") + F.col("_row") - F.col("_first") + 1).select(*df.columns, name)


def running_total(df: DataFrame, weight: str, order: list[str | Column], group: list[str], name: str) -> DataFrame:
    """Sum of ``weight`` from the first row of each group up to every row, in the given order."""
    tagged = spread_in_order(df, [*group, *order])
    inside = Window.partitionBy("_part", *group).orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    running = tagged.withColumn("_running", F.sum(weight).over(inside))
    blocks = tagged.groupBy("_part", *group).agg(F.sum(weight).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        F.col("_part").alias("_p"), *[F.col(g).alias(f"_g_{g}") for g in group],
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"),
    )
    same = F.col("_part") == F.col("_p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return running.join(offsets, same).withColumn(name, F.col("_before") + F.col("_running")).select(*df.columns, name)


SEGMENT_ROWS = 1_000_000
SAMPLES = 64  # of one segment, to find where it ends


def segment_cuts(df: DataFrame, order: list[str], keys: list[str], rows: int) -> DataFrame:
    """(keys, _cuts) of the keys with more than ``rows`` rows: places in the order that part them into about so many rows each.

    Cuts come from a sample chosen by hash of the order's columns; one key has one number of cuts for each ``rows`` of its rows, so the
    frame stays a tiny share of the data.
    """
    many = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows).drop("_n")
    rate = max(1, rows // SAMPLES)
    sample = df.select(*keys, F.struct(*order).alias("_place")).where(F.pmod(F.xxhash64(*order), F.lit(rate)) == 0)
    taken = sample.groupBy(*keys).agg(F.sort_array(F.collect_list("_place")).alias("_places"))
    every = max(1, rows // rate)
    cuts = F.filter("_places", lambda place, i: i % every == every - 1)
    found = taken.select(*keys, cuts.alias("_cuts"))
    return found.join(_keyed(many, keys), _same(found, keys), "left_semi") if keys else found.crossJoin(many.select())


def _keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"_k_{k}" for k in keys})


def _same(df: DataFrame, keys: list[str]) -> Column:
    return reduce(Column.__and__, [df[k].eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.lit(True))


def carry_fill(df: DataFrame, columns: list[str], order: list[str], keys: list[str] | None = None,
               backward: bool = False, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Replace NULLs by the last value seen before (or the next one after) in the given order.

    Rows of a key follow each other in one window. A key with more than ``segment_rows`` rows (all of them, without keys) is parted
    into segments first: one pass takes the last known value of each segment, with partial results in every task, and the
    windows of the next segments begin with what came before. Only keys, cuts and carried values are stored, never the rows.
    """
    keys = keys or []
    inside = Window.partitionBy(*keys, "_segment")
    inside = inside.orderBy(*[F.col(c).desc() if backward else F.col(c) for c in order])
    inside = inside.rowsBetween(Window.unboundedPreceding, 0)
    cuts = cut_lineage(segment_cuts(df, order, keys, segment_rows))
    if cuts.isEmpty():
        single = df.withColumn("_segment", F.lit(0))
        return single.withColumns({c: F.last(c, ignorenulls=True).over(inside) for c in columns}).select(*df.columns)
    # one row for each key of more than segment_rows rows
    marked = df.join(F.broadcast(_keyed(cuts, keys)), _same(df, keys), "left")
    place = F.struct(*order)
    segment = F.coalesce(F.size(F.filter("_cuts", lambda cut: cut < place)), F.lit(0))
    marked = marked.withColumn("_segment", -segment if backward else segment)
    take = F.min_by if backward else F.max_by
    ends = marked.where("_cuts is not null").groupBy(*keys, "_segment").agg(
        *[take(F.col(c), F.when(F.col(c).isNotNull(), place)).alias(f"_end_{c}") for c in columns]
    )
    before = Window.partitionBy(*keys).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_segment").alias("_s"),
        *[F.last(f"_end_{c}", ignorenulls=True).over(before).alias(f"_carry_{c}") for c in columns],
    )
    carried = cut_lineage(carried)
    filled = marked.withColumns({c: F.last(c, ignorenulls=True).over(inside) for c in columns}).select(*df.columns, "_segment")
    joined = filled.join(F.broadcast(carried), _same(filled, keys) & (filled["_segment"] == F.col("_s")), "left")
    return joined.select(*[F.coalesce(F.col(c), F.col(f"_carry_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])
