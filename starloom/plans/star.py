"""End-to-end plans: text tables -> profile -> typed tables -> star -> wide table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from starloom.operators.hierarchy import dimension_columns, hierarchy_levels, hierarchy_rows
from starloom.operators.model import (
    DimensionJoin, build_star_table, choose_join_keys, duplicate_keys, k_table, k_table_name, recommend, star_table_spec,
)
from starloom.operators.profile import Tables, column_statistics, discover, erd_rules, table_types
from starloom.operators.typed import SPEC, build_stage1, lossless_specs
from starloom.session import cut_lineage
from starloom.sources.ingest import land


def land_all(tables: Tables, stamp: str) -> Tables:
    """Bronze form of several sources."""
    return {name: land(df, stamp) for name, df in tables.items()}


def typed_from_text(bronze: Tables, numeric_threshold: float = 0.7) -> Tables:
    """Typed tables whose types come from one profiling job over all values of all text tables.

    Only the specs (one row per column) reach the driver; they shape one projection per table. A second pass counts
    the values that the types can't read; their columns stay text, so no value is lost.
    """
    profile = discover(bronze, numeric_threshold=numeric_threshold)
    specs: dict[str, list] = {name: [] for name in bronze}
    for row in profile.select("original_table_name", *SPEC).orderBy("original_table_name", "position").collect():
        specs[row["original_table_name"]].append(row)
    return {name: build_stage1(df, lossless_specs(df, specs[name])) for name, df in bronze.items()}


def recommend_star(tables: Tables) -> DataFrame:
    """Fact and dimension recommendations for typed tables.

    The column statistics are the only heavy step; they are stored once (one row per column) and every
    rule reads the stored frame.
    """
    stats = cut_lineage(column_statistics(tables))
    levels = hierarchy_levels(dimension_columns(stats))
    structure = stats.select("table_name", "column_name", "position", "type_name")
    return recommend(table_types(erd_rules(stats)), hierarchy_rows(levels), structure)


def wide_table(fact: DataFrame, dims: dict[str, tuple[DataFrame, str, str]], allow_duplicates: bool = False) -> DataFrame:
    """Wide table of a fact; ``dims``: name -> (frame, fact column, dimension column)."""
    joins = [DimensionJoin(name, df, fact_column, dim_column) for name, (df, fact_column, dim_column) in dims.items()]
    return k_table(fact, joins, allow_duplicates)



@dataclass(frozen=True)
class Gold:
    """Star tables and wide tables by name, and (fact, dim, reason) of the dimensions that no wide table holds."""

    star: Tables
    wide: Tables
    left_out: DataFrame


def assemble_gold(silver: Tables, recommendations: DataFrame, relationships: DataFrame) -> Gold:
    """Every named recommendation as a star table and every fact with its dimensions as a wide table.

    ``silver`` is keyed by the recommendations' source tables and ``relationships`` name the gold tables. Joins are
    those of ``choose_join_keys``; a dimension without a key, or whose key repeats, is left out and reported, so no
    fact row is lost or multiplied. The driver holds one row per recommendation and per join.
    """
    rows = [r.asDict() for r in recommendations.collect()]
    named = [(r, spec) for r in rows if (spec := star_table_spec(r)) and r["source_table"] in silver]
    star = {spec.name: build_star_table(silver[r["source_table"]], spec) for r, spec in named}
    kinds = {spec.name: r["table_type"] for r, spec in named}
    chosen = [j for j in choose_join_keys(recommendations, relationships).collect() if {j["fact"], j["dim"]} <= star.keys()]
    joins = {(j["fact"], j["dim"]): DimensionJoin(j["dim"], star[j["dim"]], j["fact_column"], j["dim_column"]) for j in chosen}
    keys = {f"{d.name}.{d.dim_column}": d for d in joins.values()}
    checked = [DimensionJoin(name, d.df, d.fact_column, d.dim_column) for name, d in keys.items()]
    repeated = {r["dim"] for r in duplicate_keys(checked).select("dim").distinct().collect()} if checked else set()

    wide, reasons = {}, []
    facts, dims = ([name for name, kind in kinds.items() if kind == wanted] for wanted in ("fact", "dimension"))
    for fact in facts:
        good = []
        for dim in dims:
            join = joins.get((fact, dim))
            if join is None:
                reasons.append((fact, dim, "no join key"))
            elif f"{dim}.{join.dim_column}" in repeated:
                reasons.append((fact, dim, "key repeats"))
            else:
                good.append(join)
        wide[k_table_name(fact)] = k_table(star[fact], good, allow_duplicates=True)  # the keys are checked above
    spark = recommendations.sparkSession
    return Gold(star, wide, spark.createDataFrame(reasons, "fact string, dim string, reason string"))
