"""Dimensional model: recommend facts and dimensions, choose join keys, build the star and wide tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from starloom.functions.names import is_measure
from starloom.operators.versioned import latest_by_key
from starloom.session import cut_lineage

STAGE1_SUFFIX = "_stage1"


def _no_text() -> Column:
    return F.array().cast("array<string>")


def original_name(table: Column) -> Column:
    return F.replace(table, F.lit(STAGE1_SUFFIX), F.lit(""))


def latest_metadata(erd: DataFrame, hierarchies: DataFrame, profile: DataFrame,
                    schema_name: str = "silver") -> dict[str, DataFrame]:
    """Newest ERD and hierarchy row per table of one schema, and the profile rows of its tables."""
    erd_now = latest_by_key(erd.where(F.col("schema_name") == schema_name), ["table_name"], "analysis_timestamp")
    hier_now = latest_by_key(hierarchies, ["table_name"], "analysis_timestamp")
    tables = hier_now.select(original_name(F.col("table_name")).alias("_t")).distinct()
    staged = F.col("original_table_name").endswith(STAGE1_SUFFIX)
    listed = profile.where(~staged).join(tables, F.col("original_table_name") == F.col("_t"), "left_semi")
    return {"erd": erd_now, "hierarchies": hier_now, "profile": profile.where(staged).unionByName(listed)}


def _details(entry_fields: list[Column]) -> Column:
    """Column details sorted by name."""
    return F.array_sort(F.collect_list(F.struct(*entry_fields)))


def recommend_dimensions(hierarchies: DataFrame, structure: DataFrame, facts: DataFrame | None = None,
                         profile: DataFrame | None = None) -> DataFrame:
    """One dimension per hierarchy of a table that is no fact.

    Columns: those of the stored profile that belong to the hierarchy, and every column of the table
    that is no measure. ``structure`` rows: table_name, column_name, type_name.
    """
    chosen = hierarchies if facts is None else hierarchies.join(facts.select("table_name"), "table_name", "left_anti")
    measure = is_measure(F.col("table_name"), F.col("column_name"), F.col("type_name"))
    columns = structure.where(~measure).select(
        "table_name", "column_name", F.col("type_name").alias("data_type"),
        F.lit("dimension").alias("classification"), F.lit(1).alias("source_rank"),
    )
    if profile is not None:
        members = F.array_distinct(F.flatten(F.array("levels", F.array("root_column", "leaf_column"))))
        named = chosen.select(
            "table_name", original_name(F.col("table_name")).alias("original_table_name"),
            F.explode(members).alias("column_name"),
        )
        known = profile.select(
            "original_table_name", F.coalesce("new_column_name", "original_column_name").alias("column_name"),
            F.col("inferred_type").alias("data_type"), "classification",
        )
        columns = columns.unionByName(
            named.join(known, ["original_table_name", "column_name"]).select(
                "table_name", "column_name", "data_type", "classification", F.lit(0).alias("source_rank")
            )
        )
    best = Window.partitionBy("table_name", "column_name").orderBy("source_rank")
    unique = columns.withColumn("_r", F.row_number().over(best)).where(F.col("_r") == 1)
    listed = unique.groupBy("table_name").agg(
        _details([F.col("column_name").alias("name"), F.col("data_type").alias("type"), F.col("classification")]).alias(
            "column_details"
        )
    )
    number = F.row_number().over(Window.orderBy("table_name"))  # one row per table
    return (
        chosen.join(listed, "table_name", "left")
        .withColumn("column_details", F.coalesce("column_details", F.array().cast("array<struct<name:string,type:string,classification:string>>")))
        .select(
            F.lit("dimension").alias("table_type"),
            F.concat(F.lit("dimension"), number.cast("string"), F.lit("_dim")).alias("recommended_name"),
            F.col("table_name").alias("source_table"),
            original_name(F.col("table_name")).alias("original_table_name"),
            "hierarchy_name", "root_column", "leaf_column",
            _no_text().alias("fact_columns"),
            _no_text().alias("dimension_keys"),
            F.transform("column_details", lambda c: c["name"]).alias("columns"),
            "column_details",
            F.size("column_details").alias("total_columns"),
            (F.size("intermediate_levels") + 2).alias("hierarchy_levels"),
        )
    )


def recommend_facts(erd: DataFrame, structure: DataFrame, relationships: DataFrame | None = None,
                    profile: DataFrame | None = None) -> DataFrame:
    """One fact per table of type fact: measures by name rule, all other columns as dimension keys.

    Columns that the ERD lists as dimensions or that take part in a relationship are keys unless they
    are measures. ``structure`` rows: table_name, column_name, position, type_name.
    """
    facts = erd.where(F.col("table_type") == "fact")
    columns = structure.join(facts.select("table_name"), "table_name", "left_semi").withColumn(
        "is_measure", is_measure(F.col("table_name"), F.col("column_name"), F.col("type_name"))
    )
    kind = F.col("type_name")
    if profile is not None:
        known = profile.select(
            F.col("original_table_name").alias("_t"),
            F.coalesce("new_column_name", "original_column_name").alias("_c"),
            F.col("inferred_type").alias("_type"),
        )
        columns = columns.join(
            known, (original_name(F.col("table_name")) == F.col("_t")) & (F.col("column_name") == F.col("_c")), "left"
        )
        kind = F.coalesce("_type", "type_name")
    role = F.when(F.col("is_measure"), "fact").otherwise("dimension_key")
    detail = [F.col("column_name").alias("name"), kind.alias("type"), role.alias("classification")]

    def names(condition: Column) -> Column:
        entry = F.when(condition, F.struct("position", "column_name"))
        return F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["column_name"])

    listed = columns.groupBy("table_name").agg(
        _details(detail).alias("column_details"),
        names(F.col("is_measure")).alias("fact_columns"),
        names(~F.col("is_measure")).alias("dimension_keys"),
    )
    number = F.row_number().over(Window.orderBy("table_name"))  # one row per table
    return listed.select(
        F.lit("fact").alias("table_type"),
        F.concat(F.lit("fact"), number.cast("string"), F.lit("_fact")).alias("recommended_name"),
        F.col("table_name").alias("source_table"),
        original_name(F.col("table_name")).alias("original_table_name"),
        F.lit(None).cast("string").alias("hierarchy_name"),
        F.lit(None).cast("string").alias("root_column"),
        F.lit(None).cast("string").alias("leaf_column"),
        "fact_columns", "dimension_keys",
        F.transform("column_details", lambda c: c["name"]).alias("columns"),
        "column_details",
        F.size("column_details").alias("total_columns"),
        F.lit(0).alias("hierarchy_levels"),
    )


def recommend(erd: DataFrame, hierarchies: DataFrame, structure: DataFrame,
              profile: DataFrame | None = None) -> DataFrame:
    """Facts first, then dimensions of the other tables."""
    facts = recommend_facts(erd, structure, profile=profile)
    used = facts.select(F.col("source_table").alias("table_name"))
    return facts.unionByName(recommend_dimensions(hierarchies, structure, used, profile))


def recommendation_counts(recommendations: DataFrame) -> DataFrame:
    return recommendations.agg(
        F.count_if(F.col("table_type") == "fact").alias("fact_tables"),
        F.count_if(F.col("table_type") == "dimension").alias("dimension_tables"),
        F.count(F.lit(1)).alias("total_recommendations"),
    )


def rename_recommendation(recommendations: DataFrame, recommended_name: str, final_name: str,
                          column_names: dict[str, str] | None = None) -> DataFrame:
    """Set the final name of one recommendation and rename its columns everywhere they are listed."""
    mine = F.col("recommended_name") == recommended_name
    if "final_name" not in recommendations.columns:
        recommendations = recommendations.withColumn("final_name", F.lit(None).cast("string"))
    out = recommendations.withColumn("final_name", F.when(mine, F.lit(final_name)).otherwise(F.col("final_name")))
    if not column_names:
        return out
    mapping = F.create_map(*[F.lit(x) for pair in column_names.items() for x in pair])

    def renamed(name: Column) -> Column:
        return F.coalesce(F.try_element_at(mapping, name), name)

    def lists(column: str) -> Column:
        return F.when(mine, F.transform(column, renamed)).otherwise(F.col(column))

    details = F.transform("column_details", lambda d: d.withField("name", renamed(d["name"])))
    return out.withColumns(
        {
            **{c: lists(c) for c in ("columns", "fact_columns", "dimension_keys")},
            "column_details": F.when(mine, details).otherwise(F.col("column_details")),
            "root_column": F.when(mine, renamed(F.col("root_column"))).otherwise(F.col("root_column")),
            "leaf_column": F.when(mine, renamed(F.col("leaf_column"))).otherwise(F.col("leaf_column")),
        }
    )


def list_recommendations(recommendations: DataFrame, table_type: str | None = None,
                         name: str | None = None) -> DataFrame:
    out = recommendations
    if table_type:
        out = out.where(F.col("table_type") == table_type)
    if name:
        out = out.where(F.col("recommended_name") == name)
    return out.orderBy("table_type", "recommended_name")


@dataclass(frozen=True)
class StarTable:
    """What a star table takes from its silver source: columns (old name -> new name) and order."""

    name: str
    columns: dict[str, str]
    sort_by: tuple[str, ...]


def star_table_spec(recommendation: dict) -> StarTable | None:
    """Spec of one collected recommendation; None until it has a final name."""
    if not recommendation.get("final_name"):
        return None
    if recommendation["table_type"] == "fact":
        order = tuple(recommendation["dimension_keys"])
    else:
        order = tuple(c for c in (recommendation["root_column"], recommendation["leaf_column"]) if c)
    return StarTable(recommendation["final_name"], {c: c for c in recommendation["columns"]}, order)


def build_star_table(silver: DataFrame, spec: StarTable) -> DataFrame:
    """Listed columns of the silver table with their types, ordered inside partitions for pruning."""
    chosen = silver.select(*[F.col(f"`{old}`").alias(new) for old, new in spec.columns.items()])
    return chosen.sortWithinPartitions(*spec.sort_by) if spec.sort_by else chosen


# ---- join keys ---------------------------------------------------------------------------------


def _fact_columns(recommendations: DataFrame) -> DataFrame:
    return recommendations.where(F.col("table_type") == "fact").select(
        F.coalesce("final_name", "recommended_name").alias("fact"), "dimension_keys",
        F.posexplode("columns").alias("fact_pos", "fact_column"),
    )


def _dimensions(recommendations: DataFrame) -> DataFrame:
    name = F.coalesce("final_name", "recommended_name")
    has_root = F.array_contains("columns", F.col("root_column"))
    base = name
    for part in ("_dim", "_key", "_id"):
        base = F.replace(base, F.lit(part), F.lit(""))
    return recommendations.where(F.col("table_type") == "dimension").select(
        name.alias("dim"),
        "root_column",
        F.when(F.coalesce(has_root, F.lit(False)), F.col("root_column")).otherwise(F.get("columns", F.lit(0))).alias("dim_key"),
        base.alias("base"),
        F.replace(name, F.lit("_dim"), F.lit("")).alias("stem"),
    )


def relationship_keys(recommendations: DataFrame, relationships: DataFrame) -> DataFrame:
    """(fact, dim, fact_column, dim_column) of confident value overlaps, read in both directions."""
    sure = relationships.where(F.col("join_confidence") > 0.7)
    forward = sure.select(
        F.col("table1").alias("fact"), F.col("table2").alias("dim"),
        F.col("column1").alias("fact_column"), F.col("column2").alias("dim_column"), "join_confidence",
    )
    back = sure.select(
        F.col("table2").alias("fact"), F.col("table1").alias("dim"),
        F.col("column2").alias("fact_column"), F.col("column1").alias("dim_column"), "join_confidence",
    )
    facts = _fact_columns(recommendations).select("fact").distinct()
    dims = _dimensions(recommendations).select("dim").distinct()
    both = forward.unionByName(back).join(facts, "fact", "left_semi").join(dims, "dim", "left_semi")
    best = Window.partitionBy("fact", "dim").orderBy(F.col("join_confidence").desc(), "fact_column", "dim_column")
    return both.withColumn("_r", F.row_number().over(best)).where(F.col("_r") == 1).drop("_r", "join_confidence")


def related_dimensions(recommendations: DataFrame, relationships: DataFrame) -> DataFrame:
    """Related pairs; both inputs are stored first because they are read several times."""
    return _related(cut_lineage(recommendations), cut_lineage(relationships))


def _related(recommendations: DataFrame, relationships: DataFrame) -> DataFrame:
    """(fact, dim, via): by relationship; for facts without any, by key names; else every dimension.

    The last form is not spelled out as pairs: ``via`` is 'any' with a NULL dimension, and
    ``choose_join_keys`` then accepts every dimension whose key has a matching name.
    """
    by_value = relationship_keys(recommendations, relationships).select("fact", "dim").distinct()
    dims = _dimensions(recommendations)
    keys = dims.select(
        "dim",
        F.explode(
            F.array_distinct(F.array_compact(F.array(
                F.col("root_column"), F.concat("stem", F.lit("_key")), F.concat("stem", F.lit("_id")), F.col("stem")
            )))
        ).alias("key"),
        "root_column",
    )
    first = Window.partitionBy("key").orderBy(
        F.when(F.col("key") == F.col("root_column"), 0).otherwise(1), "dim"
    )
    keys = keys.withColumn("_r", F.row_number().over(first)).where(F.col("_r") == 1).select("dim", "key")
    wanted = (
        recommendations.where(F.col("table_type") == "fact")
        .select(F.coalesce("final_name", "recommended_name").alias("fact"), F.explode("dimension_keys").alias("key"))
        .join(by_value.select("fact").distinct(), "fact", "left_anti")
    )
    by_name = wanted.join(keys, "key").select("fact", "dim").distinct()
    facts = _fact_columns(recommendations).select("fact").distinct()
    left_over = facts.join(by_value.unionByName(by_name).select("fact").distinct(), "fact", "left_anti")
    return (
        by_value.withColumn("via", F.lit("relationship"))
        .unionByName(by_name.withColumn("via", F.lit("key_name")))
        .unionByName(left_over.select("fact", F.lit(None).cast("string").alias("dim"), F.lit("any").alias("via")))
    )


def choose_join_keys(recommendations: DataFrame, relationships: DataFrame) -> DataFrame:
    """One join per related fact and dimension: (fact, dim, fact_column, dim_column, rule).

    A confident value overlap wins; else the first fact column that equals the dimension's key or root
    or starts with the dimension's name. Prefixes of the fact columns are exploded so that the name
    match is an equi-join. A related dimension without any key is left out.
    """
    recommendations, relationships = cut_lineage(recommendations), cut_lineage(relationships)
    by_value = relationship_keys(recommendations, relationships).withColumns(
        {"rule": F.lit("relationship"), "rank": F.lit(0), "fact_pos": F.lit(0)}
    )
    dims = _dimensions(recommendations)
    columns = _fact_columns(recommendations)
    equal = columns.join(
        dims.select("dim", "dim_key", F.explode(F.array_distinct(F.array_compact(F.array("dim_key", "root_column")))).alias("fact_column")),
        "fact_column",
    )
    lower = F.lower("fact_column")
    prefixes = columns.select(
        "fact", "fact_pos", "fact_column",
        F.explode(F.transform(F.sequence(F.lit(1), F.length("fact_column")), lambda i: F.substr(lower, F.lit(1), i))).alias("base"),
    )
    prefix = prefixes.join(dims.where(F.col("base") != "").select("dim", "dim_key", "base"), "base")
    wanted = ["fact", "dim", "fact_column", F.col("dim_key").alias("dim_column"), F.lit("name").alias("rule"),
              F.lit(1).alias("rank"), "fact_pos"]
    candidates = by_value.unionByName(equal.select(*wanted)).unionByName(prefix.select(*wanted))

    related = cut_lineage(_related(recommendations, relationships))
    listed = candidates.join(related.where(F.col("dim").isNotNull()), ["fact", "dim"], "left_semi")
    anything = candidates.join(related.where(F.col("via") == "any"), "fact", "left_semi")
    best = Window.partitionBy("fact", "dim").orderBy("rank", "fact_pos")
    return (
        listed.unionByName(anything)
        .withColumn("_r", F.row_number().over(best))
        .where(F.col("_r") == 1)
        .select("fact", "dim", "fact_column", "dim_column", "rule")
    )


# ---- wide tables -------------------------------------------------------------------------------


@dataclass(frozen=True)
class DimensionJoin:
    """One dimension of a wide table: ``fact.fact_column = <name>.dim_column``."""

    name: str
    df: DataFrame
    fact_column: str
    dim_column: str


def duplicate_keys(dims: list[DimensionJoin]) -> DataFrame:
    """(dim, key, rows) of dimension keys that occur more than once."""
    parts = [
        d.df.where(F.col(f"`{d.dim_column}`").isNotNull())
        .groupBy(F.col(f"`{d.dim_column}`").cast("string").alias("key"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .where(F.col("rows") > 1)
        .select(F.lit(d.name).alias("dim"), "key", "rows")
        for d in dims
    ]
    return reduce(DataFrame.unionByName, parts)


def k_table_name(fact_name: str) -> str:
    return fact_name.replace("_fact", "_k")


def k_table(fact: DataFrame, dims: list[DimensionJoin], allow_duplicates: bool = False) -> DataFrame:
    """Fact with every column of every dimension as ``<dim>_<column>``, by left joins.

    Spark broadcasts a dimension when its measured size is under the session's threshold and shuffles
    it otherwise, splitting skewed keys at run time. Keys that repeat in a dimension would multiply fact
    rows: they raise an error unless allowed.
    """
    if dims and not allow_duplicates and not duplicate_keys(dims).isEmpty():
        raise ValueError("a dimension key is not unique; pass allow_duplicates=True to join anyway")
    wide = fact
    for d in dims:
        prefixed = d.df.select(*[F.col(f"`{c}`").alias(f"{d.name}_{c}") for c in d.df.columns])
        wide = wide.join(prefixed, F.col(f"`{d.fact_column}`") == F.col(f"`{d.name}_{d.dim_column}`"), "left")
    return wide


def one_big_table(fact: DataFrame, dims: list[DimensionJoin], day_column: str | None = None,
                  calendar: DataFrame | None = None, allow_duplicates: bool = False) -> DataFrame:
    """A fact with the columns of its dimensions under their own names, and the calendar of one of its days.

    Left joins keep every fact row. A column that the fact or an earlier dimension has already is not repeated. The
    calendar is joined on the day of ``day_column``.
    """
    joins = list(dims)
    if calendar is not None:
        fact = fact.withColumn("_day", F.col(f"`{day_column}`").cast("date"))
        joins.insert(0, DimensionJoin("calendar", calendar, "_day", "calendar_date"))
    if joins and not allow_duplicates and not duplicate_keys(joins).isEmpty():
        raise ValueError("a dimension key is not unique; pass allow_duplicates=True to join anyway")
    wide = fact
    for d in joins:
        new = [c for c in d.df.columns if c not in wide.columns]
        side = d.df.select(F.col(f"`{d.dim_column}`").alias("_key"), *[F.col(f"`{c}`") for c in new])
        wide = wide.join(side, F.col(f"`{d.fact_column}`") == F.col("_key"), "left").drop("_key")
    return wide.drop("_day")
