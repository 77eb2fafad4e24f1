"""Relationship discovery: by column names over the profile, by shared values over the data.

Shared values, the heavy job, take one large shuffle. Rows become (join family, value) with one bit per
source column; a partial OR collapses repeated values inside each task, so hot values cost nothing
extra. Equal bit patterns are then counted *before* any column pair is formed, and a bound on what a column can still
share decides which patterns form pairs at all.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from starloom.functions.names import storage_type_name, type_family, types_compatible
from starloom.operators.profile import (
    COLUMN_KEY,
    Tables,
    column_catalog,
    erd_rules,
    table_types,
)
from starloom.session import cut_lineage

BITS = 62  # columns per bit mask
HIGH_CONFIDENCE = 0.7
PAIR_KEY = ["table1", "column1", "table2", "column2"]


def primary_keys(profile: DataFrame) -> DataFrame:
    return profile.where("is_primary_key_candidate")


def _side(profile: DataFrame, number: int) -> DataFrame:
    return profile.select(
        F.lower("column_name").alias("_name"),
        F.struct("table_name", "position").alias(f"_ord{number}"),
        F.col("table_name").alias(f"table{number}"),
        F.col("column_name").alias(f"column{number}"),
        F.col("type_name").alias(f"type{number}"),
        F.col("cardinality").alias(f"cardinality{number}"),
        F.col("is_primary_key_candidate").alias(f"is_pk{number}"),
    )


def join_confidence() -> Column:
    """Score of a same-named pair from types, key roles and closeness of distinct counts."""
    c1, c2 = F.col("cardinality1"), F.col("cardinality2")
    both, one = F.col("is_pk1") & F.col("is_pk2"), F.col("is_pk1") | F.col("is_pk2")
    closeness = F.when((c1 > 0) & (c2 > 0), F.least(c1, c2) / F.greatest(c1, c2)).otherwise(0.0)
    score = (
        0.3
        + F.when(types_compatible(F.col("type1"), F.col("type2")), 0.2).otherwise(0.0)
        + F.when(both, 0.3).when(one, 0.15).otherwise(0.0)
        + closeness * 0.2
    )
    return F.least(score, F.lit(1.0))


def relationship_type_by_pk(both_keys: str = "many_to_many") -> Column:
    """``both_keys``: many_to_many for name matching, one_to_one for typed tables."""
    both, one = F.col("is_pk1") & F.col("is_pk2"), F.col("is_pk1") | F.col("is_pk2")
    return F.when(both, both_keys).when(one, "one_to_many").otherwise("many_to_many")


def join_candidates_by_name(profile: DataFrame, both_keys: str = "many_to_many") -> DataFrame:
    """Pairs of same-named columns with compatible types (profile-sized equi-join)."""
    pairs = _side(profile, 1).join(_side(profile, 2), "_name").where(F.col("_ord1") < F.col("_ord2"))
    return pairs.where(types_compatible(F.col("type1"), F.col("type2"))).select(
        *PAIR_KEY, "type1", "type2", "cardinality1", "cardinality2", "is_pk1", "is_pk2",
        join_confidence().alias("confidence"),
        relationship_type_by_pk(both_keys).alias("relationship_type"),
    )


def foreign_key_candidates(candidates: DataFrame) -> DataFrame:
    """Confident pairs as references: the side that is no key points to the key side."""
    first_is_target = F.col("is_pk1") & ~F.col("is_pk2")
    sure = candidates.where((F.col("confidence") > HIGH_CONFIDENCE) & (F.col("is_pk1") | F.col("is_pk2")))

    def pick(then: str, other: str) -> Column:
        return F.when(first_is_target, F.col(then)).otherwise(F.col(other))

    return sure.select(
        pick("table2", "table1").alias("foreign_key_table"),
        pick("column2", "column1").alias("foreign_key_column"),
        pick("table1", "table2").alias("referenced_table"),
        pick("column1", "column2").alias("referenced_column"),
        "confidence",
        F.when(F.col("is_pk1") & F.col("is_pk2"), "many_to_many").otherwise("one_to_many").alias("relationship_type"),
    )


def relationship_report(candidates: DataFrame) -> DataFrame:
    """Counts of join and foreign-key candidates."""
    is_reference = (F.col("confidence") > HIGH_CONFIDENCE) & (F.col("is_pk1") | F.col("is_pk2"))
    return candidates.agg(
        F.count(F.lit(1)).alias("join_candidates"),
        F.count_if(F.col("confidence") > HIGH_CONFIDENCE).alias("high_confidence_joins"),
        F.count_if(is_reference).alias("foreign_key_candidates"),
    )


def relationship_list(candidates: DataFrame) -> DataFrame:
    """Join and foreign-key candidates in one listing."""
    joins = candidates.select(F.lit("join").alias("kind"), *PAIR_KEY, "confidence", "relationship_type")
    references = foreign_key_candidates(candidates).select(
        F.lit("foreign_key").alias("kind"),
        F.col("foreign_key_table").alias("table1"),
        F.col("foreign_key_column").alias("column1"),
        F.col("referenced_table").alias("table2"),
        F.col("referenced_column").alias("column2"),
        "confidence",
        "relationship_type",
    )
    return joins.unionByName(references)


# ---- shared values -----------------------------------------------------------------------------


def _candidate_columns(tables: Tables, ignore: list[str]) -> list[tuple[int, str, str, str]]:
    """(cid, table, column, family) of columns that can have a partner in another table at all."""
    ignored = {name.lower() for name in ignore}
    catalog, cid = [], 0
    for table, df in tables.items():
        for field in df.schema:
            family = type_family(storage_type_name(field.dataType))
            if field.name.lower() not in ignored:
                catalog.append((cid, table, field.name, family))
            cid += 1
    spread: dict[str, set[str]] = {}
    for _, table, _, family in catalog:
        spread.setdefault(family, set()).add(table)
    return [entry for entry in catalog if len(spread[entry[3]]) > 1]


def canonical_number(number: Column, decimal: T.DecimalType | None = None) -> Column:
    """One text for equal numbers of any numeric type: whole ones without fraction or exponent, else the shortest form.

    ``decimal``: the column's type if it is one; such numbers take the text of the equal double where there is one.
    """
    whole, rest = _whole_and_rest(number, decimal)
    return F.coalesce(whole.cast("string"), rest)


def _whole_and_rest(number: Column, decimal: T.DecimalType | None) -> tuple[Column, Column]:
    """A whole number as bigint, or else a text; the other one is NULL."""
    whole = (number == F.floor(number)) & (F.abs(number) < 1e18)
    shortest = number.cast("string")
    if decimal is not None:
        double = number.cast("double")
        same = double.cast("string").try_cast(decimal) == number
        shortest = F.when(same, double.cast("string")).otherwise(F.regexp_replace(shortest, r"(\.[0-9]*?)0+$", "$1"))
    return F.when(whole, number.cast("bigint")), F.when(whole, F.lit(None)).otherwise(shortest)


def _comparable(df: DataFrame, name: str, family: str) -> tuple[Column, Column]:
    """A cell as (bigint, text), one of them set where the cell is; equal cells of a family have equal pairs."""
    column, kind = F.col(f"`{name}`"), df.schema[name].dataType
    none = F.lit(None)
    if family != "numeric":
        return none.cast("bigint"), column.cast("string")
    if isinstance(kind, (T.BooleanType, T.IntegralType)):
        return (column.cast("int") if isinstance(kind, T.BooleanType) else column).cast("bigint"), none.cast("string")
    return _whole_and_rest(column, None)


@dataclass(frozen=True)
class Signatures:
    """Stored bit patterns of the values of tables, and plain counts; all small against the data.

    ``patterns``: (n, members), how many distinct values lie in exactly these columns; ``nulls``: (cid, n); ``rows``: (table
    number, n). ``table_of`` and ``eligible`` are by cid: the column's table number, and whether it may pair at all.
    """

    patterns: DataFrame
    nulls: DataFrame
    rows: DataFrame
    table_of: list[int]
    eligible: list[bool]


def value_signatures(tables: Tables, ignore: list[str] | None = None, every: bool = False) -> Signatures:
    """Bit patterns of all values, from one scan of each table and one large shuffle, of two 64-bit hashes a value.

    ``every``: index columns without a possible partner too, for their counts.
    """
    candidates = {cid: family for cid, _, _, family in _candidate_columns(tables, ignore or [])}
    table_of = [k for k, df in enumerate(tables.values()) for _ in df.columns]
    kinds = [storage_type_name(f.dataType) for df in tables.values() for f in df.schema]
    shown = [cid for cid in range(len(table_of)) if every or cid in candidates]
    bit = {cid: i for i, cid in enumerate(shown)}
    words = max(1, -(-len(shown) // BITS))
    masks = [f"mask_{w}" for w in range(words)]
    families = {family: i for i, family in enumerate(sorted({type_family(k) for k in kinds}))}
    none = [F.lit(None).cast("bigint"), F.lit(None).cast("string")]

    def cell(family: Column, whole: Column, rest: Column, at: int | None) -> Column:
        own = [F.lit(1 << (at % BITS) if at is not None and at // BITS == w else 0).cast("bigint").alias(m) for w, m in enumerate(masks)]
        return F.struct(family.alias("family"), whole.alias("whole"), rest.alias("rest"), *own)

    parts, cid = [], 0
    for number, df in enumerate(tables.values()):
        cells = [cell(F.lit(-1 - number), *none, None)]  # one for every row
        for field in df.schema:
            if cid in bit:
                family = type_family(kinds[cid])
                whole, rest = _comparable(df, field.name, family)
                known = F.lit(families[family])
                cells.append(cell(F.when(F.col(f"`{field.name}`").isNull(), F.lit(None)).otherwise(known), whole, rest, bit[cid]))
            cid += 1
        parts.append(df.select(F.inline(F.array(*cells))))
    keyed = reduce(DataFrame.unionByName, parts).withColumn("known", F.col("family") >= 0)
    # rows and NULLs are counted under their own keys: NULLs by their column's bit, rows by their table
    h1 = F.when(F.col("known"), F.xxhash64("whole", "rest")).otherwise(F.xxhash64(*masks))
    h2 = F.when(F.col("known"), F.xxhash64(F.lit(1), "whole", "rest")).otherwise(F.lit(0))
    keyed = keyed.select("family", h1.alias("h1"), h2.alias("h2"), *masks)
    per_value = keyed.groupBy("family", "h1", "h2").agg(*[F.bit_or(m).alias(m) for m in masks], F.count(F.lit(1)).alias("cnt"))
    plain = F.when(F.col("family") >= 0, F.lit(0)).otherwise(F.coalesce("family", F.lit(1)))  # 0 values, 1 NULLs, else rows of a table
    counted = F.sum(F.when(F.col("family") >= 0, F.lit(1)).otherwise(F.col("cnt")))
    stored = cut_lineage(per_value.groupBy(plain.alias("kind"), *masks).agg(counted.alias("n")).select("kind", "n", _members(shown).alias("members")))
    return Signatures(
        stored.where("kind = 0").select("n", "members"),
        stored.where("kind = 1").select(F.col("members")[0].alias("cid"), "n"),
        stored.where("kind < 0").select((-1 - F.col("kind")).alias("number"), "n"),
        table_of, [c in candidates for c in range(len(table_of))],
    )


def _members(shown: list[int]) -> Column:
    """Column ids of the set bits of a signature, ascending."""
    flags = [
        F.when(F.col(f"mask_{i // BITS}").bitwiseAND(F.lit(1 << (i % BITS))) != 0, F.lit(cid)) for i, cid in enumerate(shown)
    ]
    return F.array_compact(F.array(*flags))


def cardinalities(found: Signatures) -> DataFrame:
    """(cid, cardinality) of the indexed columns that hold a value."""
    return found.patterns.select("n", F.explode("members").alias("cid")).groupBy("cid").agg(F.sum("n").alias("cardinality"))


def signature_statistics(tables: Tables, found: Signatures) -> DataFrame:
    """Row, NULL and distinct counts per column, read off the signatures."""
    numbers = F.array(*[F.lit(t) for t in found.table_of])
    stats = column_catalog(tables).withColumn("number", F.element_at(numbers, F.col("cid") + 1))
    stats = stats.join(found.rows.withColumnRenamed("n", "row_count"), "number", "left")
    stats = stats.join(found.nulls.withColumnRenamed("n", "null_count"), "cid", "left").join(cardinalities(found), "cid", "left")
    return stats.drop("number").withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("row_count", "null_count", "cardinality")})


def contained_pairs(found: Signatures, threshold: float) -> DataFrame:
    """(cid1, cid2, overlap_count) of columns of different tables that share at least ``threshold`` of the smaller one's values.

    Patterns are ordered by how many columns of other tables they hold. A smaller column has to share that much mass with
    its partner, so from the point of the order where less than that remains, no new partner can appear: only the patterns
    before it (few columns each) form pairs. A pair ends there, too, if what it shares so far and all that remains stay
    below the bar. Overlaps are then summed for the remaining pairs only. With threshold 0 every pattern forms pairs.
    """
    bar = threshold * (1 - 1e-9)  # callers compare shares, which may round the other way
    tables, able = F.array(*[F.lit(t) for t in found.table_of]), F.array(*[F.lit(e) for e in found.eligible])

    def of(values: Column, cid: Column) -> Column:
        return F.element_at(values, cid + 1)

    patterns = found.patterns.withColumn("members", F.filter("members", lambda m: of(able, m)))
    each = patterns.select("n", "members", F.explode("members").alias("cid1"))
    each = each.withColumn("partners", F.filter("members", lambda m: of(tables, m) != of(tables, F.col("cid1"))))
    each = each.withColumn("width", F.size("partners")).where("width > 0").select("n", "cid1", "partners", "width")
    cards = cardinalities(found)
    mass = each.groupBy("cid1", "width").agg(F.sum("n").alias("n"))
    left = F.sum("n").over(Window.partitionBy("cid1").orderBy(F.desc("width")))  # the mass of this width and all greater ones
    mass = mass.withColumn("left", left).join(cards.withColumnsRenamed({"cid": "cid1", "cardinality": "card1"}), "cid1")
    short = F.col("left") < F.col("card1") * bar
    ends = mass.groupBy("cid1", "card1").agg(
        F.coalesce(F.min(F.when(short, F.col("width"))), F.lit(len(found.table_of) + 1)).alias("end"),
        F.coalesce(F.max(F.when(short, F.col("left"))), F.lit(0)).alias("rest"),
    )
    first = each.join(ends, "cid1").where("width < end").select("n", "cid1", "card1", "rest", F.explode("partners").alias("cid2"))
    first = first.groupBy("cid1", "cid2", "card1", "rest").agg(F.sum("n").alias("shared"))
    first = first.where(F.col("shared") + F.col("rest") >= F.col("card1") * bar)
    larger = cards.withColumnsRenamed({"cid": "cid2", "cardinality": "card2"})
    open_pairs = first.join(larger, "cid2").where("card1 < card2 or (card1 = card2 and cid1 < cid2)")
    wanted = open_pairs.groupBy("cid1", "card1").agg(F.collect_set("cid2").alias("wanted"))
    shared = each.join(wanted, "cid1").select("n", "cid1", "card1", F.explode(F.array_intersect("partners", "wanted")).alias("cid2"))
    total = shared.groupBy("cid1", "cid2", "card1").agg(F.sum("n").alias("overlap_count"))
    kept = total.where(F.col("overlap_count") >= F.col("card1") * bar)
    return kept.select(F.least("cid1", "cid2").alias("cid1"), F.greatest("cid1", "cid2").alias("cid2"), "overlap_count")


def value_overlaps(tables: Tables, ignore: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Distinct counts (cid, cardinality) and shared distinct values (cid1, cid2, overlap_count) of different tables' columns.

    Both come from one stored signature frame, so the data is read and shuffled once.
    """
    found = value_signatures(tables, ignore)
    return cardinalities(found), contained_pairs(found, 0.0)


def relationship_type_by_data() -> Column:
    covered = F.col("overlap_count") == F.least("cardinality1", "cardinality2")
    both = F.col("is_pk1") & F.col("is_pk2")
    return F.when(both & covered, "one_to_one").when(covered, "one_to_many").otherwise("many_to_many")


def join_candidates_by_overlap(tables: Tables, threshold: float = 0.8, ignore: list[str] | None = None) -> DataFrame:
    """Column pairs of different tables whose smaller value set lies (mostly) inside the other one.

    Confidence is the share of the smaller distinct set that is shared. Counts, key roles and classes fall out of the
    same signatures: one scan and one large shuffle in all.
    """
    if not _candidate_columns(tables, ignore or []):
        raise ValueError("no two tables have columns of comparable types")
    return _linked_columns(tables, value_signatures(tables, ignore), threshold)


def _linked_columns(tables: Tables, found: Signatures, threshold: float) -> DataFrame:
    stats = signature_statistics(tables, found)
    info = erd_rules(stats).join(column_catalog(tables).select("cid", *COLUMN_KEY), COLUMN_KEY)

    def side(i: int) -> DataFrame:
        return info.select(
            F.col("cid").alias(f"cid{i}"),
            F.col("table_name").alias(f"table{i}"),
            F.col("column_name").alias(f"column{i}"),
            F.col("type_name").alias(f"type{i}"),
            F.col("cardinality").alias(f"cardinality{i}"),
            F.col("is_primary_key_candidate").alias(f"is_pk{i}"),
            F.col("classification").alias(f"classification{i}"),
        )

    pairs = contained_pairs(found, threshold).join(side(1), "cid1").join(side(2), "cid2")
    confidence = F.col("overlap_count") / F.least("cardinality1", "cardinality2")
    useful = (
        (F.col("table1") != F.col("table2"))
        & (F.col("cardinality1") >= 2)
        & (F.col("cardinality2") >= 2)
        & (confidence >= threshold)
    )
    return pairs.where(useful).select(
        *PAIR_KEY, "type1", "type2", "cardinality1", "cardinality2", "is_pk1", "is_pk2",
        "classification1", "classification2", "overlap_count",
        F.round(confidence * 100, 2).alias("overlap_percentage"),
        F.round(confidence, 4).alias("join_confidence"),
        relationship_type_by_data().alias("relationship_type"),
    )


# ---- ERD ---------------------------------------------------------------------------------------


def erd_summary(profile: DataFrame, relationships: DataFrame) -> DataFrame:
    """One row: tables by type, key candidates, relationships and how many are confident."""
    kinds = table_types(profile).agg(
        F.count(F.lit(1)).alias("total_tables"),
        F.count_if(F.col("table_type") == "fact").alias("fact_tables"),
        F.count_if(F.col("table_type") == "dimension").alias("dimension_tables"),
    )
    keys = profile.agg(F.count_if("is_primary_key_candidate").alias("n"))
    links = relationships.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("join_confidence") > HIGH_CONFIDENCE).alias("sure")
    )
    return kinds.withColumns(
        {
            "primary_key_candidates": keys.scalar(),
            "total_relationships": links.select("total").scalar(),
            "high_confidence_relationships": links.select("sure").scalar(),
        }
    )


def _listed(condition: Column) -> Column:
    entry = F.when(condition, F.struct("position", "column_name"))
    return F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["column_name"])


def erd_table_rows(profile: DataFrame, relationships: DataFrame, schema_name: str = "silver") -> DataFrame:
    """One row per table: type, key, fact and dimension columns, and its relationships as text."""
    tables = profile.groupBy("table_name").agg(
        _listed(F.col("is_primary_key_candidate")).alias("primary_key_candidates"),
        _listed(F.col("classification") == "fact").alias("fact_columns"),
        _listed(F.col("classification") == "dimension").alias("dimension_columns"),
    )
    link = F.format_string("%s.%s = %s.%s", *[F.col(c) for c in PAIR_KEY])
    links = (
        relationships.select(F.explode(F.array("table1", "table2")).alias("table_name"), link.alias("link"))
        .groupBy("table_name")
        .agg(F.array_sort(F.collect_list("link")).alias("relationships"))
    )
    return (
        table_types(profile)
        .select("table_name", "table_type", "row_count", "column_count")
        .join(tables, "table_name")
        .join(links, "table_name", "left")
        .withColumns(
            {
                "relationships": F.coalesce("relationships", F.array().cast("array<string>")),
                "schema_name": F.lit(schema_name),
            }
        )
    )


def analyze_erd(tables: Tables, threshold: float = 0.8, schema_name: str = "silver",
                ignore: list[str] | None = None) -> dict[str, DataFrame]:
    """Profile, relationships, table rows and summary of one schema, from one scan and one large shuffle.

    Profile and relationships have one row per column and per link; both are stored because several of
    the results read them.
    """
    found = value_signatures(tables, ignore, every=True)
    profile = cut_lineage(erd_rules(signature_statistics(tables, found)))
    relationships = cut_lineage(_linked_columns(tables, found, threshold))
    return {
        "profile": profile,
        "relationships": relationships,
        "tables": erd_table_rows(profile, relationships, schema_name),
        "summary": erd_summary(profile, relationships),
    }


def adjacent_cardinality_links(profile: DataFrame, min_confidence: float = 0.5, limit: int | None = None) -> DataFrame:
    """Neighbouring dimension columns of a table in order of distinct counts; with ``limit`` a top report."""
    order = Window.partitionBy("table_name").orderBy("cardinality", "position")
    dims = profile.where(F.col("classification") == "dimension").select(
        "table_name",
        F.col("column_name").alias("column1"),
        F.lead("column_name").over(order).alias("column2"),
        F.col("cardinality").alias("parent_cardinality"),
        F.lead("cardinality").over(order).alias("child_cardinality"),
    )
    closeness = F.coalesce(
        F.try_divide(
            F.least("parent_cardinality", "child_cardinality"), F.greatest("parent_cardinality", "child_cardinality")
        ),
        F.lit(0.0),
    )
    links = (
        dims.where(F.col("column2").isNotNull())
        .select("table_name", "column1", "column2", F.lit("hierarchy").alias("relationship_type"),
                closeness.alias("confidence"), "parent_cardinality", "child_cardinality")
        .where(F.col("confidence") >= min_confidence)
        .orderBy(F.col("confidence").desc(), "table_name", "column1")
    )
    return links if limit is None else links.limit(limit)


def common_column_links(profile: DataFrame) -> DataFrame:
    """Table pairs that share column names, with the shared names."""
    names = profile.select("table_name", F.lower("column_name").alias("name")).distinct()
    left = names.withColumnRenamed("table_name", "table1")
    right = names.withColumnRenamed("table_name", "table2")
    shared = left.join(right, "name").where(F.col("table1") < F.col("table2"))
    return shared.groupBy("table1", "table2").agg(
        F.array_sort(F.collect_set("name")).alias("columns"),
        F.lit("one_to_many").alias("relationship_type"),
        F.lit(0.7).alias("confidence"),
    )


def validate_relationships(entities: DataFrame, links: DataFrame) -> DataFrame:
    """Links to unknown tables are errors, tables without any link warnings."""
    known = entities.select("table_name").distinct()
    used = links.select(F.explode(F.array("table1", "table2")).alias("table_name")).distinct()
    missing = used.join(known, "table_name", "left_anti").select(
        F.lit("error").alias("severity"), F.lit("missing_entity").alias("finding"), "table_name"
    )
    orphaned = known.join(used, "table_name", "left_anti").select(
        F.lit("warning").alias("severity"), F.lit("orphaned_entity").alias("finding"), "table_name"
    )
    return missing.unionByName(orphaned)


def edit_relationships(stored: DataFrame, edits: DataFrame) -> DataFrame:
    """Append edits as new versions. ``edits``: pair key, confidence, type, ``action`` (set or remove)."""
    from starloom.operators.versioned import next_versions

    return next_versions(stored, edits.withColumn("removed", F.col("action") == "remove").drop("action"), PAIR_KEY)


def current_relationships(stored: DataFrame) -> DataFrame:
    """Latest version of every link without the removed ones."""
    from starloom.operators.versioned import latest_by_key

    return latest_by_key(stored, PAIR_KEY, "version").where(~F.col("removed"))
