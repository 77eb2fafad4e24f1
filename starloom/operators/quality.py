"""Quality assessment over a catalog profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Issue types and their severities.
SEVERITIES = {
    "high_nulls": "high",
    "low_cardinality": "medium",
    "poor_quality": "high",
    "potential_primary_key": "low",
}
SEVERITY_RANK = {"high": 0, "medium": 1, "low": 2}


def _issue(kind: str, condition: Column, message: Column) -> Column:
    found = F.struct(F.lit(kind).alias("type"), F.lit(SEVERITIES[kind]).alias("severity"), message.alias("message"))
    return F.when(condition, found)


def issue_conditions() -> dict[str, Column]:
    nulls, card = F.col("null_percentage"), F.col("cardinality")
    dimension = F.col("classification") == "dimension"
    return {
        "high_nulls": nulls > 50,
        "low_cardinality": dimension & (card < 10),
        "poor_quality": F.col("data_quality_score") < 0.3,
        "potential_primary_key": dimension & ~F.col("is_primary_key_candidate") & (card > 100) & (nulls < 5),
    }


def column_issues(profile: DataFrame) -> DataFrame:
    """One row per issue of a column; one pass, no shuffle."""
    name, when = F.col("column_name"), issue_conditions()
    # Message texts.
    messages = {
        "high_nulls": F.format_string("Column %s has %.1f%% null values", name, F.col("null_percentage")),
        "low_cardinality": F.format_string(
            "Dimension column %s has very low cardinality (%d)", name, F.col("cardinality")
        ),
        "poor_quality": F.format_string(
            "Column %s has very low quality score (%.2f)", name, F.col("data_quality_score")
        ),
        "potential_primary_key": F.format_string("Column %s might be a good primary key candidate", name),
    }
    found = F.array_compact(F.array(*[_issue(kind, when[kind], messages[kind]) for kind in SEVERITIES]))
    return profile.select("table_name", "column_name", F.inline(found))


def severity_rank(severity: Column) -> Column:
    rank = F.lit(len(SEVERITY_RANK))
    for name, place in SEVERITY_RANK.items():
        rank = F.when(severity == name, place).otherwise(rank)
    return rank


def ordered_issues(profile: DataFrame) -> DataFrame:
    """All issues, most severe first."""
    return column_issues(profile).orderBy(severity_rank(F.col("severity")), "table_name", "column_name", "type")


def _issue_count() -> Column:
    return sum((F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0) for c in issue_conditions().values()), F.lit(0))


def table_quality(profile: DataFrame) -> DataFrame:
    """Mean column score, issue count and quality band of each table."""
    scored = profile.groupBy("table_name").agg(
        F.avg("data_quality_score").alias("score"),
        F.count(F.lit(1)).alias("column_count"),
        F.max("row_count").alias("row_count"),
        F.sum(_issue_count()).alias("issue_count"),
    )
    band = F.when(F.col("score") > 0.8, "high").when(F.col("score") > 0.5, "medium").otherwise("low")
    return scored.withColumn("band", band)


def catalog_quality(profile: DataFrame) -> DataFrame:
    """One row: overall mean of table scores, tables per band, issues per severity."""
    kinds = issue_conditions()
    per_table = profile.groupBy("table_name").agg(
        F.avg("data_quality_score").alias("score"),
        *[F.count_if(condition).alias(kind) for kind, condition in kinds.items()],
    )
    score = F.col("score")
    return per_table.agg(
        F.coalesce(F.avg(score), F.lit(0.0)).alias("overall_score"),
        F.count(F.lit(1)).alias("total_tables"),
        F.count_if(score > 0.8).alias("high_quality_tables"),
        F.count_if((score > 0.5) & (score <= 0.8)).alias("medium_quality_tables"),
        F.count_if(score <= 0.5).alias("low_quality_tables"),
        *[F.coalesce(F.sum(kind), F.lit(0)).alias(f"{kind}_issues") for kind in kinds],
    )


def recommendations(profile: DataFrame) -> DataFrame:
    """Advice that follows from the catalog score and the issue counts."""
    report = catalog_quality(profile)
    found = F.col

    def advice(condition: Column, kind: str, priority: str, title: str, text: Column, actions: list[str]) -> Column:
        return F.when(
            condition,
            F.struct(
                F.lit(kind).alias("type"),
                F.lit(priority).alias("priority"),
                F.lit(title).alias("title"),
                text.alias("description"),
                F.array(*[F.lit(a) for a in actions]).alias("actions"),
            ),
        )

    # Titles, descriptions and actions.
    rules = F.array(
        advice(
            found("overall_score") < 0.5, "overall_quality", "high", "Improve Overall Data Quality",
            F.lit("The overall data quality is low. Focus on addressing null values and data completeness."),
            ["Review and fix null value patterns", "Implement data validation rules",
             "Consider data cleansing processes"],
        ),
        advice(
            found("high_nulls_issues") > 0, "null_values", "high", "Address High Null Percentages",
            F.format_string("Found %d columns with high null percentages.", found("high_nulls_issues")),
            ["Investigate null value patterns", "Consider default values or data imputation",
             "Review data collection processes"],
        ),
        advice(
            found("potential_primary_key_issues") > 0, "primary_keys", "medium", "Review Primary Key Candidates",
            F.format_string("Found %d potential primary key candidates.", found("potential_primary_key_issues")),
            ["Validate primary key candidates", "Implement proper primary keys", "Review table relationships"],
        ),
        advice(
            found("low_cardinality_issues") > 0, "cardinality", "medium", "Review Low Cardinality Columns",
            F.format_string("Found %d columns with very low cardinality.", found("low_cardinality_issues")),
            ["Review if low cardinality is expected", "Consider data aggregation strategies",
             "Validate data collection completeness"],
        ),
    )
    return report.select(F.inline(F.array_compact(rules)))
