"""Type inference on text columns: dates by layout, numbers by features, all columns in one job.

Input frames are long: (table_name, column_name, value). Samples are bounded per column, so everything
after the sampling step is metadata-sized.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from starloom.functions.text import strip
from starloom.functions.values import (
    DATE_PATTERNS,
    NUMERIC_PATTERNS,
    loose_number,
    matches_date_pattern,
    numeric_pattern,
    valid_for_pattern,
)
from starloom.operators.ordering import global_position

COLUMN_KEY = ["table_name", "column_name"]
SAMPLE_SIZE = 100
DATE_THRESHOLD = 0.7
NUMERIC_THRESHOLD = 0.7

# Weights of the numeric features (the fifth, a distribution score, is always zero).
NUMERIC_WEIGHTS = {"pattern_ratio": 0.4, "decimal_ratio": 0.2, "range_consistency": 0.2, "length_consistency": 0.1}

# Families of the simple inferer, in tie order.
SIMPLE_FAMILIES = {
    "integer": r"^-?\d+$|^-?\d{1,3}(,\d{3})*$",
    "decimal": r"^-?\d+\.\d+$|^-?\d{1,3}(,\d{3})*\.\d+$",
    "date": r"^\d{4}-\d{2}-\d{2}$|^\d{2}/\d{2}/\d{4}$|^\d{2}-\d{2}-\d{4}$|^\d{8}$",
    "datetime": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$|^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"
    r"|^\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}$",
    "boolean": r"^(true|false|yes|no|1|0|y|n)$",
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "url": r"^https?://[^\s/$.?#].[^\s]*$",
}
SIMPLE_MINIMUM = 0.3


def long_values(df: DataFrame, table: str, columns: list[str] | None = None) -> DataFrame:
    """Unpivot columns to (table_name, column_name, value text)."""
    columns = columns or df.columns
    text = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
    return text.unpivot([], columns, "column_name", "value").select(
        F.lit(table).alias("table_name"), "column_name", "value"
    )


def distinct_values(values: DataFrame) -> DataFrame:
    """All distinct non-blank values of each column."""
    return values.where(F.col("value").isNotNull() & (F.col("value") != "")).dropDuplicates([*COLUMN_KEY, "value"])


def distinct_sample(values: DataFrame, n: int) -> DataFrame:
    """The first n distinct non-blank values of each column, in value order.

    Ranking and the rank filter stay together, so Spark keeps at most n rows per column and task before
    it shuffles; no task ever holds a whole column.
    """
    ranked = distinct_values(values).withColumn("rank", F.row_number().over(Window.partitionBy(*COLUMN_KEY).orderBy("value")))
    return ranked.where(F.col("rank") <= n)


def stride_sample(values: DataFrame, n: int = SAMPLE_SIZE) -> DataFrame:
    """Every (count div n)-th value of each column in value order, n values at most."""
    numbered = global_position(values, ["value"], COLUMN_KEY, "position")
    sizes = numbered.groupBy(*COLUMN_KEY).agg(F.count(F.lit(1)).alias("size"))
    step = F.greatest(F.lit(1), F.floor(F.col("size") / n))
    return (
        numbered.join(sizes, COLUMN_KEY)
        .withColumn("step", step)
        .where((F.pmod(F.col("position") - 1, F.col("step")) == 0) & (F.col("position") - 1 < F.col("step") * n))
        .select(*COLUMN_KEY, "position", "value")
    )


def success_rates(corrections: DataFrame) -> DataFrame:
    """Share of confirmed detections per date layout, from rows (pattern, was_correct)."""
    known = corrections.where(F.col("pattern").isin(list(DATE_PATTERNS)))
    return known.groupBy("pattern").agg(
        F.count_if("was_correct").alias("correct"),
        F.count(F.lit(1)).alias("total"),
        F.avg(F.col("was_correct").cast("double")).alias("success_rate"),
    )


FEATURES = ["dates", "shape", "size", "number", "digits"]

# Least and most characters of a text in each date layout.
DATE_SIZES = {
    "YYYYMMDD": (8, 8),
    "YYYY-MM-DD": (10, 10),
    "MM/DD/YYYY": (8, 10),
    "DD-MM-YYYY": (8, 10),
    "Unix Timestamp": (10, 10),
    "ISO DateTime": (19, 2**31 - 1),
}


def value_features(values: DataFrame, key: list[str]) -> DataFrame:
    """The key columns and what inference needs to know of each value, found once: five numbers of fixed width.

    ``dates``: two bits a layout, has its shape and is a real date of it; ``shape``: number of the numeric shape, from 1, or 0;
    ``size``: characters; ``number``: the value as a number; ``digits``: before the point. All NULL for NULL and empty values.
    """
    text, shape, size = F.col("_text"), F.col("shape"), F.col("size")
    filled = values.select(*key, strip(F.when(F.col("value") != "", F.col("value"))).alias("_text"))
    begun = F.ascii(text).isin([ord(c) for c in "-+.,$%0123456789"])  # numbers begin so, dates with a digit: other texts skip the patterns
    names = F.array(*[F.lit(name) for name in NUMERIC_PATTERNS])
    other = F.coalesce(F.array_position(names, numeric_pattern(text)), F.lit(0)).cast("int")
    plain = F.when(text.contains(".") & text.rlike(NUMERIC_PATTERNS["decimal"]), 1).when(text.rlike(NUMERIC_PATTERNS["integer"]), 2)
    shaped = filled.select(
        *key, "_text", F.length(text).alias("size"),
        F.when(text.isNotNull(), F.when(begun, plain.otherwise(other)).otherwise(0)).cast("int").alias("shape"),
    )
    bits = F.lit(0)
    for i, pattern in enumerate(DATE_PATTERNS):
        possible = size.between(*DATE_SIZES[pattern])
        matched = possible & matches_date_pattern(text, pattern)
        bits = bits + F.when(matched, F.when(valid_for_pattern(text, pattern), 3 << (2 * i)).otherwise(1 << (2 * i))).otherwise(0)
    dated = F.ascii(text).between(48, 57) & (size >= 8) & (shape != 1)  # no layout has a decimal's shape
    digits = F.length(F.regexp_replace(F.substring_index(text, ".", 1), "[^0-9]", ""))
    return shaped.select(
        *key,
        F.when(text.isNotNull(), F.when(dated, bits).otherwise(0)).alias("dates"),
        "shape",
        "size",
        F.when(shape.isin(1, 2), text.try_cast("double")).when(begun, loose_number(text)).alias("number"),
        F.when(shape == 2, size).when(shape == 1, F.instr(text, ".") - 1).otherwise(digits).alias("digits"),
    )


def _date_counts() -> list[Column]:
    """Per layout: values of its shape (_m<i>) and real dates among them (_v<i>)."""
    counts = []
    for i in range(len(DATE_PATTERNS)):
        for name, bit in (("_m", 1 << (2 * i)), ("_v", 2 << (2 * i))):
            counts.append(F.count_if(F.col("dates").bitwiseAND(bit) != 0).alias(f"{name}{i}"))
    return counts


def _rate_map(rates: DataFrame | None) -> Column | None:
    """Success rates as one map value; they have one row per layout, six at most."""
    if rates is None:
        return None
    entries = F.collect_list(F.struct("pattern", "success_rate"))
    return rates.agg(F.map_from_entries(entries).alias("rates")).scalar()


def _date_entries(rates: Column | None) -> Column:
    """Array over the layouts that match at all: confidence, order, pattern, shares."""
    entries = []
    for i, (pattern, (_, base)) in enumerate(DATE_PATTERNS.items()):
        rate = F.lit(0.0) if rates is None else F.coalesce(F.try_element_at(rates, F.lit(pattern)), F.lit(0.0))
        match_ratio = F.col(f"_m{i}") / F.col("n")
        valid_ratio = F.col(f"_v{i}") / F.col(f"_m{i}")
        entries.append(
            F.when(
                F.col(f"_m{i}") > 0,
                F.struct(
                    (base * match_ratio * valid_ratio * (0.8 + 0.2 * rate)).alias("confidence"),
                    F.lit(-i).alias("tie"),
                    F.lit(pattern).alias("pattern"),
                    match_ratio.alias("match_ratio"),
                    valid_ratio.alias("valid_ratio"),
                ),
            )
        )
    return F.array_compact(F.array(*entries))


def date_scores(sample: DataFrame, rates: DataFrame | None = None, key: list[str] | None = None) -> DataFrame:
    """Per column and matching layout: match share, valid share and confidence."""
    key = key or COLUMN_KEY
    counted = value_features(sample, key).groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *_date_counts())
    return counted.select(*key, F.inline(_date_entries(_rate_map(rates)))).drop("tie")


def date_confidence(sample: DataFrame, rates: DataFrame | None = None, key: list[str] | None = None) -> DataFrame:
    """Best layout of each column; the earlier layout wins ties. Columns without any match have NULLs."""
    key = key or COLUMN_KEY
    counted = value_features(sample, key).groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *_date_counts())
    best = F.array_max(_date_entries(_rate_map(rates)))
    return counted.withColumn("_best", best).select(
        *key, F.col("_best.pattern").alias("date_pattern"), F.col("_best.confidence").alias("date_confidence")
    )


def _numeric_counts() -> list[Column]:
    return [
        F.count_if(F.col("shape") > 0).alias("_shaped"),
        F.count_if(F.col("shape") == 1).alias("_decimal"),
        F.stddev_pop("size").alias("_len_std"),
        F.avg("size").alias("_len_avg"),
        F.count("number").alias("_parsed"),
        F.stddev_pop("number").alias("_std"),
        F.avg(F.abs("number")).alias("_scale"),
    ]


def _numeric_features() -> dict[str, Column]:
    spread = F.when(
        (F.col("_parsed") > 1) & (F.col("_std") > 0), 1 / (1 + F.try_divide(F.col("_std"), F.col("_scale")))
    )
    return {
        "pattern_ratio": F.col("_shaped") / F.col("n"),
        "decimal_ratio": F.col("_decimal") / F.col("n"),
        "range_consistency": F.coalesce(spread, F.lit(0.0)),
        "length_consistency": 1 / (1 + F.col("_len_std") / F.greatest(F.lit(1.0), F.col("_len_avg"))),
    }


def numeric_features(sample: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Pattern share, plain-decimal share, range and length consistency of each column."""
    key = key or COLUMN_KEY
    stats = value_features(sample, key).groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *_numeric_counts())
    return stats.select(*key, "n", *[c.alias(name) for name, c in _numeric_features().items()])


def _numeric_score(features: dict[str, Column]) -> Column:
    weighted = F.lit(0.0)
    for feature, weight in NUMERIC_WEIGHTS.items():
        weighted = weighted + features[feature] * weight
    return F.least(F.lit(1.0), weighted)


def numeric_confidence(sample: DataFrame, threshold: float = NUMERIC_THRESHOLD, key: list[str] | None = None) -> DataFrame:
    features = numeric_features(sample, key)
    score = _numeric_score({name: F.col(name) for name in NUMERIC_WEIGHTS})
    scored = features.withColumn("numeric_confidence", score)
    return scored.withColumn("is_numeric", F.col("numeric_confidence") > threshold)


def infer_types(values: DataFrame, rates: DataFrame | None = None, numeric_threshold: float = NUMERIC_THRESHOLD,
                key: list[str] | None = None) -> DataFrame:
    """Type, confidence, layout and reasoning of each column over all given values, from one aggregation.

    NULL and empty values count for nothing; columns without any other value are left out. ``integer_digits``
    is the largest number of digits before the decimal point.
    """
    key = key or COLUMN_KEY
    return types_of_features(value_features(values, key), rates, numeric_threshold, key)


def types_of_features(features: DataFrame, rates: DataFrame | None = None, numeric_threshold: float = NUMERIC_THRESHOLD,
                      key: list[str] | None = None) -> DataFrame:
    """``infer_types`` from the features of the values."""
    key = key or COLUMN_KEY
    counted = features.groupBy(*key).agg(
        F.count("size").alias("n"), *_date_counts(), *_numeric_counts(), F.max("digits").alias("integer_digits"),
    ).where(F.col("n") > 0)
    scored = counted.select(
        *key,
        "integer_digits",
        F.array_max(_date_entries(_rate_map(rates))).alias("_date"),
        _numeric_score(_numeric_features()).alias("_number"),
    )
    date_conf, number_conf = F.coalesce(F.col("_date.confidence"), F.lit(0.0)), F.col("_number")
    is_date = date_conf > DATE_THRESHOLD
    is_number = number_conf > numeric_threshold
    return scored.select(
        *key,
        F.when(is_date, "date").when(is_number, "numeric").otherwise("string").alias("inferred_type"),
        F.when(is_date, date_conf)
        .when(is_number, number_conf)
        .otherwise(F.greatest(F.lit(0.1), 1.0 - F.greatest(date_conf, number_conf)))
        .alias("type_confidence"),
        F.when(is_date, F.col("_date.pattern")).when(is_number, "numeric_measure").alias("pattern"),
        F.when(
            is_date,
            F.format_string("Detected %s date pattern with %.2f confidence", F.col("_date.pattern"), date_conf),
        )
        .when(is_number, F.format_string("Detected numeric pattern with %.2f confidence", number_conf))
        .otherwise(
            F.format_string("No strong pattern detected. Date: %.2f, Numeric: %.2f", date_conf, number_conf)
        )
        .alias("reasoning"),
        "integer_digits",
    )


def infer_types_simple(values: DataFrame) -> DataFrame:
    """Seven-family inference over all non-blank values of each column."""
    stripped = values.select(*COLUMN_KEY, strip(F.col("value")).alias("value")).where(F.col("value") != "")
    value = F.col("value")
    first, size = F.ascii(value), F.length(value)
    digit = first.between(48, 57)
    possible = {  # what every text of the family has: others skip its pattern
        "integer": digit | (first == ord("-")),
        "decimal": (digit | (first == ord("-"))) & value.contains("."),
        "date": digit & size.isin(8, 10),
        "datetime": digit & (size >= 19),
        "boolean": size <= 5,
        "email": value.contains("@"),
        "url": first.isin(ord("h"), ord("H")),
    }
    shares = stripped.groupBy(*COLUMN_KEY).agg(
        *[
            (F.count_if(possible[family] & value.rlike(f"(?i)(?:{shape})")) / F.count(F.lit(1))).alias(family)
            for family, shape in SIMPLE_FAMILIES.items()
        ]
    )
    best = F.array_max(
        F.array(
            *[
                F.struct(F.col(family).alias("share"), F.lit(-i).alias("tie"), F.lit(family).alias("family"))
                for i, family in enumerate(SIMPLE_FAMILIES)
            ]
        )
    )
    scored = shares.withColumn("best", best)
    sure = F.col("best.share") >= SIMPLE_MINIMUM
    return scored.select(
        *COLUMN_KEY,
        F.when(sure, F.col("best.family")).otherwise("string").alias("inferred_type"),
        F.when(sure, F.col("best.share")).otherwise(F.lit(0.0)).alias("confidence"),
    )
