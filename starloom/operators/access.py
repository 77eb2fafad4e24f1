"""Read-only queries over the gold tables."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession

GOLD = "gold"


class QueryRejected(ValueError):
    """The text is no plain query, or it reads something that is no gold table."""


def _items(seq: Any) -> list[Any]:
    return [seq.apply(i) for i in range(seq.size())]


def _nodes(plan: Any) -> Iterator[Any]:
    """A plan node, its children and its subqueries; views are not opened."""
    yield plan
    if plan.nodeName() == "View":
        return
    for child in _items(plan.children()):
        yield from _nodes(child)
    for sub in _items(plan.subqueries()):
        yield from _nodes(sub)


def _is_command(spark: SparkSession, node: Any) -> bool:
    classes = spark._jvm.java.lang.Class
    package = "org.apache.spark.sql.catalyst.plans.logical."
    loader = spark._jvm.java.lang.Thread.currentThread().getContextClassLoader()
    return any(
        classes.forName(package + name, True, loader).isInstance(node) for name in ("Command", "ParsedStatement")
    )


# Functions that gold queries may call. Whatever reads files, the session or the JVM is not among them.
FUNCTIONS = frozenset(
    """abs acos add_months any any_value approx_count_distinct array array_agg array_contains array_distinct array_join
    array_max array_min array_size array_sort ascii asin atan atan2 avg between bit_and bit_or bit_xor bool_and bool_or
    bround btrim cardinality cast cbrt ceil ceiling char char_length character_length coalesce collect_list collect_set concat
    concat_ws contains corr cos count count_if covar_pop covar_samp cume_dist curdate current_date current_timestamp
    date date_add date_diff date_format date_part date_sub date_trunc dateadd datediff day dayname dayofmonth dayofweek dayofyear
    decode dense_rank div double element_at endswith every exists exp extract filter first first_value float floor forall
    format_number format_string get greatest grouping grouping_id hour if ifnull ilike in initcap instr int isnan isnotnull isnull
    kurtosis lag last last_day last_value lcase lead least left len length levenshtein like ln locate log log10 log2 lower lpad ltrim
    make_date map map_keys map_values max max_by mean median min min_by minute mod mode month monthname months_between named_struct
    negative next_day not now nth_value ntile nullif nvl nvl2 percent_rank percentile percentile_approx pmod position positive pow
    power quarter rank regexp_count regexp_extract regexp_like regexp_replace regr_count regr_r2 regr_slope repeat replace reverse
    right rint rlike round row_number rpad rtrim second sequence sign signum sin size skewness slice some sort_array split split_part
    sqrt startswith std stddev stddev_pop stddev_samp string struct substr substring substring_index sum tan timestamp timestamp_diff
    to_char to_date to_number to_timestamp transform translate trim trunc try_add try_avg try_cast try_divide try_multiply try_subtract
    try_sum ucase upper var_pop var_samp variance weekday weekofyear when width_bucket year""".split()
)


def _parsed_nodes(plan: Any) -> Iterator[Any]:
    """A parsed plan node with everything below it: children, subqueries and named queries."""
    yield plan
    for part in (*_items(plan.children()), *_items(plan.innerChildren())):
        yield from _parsed_nodes(part)


def _functions(expression: Any) -> Iterator[str]:
    """Names of the functions that an expression of a parsed plan calls."""
    if expression.getClass().getSimpleName() == "UnresolvedFunction":
        yield ".".join(_items(expression.nameParts())).lower()
    for child in _items(expression.children()):
        yield from _functions(child)


def _check_plain_query(spark: SparkSession, sql: str) -> None:
    """Parsing alone runs nothing, so commands and functions off the list are found before they can act."""
    parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    nodes = list(_parsed_nodes(parsed))
    if any(_is_command(spark, node) for node in nodes):
        raise QueryRejected("Only SELECT queries are allowed. DML/DDL operations are not permitted.")
    called = {name for node in nodes for part in _items(node.expressions()) for name in _functions(part)}
    if refused := sorted(called - FUNCTIONS):
        raise QueryRejected(f"Query calls functions that are not allowed: {', '.join(refused)}.")


def tables_read(df: DataFrame) -> set[tuple[str, str]]:
    """(database, table) of everything a query reads; database '' for views of the session."""
    found: set[tuple[str, str]] = set()
    for node in _nodes(df._jdf.queryExecution().analyzed()):
        name = node.nodeName()
        if name == "View":
            ident = node.desc().identifier()
        elif _items(node.children()) or name in ("OneRowRelation", "CTERelationRef", "LocalRelation"):
            continue
        elif name.startswith("LogicalRelation") and node.catalogTable().isDefined():
            ident = node.catalogTable().get().identifier()
        else:
            found.add(("", f"<{name}>"))
            continue
        database = ident.database()
        found.add((database.get() if database.isDefined() else "", ident.table().lower()))
    return found


def gold_query(spark: SparkSession, sql: str, gold_tables: set[str], limit: int | None = None) -> DataFrame:
    """Lazy result of a SELECT (WITH included) over gold tables only, with functions of FUNCTIONS only.

    The parsed and the analysed plan are read through the session's JVM, so this needs a classic session.
    """
    _check_plain_query(spark, sql)
    df = spark.sql(sql)
    allowed = {name.lower() for name in gold_tables}
    foreign = sorted(
        ".".join(part for part in (database, table) if part)
        for database, table in tables_read(df)
        if table not in allowed or database not in ("", GOLD)
    )
    if foreign:
        raise QueryRejected(
            f"Query references tables not in gold schema: {', '.join(foreign)}. "
            f"Available tables: {', '.join(sorted(allowed))}"
        )
    return df if limit is None else with_limit(df, limit)


def with_limit(df: DataFrame, n: int) -> DataFrame:
    """At most n rows; a smaller limit inside the query stays in force."""
    return df.limit(n)
