"""Expressions that read typed values out of text: dates, numbers, money, flags.

ANSI mode is on by default, so every cast of source text is a ``try_`` form.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from starloom.functions.text import strip

# Date layouts in the order they are tried, with their base confidence.
DATE_PATTERNS = {
    "YYYYMMDD": (r"^\d{8}$", 0.90),
    "YYYY-MM-DD": (r"^\d{4}-\d{2}-\d{2}$", 0.95),
    "MM/DD/YYYY": (r"^\d{1,2}/\d{1,2}/\d{4}$", 0.90),
    "DD-MM-YYYY": (r"^\d{1,2}-\d{1,2}-\d{4}$", 0.90),
    "Unix Timestamp": (r"^\d{10}$", 0.80),
    "ISO DateTime": (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", 0.95),
}
LAST_EPOCH_SECOND = 4102444800  # 2100-01-01

# Numeric shapes in the order they are tried.
NUMERIC_PATTERNS = {
    "decimal": r"^\d+\.\d+$",
    "integer": r"^\d+$",
    "currency": r"^\$?\d+(?:,\d{3})*(?:\.\d{2})?$",
    "percentage": r"^\d+(?:\.\d+)?%$",
    "scientific": r"^\d+(?:\.\d+)?[eE][+-]?\d+$",
    "negative_number": r"^-\d+(?:\.\d+)?$",
}

# Text read as true by the flag conversion.
TRUE_WORDS = ["true", "1", "yes", "y"]

# Full shape of an ISO date-time, of which the pattern above tests the beginning only.
ISO_DATETIME_FULL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}(:?\d{2}){0,2})?$"
PLAIN_MONEY = r"^-?\d+(\.\d\d?)?$"  # needs no rewriting
NUMBER_SHAPE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def matches_date_pattern(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(DATE_PATTERNS[pattern][0]), F.lit(False))


# How each plain date layout is read: full shape (with the allowed years) and its ISO rearrangement.
# Casting ISO text is much cheaper than a formatter per row, and rejects dates that do not exist.
DATE_READINGS = {
    "YYYYMMDD": (r"^(?:19\d\d|20\d\d|2100)\d{4}$", r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"),
    "YYYY-MM-DD": (r"^(?!0000)\d{4}-\d{2}-\d{2}$", None, None),
    "MM/DD/YYYY": (r"^\d{1,2}/\d{1,2}/(?!0000)\d{4}$", r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$3-$1-$2"),
    "DD-MM-YYYY": (r"^\d{1,2}-\d{1,2}-(?!0000)\d{4}$", r"^(\d{1,2})-(\d{1,2})-(\d{4})$", "$3-$2-$1"),
}


def _iso_date_text(text: Column, reading: str) -> Column:
    shape, taken, iso = DATE_READINGS[reading]
    return F.when(text.rlike(shape), text if taken is None else F.regexp_replace(text, taken, iso))


def date_by_pattern(text: Column, pattern: str) -> Column:
    """The date a text stands for under one layout, NULL when it is not a real date."""
    if pattern in DATE_READINGS:
        return _iso_date_text(text, pattern).try_cast("date")
    return timestamp_by_pattern(text, pattern).cast("date")


def timestamp_by_pattern(text: Column, pattern: str) -> Column:
    """The instant a text stands for under one layout (midnight for plain dates)."""
    if pattern == "Unix Timestamp":
        seconds = F.when(text.rlike(DATE_PATTERNS[pattern][0]), text.try_cast("bigint"))
        return F.when(seconds.between(0, LAST_EPOCH_SECOND), F.timestamp_seconds(seconds))
    if pattern == "ISO DateTime":
        return F.when(text.rlike(ISO_DATETIME_FULL), text.try_cast("timestamp"))
    return _iso_date_text(text, pattern).try_cast("timestamp")


def valid_for_pattern(text: Column, pattern: str) -> Column:
    if pattern == "ISO DateTime":
        whole = text.rlike(ISO_DATETIME_FULL) & F.substring(text, 1, 19).try_cast("timestamp").isNotNull()
        return F.coalesce(whole, F.lit(False))
    if pattern == "Unix Timestamp":
        return timestamp_by_pattern(text, pattern).isNotNull()
    return date_by_pattern(text, pattern).isNotNull()


def numeric_pattern(text: Column) -> Column:
    """Name of the first numeric shape the text has, NULL when it has none."""
    found = F.lit(None).cast("string")
    for name, pattern in reversed(NUMERIC_PATTERNS.items()):
        found = F.when(text.rlike(pattern), F.lit(name)).otherwise(found)
    return found


def to_double(text: Column) -> Column:
    """Plain or scientific number; anything else (also Java's '1d', 'NaN') is NULL."""
    bare = strip(text)
    return F.when(bare.rlike(NUMBER_SHAPE), bare.try_cast("double"))


def loose_number(text: Column) -> Column:
    """Number after removing ``,``, ``$`` and ``%``."""
    return to_double(F.regexp_replace(text, "[,$%]", ""))


def to_long_strict(text: Column) -> Column:
    """The whole text must be an integer, without surrounding spaces."""
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))


def to_long_coerced(text: Column) -> Column:
    """Numeric text with an integral value; others become NULL."""
    exact = to_long_strict(strip(text))
    number = to_double(text)
    return F.coalesce(exact, F.when(number == F.floor(number), number.try_cast("bigint")))


def currency_to_decimal(text: Column, precision: int = 15) -> Column:
    """Money text without ``,`` and ``$``; digits beyond two decimals are cut, not rounded."""
    bare = F.translate(text, ",$", "")
    point = F.instr(bare, ".")
    cut = F.when(point > 0, F.substr(bare, F.lit(1), point + 2)).otherwise(bare)
    kind = f"decimal({precision},2)"
    return F.when(text.rlike(PLAIN_MONEY), text.try_cast(kind)).otherwise(
        F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), cut.try_cast(kind))
    )


def accounting_to_decimal(text: Column, precision: int = 15) -> Column:
    """Money text where brackets mean a negative amount: ``(1,234.50)`` is -1234.50."""
    bracketed = text.startswith("(") & text.endswith(")") & (F.length(text) > 1)
    signed = F.when(bracketed, F.concat(F.lit("-"), F.translate(text, "()", ""))).otherwise(text)
    return currency_to_decimal(signed, precision)


def to_flag(text: Column) -> Column:
    return F.coalesce(text.isin(TRUE_WORDS), F.lit(False)).cast("int")


# Shape of what the best-effort reading casts once day and month are in ISO order.
ISO_LIKE = r"^(?!0000)\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{1,2}:\d{1,2}([.,]\d+)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"
MONTH_FIRST = r"^(0?[1-9]|1[0-2])/(\d{1,2})/(\d{4})$"


def _best_effort(text: Column, pattern: Column | str | None, kind: str) -> Column:
    """Bring all layouts into ISO order, then cast once.

    ``a/b/yyyy`` is read day first unless profiling found the month-first layout.
    """
    bare = F.trim(text)
    ordered = bare
    if isinstance(pattern, Column):
        ordered = F.when(pattern == "MM/DD/YYYY", F.regexp_replace(bare, MONTH_FIRST, "$3-$1-$2")).otherwise(bare)
    elif pattern == "MM/DD/YYYY":
        ordered = F.regexp_replace(bare, MONTH_FIRST, "$3-$1-$2")
    ordered = F.regexp_replace(ordered, r"^(\d{1,2})([/-])(\d{1,2})\2(\d{4})$", "$4-$3-$1")
    ordered = F.regexp_replace(ordered, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    read = F.when(ordered.rlike(ISO_LIKE), ordered.try_cast(kind))
    epoch = timestamp_by_pattern(bare, "Unix Timestamp").cast(kind)
    if isinstance(pattern, str) and pattern == "YYYY-MM-DD":
        return F.coalesce(_iso_date_text(bare, pattern).try_cast(kind), read, epoch)
    return F.coalesce(read, epoch)


def to_datetime_best_effort(text: Column, pattern: Column | str | None = None) -> Column:
    """Instant from text: the layout found by profiling first, then the common ones, else NULL."""
    return _best_effort(text, pattern, "timestamp")


def to_date_best_effort(text: Column, pattern: Column | str | None = None) -> Column:
    return _best_effort(text, pattern, "date")


# The general parser reads a date, a date-time with blank or T and optional fraction, and
# the T form with a final Z that is taken literally.
GENERAL_DATETIME = (
    r"^(?!0000)\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{1,2}:\d{1,2}(\.\d{1,6})?)?$"
    r"|^(?!0000)\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}Z$"
)


def parse_datetime(text: Column, layout: str | None = None) -> Column:
    """Instant from text in one of the general forms, or in one given layout."""
    if layout:
        return F.try_to_timestamp(text, F.lit(layout))
    return F.when(text.rlike(GENERAL_DATETIME), F.rtrim(text, F.lit("Z")).try_cast("timestamp"))


def format_datetime(moment: Column, layout: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(moment, layout)
