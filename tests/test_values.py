"""Reading typed values out of text."""

from datetime import date, datetime
from decimal import Decimal

import pytest

from starloom.functions import values

D = Decimal


@pytest.mark.parametrize(
    "text, pattern, matched, day",
    [
        ("20251026", "YYYYMMDD", True, date(2025, 10, 26)),
        ("20230231", "YYYYMMDD", True, None),
        ("18991231", "YYYYMMDD", True, None),
        ("21001231", "YYYYMMDD", True, date(2100, 12, 31)),
        ("2025-10-26", "YYYY-MM-DD", True, date(2025, 10, 26)),
        ("2025-1-6", "YYYY-MM-DD", False, None),
        ("10/26/2025", "MM/DD/YYYY", True, date(2025, 10, 26)),
        ("1/1/2024", "MM/DD/YYYY", True, date(2024, 1, 1)),
        ("13/01/2024", "MM/DD/YYYY", True, None),
        ("26-10-2025", "DD-MM-YYYY", True, date(2025, 10, 26)),
        ("1732627200", "Unix Timestamp", True, date(2024, 11, 26)),
        ("9999999999", "Unix Timestamp", True, None),
        ("2025-10-26T10:30:00", "ISO DateTime", True, date(2025, 10, 26)),
        ("2025-10-26T25:30:00", "ISO DateTime", True, None),
        ("hello", "YYYYMMDD", False, None),
    ],
)
def test_date_layouts(one, text, pattern, matched, day):
    assert one(lambda c: values.matches_date_pattern(c, pattern), text) is matched
    assert one(lambda c: values.date_by_pattern(c, pattern), text) == day
    assert one(lambda c: values.valid_for_pattern(c, pattern), text) is (day is not None)


@pytest.mark.parametrize(
    "text, shape, number",
    [
        ("10336.48", "decimal", 10336.48),
        ("12345", "integer", 12345.0),
        ("$1,234.56", "currency", 1234.56),
        ("85.5%", "percentage", 85.5),
        ("1.23e+04", "scientific", 12300.0),
        ("-123.45", "negative_number", -123.45),
        ("NaN", None, None),
        ("1d", None, None),
        ("abc", None, None),
    ],
)
def test_numeric_shapes(one, text, shape, number):
    assert one(values.numeric_pattern, text) == shape
    assert one(values.loose_number, text) == number


@pytest.mark.parametrize(
    "text, plain, accounting",
    [
        ("1,234.50", D("1234.50"), D("1234.50")),
        ("$1.239", D("1.23"), D("1.23")),
        ("(1,234.50)", None, D("-1234.50")),
        ("($99)", None, D("-99.00")),
        ("1.239x", None, None),
        ("-5.1", D("-5.10"), D("-5.10")),
        ("", None, None),
    ],
)
def test_money(one, text, plain, accounting):
    assert one(values.currency_to_decimal, text) == plain
    assert one(values.accounting_to_decimal, text) == accounting


@pytest.mark.parametrize(
    "text, pattern, day",
    [
        ("05/06/2024", None, date(2024, 6, 5)),
        ("05/06/2024", "MM/DD/YYYY", date(2024, 5, 6)),
        ("26/10/2025", "MM/DD/YYYY", date(2025, 10, 26)),
        (" 2024-01-02 03:04:05 ", None, date(2024, 1, 2)),
        ("20240102", None, date(2024, 1, 2)),
        ("1732627200", None, date(2024, 11, 26)),
        ("31/02/2024", None, None),
        ("soon", None, None),
    ],
)
def test_best_effort_dates(one, text, pattern, day):
    assert one(lambda c: values.to_date_best_effort(c, pattern), text) == day


@pytest.mark.parametrize("text, number", [("12", 12), ("-7", -7), (" 12", None), ("1.0", None), ("x", None)])
def test_strict_integer(one, text, number):
    assert one(values.to_long_strict, text) == number


@pytest.mark.parametrize("text, number", [(" 12 ", 12), ("1e2", 100), ("1.5", None), ("x", None), ("9007199254740993", 9007199254740993)])
def test_coerced_integer(one, text, number):
    assert one(values.to_long_coerced, text) == number


@pytest.mark.parametrize("text, flag", [("true", 1), ("1", 1), ("yes", 1), ("y", 1), ("TRUE", 0), ("no", 0), (None, 0)])
def test_flag(one, text, flag):
    assert one(values.to_flag, text) == flag


@pytest.mark.parametrize(
    "text, moment",
    [
        ("2024-01-02", datetime(2024, 1, 2)),
        ("2024-01-02 03:04:05", datetime(2024, 1, 2, 3, 4, 5)),
        ("2024-01-02T03:04:05.25", datetime(2024, 1, 2, 3, 4, 5, 250000)),
        ("2024-01-02T03:04:05Z", datetime(2024, 1, 2, 3, 4, 5)),
        ("2024-01-02 03:04:05Z", None),
        ("02.01.2024", None),
    ],
)
def test_parse_datetime(one, text, moment):
    shown = one(lambda c: values.format_datetime(values.parse_datetime(c), "yyyy-MM-dd HH:mm:ss.SSSSSS"), text)
    assert shown == (moment.strftime("%Y-%m-%d %H:%M:%S.%f") if moment else None)
