"""The text, number and date rules, on hand-made values and against plain Python."""

import re
import unicodedata
from datetime import UTC, datetime
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldledger import functions as fn
from checks.oracle import EXPECTED_LABELS


def values(spark, column, rows, ddl="x STRING"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in rows], ddl).select(column).collect()]


def caps(text):
    def is_word(c):
        return unicodedata.category(c)[0] in "LNM"

    out, inside = [], False
    for c in text:
        out.append(c.upper() if is_word(c) and not inside else c.lower())
        inside = is_word(c)
    return "".join(out)


def test_word_caps(spark):
    rows = ["md. abdul-karim", "o'NEIL  mc.donald", "4th street", "a1b 2C", "", None, "রহিম মিয়া", "\tx\ny", "_a", "é-è"]
    wanted = [None if r is None else caps(r) for r in rows]
    assert values(spark, fn.word_caps("x"), rows) == wanted
    assert wanted[0] == "Md. Abdul-Karim"


def test_word_caps_leaves_the_marker_character_alone(spark):
    rows = [" a", "ab", " x", "  "]
    assert values(spark, fn.word_caps("x"), rows) == [caps(r) for r in rows]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=st.sampled_from("abzXYZ09 -'._,\t#/éÀকা"), max_size=24), min_size=50, max_size=80))
def test_word_caps_on_random_text(spark, rows):
    assert values(spark, fn.word_caps("x"), rows) == [caps(r) for r in rows]


def test_full_name_keeps_the_blank(spark):
    rows = [("a", "b"), ("a", None), (None, "b"), (None, None)]
    df = spark.createDataFrame(rows, "f STRING, l STRING")
    got = [r[0] for r in df.select(fn.full_name(F.col("f"), F.col("l"))).collect()]
    assert got == ["a b", "a ", " b", " "]


def test_strip_space_is_python_strip(spark):
    rows = [" a ", "\t\n a b \r\n", "\xa0x ", "\x1cq\x1f", "", "  ", "a\x85", "　z\n\n", "\x0by", None]
    assert values(spark, fn.strip_space("x"), rows) == [r if r is None else r.strip() for r in rows]


def test_or_default(spark):
    assert values(spark, fn.or_default("x", "N/A"), ["a", "", None]) == ["a", "N/A", "N/A"]


def test_grouped_amount(spark):
    rows = ["0.00", "2.50", "3.50", "-2.50", "1234567.49", "999999999.49", "999999999.50", "-1000000000.00", None]
    column = fn.grouped_amount(F.col("x"))
    got = values(spark, column, [r and Decimal(r) for r in rows], "x DECIMAL(18,2)")
    assert got == ["0", "3", "4", "-3", "1,234,567", "999,999,999", "#" * 12, "#" * 12, None]
    price = fn.grouped_amount(F.col("x"), digits=6)
    assert values(spark, price, [Decimal("999999.4"), Decimal("1000000")], "x DECIMAL(12,2)") == ["999,999", "#" * 8]


def test_day_mon_year(spark):
    moments = [datetime(2024, 1, 5, 23, 59, 59), datetime(1999, 12, 31), None]
    assert values(spark, fn.day_mon_year(F.col("x")), moments, "x TIMESTAMP_NTZ") == ["05-Jan-2024", "31-Dec-1999", None]


@pytest.mark.parametrize(
    ("day", "months", "wanted"),
    [
        ("2001-02-28", 1, "2001-03-31"),
        ("2001-01-31", 1, "2001-02-28"),
        ("2001-01-30", 1, "2001-02-28"),
        ("2000-02-28", 1, "2000-03-28"),
        ("2000-02-29", 12, "2001-02-28"),
        ("2001-04-30", -1, "2001-03-31"),
        ("2001-05-15", 0, "2001-05-15"),
    ],
)
def test_add_months_sticky(spark, day, months, wanted):
    got = spark.range(1).select(
        fn.add_months_sticky(F.lit(f"{day} 13:00:00").cast("timestamp_ntz"), F.lit(months)).cast("string")
    )
    assert got.first()[0] == wanted


def test_days_since_rounds_the_fraction(spark):
    moment = datetime(2002, 1, 1, 18)
    rows = [datetime(2002, 1, 1), datetime(2002, 1, 1, 6), datetime(2002, 1, 1, 6, 0, 1), datetime(2001, 12, 31, 17),
            datetime(2002, 1, 2, 18), datetime(2002, 1, 2, 6), None]
    got = values(spark, fn.days_since(fn.as_of_column(moment), F.col("x")), rows, "x TIMESTAMP_NTZ")
    assert got == [1, 1, 0, 1, -1, -1, None]


def test_as_of_defaults_to_the_clock(spark):
    shown = spark.range(1).select(fn.as_of_column(None)).first()[0]
    assert abs((shown - datetime.now(UTC).replace(tzinfo=None)).total_seconds()) < 3600


def test_labels(spark):
    def shown(domain, code, language="bn"):
        return values(spark, fn.label(domain, F.col("x"), language), [code])[0]

    for domain, codes in EXPECTED_LABELS.items():
        for code, (english, bengali) in codes.items():
            assert shown(domain, code, "en") == english
            assert re.search(r"[ঀ-৿]", bengali) and shown(domain, code) == bengali
    assert shown("kyc_status", "REJECTED") == "-"
    assert shown("loan_status", "DEFAULTED") == "DEFAULTED"
    assert shown("loan_status", None) == "N/A"
    assert shown("pending_order", None, "en") == "No"
    assert shown("loan_state", "DEFAULTED") == "DEFAULTED"
    assert shown("loan_status", "Active Loan") != shown("dashboard_loan_status", "Active Loan")
    assert shown("role", "gUEST", "en") == "Guest"
    assert shown("role", "GUEST") == "GUEST"
