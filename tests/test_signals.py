"""Signals of single lines, ISBN checks and Unicode text."""

from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.functions import isbn, signals, text


def one(spark, column, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x")).alias("y")).collect()]


@pytest.mark.parametrize(
    "line, amount, currency, qualifier, binding",
    [
        ("USD : 45.00 / PB", "45.00", "USD", None, "PB"),
        ("$ 25.00 / PB", "25.00", "$", None, "PB"),
        ("BND 8.00 / PB", "8.00", "BND", None, "PB"),
        ("USD 12,5 (net) / HB", "12.50", "USD", "net", "HB"),
        ("USD : 1,234 / PB", "1.23", "USD", None, "PB"),
    ],
)
def test_price(spark, line, amount, currency, qualifier, binding):
    p = one(spark, signals.price, line)[0]
    assert (p["amount"], p["currency"], p["qualifier"], p["binding"]) == (Decimal(amount), currency, qualifier, binding)


def test_not_prices(spark):
    assert one(spark, signals.price, "usd 4 / PB", "USD 1,234.56 / PB", "USD / PB", "45.00", None, "") == [None] * 6


def test_identifiers(spark):
    assert one(spark, signals.is_identifier, "978-623-7554-55-4", "7661303251963", "0306406152", "08044295 7X", "12345", "97812345678901") == [True, True, True, True, False, False]


def test_physical(spark):
    assert one(spark, signals.is_physical, "xii, 74p.", "X+82 p", "10 v.", "120 p. ; 23 cm.", "A study of 100 people", "no pages") == [True, True, True, True, True, False]


def test_publication_weight_url(spark):
    assert one(spark, signals.is_publication, "Indonesia : Histokultura 2025", "Jakarta: X, 1899", "Histokultura 2025") == [True, False, False]
    assert one(spark, signals.is_weight, "148gm.", "1,5 kg.", "148 lb") == [True, True, False]
    url = "https://www.marymartin.com/web?pid=908034"
    assert one(spark, signals.vendor_url, f"[{url}]({url})", "http://example.org") == [url, None]


def test_notes_and_topics(spark):
    assert one(spark, signals.is_note, "Includes Bibliography", "include index.", "(History)", "(" + "x" * 120 + ")") == [True, True, True, False]
    assert one(spark, signals.is_category_text, "Arts", "A", "a.b", "a:b", "မြန်မာ") == [True, False, False, False, True]


def test_isbn(spark):
    good = ["9783161484100", "978-3-16-148410-0", " 9783161484100 ", "0306406152", "080442957X", "080442957x"]
    bad = ["9783161484101", "08044295X7", "0306406153", "9786041-27798", "not an isbn", None, ""]
    assert one(spark, isbn.is_valid_isbn, *good, *bad) == [True] * 6 + [False] * 7


def check13(nine):
    body = "978" + nine
    return body + str(-sum(int(c) * (3 if i % 2 else 1) for i, c in enumerate(body)) % 10)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("0123456789", min_size=9, max_size=9), min_size=1, max_size=30))
def test_isbn_of_every_check_digit(spark, nines):
    values = [check13(n)[:12] + str(d) for n in nines for d in range(10)]
    want = [v == check13(v[3:12]) for v in values]
    assert one(spark, isbn.is_valid_isbn, *values) == want


def test_text(spark):
    assert one(spark, text.utrim, " 　 a b \n", "  ") == ["a b", ""]
    assert one(spark, text.grapheme_len, "မြန်မာ", "é", "") == [4, 1, 0]
    assert one(spark, text.ws_normalize, " a \n\t b ") == ["a b"]
    assert one(spark, text.clean, "  ", " x ") == [None, "x"]
    assert one(spark, lambda c: text.shortened(c, 3), "abcdef", None, "ab") == ["abc…", "—", "ab"]


def test_trim_in_linear_time(spark):
    """Millions of blanks within a line are looked at once."""
    blanks = " " * 1_000_000
    rows = [(f"a{blanks}b",), (f"{blanks}a \u3000b\u2003{blanks}",), (blanks,), ("",), (None,), (" a\n ",)]
    got = [r.t for r in spark.createDataFrame(rows, "x string").coalesce(1).select(text.utrim(F.col("x")).alias("t")).collect()]
    assert got == [f"a{blanks}b", "a \u3000b", "", "", None, "a"]
