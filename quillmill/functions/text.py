"""Unicode-aware text functions as columns. None of them normalizes what is stored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; an expression of a name grows with each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def utrim(c: Column) -> Column:
    """White space of any script off both ends (``trim`` takes blanks only)."""
    return F.regexp_replace(c, r"(?U)\A\s+|(?<!\s)\s+\z", "")  # looks at each inner run of white space once


def ws_normalize(c: Column) -> Column:
    """Each run of white space to one blank, then trimmed."""
    return utrim(F.regexp_replace(c, r"(?U)\s+", " "))


def clean(c: Column) -> Column:
    """Trimmed, blank to null."""
    return F.nullif(utrim(c), F.lit(""))


def grapheme_len(c: Column) -> Column:
    """Number of extended grapheme clusters; ``length`` counts code points, which in ASCII are the same but for CR LF."""
    plain = (F.octet_length(c) == F.length(c)) & ~F.contains(c, F.lit("\r\n"))
    return F.when(plain, F.length(c)).otherwise(F.size(F.regexp_extract_all(c, F.lit(r"\X"), F.lit(0))))


def blank(c: Column) -> Column:
    """Null or white space only."""
    return F.coalesce(utrim(c) == "", F.lit(True))


def shortened(c: Column, most: int) -> Column:
    """White space collapsed, at most ``most`` characters and then an ellipsis; null is a dash."""
    flat = ws_normalize(c)
    return F.when(c.isNull(), "—").when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def money(amount: Column, currency: Column) -> Column:
    """``12.50 EUR``; without an amount a dash."""
    return F.when(amount.isNull(), "—").otherwise(F.concat_ws(" ", F.format_number(amount, "0.00"), currency))


def locator_text(locator: Column, names: list[str]) -> Column:
    """The locator's fields that are set, ``key=value`` by key, comma-separated; a dash without any."""
    parts = [F.when(locator[n].isNotNull(), F.concat(F.lit(f"{n}="), locator[n].cast("string"))) for n in sorted(names)]
    return F.coalesce(F.nullif(F.concat_ws(", ", *parts), F.lit("")), F.lit("—"))
