"""What a single line of an offer looks like: price, identifier, imprint, extent, weight, link."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import grapheme_len, ws_normalize

# Patterns and words that decide how lines of this vendor's lists are read.
PRICE = r"(?U)^\s*(USD|BND|\$)\s*:?\s*(\d+(?:[.,]\d+)?)\s*(?:\(([^)]+)\))?\s*/\s*([\p{L}\p{N}-]+)\s*$"
IDENTIFIER = r"(?U)^(?:\d{9}[\dXx]|\d{11,13})$"
PHYSICAL = r"(?iuU)(\d+\s*p\.?|[ivxlcdm]+\s*[,+.]\s*\d+\s*p\.?|\d+\s*v\.)(\s*;\s*[\d.,x]+\s*cm\.?)?"
PUBLICATION = r"(?dU):\s*.+(19|20)\d{2}\s*$"
WEIGHT = r"(?iuU)^\s*\d+([.,]\d+)?\s*(gm\.?|kg\.?)\s*$"
VENDOR_URL = r"(?iuU)https?://(www\.)?marymartin\.com/web\?pid=\d+"
EDITION = r"(?iuU)\b(?:edition|edisi)\b"
NOTE = r"(?iuU)^Includes?\s+(Bibliography|Index)\.?$"
SEPARATOR = r"^[-_]{20,}$"
PREAMBLE, PREAMBLE_END = "Mary Martin Booksellers Pte Ltd", "www.marymartin.com"
VENDOR, HEADING, LIST_STYLE = "Mary Martin Booksellers", "Heading1", "ListParagraph"


#: A character or two that a pattern can't match without: looked for first, as most lines lack them.
PRICE_HAS, PUBLICATION_HAS, URL_HAS = "/", ":", "://"


def price(line: Column) -> Column:
    """amount (rounded to cents), currency, qualifier and binding; null if the line isn't a price."""
    part = lambda k: F.regexp_extract(line, PRICE, k)
    number = F.replace(part(2), F.lit(","), F.lit("."))
    amount = F.round(number.try_cast("decimal(38,18)"), 2).cast("decimal(38,18)")
    found = F.struct(amount.alias("amount"), part(1).alias("currency"), F.nullif(part(3), F.lit("")).alias("qualifier"), part(4).alias("binding"))
    return F.when(line.rlike(PRICE) & amount.isNotNull(), found)


def is_price(line: Column) -> Column:
    return line.contains(PRICE_HAS) & line.rlike(PRICE) & F.replace(F.regexp_extract(line, PRICE, 2), F.lit(","), F.lit(".")).try_cast("decimal(38,18)").isNotNull()


def is_identifier(line: Column) -> Column:
    """Digits of an ISBN's length, or nearly, without hyphens and white space; no checksum."""
    return F.regexp_replace(line, r"(?U)[\s-]", "").rlike(IDENTIFIER)


def is_physical(line: Column) -> Column:
    return line.rlike(PHYSICAL)


def is_publication(line: Column) -> Column:
    return line.contains(PUBLICATION_HAS) & line.rlike(PUBLICATION)


def is_weight(line: Column) -> Column:
    return line.rlike(WEIGHT)


def vendor_url(line: Column) -> Column:
    """The first link to the vendor's shop in a line, or null."""
    return F.nullif(F.regexp_extract(line, VENDOR_URL, 0), F.lit(""))


def is_url(line: Column) -> Column:
    return line.contains(URL_HAS) & line.rlike(VENDOR_URL)


def is_edition(line: Column) -> Column:
    return line.rlike(EDITION)


def is_note(line: Column) -> Column:
    """A bibliography or index remark, or a short line in parentheses."""
    return line.rlike(NOTE) | (line.startswith("(") & line.endswith(")") & (grapheme_len(line) <= 120))


def is_category_text(line: Column) -> Column:
    return grapheme_len(line).between(2, 100) & ~line.contains(".") & ~line.contains(":")


def is_separator(text: Column) -> Column:
    """A rule of dashes or underscores. ``text`` is trimmed."""
    return text.rlike(SEPARATOR)


def is_grounded(value: Column, source: Column) -> Column:
    """The value, white space normalized, isn't empty and occurs in the source, which is normalized already; null is grounded."""
    own = ws_normalize(value)
    return F.coalesce((own != "") & F.contains(source, own), F.lit(True))
