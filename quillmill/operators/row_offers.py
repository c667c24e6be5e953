"""Spreadsheet rows to offers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean, utrim
from ..types import IDENTIFIER, TEXT_CONTENT
from .line_offers import given

# Column headings of this vendor's sheets (one has a blank at its end) and its currency.
CODE, TITLE, TRANSLATION, AUTHORS, ISBN = "Code", "Title", "Title (TRANSLATION)", "Authors", "ISBN"
PUBLISHER, YEAR, LANGUAGE, SIZE, PAGES, PRICE = "Publisher", "Year", "Language", "Size", "Pages", "Price in EUR"
CONTENT = ("Content ", "Content")
CURRENCY = "EUR"
NUMBER = r"\A[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"


def cell(row: Column, name: str) -> Column:
    return F.try_element_at(row, F.lit(name))


def text_value(c: Column) -> Column:
    """A cell's text: strings trimmed and blank to null, numbers as they are written plainly."""
    return F.when(c["kind"] == "string", clean(c["s"])).otherwise(c["s"])


def first_present(row: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*(text_value(cell(row, n)) for n in names))


def decimal_value(c: Column) -> Column:
    """An exact number: decimals and floats rounded to cents, strings only if all of them is a number (not rounded)."""
    s = utrim(c["s"])
    return (
        F.when(c["kind"].isin("decimal", "float"), F.round(c["d"], 2).cast("decimal(38,18)"))
        .when(c["kind"] == "int", c["d"])
        .when((c["kind"] == "string") & s.rlike(NUMBER), s.try_cast("decimal(38,18)"))
    )


def publication_statement(row: Column) -> Column:
    return F.nullif(F.concat_ws(", ", text_value(cell(row, PUBLISHER)), text_value(cell(row, YEAR))), F.lit(""))


def physical_description(row: Column) -> Column:
    part = lambda name: F.concat(F.lit(f"{name}: "), text_value(cell(row, name)))
    return F.nullif(F.concat_ws("; ", part(PAGES), part(SIZE)), F.lit(""))


def price_currency(row: Column) -> Column:
    """Set as soon as a price is given, even if it isn't a number."""
    c = cell(row, PRICE)
    given = F.coalesce(c["kind"].isNotNull() & (c["kind"] != "null") & ~((c["kind"] == "string") & (c["s"] == "")), F.lit(False))
    return F.when(given, CURRENCY)


def _texts(*pairs: tuple[str, Column]) -> Column:
    none = F.create_map().cast("map<string,string>")
    every = [F.when(text.isNotNull(), F.struct(F.lit(role).alias("role"), text.alias("text"), F.lit(None).cast("string").alias("language"), none.alias("metadata"))) for role, text in pairs]
    return F.array_compact(F.array(*every)).cast(f"array<{TEXT_CONTENT}>")


def parse_rows(records: DataFrame) -> DataFrame:
    """For each record its ``source`` (all its columns), the fields of its offer, and ``error``.

    Any map of cells is an offer, even without a title; a record that isn't one has the
    error ``invalid_raw_record``.
    """
    row = F.col("raw_row")
    get = lambda name: text_value(cell(row, name))
    none, null = F.array().cast("array<string>"), F.lit(None).cast("string")
    isbn = F.struct(F.lit("isbn").alias("scheme"), get(ISBN).alias("value"), F.lit("unchecked").alias("validation_status"), F.create_map().cast("map<string,string>").alias("metadata"))
    fields = (
        get(CODE).alias("vendor_code"),
        null.alias("vendor_url"),
        _texts(("primary_title", get(TITLE)), ("translated_title", get(TRANSLATION))).alias("titles"),
        _texts(("description", first_present(row, CONTENT))).alias("descriptions"),
        get(AUTHORS).alias("responsibility_statement"),
        publication_statement(row).alias("publication_statement"),
        physical_description(row).alias("physical_description"),
        null.alias("edition_statement"),
        F.array_compact(F.array(F.when(get(ISBN).isNotNull(), isbn))).cast(f"array<{IDENTIFIER}>").alias("identifiers"),
        F.array_compact(F.array(get(LANGUAGE))).alias("language_statements"),
        none.alias("series_statements"),
        none.alias("subjects"),
        none.alias("notes"),
        null.alias("vendor_category"),
        decimal_value(cell(row, PRICE)).alias("price_amount"),
        price_currency(row).alias("price_currency"),
        null.alias("price_qualifier"),
        null.alias("binding"),
        null.alias("weight"),
        none.alias("unparsed"),
        none.alias("warnings"),
        F.create_map().cast("map<string,string>").alias("metadata"),
    )
    return records.select(F.struct(*records.columns).alias("source"), *given(row.isNotNull(), fields), F.when(row.isNull(), "invalid_raw_record").alias("error"))
