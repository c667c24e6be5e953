"""Import plans: parse, validate, keep offers and errors apart.

A parser is a function from source records to rows of ``source``, offer fields and ``error``.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.isbn import validated
from ..operators.places import numbered


class Parser(Protocol):
    def __call__(self, records: DataFrame) -> DataFrame: ...


def validate(parsed: DataFrame) -> DataFrame:
    """Offers with the validation status of their identifiers."""
    return parsed.withColumn("identifiers", validated(F.col("identifiers")))


def process(records: DataFrame, parser: Parser) -> DataFrame:
    """Each record's validated offer or the ``error`` of its parser. One plan, no shuffle."""
    return records.transform(parser).transform(validate)


def split(processed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Offers, and the sources that failed with why. Order lies in the locators."""
    return processed.where(F.col("error").isNull()), processed.where(F.col("error").isNotNull()).select("source", "error")


def placed(processed: DataFrame, first: int = 1) -> DataFrame:
    """``processed`` with ``place``: gapless numbers over all files, by file name, sheet, row and paragraph, without one task for all."""
    locator = F.col("source.locator")
    return numbered(processed, F.col("source.source_filename"), locator["sheet"], locator["row"], locator["paragraph_start"], name="place", first=first)
