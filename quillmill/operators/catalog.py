"""Catalogue search and look-up behind adapters.

A search gives rows; a look-up gives at most one. What an adapter can't do is a status,
never an empty result: not found and failed are different things.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import utrim
from ..types import CATALOG_RECORD

#: Why an adapter may fail.
REASONS = ("unavailable", "timeout", "unauthorized", "invalid_request", "not_found", "unexpected")


@dataclass(frozen=True)
class Answer:
    """``records`` if ``reason`` is None."""

    records: DataFrame | None
    reason: str | None = None

    @property
    def ok(self) -> bool:
        return self.reason is None


class Adapter(ABC):
    @abstractmethod
    def search(self, query: str) -> Answer: ...

    @abstractmethod
    def lookup(self, identifier: str) -> Answer: ...


def matches(query: Column) -> Column:
    """title, creator and isbn, lower-cased and joined by blanks, contain the query; an empty one matches all."""
    return F.contains(F.lower(F.concat_ws(" ", "title", "creator", "isbn")), F.lower(utrim(query)))


class TableAdapter(Adapter):
    """Any DataFrame of catalogue records; ``order`` decides which of several is looked up."""

    def __init__(self, records: DataFrame, order: str = "record_id"):
        self.records, self.order = records, order

    def search(self, query: str) -> Answer:
        return Answer(self.records.where(matches(F.lit(query))))

    def lookup(self, identifier: str) -> Answer:
        own = utrim(F.lit(identifier))
        return Answer(self.records.where((F.col("record_id") == own) | (F.col("isbn") == own)).orderBy(self.order).limit(1))


class UnavailableAdapter(Adapter):
    """A remote catalogue that isn't connected: every request fails, none finds nothing."""

    def search(self, query: str) -> Answer:
        return Answer(None, "unavailable")

    def lookup(self, identifier: str) -> Answer:
        return Answer(None, "unavailable")


# The records of the built-in catalogue, for trying things out.
SAMPLE = (
    ("fake", "fake-1", "မြန်မာ့သမိုင်း", "Example Author", "9780000000001"),
    ("fake", "fake-2", "中國歷史", "Example Author", "9780000000002"),
    ("fake", "fake-3", "Pāṇini and the Sanskrit Grammatical Tradition", "Example Scholar", "9780000000003"),
)


def sample_catalog(spark: SparkSession) -> TableAdapter:
    return TableAdapter(spark.createDataFrame(list(SAMPLE), CATALOG_RECORD))


class Catalog:
    """Adapters by name; requests go to the chosen one."""

    def __init__(self, default: str, **adapters: Adapter):
        self.adapters, self.default = adapters, default

    def _adapter(self) -> Adapter:
        return self.adapters[self.default]

    def search(self, query: str) -> Answer:
        if not isinstance(query, str):
            raise TypeError("a query is a text")
        return self._adapter().search(query)

    def lookup(self, identifier: str) -> Answer:
        if not isinstance(identifier, str):
            raise TypeError("an identifier is a text")
        return self._adapter().lookup(identifier)
