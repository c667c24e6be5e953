"""Catalogue search for many queries at once: an inverted index of what records hold, as tables.

A record is found by title, creator and isbn, lower-cased and joined by blanks, as in ``catalog.matches``. The index has a row for each record
and each of its stretches of eight characters, of three, of two and of one, and one for the empty stretch. A query of up to two characters is one of
these stretches, and the index's rows are its answer. A longer one is looked up by the stretch of three (of eight, if it is as long) that
the fewest records have; those records are verified. Three digits of a number lie in a fixed share of all records' numbers, so that numbers looked for by these would meet ever more of them. So no record is compared with a query that it has nothing of.

Rows lie in ranges of the stretch, so that a few queries read a few files. Everything is a join by equality: the rows of a
stretch that a third of all records hold are dealt by AQE like any skewed key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import utrim
from ..sources.shared import scratch_path, written
from .catalog import Answer, TableAdapter

GRAM, LONG = 3, 8
#: Records of a task that tells their stretches; queries up to this number are broadcast, beyond it they are joined by exchange.
RECORDS, QUERIES = 8192, 1 << 16


def haystack() -> Column:
    return F.lower(F.concat_ws(" ", "title", "creator", "isbn"))


def stretches(text: Column, size: int) -> Column:
    """The distinct stretches of ``size`` characters of a text that isn't null."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


class CatalogIndex:
    """The index of one set of records, under one path of the shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, records: DataFrame, path: str | None = None) -> CatalogIndex:
        """Writes records, stretches and how many records have each. Records may repeat, and lack any field.

        Records are dealt first: a record has a hundred stretches, so a file that is one task's to read is a hundred times that to index.
        """
        spark = records.sparkSession
        index = cls(spark, path or scratch_path(spark))
        dealt = records.repartition(-(-records.count() // RECORDS) or 1)
        dealt.withColumn("_row", F.monotonically_increasing_id()).withColumn("_hay", haystack()).write.parquet(f"{index.path}/records")
        hay = F.col("_hay")
        every = F.concat(F.array(F.lit("")), *(stretches(hay, n) for n in (*range(1, GRAM + 1), LONG)))
        rows = index._table("records").select(F.explode(every).alias("gram"), "_row")
        rows.repartitionByRange("gram", "_row").sortWithinPartitions("gram", "_row").write.parquet(f"{index.path}/rows")
        index._table("rows").groupBy("gram").agg(F.count(F.lit(1)).alias("records")).write.parquet(f"{index.path}/counts")
        return index

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def search(self, queries: DataFrame) -> DataFrame:
        """The distinct ``query`` of each row of ``queries`` and the columns of every record that it finds.

        A query is lower-cased and trimmed; an empty one finds all records, a null one none.
        """
        asked = queries.select("query").where("query is not null").distinct().withColumn("_needle", F.lower(utrim(F.col("query"))))
        needle = F.col("_needle")
        grams = F.when(F.length(needle) <= GRAM, F.array(needle)).when(F.length(needle) < LONG, stretches(needle, GRAM)).otherwise(stretches(needle, LONG))
        counted = asked.withColumn("gram", F.explode(grams)).join(self._table("counts"), "gram", "left")
        rarest = counted.groupBy("query", "_needle").agg(F.min(F.struct(F.coalesce("records", F.lit(0)).alias("n"), "gram")).alias("m")).where("m.n > 0")
        sought = written(rarest.select("query", "_needle", "m.gram"))
        rows = (F.broadcast(sought) if sought.count() <= QUERIES else sought).join(self._table("rows"), "gram")
        return rows.join(self._table("records"), "_row").where((F.length(needle) <= GRAM) | F.contains("_hay", needle)).drop("gram", "_row", "_hay", "_needle")

    def adapter(self) -> IndexAdapter:
        return IndexAdapter(self)


class IndexAdapter(TableAdapter):
    """A catalogue whose searches go through an index."""

    def __init__(self, index: CatalogIndex, order: str = "record_id"):
        super().__init__(index._table("records").drop("_row", "_hay"), order)
        self.index = index

    def search(self, query: str) -> Answer:
        return Answer(self.index.search(self.index.spark.createDataFrame([(query,)], "query string")).drop("query"))
