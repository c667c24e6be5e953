"""How well an import went: counts, frequencies and the records to look at."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import blank

#: Places of a file whose paragraphs are brought together.
STRETCH = 1024


def totals(parsed: DataFrame) -> DataFrame:
    """One row of counts over parsed records, in one pass."""
    n = lambda c: F.count_if(c).cast("long")
    offer, some = {c: F.col(c) for c in parsed.columns}, F.col("error").isNull()
    return parsed.agg(
        F.count(F.lit(1)).alias("candidates"),
        n(some).alias("offers"),
        n(~some).alias("failures"),
        n(some & ~blank(offer["vendor_category"])).alias("with_category"),
        n(some & blank(offer["vendor_category"])).alias("without_category"),
        n(some & (F.size(offer["identifiers"]) > 0)).alias("with_identifiers"),
        n(some & offer["price_amount"].isNotNull()).alias("with_price"),
        n(some & (F.size(offer["descriptions"]) > 0)).alias("with_description"),
        n(some & (F.size(offer["unparsed"]) > 0)).alias("with_unparsed"),
        F.coalesce(F.sum(F.when(some, F.size(offer["unparsed"]))), F.lit(0)).cast("long").alias("unparsed_statements"),
    )


def _each(offers: DataFrame, column: str) -> DataFrame:
    """A row for each element. ``explode`` would have Spark parse every offer once more, to filter empty arrays before."""
    return offers.select(F.explode_outer(column).alias("value")).where("value is not null")


def status_histogram(offers: DataFrame) -> DataFrame:
    """Number of identifiers by validation status."""
    return _each(offers, "identifiers").select(F.col("value").alias("i")).groupBy(F.col("i.validation_status").alias("status")).agg(F.count(F.lit(1)).alias("n")).orderBy("status")


def frequent_unparsed(offers: DataFrame, most: int = 10) -> DataFrame:
    """The most frequent statements that no rule fits, by count and then by text."""
    return _each(offers, "unparsed").groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(most)


def with_unparsed(offers: DataFrame) -> DataFrame:
    return offers.where(F.size("unparsed") > 0)


def without_identifiers(offers: DataFrame) -> DataFrame:
    return offers.where(F.size("identifiers") == 0)


def with_invalid_identifier(offers: DataFrame) -> DataFrame:
    return offers.where(F.exists("identifiers", lambda i: i["validation_status"] == "invalid"))


def paragraphs_of(records: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Every paragraph in the range of each record's locator; a missing one is ``<missing>``.

    Ranges and paragraphs meet by stretches of ``STRETCH`` places, and a stretch is laid out after the join: what is missing isn't exchanged.
    The join is a merge join whatever Spark takes the sizes to be: rows that a plan unfolds from a small table look small to it, and were broadcast.
    """
    start, end = F.col("locator.paragraph_start"), F.col("locator.paragraph_end")
    stretch = lambda place: F.floor(place / STRETCH).cast("int")
    of = records.where(start.isNotNull()).select(F.col("source_filename").alias("file"), start.alias("start"), end.alias("end"), F.explode(F.sequence(stretch(start), stretch(end))).alias("stretch"))
    wanted = of.select("file", "stretch", F.greatest("start", F.col("stretch") * STRETCH).alias("start"), F.least("end", F.col("stretch") * STRETCH + (STRETCH - 1)).alias("end"))
    shown = F.struct(F.col("index").cast("int").alias("index"), F.coalesce("text", F.lit("<missing>")).alias("text"))
    held = paragraphs.select("file", stretch(F.col("index")).alias("stretch"), shown.alias("p")).groupBy("file", "stretch").agg(F.collect_list("p").alias("held"))
    both = wanted.join(held.hint("merge"), ["file", "stretch"], "left").withColumn("held", F.filter("held", lambda p: p["index"].between(F.col("start"), F.col("end"))))
    places = F.sequence("start", "end")
    absent = F.when(F.col("held").isNull(), places).otherwise(F.array_except(places, F.col("held.index")))
    every = F.concat(F.coalesce("held", F.array().cast(both.schema["held"].dataType)), F.transform(absent, lambda i: F.struct(i.alias("index"), F.lit("<missing>").alias("text"))))
    return both.select("file", F.inline(every))


def preview(rows: DataFrame, most: int, *order: str) -> tuple[list, int]:
    """The first rows in an order, and how many more there are.

    Rows are counted by the job that finds the first ones, as it sees them all; without an order it needn't, and they are counted by another.
    """
    if not order:
        shown = rows.limit(most).collect()
        return shown, 0 if len(shown) < most else rows.count() - len(shown)
    seen, tie = Observation(), next(c for k in range(len(rows.columns) + 1) if (c := f"_tie{k}") not in rows.columns)
    # with the tie no plan is sorted already, so that none stops before it has seen all rows
    found = rows.observe(seen, F.count(F.lit(1)).alias("rows")).withColumn(tie, F.monotonically_increasing_id()).orderBy(*order, tie)
    shown = found.limit(max(most, 1)).drop(tie).collect()[:most]
    return shown, seen.get["rows"] - len(shown)
