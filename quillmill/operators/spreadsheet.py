"""Worksheet cells to source records: header row, headings, rows as maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank
from ..sources.shared import written

UNNAMED = "__unnamed_column_"
#: Headings of so many files are broadcast.
FILES = 10_000


def prepared(cells: Column) -> Column:
    """Headings from the header row's cells: blank ones are named by their place, others stay as they are."""
    return F.transform(
        cells,
        lambda c, i: F.when(c.isNull() | c["kind"].isNull() | (c["kind"] == "null") | ((c["kind"] == "string") & blank(c["s"])), F.concat(F.lit(UNNAMED), (i + 1).cast("string"))).otherwise(c["s"]),
    )


def duplicates(headers: Column) -> Column:
    """Headings that occur more than once, each once, in order; generated names don't count unless a sheet spells one out."""
    return F.array_distinct(F.filter(headers, lambda h: F.size(F.filter(headers, lambda x: x == h)) > 1))


def is_empty_row(cells: Column) -> Column:
    """Every cell is null or a blank string; the number 0 is not empty."""
    return F.forall(cells, lambda c: c.isNull() | c["kind"].isNull() | (c["kind"] == "null") | ((c["kind"] == "string") & blank(c["s"])))


def from_rows(rows: DataFrame, vendor: str | None = None, header_row: int = 1) -> DataFrame:
    """Source records of ``rows`` (file, sheet, row_no, cells), one for each non-empty row below the header.

    A sheet whose header row is missing, or has a heading twice, gives one record with
    ``error`` (and ``detail``) and no raw row. Rows are padded with empty cells; cells beyond
    the header are kept under generated names (with a low line after one that is a heading
    already), as no source value may be lost.

    ``rows`` is read once and exchanged once, by file and sheet: a window gives each row its
    sheet's header. A sheet is one task's (the format bounds it at 1,048,576 rows).
    """
    if header_row < 1:
        raise ValueError(f"invalid_header_row: {header_row}")
    sheet = Window.partitionBy("file", "sheet")
    heads = F.when(F.col("row_no") == header_row, prepared(F.col("cells")))
    every = rows.select("file", "sheet", "row_no", "cells", F.row_number().over(sheet.orderBy("row_no")).alias("nth"), F.min(heads).over(sheet).alias("headers"))
    every = every.withColumn("twice", F.when(F.col("nth") == 1, duplicates(F.col("headers"))))
    # the sheet's first row knows of the error, the others need only know that there is one
    problem = F.when(F.col("headers").isNull(), "header_row_not_found").when(F.size("headers") > F.size(F.array_distinct("headers")), "duplicate_headers")
    every = every.withColumn("error", problem)
    row = (F.col("row_no") > header_row) & ~is_empty_row(F.col("cells"))
    kept = every.where(F.when(F.col("error").isNull(), row).otherwise(F.col("nth") == 1))
    good = F.col("error").isNull()
    detail = F.when(F.col("error") == "duplicate_headers", F.array_join("twice", ", ")).when(~good, F.lit(str(header_row)))
    return _records(kept, "xlsx", vendor, detail)


def from_csv(rows: DataFrame, vendor: str | None = None, header_row: int = 1) -> DataFrame:
    """The same of the records of CSV files (``sources.csv_files``): file, row_no and cells.

    A file's rows stay in the tasks that read them: headings, a row for each file, are joined to them (broadcast, if there are at most
    ``FILES`` files). A file whose header row is missing or has a heading twice gives one record with ``error``.
    """
    if header_row < 1:
        raise ValueError(f"invalid_header_row: {header_row}")
    own = rows.select("file", "row_no", "cells")
    found = own.where(F.col("row_no") == header_row).select("file", prepared(F.col("cells")).alias("headers"))
    heads = own.select("file").distinct().join(found, "file", "left").withColumn("twice", duplicates(F.col("headers")))
    heads = heads.withColumn("error", F.when(F.col("headers").isNull(), "header_row_not_found").when(F.size("twice") > 0, "duplicate_headers"))
    heads = written(heads)  # read thrice
    good = heads.where("error is null").drop("twice", "error")
    kept = own.where((F.col("row_no") > header_row) & ~is_empty_row(F.col("cells"))).join(F.broadcast(good) if good.count() <= FILES else good, "file")
    none = F.lit(None).cast("string")
    bad = heads.where("error is not null").select("file", F.lit(None).cast("long").alias("row_no"), F.array().cast(own.schema["cells"].dataType).alias("cells"), "headers", "error", F.array_join("twice", ", ").alias("detail"))
    every = kept.withColumn("error", none).withColumn("detail", none).unionByName(bad).withColumn("sheet", none)
    return _records(every, "csv", vendor, F.when(F.col("error") == "header_row_not_found", F.lit(str(header_row))).otherwise(F.col("detail")))


def _records(kept: DataFrame, format_: str, vendor: str | None, detail: Column) -> DataFrame:
    """Source records of rows (file, sheet, row_no, cells) with their headers and error."""
    good = F.col("error").isNull()
    width = F.greatest(F.size("headers"), F.size("cells"))
    beyond = lambda i: F.concat(F.lit(UNNAMED), i.cast("string"), F.when(F.array_contains("headers", F.concat(F.lit(UNNAMED), i.cast("string"))), "_").otherwise(""))
    names = F.concat("headers", F.when(width > F.size("headers"), F.transform(F.sequence(F.size("headers") + 1, width), beyond)).otherwise(F.array().cast("array<string>")))
    values = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.get("cells", i))
    return kept.select(
        F.lit(format_).alias("format"), F.col("file").alias("source_filename"), F.lit(vendor).cast("string").alias("vendor"), _locator(F.col("sheet"), F.when(good, F.col("row_no").try_cast("int"))),
        F.when(good, F.map_from_arrays(names, values)).alias("raw_row"), F.col("headers").alias("original_headers"), "error", detail.alias("detail"),
    )


def _locator(sheet: Column, row: Column) -> Column:
    none = F.lit(None).cast("int")
    return F.struct(sheet.alias("sheet"), row.alias("row"), none.alias("paragraph_start"), none.alias("paragraph_end")).alias("locator")
