"""Paragraphs of word-processor lists to offer records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.signals import HEADING, VENDOR, is_separator
from ..functions.text import blank, utrim
from ..types import PARAGRAPH


def segment(paragraphs: DataFrame, vendor: str = VENDOR) -> DataFrame:
    """Records of ``paragraphs`` (file, index, text, style).

    A heading ends the record before it and names the category of those that follow; a
    rule of 20 or more dashes or underscores ends a record as well. A record without any
    text isn't one; empty paragraphs at its edges are dropped, those within it kept.
    One exchange by file serves the windows and the aggregate.
    """
    text = utrim(F.coalesce("text", F.lit("")))
    heading = F.coalesce(F.col("style") == HEADING, F.lit(False))
    boundary = heading | is_separator(text)
    so_far = Window.partitionBy("file").orderBy("index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = paragraphs.select(
        "file", "index", "text", "style", boundary.alias("boundary"),
        F.sum(boundary.cast("int")).over(so_far).alias("part"),
        F.last(F.when(heading, text), ignorenulls=True).over(so_far).alias("category"),
    )
    filled = F.when(~blank(F.col("text")), F.col("index"))
    records = (
        marked.where(~F.col("boundary"))
        .groupBy("file", "part")
        .agg(
            F.min(filled).alias("first"),
            F.max(filled).alias("last"),
            F.first("category").alias("vendor_category"),
            F.sort_array(F.collect_list(F.struct(F.col("index").cast("int").alias("index"), "text", "style"))).alias("all"),
        )
        .where(F.col("first").isNotNull())
    )
    kept = F.filter("all", lambda p: p["index"].between(F.col("first"), F.col("last"))).cast(f"array<{PARAGRAPH}>")
    return records.select(
        F.lit("docx").alias("format"),
        F.col("file").alias("source_filename"),
        F.lit(vendor).alias("vendor"),
        F.struct(F.lit(None).cast("string").alias("sheet"), F.lit(None).cast("int").alias("row"), F.col("first").cast("int").alias("paragraph_start"), F.col("last").cast("int").alias("paragraph_end")).alias("locator"),
        kept.alias("raw_paragraphs"),
        "vendor_category",
    )
