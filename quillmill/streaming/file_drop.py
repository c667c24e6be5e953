"""Word-processor lists and workbooks as they arrive in a folder.

A file is whole when it appears, and records don't cross files, so every batch is
decoded, segmented and parsed by the same plan as a batch job; there is no event time
and no state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.line_offers import parse_lines
from ..operators.row_offers import parse_rows
from ..operators.segment import segment
from ..operators.spreadsheet import from_rows
from ..plans.imports import process
from ..sources.readers import paragraphs, worksheet_rows

#: For each kind of file: its decoder, and how decoded rows become processed records and records that failed before (with file, error and detail).
KINDS = {
    "docx": (paragraphs, lambda rows: (process(segment(rows), parse_lines), None)),
    "xlsx": (worksheet_rows, lambda rows: _sheets(from_rows(rows))),
}


def _sheets(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Processed rows of sheets, and sheets whose header can't be used."""
    good = records.where("error is null").drop("error", "detail")
    return process(good, parse_rows), records.where("error is not null").selectExpr("source_filename as file", "error", "concat_ws(': ', locator.sheet, detail) as detail")


def files(spark: SparkSession, path: str, per_batch: int = 1000, kind: str = "docx") -> DataFrame:
    return (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", f"*.{kind}").option("maxFilesPerTrigger", per_batch).load(path)
    )


def ingest(spark: SparkSession, path: str, out: str, checkpoint: str, per_batch: int = 1000, failed: str | None = None, kind: str = "docx") -> StreamingQuery:
    """Appends processed records of files of one kind (docx or xlsx) to ``out`` until all that are there are done.

    Files that can't be decoded, and sheets without a usable header, go to ``failed`` (``out`` and ``_failed``, if not given) with
    error and detail. A batch writes to folders of its own number and overwrites them when
    repeated after a failure.
    """
    failed = failed or f"{out.rstrip('/')}_failed"

    def batch(df: DataFrame, number: int) -> None:
        decoded, processed = KINDS[kind]
        lines = decoded(df).persist()  # files are decoded once for both outputs
        try:
            good, bad = processed(lines.where("error is null").drop("error", "detail"))
            broken = lines.where("error is not null").select("file", "error", "detail")
            good.write.mode("overwrite").parquet(f"{out}/batch={number}")
            (broken if bad is None else broken.unionByName(bad)).write.mode("overwrite").parquet(f"{failed}/batch={number}")
        finally:
            lines.unpersist()

    return files(spark, path, per_batch, kind).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
