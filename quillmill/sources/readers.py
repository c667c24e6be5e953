"""Files to DataFrames: one task decodes one file at a time; a file that fails is a row with an error."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

from ..types import CATALOG_RECORD, CELL, schema
from . import decode

PARAGRAPHS = "file string, index int, text string, style string, error string, detail string"
ROWS = f"file string, sheet string, row_no int, cells array<{CELL}>, error string, detail string"
RECORDS = f"{CATALOG_RECORD}, file string, error string, detail string"
# Fixed value: the name that these catalogue records carry as their source.
MODS_SOURCE = "stabikat"
#: Rows, or cells of rows, of a batch that a decoder hands on.
BATCH = 4096
CELLS = 1 << 15


def batches_of(
    files: Iterable[tuple[str, bytes]], rows_of: Callable[[str, bytes], Iterator[dict]], out: pa.Schema,
    weight: Callable[[dict], int] = lambda row: 1, most: int = BATCH, made: Callable[[list[dict], pa.Schema], pa.RecordBatch] | None = None,
) -> Iterator[pa.RecordBatch]:
    """Rows of all files in batches of a bounded size; a file that fails is a row with its error."""
    some, size = [], 0
    made = made or (lambda rows, schema: pa.RecordBatch.from_pylist(rows, schema=schema))
    for path, content in files:
        try:
            for row in rows_of(path, content):
                some.append(row)
                size += weight(row)
                if size >= most:
                    yield made(some, out)
                    some, size = [], 0
        except decode.DecodeError as e:
            some.append({"file": path, "error": e.reason, "detail": e.detail})
    if some:
        yield made(some, out)


def paragraph_rows(path: str, data: bytes) -> Iterator[dict]:
    return ({"file": path, "index": i, "text": t, "style": s} for i, t, s in decode.docx(data))


def sheet_cells(sheet: str | None) -> Callable[[str, bytes], Iterator[dict]]:
    return lambda path, data: ({"file": path, "sheet": name, "row_no": number, "cells": cells} for name, number, cells in decode.xlsx_rows(data, sheet))


def _weight(row: dict) -> int:
    """What a row with its empty cells takes, in cells."""
    cells = row.get("cells") or {}
    return max(cells, default=0) + decode.weight(cells)


def _cell_batch(rows: list[dict], out: pa.Schema) -> pa.RecordBatch:
    """Rows whose cells come by column, padded with empty ones as the batch's arrays are made."""
    offsets, none = [0], [r.get("cells") is None for r in rows]
    for r in rows:
        offsets.append(offsets[-1] + (0 if not r.get("cells") else max(r["cells"]) + 1))
    kinds, texts, numbers = ["null"] * offsets[-1], [None] * offsets[-1], [None] * offsets[-1]
    for r, begin in zip(rows, offsets, strict=False):
        for at, (kind, text, number) in (r.get("cells") or {}).items():
            kinds[begin + at], texts[begin + at], numbers[begin + at] = kind, text, number
    kind = out.field("cells").type
    fields = [pa.array(v, kind.value_type.field(n).type) for n, v in (("kind", kinds), ("s", texts), ("d", numbers))]
    cells = pa.StructArray.from_arrays(fields, fields=list(kind.value_type))
    listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), cells, type=kind, mask=pa.array(none))
    return pa.RecordBatch.from_arrays([listed if f.name == "cells" else pa.array([r.get(f.name) for r in rows], f.type) for f in out], schema=out)


def row_batches(files: Iterable[tuple[str, bytes]], sheet: str | None, out: pa.Schema) -> Iterator[pa.RecordBatch]:
    return batches_of(files, sheet_cells(sheet), out, _weight, CELLS, _cell_batch)


def _decoded(files: DataFrame, batches: Callable[[Iterable[tuple[str, bytes]], pa.Schema], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
    out = to_arrow_schema(schema(ddl))

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = ((path, content.as_py() or b"") for batch in given for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
        return batches(each, out)

    return files.select("path", "content").mapInArrow(run, ddl)


def paragraphs(files: DataFrame) -> DataFrame:
    """Paragraphs of word-processor files; ``files`` has path and content."""
    return _decoded(files, lambda each, out: batches_of(each, paragraph_rows, out), PARAGRAPHS)


def worksheet_rows(files: DataFrame, sheet: str | None = None) -> DataFrame:
    """Rows of all sheets (or of one) of workbooks; a sheet that fails fails its file."""
    return _decoded(files, lambda each, out: row_batches(each, sheet, out), ROWS)


def record_rows(path: str, data: bytes) -> Iterator[dict]:
    return ({"source": MODS_SOURCE, "file": path, **r} for r in decode.mods_records(data))


def catalogue_records(responses: DataFrame) -> DataFrame:
    """Catalogue records of XML responses (path, content)."""
    return _decoded(responses, lambda each, out: batches_of(each, record_rows, out), RECORDS)


def read_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    return paragraphs(read_files(spark, path, "*.docx"))


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    return worksheet_rows(read_files(spark, path, "*.xlsx"), sheet)


def read_mods(spark: SparkSession, path: str) -> DataFrame:
    return catalogue_records(read_files(spark, path, "*.xml"))
