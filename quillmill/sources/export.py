"""Order lists as workbooks that are safe to open: ``export_xlsx``, and the data sink ``quillmill_xlsx`` below it.

Texts that a spreadsheet would take for a formula get an apostrophe before them (``inert``), headings as well. Each task
writes one workbook row by row, under a hidden name; when all are there the driver gives them their names, so
a job that fails leaves none. A sheet that is full is followed by another one.
"""

from __future__ import annotations

import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import BooleanType, DateType, NumericType, StringType, StructType, TimestampNTZType, TimestampType

from .decode import COLUMNS, LAST_ROW
from .offer_files import store

# With what a text begins that spreadsheets take for a formula, also after white space; and characters that XML can't hold.
FORMULA = r"\A[\s\x00]*[=+\-@|%]|\A[\t\r\n]"
NO_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff￾￿]")


def inert(text: Column) -> Column:
    """The text, with an apostrophe before it if a spreadsheet would take it for a formula."""
    return F.when(text.rlike(FORMULA), F.concat(F.lit("'"), text)).otherwise(text)


def exported(df: DataFrame) -> DataFrame:
    """``df`` with texts and headings made inert: what may be written as CSV or to a workbook. Nested columns are an error."""
    nested = [f.name for f in df.schema if not isinstance(f.dataType, (StringType, NumericType, BooleanType, DateType, TimestampType, TimestampNTZType))]
    if nested:
        raise ValueError(f"not a cell's kind: {', '.join(nested)}")
    heading = lambda n: f"'{n}" if re.search(FORMULA, n) else n
    columns = (F.col(f"`{f.name.replace('`', '``')}`") for f in df.schema)
    return df.select(*((inert(c) if isinstance(f.dataType, StringType) else c).alias(heading(f.name)) for c, f in zip(columns, df.schema, strict=True)))


@dataclass
class Written(WriterCommitMessage):
    hidden: str | None
    name: str


class WorkbookWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        if overwrite:
            raise ValueError("workbooks are only added to a folder; use mode append")
        if len(schema) > COLUMNS:
            raise ValueError(f"a sheet has {COLUMNS} columns at most")
        self.path, self.most, self.names = options["path"], min(int(options.get("rows", LAST_ROW)), LAST_ROW), schema.names
        self.numbers = [isinstance(f.dataType, NumericType) for f in schema]

    def _cells(self, values: tuple) -> str:
        out = []
        for value, number in zip(values, self.numbers, strict=False):
            if value is None or value != value:  # noqa: PLR0124  a number that is none has no cell, as null
                out.append("<c/>")
            elif number and abs(value) != float("inf"):
                out.append(f"<c><v>{value if isinstance(value, (int, float)) else format(value, 'f')}</v></c>")
            else:
                text = NO_XML.sub("�", ("true" if value else "false") if isinstance(value, bool) else str(value))
                out.append(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text, {chr(13): "&#13;"})}</t></is></c>')
        return f"<row>{''.join(out)}</row>"

    def _sheet(self, archive: zipfile.ZipFile, number: int, rows: Iterator[tuple], first: tuple) -> tuple | None:
        """One sheet with a heading; the row that it had no more place for, if there is one."""
        heading = "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(NO_XML.sub("�", n))}</t></is></c>' for n in self.names)
        with archive.open(f"xl/worksheets/sheet{number}.xml", "w", force_zip64=True) as f:
            f.write(f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row>{heading}</row>'.encode())
            count, row = 1, first
            while row is not None and count < self.most:
                f.write(self._cells(row).encode())
                count, row = count + 1, next(rows, None)
            f.write(b"</sheetData></worksheet>")
        return row

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        rows = (row for batch in iterator for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        row, name = next(rows, None), f"part-{uuid.uuid4().hex}.xlsx"
        if row is None:
            return Written(None, name)
        files, path = store(self.path)
        files.create_dir(path, recursive=True)
        hidden, sheets = f"{path.rstrip('/')}/.{name}.unfinished", 0
        with files.open_output_stream(hidden, compression=None) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            while row is not None:
                sheets += 1
                row = self._sheet(archive, sheets, rows, row)
            numbers = range(1, sheets + 1)
            office, package = "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006"
            kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
            listed = "".join(f'<sheet name={quoteattr(f"Sheet{k}")} sheetId="{k}" r:id="r{k}"/>' for k in numbers)
            archive.writestr("xl/workbook.xml", f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{office}"><sheets>{listed}</sheets></workbook>')
            related = "".join(f'<Relationship Id="r{k}" Type="{office}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in numbers)
            archive.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">{related}</Relationships>')
            archive.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="b" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in numbers)
            archive.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>')
        return Written(hidden, name)

    def commit(self, messages: list[Written | None]) -> None:
        files, path = store(self.path)
        for m in messages:
            if m is not None and m.hidden:
                files.move(m.hidden, f"{path.rstrip('/')}/{m.name}")

    def abort(self, messages: list[Written | None]) -> None:
        files, _ = store(self.path)
        for m in messages:
            if m is not None and m.hidden:
                files.delete_file(m.hidden)


class Workbooks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quillmill_xlsx"

    def writer(self, schema: StructType, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the sink known to the session."""
    spark.dataSource.register(Workbooks)


def export_xlsx(df: DataFrame, path: str, rows: int = LAST_ROW) -> None:
    """Adds workbooks with the rows of ``df``, a heading above each sheet's, to a folder that driver and executors share.

    Each task writes one, those without rows none. Null has an empty cell; numbers are numbers; all else is text and inert. Characters that XML
    can't hold are replaced. Rows keep the order that their partition has.
    """
    register(df.sparkSession)
    exported(df).write.format("quillmill_xlsx").mode("append").option("rows", rows).save(path)
