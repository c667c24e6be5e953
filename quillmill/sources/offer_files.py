"""Files of offers and catalogue records as a Python data source: ``spark.read.format("quillmill_files")``.

Options: ``kind`` (docx, xlsx or mods), ``sheet`` (of workbooks), ``bundle`` (bytes of files that one task reads,
32 MB if not given). The path is a file or a folder, read with all below it, in any store that Arrow opens by its address. Files are bundled before
they are read, so that neither many small ones nor a few large ones make a bad number of tasks. A condition on ``sheet`` reaches the
reader, so that no other sheet is unpacked; ``register`` sets ``spark.sql.python.filterPushdown.enabled`` for that.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .readers import PARAGRAPHS, RECORDS, ROWS, batches_of, paragraph_rows, record_rows, row_batches

#: What a kind of file has as its last name, and the columns that it gives.
KINDS = {"docx": (".docx", PARAGRAPHS), "xlsx": (".xlsx", ROWS), "mods": (".xml", RECORDS)}
#: Files in a bundle at most, and its bytes.
FILES, BYTES = 256, 32 << 20


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; without an address it is the machine's own."""
    return fs.FileSystem.from_uri(path) if ":" in path.partition("/")[0] else (fs.LocalFileSystem(), path)


@dataclass
class Bundle(InputPartition):
    paths: list[str]


class FileReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.kind, self.path, self.sheet = options.get("kind", "docx"), options["path"], options.get("sheet")
        self.most, self.out = int(options.get("bundle", BYTES)), to_arrow_schema(schema)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if self.kind == "xlsx" and isinstance(f, EqualTo) and f.attribute == ("sheet",) and self.sheet in (None, f.value):
                self.sheet = f.value
            yield f  # and Spark applies it, as it does to files that have no such sheet

    def partitions(self) -> list[Bundle]:
        files, path = store(self.path)
        end, at = KINDS[self.kind][0], files.get_file_info(path)
        if at.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [at] if at.type == fs.FileType.File else files.get_file_info(fs.FileSelector(path, recursive=True))
        bundles, size = [], 0
        for f in sorted((f for f in found if f.type == fs.FileType.File and f.path.endswith(end) and not f.base_name.startswith((".", "_", "~"))), key=lambda f: f.path):
            if not bundles or size + f.size > self.most or len(bundles[-1].paths) >= FILES:
                bundles.append(Bundle([]))
                size = 0
            bundles[-1].paths.append(f.path)
            size += f.size
        return bundles or [Bundle([])]

    def read(self, partition: Bundle) -> Iterator[pa.RecordBatch]:
        files, _ = store(self.path)

        def each() -> Iterator[tuple[str, bytes]]:
            for path in partition.paths:
                with files.open_input_stream(path, compression=None) as f:
                    yield path, f.read()

        if self.kind == "xlsx":
            return row_batches(each(), self.sheet, self.out)
        return batches_of(each(), paragraph_rows if self.kind == "docx" else record_rows, self.out)


class OfferFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quillmill_files"

    def schema(self) -> str:
        kind = self.options.get("kind", "docx")
        if kind not in KINDS:
            raise ValueError(f"kind is one of {', '.join(KINDS)}, not {kind}")
        return KINDS[kind][1]

    def reader(self, schema: StructType) -> FileReader:
        return FileReader(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets conditions reach Python data sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(OfferFiles)
