"""CSV files in several tasks each, whose records may cross lines: ``read_csv``.

Whether a line's end within a stretch of bytes ends a record depends on how many quotes stand before it, in the whole
file. So two jobs read the files by stretches. The first counts, for each stretch, its quotes and the line ends that would end a record
if it began outside a quoted field, and if it began inside. From these the driver (a few numbers for each stretch) knows how each
one begins and how many records lie before it. In the second job a task takes the records that begin in its stretch, reads the
last of them to its end, and numbers them as one reader of the whole file would.

Fields are quoted as RFC 4180 says: a quote within a quoted field is doubled, other fields hold none. Files are UTF-8.
"""

from __future__ import annotations

import csv
import io
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

from ..types import CELL, schema
from .decode import NO_CELL, DecodeError
from .offer_files import store
from .readers import CELLS, _cell_batch, _weight

CSV_ROWS = f"file string, sheet string, row_no long, cells array<{CELL}>, error string, detail string"
#: Bytes of a stretch, of a record at most, and of what is read at once beyond a stretch.
STRETCH, RECORD, MORE = 16 << 20, 64 << 20, 1 << 20
_QUOTE, _END, _MARK = 34, 10, b"\xef\xbb\xbf"


@dataclass(frozen=True)
class Stretch:
    """Bytes of a file; whether they begin inside a quoted field, and how many records end before them."""

    path: str
    begin: int
    end: int
    inside: bool = False
    records: int = 0


def inside(data: np.ndarray, begins: bool) -> np.ndarray:
    """For each byte whether it stands inside a quoted field (its closing quote does, its opening one doesn't)."""
    quotes = (data == _QUOTE).astype(np.uint8)
    return (np.bitwise_xor.accumulate(quotes) ^ quotes ^ np.uint8(begins)).astype(bool)


def counted(data: bytes) -> tuple[int, int, int]:
    """Whether the number of quotes is odd, and the line ends outside of quotes if the stretch begins outside, and if inside."""
    own = np.frombuffer(data, np.uint8)
    within = inside(own, False)[own == _END]
    return int(np.count_nonzero(own == _QUOTE) % 2), int(np.count_nonzero(~within)), int(np.count_nonzero(within))


def records(f, own: Stretch) -> tuple[int, list[bytes]]:
    """The number of the first record that begins in a stretch (from 1), and all of them."""
    back = min(own.begin, 1)
    f.seek(own.begin - back)
    data = f.read(own.end - own.begin + back)
    bytes_ = np.frombuffer(data, np.uint8)[back:]
    within = inside(bytes_, own.inside)
    ends = np.flatnonzero((bytes_ == _END) & ~within) + 1  # where the next record begins
    if not own.begin or (data[0] == _END and not own.inside):
        starts, number = [0, *ends.tolist()], own.records + 1
    else:
        starts, number = ends.tolist(), own.records + 2
    starts = [s for s in starts if s < len(bytes_)]
    if not starts:
        return number, []
    body = data[back:]
    found = [body[a:b] for a, b in zip(starts, starts[1:], strict=False)]
    rest, begins = [body[starts[-1] :]], bool(within[-1]) ^ bool(bytes_[-1] == _QUOTE)
    if not (len(ends) and ends[-1] == len(bytes_)):  # the last record goes on
        size = len(rest[0])
        while more := f.read(MORE):
            some = np.frombuffer(more, np.uint8)
            state = inside(some, begins)
            stop = np.flatnonzero((some == _END) & ~state)
            rest.append(more[: stop[0] + 1] if len(stop) else more)
            size += len(rest[-1])
            if len(stop):
                break
            if size > RECORD:
                raise DecodeError("record_too_long", f"from byte {own.begin + starts[-1]}")
            begins = bool(state[-1]) ^ bool(some[-1] == _QUOTE)
    found.append(b"".join(rest))
    return number, found


def fields(record: bytes, delimiter: str) -> dict[int, tuple]:
    """Cells by column; empty ones are left out, but for the last."""
    text = record.decode("utf-8").removesuffix("\n").removesuffix("\r")
    own = next(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter), [])
    return {k: ("string", v, None) if v else NO_CELL for k, v in enumerate(own) if v or k == len(own) - 1}


def _rows(files: fs.FileSystem, own: Stretch, delimiter: str) -> Iterator[dict]:
    csv.field_size_limit(RECORD)
    try:
        with files.open_input_file(own.path) as f:
            number, found = records(f, own)
        if found and not own.begin:
            found[0] = found[0].removeprefix(_MARK)
        made = [fields(r, delimiter) for r in found]
    except (DecodeError, UnicodeDecodeError, csv.Error) as e:
        reason = e.reason if isinstance(e, DecodeError) else "invalid_encoding" if isinstance(e, UnicodeDecodeError) else "invalid_record"
        yield {"file": own.path, "error": reason, "detail": f"bytes {own.begin} to {own.end}: {e}"}
        return
    for k, cells in enumerate(made):
        yield {"file": own.path, "row_no": number + k, "cells": cells}


def stretches(path: str, most: int, end: str = ".csv") -> list[Stretch]:
    """The files at a path, by name, in stretches."""
    files, at = store(path)
    known = files.get_file_info(at)
    if known.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [known] if known.type == fs.FileType.File else files.get_file_info(fs.FileSelector(at, recursive=True))
    own = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and (f.path.endswith(end) or f is known) and not f.base_name.startswith((".", "_")))
    return [Stretch(p, a, min(a + most, size)) for p, size in own for a in range(0, size, most)]


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", stretch: int = STRETCH) -> DataFrame:
    """file, sheet (null), row_no and cells of every record of the CSV files at ``path``, as worksheets have them; blank lines are rows without cells.

    A stretch with bytes that aren't UTF-8, or a record beyond ``RECORD`` bytes (a quote that is never closed), is one row with an error. Files are
    what Arrow opens by the path's address.
    """
    own = stretches(path, stretch)
    out = to_arrow_schema(schema(CSV_ROWS))
    if not own:
        return spark.createDataFrame([], CSV_ROWS)
    shipped = spark.sparkContext.broadcast(own)  # a path and four numbers for each stretch
    each = spark.range(0, len(own), 1, len(own))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = store(path)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                with files.open_input_file(shipped.value[k].path) as f:
                    f.seek(shipped.value[k].begin)
                    got = counted(f.read(shipped.value[k].end - shipped.value[k].begin))
                yield pa.RecordBatch.from_pydict({n: [v] for n, v in zip(("k", "odd", "outside", "within"), (k, *got), strict=True)})

    counts = {r["k"]: r for r in each.mapInArrow(count, "k long, odd long, outside long, within long").collect()}
    state: dict[str, tuple[bool, int]] = defaultdict(lambda: (False, 0))
    placed = []
    for k, s in enumerate(own):
        begins, before = state[s.path]
        placed.append(Stretch(s.path, s.begin, s.end, begins, before))
        state[s.path] = (begins ^ bool(counts[k]["odd"]), before + counts[k]["within" if begins else "outside"])
    dealt = spark.sparkContext.broadcast(placed)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = store(path)
        some, size = [], 0
        for batch in batches:
            for k in batch.column(0).to_pylist():
                for row in _rows(files, dealt.value[k], delimiter):
                    some.append(row)
                    size += _weight(row)
                    if size >= CELLS:
                        yield _cell_batch(some, out)
                        some, size = [], 0
        if some:
            yield _cell_batch(some, out)

    return each.mapInArrow(read, CSV_ROWS)
