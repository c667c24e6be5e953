"""Decoders of zipped and plain XML documents; standard library only, no external entities."""

from __future__ import annotations

import io
import itertools
import re
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta
from decimal import Decimal, InvalidOperation, localcontext
from functools import lru_cache
from typing import Any
from xml.parsers import expat

#: Bytes that a member of an archive may unpack to: one that is held whole, and one that is read in pieces.
MEMBER_BYTES, STREAM_BYTES = 256 << 20, 4 << 30
#: Bytes of a piece; cells or paragraphs of a file that are held until it is known to be whole (64 characters of text count as one more).
PIECE, HELD = 1 << 16, 1 << 16
#: Bytes of a member that is unpacked in one go, or whose reading is kept for other workbooks; how many are: workbooks of one maker share styles and sheets' names.
SMALL, KEPT = 1 << 14, 64


class DecodeError(ValueError):
    """``reason`` is a short name, ``detail`` what there is to say."""

    def __init__(self, reason: str, detail: str = ""):
        super().__init__(f"{reason}: {detail}" if detail else reason)
        self.reason, self.detail = reason, detail


@lru_cache(maxsize=4096)
def local(name: str) -> str:
    return name.rpartition(":")[2]


def parse_pieces(pieces: Iterable[bytes], start: Callable, end: Callable, text: Callable, found: list | None = None) -> Iterator:
    """Runs handlers over XML that comes in pieces; what they have put into ``found`` is handed on after each piece.

    Names come without prefixes. Document type declarations are refused.
    Whatever is wrong with the XML, its encoding or the values in it is a ``DecodeError``.
    """

    def refuse(*_):
        raise DecodeError("doctype_not_allowed")

    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartDoctypeDeclHandler = refuse
    parser.StartElementHandler = lambda name, own: start(local(name), {local(k): v for k, v in own.items()})
    parser.EndElementHandler = lambda name: end(local(name))
    parser.CharacterDataHandler = text
    for piece in itertools.chain(pieces, [None]):
        try:
            parser.Parse(piece or b"", piece is None)
        except DecodeError:
            raise
        except (expat.ExpatError, ValueError, LookupError, ArithmeticError) as e:
            raise DecodeError("invalid_xml", str(e)) from None
        if found:
            yield from found
            found.clear()


def parse(data: bytes, start: Callable, end: Callable, text: Callable) -> None:
    """``parse_pieces`` of the whole."""
    for _ in parse_pieces([data], start, end, text):
        pass


@contextmanager
def _checked(broken: str) -> Iterator[None]:
    """Whatever is wrong with an archive is a ``DecodeError``."""
    try:
        yield
    except (zipfile.BadZipFile, zipfile.LargeZipFile, zlib.error, EOFError, RuntimeError, OSError, ValueError) as e:
        if isinstance(e, DecodeError):
            raise
        raise DecodeError(broken, str(e)) from None


def opened(archive: bytes, broken: str) -> zipfile.ZipFile:
    """An archive, its directory read once for all members."""
    with _checked(broken):
        return zipfile.ZipFile(io.BytesIO(archive))


def _info(z: zipfile.ZipFile, name: str, missing: str) -> zipfile.ZipInfo:
    try:
        return z.getinfo(name)
    except KeyError:
        raise DecodeError(missing) from None


def _at_once(z: zipfile.ZipFile, info: zipfile.ZipInfo) -> bytes | None:
    """A small member without a reader of its own. None if it is large or anything is unusual or wrong: the reader knows what."""
    if max(info.file_size, info.compress_size) > min(SMALL, MEMBER_BYTES, STREAM_BYTES) or info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) or info.flag_bits & ~0x806:
        return None  # encrypted, patched, or of a size that comes after it
    held = z.fp.getbuffer()
    at = info.header_offset
    begin = at + 30 + int.from_bytes(held[at + 26 : at + 28], "little")
    if held[at : at + 4] != b"PK\3\4" or held[at + 30 : begin] != info.orig_filename.encode("ascii", "backslashreplace"):
        return None
    begin += int.from_bytes(held[at + 28 : at + 30], "little")
    data = bytes(held[begin : begin + info.compress_size])
    if info.compress_type == zipfile.ZIP_DEFLATED:
        unpack = zlib.decompressobj(-zlib.MAX_WBITS)
        try:
            data = unpack.decompress(data, info.file_size + 1)
        except zlib.error:
            return None
    return data if len(data) == info.file_size and zlib.crc32(data) == info.CRC else None


def member(z: zipfile.ZipFile, name: str, missing: str, broken: str) -> bytes:
    with _checked(broken):
        info = _info(z, name, missing)
        if info.file_size > MEMBER_BYTES:
            raise DecodeError(broken, f"{name} unpacks to {info.file_size} bytes")
        data = _at_once(z, info)
        return z.read(info) if data is None else data


def member_pieces(z: zipfile.ZipFile, name: str, missing: str, broken: str) -> Iterator[bytes]:
    """A member as it unpacks, a piece at a time."""
    with _checked(broken):
        info = _info(z, name, missing)
        if (data := _at_once(z, info)) is not None:
            yield data
            return
    with _checked(broken), z.open(info) as f:
        size = 0
        while piece := f.read(PIECE):
            size += len(piece)
            if size > STREAM_BYTES:
                raise DecodeError(broken, f"{name} unpacks to more than {STREAM_BYTES} bytes")
            yield piece


def whole(make: Callable[[], Iterator], weight: Callable[[Any], int] = lambda x: 1) -> Iterator:
    """What ``make`` gives, only if it ends without an error: a little is held, more is checked first and then read again."""
    some, size = [], 0
    for x in make():
        size += weight(x)
        if size <= HELD:
            some.append(x)
        else:
            some.clear()
    return iter(some) if size <= HELD else make()


def _paragraphs(pieces: Iterable[bytes]) -> Iterator[tuple[int, str, str | None]]:
    """(index, text, style) of every paragraph, empty ones too, numbered from 1 as they end.

    Breaks are line feeds, tabs tab characters; paragraphs within a paragraph (text boxes) are
    paragraphs of their own.
    """
    found, open_, inside, count = [], [], 0, 0

    def start(name, own):
        nonlocal inside
        if name == "p":
            open_.append([[], None])
        elif open_:
            if name == "t":
                inside += 1
            elif name == "br":
                open_[-1][0].append("\n")
            elif name == "tab":
                open_[-1][0].append("\t")
            elif name == "pStyle" and "val" in own:
                open_[-1][1] = own["val"]

    def end(name):
        nonlocal inside, count
        if name == "t":
            inside = max(0, inside - 1)
        elif name == "p" and open_:
            parts, style = open_.pop()
            count += 1
            found.append((count, "".join(parts), style))

    def text(data):
        if inside and open_:
            open_[-1][0].append(data)

    try:
        yield from parse_pieces(pieces, start, end, text, found)
    except DecodeError as e:
        raise (e if e.reason.startswith(("document_", "invalid_docx")) else DecodeError("invalid_docx_xml", str(e))) from None


def docx_paragraphs(xml: bytes) -> list[tuple[int, str, str | None]]:
    """All paragraphs of a document's XML, as ``_paragraphs`` gives them."""
    return list(_paragraphs([xml]))


def docx(archive: bytes) -> Iterator[tuple[int, str, str | None]]:
    """Paragraphs of a word-processor file, if it is whole; the XML isn't held."""
    broken = "invalid_docx_archive"
    z = opened(archive, broken)
    return whole(lambda: _paragraphs(member_pieces(z, "word/document.xml", "document_xml_not_found", broken)), lambda p: 1 + len(p[1]) // 64)


def mods_records(xml: bytes) -> list[dict]:
    """record_id, title, creator and isbn of every ``mods`` element; of repeated elements the last counts.

    Texts are trimmed and blank ones null; an element's text is all that is in it, markup
    within it aside. Title and subtitle are joined by a colon. A record may lack any of
    these, its identifier too. A response that is no XML is the error ``invalid_response``;
    one without records is an empty list.
    """
    found, now, value = [], None, []
    primary, isbn = [], []
    told = ("title", "subTitle", "recordIdentifier", "namePart", "identifier")

    def start(name, own):
        nonlocal now
        if name in told:
            value.clear()
        if name == "mods":
            now = {"title": None, "subtitle": None, "creator": None, "isbn": None, "record_id": None}
        elif name == "name":
            primary.append(own.get("usage") == "primary")
        elif name == "identifier":
            isbn.append((own.get("type") or "").lower() == "isbn")

    def end(name):
        nonlocal now
        text = ("".join(value).strip() or None) if name in told else None
        if now is not None:
            key = {"title": "title", "subTitle": "subtitle", "recordIdentifier": "record_id"}.get(name)
            if key:
                now[key] = text
            elif name == "namePart" and primary and primary[-1]:
                now["creator"] = text
            elif name == "identifier" and isbn and isbn[-1]:
                now["isbn"] = text
            elif name == "mods":
                title = ": ".join(x for x in (now["title"], now.pop("subtitle")) if x) or None
                found.append(now | {"title": title})
                now = None
        if name == "name" and primary:
            primary.pop()
        elif name == "identifier" and isbn:
            isbn.pop()

    try:
        parse(xml, start, end, value.append)
    except DecodeError as e:
        raise DecodeError("invalid_response", str(e)) from None
    return found


#: Fixed values of the format: the last row, the last column, XFD; numbers of the built-in date and time formats.
LAST_ROW, COLUMNS = 1_048_576, 16_384
DATES = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
#: What a cell's number holds as an exact decimal.
DIGITS, SCALE = 38, 18


@lru_cache(maxsize=COLUMNS)
def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", reference.upper())[0][:4]:
        n = n * 26 + ord(c) - 64
    if n > COLUMNS:
        raise ValueError(f"no column {reference[:8]}")
    return n - 1


def _is_date(code: str) -> bool:
    """Whether a number format shows days or times: it has one of their letters outside quotes, escapes and brackets."""
    bare = re.sub(r"""\"[^"]*"|\\.|_.|\*.|\[(?!h+\]|m+\]|s+\])[^\]]*\]""", "", code, flags=re.I)
    return bool(re.search(r"[dmyhs]", bare, re.I)) and "general" not in bare.lower()


def _dated(number: Decimal, late: bool) -> str | None:
    """A serial day number as ISO text: a day, a day and time, or (below 1) a time; null for what is no day.

    ``late``: days are counted from 1904, not 1900. The day that the format wrongly gives
    to 1900 (number 60) is the one before March.
    """
    seconds = int((number * 86_400).to_integral_value()) if 0 <= number < 2_958_467 else -1
    if not 0 <= seconds < (2_958_466 - (1462 if late else 0)) * 86_400:
        return None
    days, rest = divmod(seconds, 86_400)
    base = datetime(1904, 1, 1) if late else datetime(1899, 12, 30) if days >= 60 else datetime(1899, 12, 31)
    time = str(timedelta(seconds=rest)).rjust(8, "0")
    if not days and not late:
        return time
    day = (base + timedelta(days=days)).date().isoformat()
    return day if not rest else f"{day} {time}"


def _styles(xml: bytes) -> list[bool]:
    """For each cell style whether its number format is one of days or times."""
    custom, found, inside = {}, [], 0

    def start(name, own):
        nonlocal inside
        inside += name == "cellXfs"
        if name == "numFmt":
            custom[own.get("numFmtId")] = _is_date(own.get("formatCode", ""))
        elif name == "xf" and inside:
            n = own.get("numFmtId", "0")
            found.append(custom[n] if n in custom else n.isdigit() and int(n) in DATES)

    def end(name):
        nonlocal inside
        inside -= name == "cellXfs"

    parse(xml, start, end, lambda x: None)
    return found


def _cell(kind: str | None, text: str | None, shared: list[str], dated: bool = False, late: bool = False) -> tuple[str, str | None, Decimal | None]:
    """(kind, text, number). Numbers keep the scale they are written with, up to what an exact decimal holds.

    Beyond that the number is rounded to its scale or, if too large, null; the text stays.
    """
    if text is None:
        return "null", None, None
    if kind == "s":
        if (place := int(text)) < 0:
            raise ValueError(f"no shared string {place}")
        return "string", shared[place], None
    if kind in ("str", "inlineStr", "e"):
        return "string", text, None
    if kind == "b":
        return "string", "true" if text == "1" else "false", None
    try:
        number = Decimal(text)
    except InvalidOperation:
        return "string", text, None
    if not number.is_finite():
        return "string", text, None
    if dated and (day := _dated(number, late)):
        return "string", day, None
    exponent, size = number.as_tuple().exponent, number.adjusted()
    plain = format(number, "f") if -100 < exponent and -100 < size < 100 else text
    exact = number if size < DIGITS - SCALE else None
    if exact is not None and exponent < -SCALE:
        with localcontext(prec=DIGITS + SCALE):
            exact = round(number, SCALE) if size > -100 else Decimal(0)
            exact = exact if exact.adjusted() < DIGITS - SCALE else None
    return ("int" if exponent == 0 else "decimal"), plain, exact


def _strings(xml: bytes) -> list[str]:
    """The shared strings; how they are spoken (``rPh``) is no part of them."""
    found, now, depth, spoken = [], [], 0, 0

    def start(name, own):
        nonlocal depth, spoken
        spoken += name == "rPh"
        if name == "si":
            now.clear()
        elif name == "t":
            depth += 1

    def end(name):
        nonlocal depth, spoken
        spoken -= name == "rPh"
        if name == "si":
            found.append("".join(now))
        elif name == "t":
            depth -= 1

    parse(xml, start, end, lambda x: now.append(x) if depth and not spoken else None)
    return found


Cell = tuple[str, str | None, Decimal | None]
NO_CELL: Cell = ("null", None, None)


def _sheet(pieces: Iterable[bytes], shared: list[str], dates: list[bool], late: bool) -> Iterator[tuple[int, dict[int, Cell]]]:
    """Number and cells by column of each row as it ends; cells that aren't there are left out."""
    found, now, kind, value, at, inside, spoken, dated, number = [], {}, None, [], -1, 0, 0, False, 0

    def start(name, own):
        nonlocal now, kind, at, number, inside, spoken, dated
        spoken += name == "rPh"
        if name == "row":
            number = int(own.get("r", number + 1))
            if not 0 < number <= LAST_ROW:
                raise ValueError(f"no row {number}")
            now, at = {}, -1
        elif name == "c":
            at = _column(own["r"]) if own.get("r") else at + 1
            if at >= COLUMNS:
                raise ValueError("too many columns")
            kind, style = own.get("t"), int(own.get("s") or 0)
            dated = kind in (None, "n") and 0 <= style < len(dates) and dates[style]
            value.clear()
        elif name in ("v", "t"):
            inside += 1

    def end(name):
        nonlocal inside, spoken
        spoken -= name == "rPh"
        if name in ("v", "t"):
            inside -= 1
        elif name == "c":
            now[at] = _cell(kind, "".join(value) if value or kind in ("str", "inlineStr") else None, shared, dated, late)
        elif name == "row":
            found.append((number, now))

    return parse_pieces(pieces, start, end, lambda x: value.append(x) if inside and not spoken else None, found)


def _kept(read: Callable[[bytes], Any]) -> Callable[[bytes], Any]:
    """``read``, which remembers what it made of small members; nobody changes that."""
    known = lru_cache(maxsize=KEPT)(read)
    return lambda data: known(data) if len(data) <= SMALL else read(data)


@_kept
def _sheets(xml: bytes) -> tuple[list[tuple[str | None, str | None]], bool]:
    """Names and relations of a workbook's sheets in order; whether its days are counted from 1904."""
    sheets, late = [], False

    def start(name, own):
        nonlocal late
        if name == "sheet":
            sheets.append((own.get("name"), own.get("id")))
        elif name == "workbookPr":
            late = own.get("date1904") in ("1", "true")

    parse(xml, start, lambda n: None, lambda x: None)
    return sheets, late


@_kept
def _targets(xml: bytes) -> dict[str | None, str]:
    """Where the members are that relations lead to."""
    targets = {}
    parse(xml, lambda n, own: targets.update({own.get("Id"): own.get("Target", "")}) if n == "Relationship" else None, lambda n: None, lambda x: None)
    return targets


_dates = _kept(_styles)


def _book(archive: bytes, only: str | None) -> Callable[[], Iterator[tuple[str, Iterator[tuple[int, dict[int, Cell]]]]]]:
    """Reads what all sheets share; then gives the sheets in the workbook's order, as often as it is called."""
    broken = "invalid_xlsx_archive"
    z = opened(archive, broken)

    def other(name: str, read: Callable[[bytes], list]) -> list:
        """Of a member that a workbook may lack."""
        try:
            data = member(z, name, "none", broken)
        except DecodeError as e:
            if e.reason != "none":
                raise
            return []
        return read(data)

    try:
        sheets, late = _sheets(member(z, "xl/workbook.xml", "workbook_not_found", broken))
        targets = _targets(member(z, "xl/_rels/workbook.xml.rels", "workbook_not_found", broken))
        shared, dates = other("xl/sharedStrings.xml", _strings), other("xl/styles.xml", _dates)
    except DecodeError as e:
        raise (DecodeError(broken, e.detail) if e.reason == "invalid_xml" else e) from None
    if only is not None and only not in [n for n, _ in sheets]:
        raise DecodeError("sheet_not_found", only)

    def rows(name: str, rel: str) -> Iterator[tuple[int, dict[int, Cell]]]:
        target = targets.get(rel, "").lstrip("/")
        path = target if target.startswith("xl/") else f"xl/{target}"
        try:
            yield from _sheet(member_pieces(z, path, "sheet_missing", broken), shared, dates, late)
        except DecodeError as e:
            raise DecodeError("sheet_error", f"{name}: {e}") from None

    return lambda: ((name, rows(name, rel)) for name, rel in sheets if only in (None, name))


def xlsx_rows(archive: bytes, only: str | None = None) -> Iterator[tuple[str, int, dict[int, Cell]]]:
    """(sheet, row number, cells by column) of a workbook, if all of it is whole; rows are handed on as they end.

    Cells are (kind, text, number); those whose format shows days or times are ISO texts, as ``_dated`` gives them.
    Shared strings are held, sheets aren't.
    """
    book = _book(archive, only)
    return whole(lambda: ((sheet, number, cells) for sheet, rows in book() for number, cells in rows), lambda row: weight(row[2]))


def weight(cells: dict[int, Cell]) -> int:
    return 1 + len(cells) + sum(len(s or "") for _, s, _ in cells.values()) // 64


def padded(cells: dict[int, Cell]) -> list[Cell]:
    """A row's cells up to its last one, empty ones in between."""
    return [cells.get(k, NO_CELL) for k in range(max(cells, default=-1) + 1)]


def xlsx(archive: bytes, only: str | None = None) -> list[tuple[str, list[tuple[int, list]]]]:
    """(sheet, rows) of a small workbook; a row is its number and its cells up to the last one."""
    return [(name, [(number, padded(cells)) for number, cells in rows]) for name, rows in _book(archive, only)()]
