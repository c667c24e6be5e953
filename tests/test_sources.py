"""Documents, workbooks, XML responses and worksheets, from bytes made here."""

import csv
import io
import random
import subprocess
import sys
import zipfile
from decimal import Decimal
from pathlib import Path

import pytest

from quillmill.operators import spreadsheet
from quillmill.operators.row_offers import parse_rows
from quillmill.plans import derived
from quillmill.plans.imports import process
from quillmill.sources import csv_files, decode, export, offer_files, readers
from quillmill.streaming import file_drop
from quillmill.types import CELL

W = 'xmlns:w="urn:w"'


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), data)
    return out.getvalue()


def docx(*paragraphs):
    body = "".join(f'<w:p>{f"<w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr>" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>' for text, style in paragraphs)
    return archive(**{"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})


def test_paragraphs():
    xml = f"""<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>A</w:t></w:r><w:hyperlink><w:r><w:t xml:space="preserve"> b</w:t></w:r></w:hyperlink></w:p>
    <w:p/><w:p><w:r><w:t>x</w:t><w:br/><w:t>y</w:t><w:tab/><w:t>မြန်မာ</w:t></w:r></w:p><w:p><w:r><w:t>out</w:t></w:r><w:p><w:r><w:t>in</w:t></w:r></w:p></w:p></w:body></w:document>"""
    assert decode.docx_paragraphs(xml.encode()) == [(1, "A b", "Heading1"), (2, "", None), (3, "x\ny\tမြန်မာ", None), (4, "in", None), (5, "out", None)]
    for bad in (b"<not valid", b'<!DOCTYPE a [<!ENTITY x "y">]><a>&x;</a>', b""):
        with pytest.raises(decode.DecodeError, match="invalid_docx_xml"):
            decode.docx_paragraphs(bad)
    with pytest.raises(decode.DecodeError, match="document_xml_not_found"):
        decode.docx(archive(other="x"))
    with pytest.raises(decode.DecodeError, match="invalid_docx_archive"):
        decode.docx(b"no archive")


def test_read_docx(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx(("Heading", "Heading1"), ("Title", None)))
    (tmp_path / "b.docx").write_bytes(b"broken")
    (tmp_path / "c.txt").write_bytes(b"other")
    got = sorted((r.file[-6:], r["index"] or 0, r.text, r.style, r.error) for r in readers.read_docx(spark, str(tmp_path)).collect())
    assert got == [("a.docx", 1, "Heading", "Heading1", None), ("a.docx", 2, "Title", None, None), ("b.docx", 0, None, None, "invalid_docx_archive")]


def workbook(**sheets):
    names = list(sheets)
    members = {
        "xl/workbook.xml": "<workbook xmlns:r='urn:r'><sheets>" + "".join(f"<sheet name='{n}' r:id='r{i}'/>" for i, n in enumerate(names)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": "<Relationships>" + "".join(f"<Relationship Id='r{i}' Target='worksheets/s{i}.xml'/>" for i in range(len(names))) + "</Relationships>",
        "xl/sharedStrings.xml": "<sst><si><t>Title</t></si><si><r><t>Pri</t></r><r><t>ce</t></r></si></sst>",
    }
    members |= {f"xl/worksheets/s{i}.xml": f"<worksheet><sheetData>{sheets[n]}</sheetData></worksheet>" for i, n in enumerate(names)}
    return archive(**members)


def test_workbooks(spark, tmp_path):
    rows = "<row r='1'><c r='A1' t='s'><v>0</v></c><c r='B1' t='s'><v>1</v></c></row><row r='3'><c r='B3'><v>12.50</v></c><c r='C3' t='inlineStr'><is><t>x</t></is></c></row><row r='4'><c r='A4'><v>3</v></c></row>"
    book = workbook(one=rows, two="<row r='1'><c r='A1' t='b'><v>1</v></c></row>")
    none = ("null", None, None)
    assert decode.xlsx(book, "one") == [("one", [(1, [("string", "Title", None), ("string", "Price", None)]), (3, [none, ("decimal", "12.50", Decimal("12.50")), ("string", "x", None)]), (4, [("int", "3", Decimal(3))])])]
    assert [n for n, _ in decode.xlsx(book)] == ["one", "two"]
    for bad, error in ((b"x", "invalid_xlsx_archive"), (workbook(a="<row"), "sheet_error")):
        with pytest.raises(decode.DecodeError, match=error):
            decode.xlsx(bad)
    with pytest.raises(decode.DecodeError, match="sheet_not_found"):
        decode.xlsx(book, "three")
    (tmp_path / "b.xlsx").write_bytes(book)
    got = spreadsheet.from_rows(readers.read_xlsx(spark, str(tmp_path), "one").drop("error", "detail"), "V").collect()
    assert sorted((r.locator.row, r.raw_row["Title"] and r.raw_row["Title"].s, r.raw_row["Price"] and r.raw_row["Price"].d) for r in got) == [(3, None, Decimal("12.5")), (4, "3", None)]
    assert all(r.vendor == "V" and r.original_headers == ["Title", "Price"] for r in got)


def test_odd_workbooks(spark, tmp_path):
    """Numbers beyond an exact decimal, dates, spoken strings; what is broken is one row with an error."""
    cell = lambda ref, v, more="": f"<c r='{ref}' {more}><v>{v}</v></c>"
    numbers = {"1.2345678901234567E-5": Decimal("0.000012345678901235"), "1e25": None, "1e-999999": Decimal(0), "1E+999999": None, "99999999999999999999.5": Decimal("99999999999999999999.5"), "-7": Decimal(-7), "NaN": None}
    row = "<row r='1'>" + "".join(cell(f"{chr(65 + k)}1", n) for k, n in enumerate(numbers)) + "</row>"
    styles = "<styleSheet><numFmts><numFmt numFmtId='164' formatCode='yyyy\\-mm'/><numFmt numFmtId='165' formatCode='0.00&quot;days&quot;[Red]'/></numFmts><cellStyleXfs><xf numFmtId='14'/></cellStyleXfs><cellXfs><xf numFmtId='0'/><xf numFmtId='14'/><xf numFmtId='164'/><xf numFmtId='165'/></cellXfs></styleSheet>"
    dates = "<row r='1'>" + "".join(cell(f"{c}1", v, f"s='{s}'") for c, v, s in [("A", "45322", 1), ("B", "45322.4375", 2), ("C", "0.5", 1), ("D", "45322", 3), ("E", "59", 1), ("F", "61", 1), ("G", "-1", 1), ("H", "5", 9)]) + "</row>"
    spoken = "<row r='1'><c r='A1' t='s'><v>0</v></c><c r='B1' t='inlineStr'><is><t>a</t><rPh><t>x</t></rPh><t>b</t></is></c></row>"

    def book(sheet, strings="<sst><si><t>東</t><rPh sb='0' eb='1'><t>hi</t></rPh></si></sst>", kind="<workbookPr/>"):
        return archive(**{
            "xl/workbook.xml": f"<workbook xmlns:r='urn:r'>{kind}<sheets><sheet name='one' r:id='r0'/></sheets></workbook>", "xl/_rels/workbook.xml.rels": "<Relationships><Relationship Id='r0' Target='worksheets/s.xml'/></Relationships>",
            "xl/sharedStrings.xml": strings, "xl/styles.xml": styles, "xl/worksheets/s.xml": f"<worksheet><sheetData>{sheet}</sheetData></worksheet>",
        })

    files = {"numbers": book(row), "dates": book(dates), "late": book(dates, kind="<workbookPr date1904='1'/>"), "spoken": book(spoken), "wide": book(cell("ZZZZZZ1", 1)), "far": book(cell("XFE1", 1)),
             "shared": book(cell("A1", 7, "t='s'")), "style": book(cell("A1", 7, "s='x'")), "encoded": book(row, strings="<?xml version='1.0' encoding='big5'?><sst/>")}
    whole = bytearray(files["numbers"])
    at = whole.index(b"xl/worksheets/s.xml") + 19
    deflated = io.BytesIO()
    with zipfile.ZipFile(deflated, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", "<workbook><sheets/></workbook>" * 40)
    damaged = bytearray(deflated.getvalue())
    damaged[45:60] = b"\xff" * 15
    files |= {"damaged": bytes(damaged), "flipped": bytes(whole[:at] + bytes([whole[at] ^ 255]) + whole[at + 1 :])}
    for name, data in files.items():
        (tmp_path / f"{name}.xlsx").write_bytes(data)
    got = {}
    for r in readers.read_xlsx(spark, str(tmp_path)).collect():
        name = r.file.rsplit("/", 1)[1][:-5]
        assert name not in got
        got[name] = r.error or [(c.s, c.d) for c in r.cells]
    assert [d for _, d in got["numbers"]] == [n if n is None else n.quantize(Decimal(1).scaleb(-18), context=__import__("decimal").Context(prec=60)) for n in numbers.values()]
    assert [s for s, _ in got["numbers"]][:2] == ["0.000012345678901234567", "10000000000000000000000000"] and got["numbers"][3][0] == "1E+999999"
    assert [s for s, _ in got["dates"]] == ["2024-01-31", "2024-01-31 10:30:00", "12:00:00", "45322", "1900-02-28", "1900-03-01", "-1", "5"]
    assert [s for s, _ in got["late"]][:2] == ["2028-02-01", "2028-02-01 10:30:00"]
    assert [s for s, _ in got["spoken"]] == ["東", "ab"]
    assert {n: got[n] for n in ("wide", "far", "shared", "style", "encoded", "damaged")} == {n: "sheet_error" for n in ("wide", "far", "shared", "style")} | {n: "invalid_xlsx_archive" for n in ("encoded", "damaged")}
    assert isinstance(got["flipped"], str)
    for bad in ("shift_jis", "no-such"):
        (tmp_path / "a.docx").write_bytes(archive(**{"word/document.xml": f"<?xml version='1.0' encoding='{bad}'?><document/>"}))
        (r,) = readers.read_docx(spark, str(tmp_path)).collect()
        assert r.error == "invalid_docx_xml"


def test_headings_that_look_generated(spark):
    s = lambda x: ("string", x, None)
    df = spark.createDataFrame([("f", "a", 1, [s("N"), s("__unnamed_column_3")]), ("f", "a", 2, [s("x"), s("y"), s("z")])], f"file string, sheet string, row_no int, cells array<{CELL}>")
    assert {k: v.s for k, v in spreadsheet.from_rows(df).first().raw_row.items()} == {"N": "x", "__unnamed_column_3": "y", "__unnamed_column_3_": "z"}


def test_worksheet_rows(spark):
    s, null = (lambda x: ("string", x, None)), ("null", None, None)
    data = [
        ("f", "a", 1, [s("above")]), ("f", "a", 2, [s("Content"), s("Content "), null, s("  ")]), ("f", "a", 3, [s("x"), None, s("y")]), ("f", "a", 4, [null, s(" "), None]),
        ("f", "a", 5, [("int", "0", Decimal(0)), s("p"), s("q"), s("r"), s("beyond")]), ("f", "b", 2, [s("N"), s("N")]), ("f", "c", 1, [s("only")]),
    ]
    df = spark.createDataFrame(data, f"file string, sheet string, row_no int, cells array<{CELL}>")
    got = spreadsheet.from_rows(df, header_row=2).collect()
    good = {(r.locator.sheet, r.locator.row): {k: v and v.s for k, v in r.raw_row.items()} for r in got if r.error is None}
    assert good == {
        ("a", 3): {"Content": "x", "Content ": None, "__unnamed_column_3": "y", "__unnamed_column_4": None},
        ("a", 5): {"Content": "0", "Content ": "p", "__unnamed_column_3": "q", "__unnamed_column_4": "r", "__unnamed_column_5": "beyond"},
    }
    assert sorted((r.locator.sheet, r.error, r.detail) for r in got if r.error) == [("b", "duplicate_headers", "N"), ("c", "header_row_not_found", "2")]
    with pytest.raises(ValueError, match="invalid_header_row"):
        spreadsheet.from_rows(df, header_row=0)
    assert spreadsheet.from_rows(df.limit(0)).count() == 0


MODS = """<r xmlns="urn:m"><mods><titleInfo><title> Pāṇini </title><subTitle>grammar</subTitle></titleInfo><name usage="primary"><namePart>A</namePart></name><name><namePart>B</namePart></name>
<identifier type="ISBN">978</identifier><identifier type="issn">1</identifier><recordInfo><recordIdentifier>7</recordIdentifier></recordInfo></mods>
<mods><titleInfo><title>  </title></titleInfo><recordInfo><recordIdentifier>8</recordIdentifier></recordInfo></mods></r>"""


def test_catalogue_responses(spark, tmp_path):
    first, second = decode.mods_records(MODS.encode())
    assert first == {"record_id": "7", "title": "Pāṇini: grammar", "creator": "A", "isbn": "978"}
    assert second == {"record_id": "8", "title": None, "creator": None, "isbn": None}
    assert decode.mods_records(b"<r/>") == []
    nested = b"<r><mods><title>A <b>x</b> C</title><identifier type='isbn'>97<i>8</i></identifier></mods><mods><recordInfo>no<recordIdentifier> 9 </recordIdentifier></recordInfo></mods></r>"
    none = {"record_id": None, "title": None, "creator": None, "isbn": None}
    assert decode.mods_records(nested) == [none | {"title": "A x C", "isbn": "978"}, none | {"record_id": "9"}]
    for bad in (b"", b"<r><mods></r>", b"<?xml version='1.0' encoding='shift_jis'?><r/>", b"<?xml version='1.0' encoding='no-such'?><r/>"):
        with pytest.raises(decode.DecodeError, match="invalid_response"):
            decode.mods_records(bad)
    (tmp_path / "a.xml").write_text(MODS)
    (tmp_path / "b.xml").write_text("<")
    got = sorted((r.record_id or "", r.source, r.error) for r in readers.read_mods(spark, str(tmp_path)).collect())
    assert got == [("", None, "invalid_response"), ("7", "stabikat", None), ("8", "stabikat", None)]


def test_file_drop(spark, tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    offer = [("Arts", "Heading1"), ("Title / Me", None), ("Rome : Press 2001", None), ("USD 2 / PB", None), ("-" * 30, None), ("nothing", None)]
    (drop / "a.docx").write_bytes(docx(*offer))
    for _ in range(2):  # the second run finds nothing new
        file_drop.ingest(spark, str(drop), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    (drop / "b.docx").write_bytes(docx(*offer))
    file_drop.ingest(spark, str(drop), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    (drop / "c.docx").write_bytes(b"broken")
    file_drop.ingest(spark, str(drop), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    failed = spark.read.parquet(str(tmp_path / "out_failed"))
    assert [(r.file[-6:], r.error) for r in failed.collect()] == [("c.docx", "invalid_docx_archive")]
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.source.source_filename[-6:], r.error or r.vendor_category) for r in got.collect()) == [("a.docx", "Arts"), ("a.docx", "not_offer"), ("b.docx", "Arts"), ("b.docx", "not_offer")]


def sheet_book(rows, **more):
    return archive(**{
        "xl/workbook.xml": "<workbook xmlns:r='urn:r'><sheets><sheet name='S' r:id='a'/></sheets></workbook>", "xl/_rels/workbook.xml.rels": "<R><Relationship Id='a' Target='worksheets/s.xml'/></R>",
        "xl/worksheets/s.xml": f"<worksheet><sheetData>{rows}</sheetData></worksheet>", **more,
    })


def test_workbooks_at_the_edges_of_the_format(spark, tmp_path):
    """Rows and strings that the format can't have fail their file, not the job; the last row and column are read."""
    strings = {"xl/sharedStrings.xml": "<sst><si><t>a</t></si></sst>"}
    books = {
        "row": sheet_book("<row r='99999999999'><c r='A1'><v>1</v></c></row>"), "zero": sheet_book("<row r='0'/>"), "next": sheet_book("<row r='1048576'/><row/>"),
        "string": sheet_book("<row r='1'><c r='A1' t='s'><v>-1</v></c></row>", **strings), "beyond": sheet_book("<row r='1'><c r='A1' t='s'><v>1</v></c></row>", **strings),
        "late": sheet_book("<row r='1'><c r='A1'><v>1</v></c></row>" * 40_000 + "<row"), "good": sheet_book("<row r='1048576'><c r='XFD1048576'><v>7</v></c><c r='B1048576' t='s'><v>0</v></c></row>", **strings),
    }
    for name, data in books.items():
        (tmp_path / f"{name}.xlsx").write_bytes(data)
    got = {}
    for r in readers.read_xlsx(spark, str(tmp_path)).collect():
        got.setdefault(r.file.rpartition("/")[2], []).append(r)
    assert {k: [r.error for r in v] for k, v in got.items() if k != "good.xlsx"} == {f"{k}.xlsx": ["sheet_error"] for k in books if k != "good"}
    (row,) = got["good.xlsx"]
    assert row.row_no == 1_048_576 and len(row.cells) == 16_384 and row.cells[1].s == "a" and row.cells[-1].s == "7" and {c.kind for c in row.cells[2:-1]} == {"null"}


def test_rows_are_read_again_beyond_what_is_held(monkeypatch):
    rows = "".join(f"<row r='{k}'><c r='B{k}'><v>{k}</v></c></row>" for k in range(1, 60))
    few = list(decode.xlsx_rows(sheet_book(rows)))
    monkeypatch.setattr(decode, "HELD", 20), monkeypatch.setattr(decode, "PIECE", 50)
    assert list(decode.xlsx_rows(sheet_book(rows))) == few and len(few) == 59 and few[2] == ("S", 3, {1: ("int", "3", Decimal(3))})
    text = "".join(f"<w:p><w:r><w:t>{k} é</w:t></w:r></w:p>" for k in range(60))
    doc = lambda more: archive(**{"word/document.xml": f'<w:document xmlns:w="urn:w"><w:body>{text}{more}</w:body></w:document>'})
    assert list(decode.docx(doc(""))) == [(k + 1, f"{k} é", None) for k in range(60)]
    with pytest.raises(decode.DecodeError, match="invalid_docx_xml"):
        decode.docx(doc("<w:p>"))
    monkeypatch.setattr(decode, "STREAM_BYTES", 100)
    with pytest.raises(decode.DecodeError, match="invalid_docx_archive"):
        decode.docx(doc(""))


def test_large_members_take_little_memory():
    """A sheet of 200 MB, and rows of one cell in the last column, in a process of their own."""
    program = """
import io, resource, zipfile
import pyarrow as pa
from quillmill.sources import readers

def book(rows):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        z.writestr("xl/workbook.xml", "<workbook xmlns:r='urn:r'><sheets><sheet name='S' r:id='a'/></sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<R><Relationship Id='a' Target='worksheets/s.xml'/></R>")
        with z.open("xl/worksheets/s.xml", "w") as f:
            f.write(b"<worksheet><sheetData>")
            for r in rows:
                f.write(r)
            f.write(b"</sheetData></worksheet>")
    return out.getvalue()

sparse, large = book(f"<row><c r='XFD{k}'><v>1</v></c></row>".encode() for k in range(600)), book(b"<row><c t='inlineStr'><is><t>" + b"text " * 400 + b"</t></is></c></row>" for _ in range(100_000))
cell = pa.struct([("kind", pa.string()), ("s", pa.string()), ("d", pa.decimal128(38, 18))])
out = pa.schema([("file", pa.string()), ("sheet", pa.string()), ("row_no", pa.int32()), ("cells", pa.list_(cell)), ("error", pa.string()), ("detail", pa.string())])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for data, want in ((sparse, 600), (large, 100_000)):
    count = 0
    for batch in readers.row_batches([("f", data)], None, out):
        count += batch.num_rows
        assert batch.column("error").null_count == batch.num_rows
    assert count == want
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    used = subprocess.run([sys.executable, "-c", program], cwd=Path(__file__).parent.parent, capture_output=True, text=True, check=True).stdout
    assert int(used) < 150_000  # KB


def test_workbooks_that_arrive(spark, tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    cells = lambda *texts: "<row>" + "".join(f"<c t='inlineStr'><is><t>{t}</t></is></c>" for t in texts) + "</row>"
    (drop / "good.xlsx").write_bytes(sheet_book(cells("Title", "ISBN") + cells("One", "9780306406157") + cells(" ", "") + cells("Two", "1")))
    (drop / "twice.xlsx").write_bytes(sheet_book(cells("Title", "Title") + cells("One", "Two")))
    (drop / "broken.xlsx").write_bytes(b"broken")
    (drop / "other.docx").write_bytes(b"broken")
    for _ in range(2):
        file_drop.ingest(spark, str(drop), str(tmp_path / "out"), str(tmp_path / "check"), kind="xlsx").awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.source.source_filename[-9:], r.titles[0].text, r.identifiers[0].validation_status) for r in got) == [("good.xlsx", "One", "valid"), ("good.xlsx", "Two", "invalid")]
    failed = spark.read.parquet(str(tmp_path / "out_failed")).collect()
    assert sorted((r.file.rpartition("/")[2], r.error, r.detail if r.error != "invalid_xlsx_archive" else "") for r in failed) == [("broken.xlsx", "invalid_xlsx_archive", ""), ("twice.xlsx", "duplicate_headers", "S: Title")]


def test_data_source(spark, tmp_path):
    offer_files.register(spark)
    book = lambda *names: archive(**{
        "xl/workbook.xml": f"<workbook xmlns:r='urn:r'><sheets>{''.join(f'<sheet name={n!r} r:id={n!r}/>' for n in names)}</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f"<R>{''.join(f'<Relationship Id={n!r} Target={f'worksheets/{n}.xml'!r}/>' for n in names)}</R>",
        **{f"xl/worksheets/{n}.xml": f"<worksheet><sheetData><row r='1'><c r='A1'><v>{k}</v></c></row></sheetData></worksheet>" if n != "bad" else "<worksheet" for k, n in enumerate(names)},
    })
    (tmp_path / "deep").mkdir()
    for k in range(7):
        (tmp_path / f"{k}.docx").write_bytes(docx((f"a{k}", None), ("b", "Heading1")))
        (tmp_path / "deep" / f"{k}.xlsx").write_bytes(book("one", "two"))
    (tmp_path / "deep" / "bad.xlsx").write_bytes(book("one", "bad"))
    (tmp_path / "7.docx").write_bytes(b"broken"), (tmp_path / "_8.docx").write_bytes(b"broken"), (tmp_path / "r.xml").write_bytes(MODS.encode())
    read = lambda kind, path=tmp_path, **o: spark.read.format("quillmill_files").options(kind=kind, **o).load(str(path))
    for bundle, parts in ((1, 8), (1 << 20, 1)):
        got = read("docx", bundle=bundle)
        assert got.rdd.getNumPartitions() == parts
        assert sorted(tuple(r)[:5] for r in got.where("error is null").collect()) == sorted(tuple(r)[:5] for k in range(7) for r in [(str(tmp_path / f"{k}.docx"), 1, f"a{k}", None, None), (str(tmp_path / f"{k}.docx"), 2, "b", "Heading1", None)])
        assert [(r.file[-6:], r.error) for r in got.where("error is not null").collect()] == [("7.docx", "invalid_docx_archive")]
    assert read("mods").count() == 2 and read("mods", tmp_path / "r.xml").count() == 2 and read("docx", "file://" + str(tmp_path / "0.docx")).count() == 2
    assert read("xlsx").groupBy("sheet").count().orderBy("sheet").collect() == [(None, 1), ("one", 7), ("two", 7)]
    assert read("xlsx", sheet="one").where("error is null").count() == 8
    assert read("xlsx").where("sheet = 'one'").count() == 8  # the broken sheet isn't looked at
    assert read("xlsx").where("sheet = 'two' and row_no = 1").select("file").count() == 7 and read("xlsx", sheet="one").where("sheet = 'two'").count() == 0
    empty = tmp_path / "empty"
    empty.mkdir()
    assert read("docx", empty).count() == 0
    for bad in (("pdf", tmp_path), ("docx", tmp_path / "nowhere")):
        with pytest.raises(Exception, match="kind is one of|FileNotFound|nowhere"):
            read(*bad).count()


def test_export(spark, tmp_path):
    texts = ["=1+1", "+1", "-1", "@x", " =1", "\t=1", "\tx", "|x", "%x", "plain", "a=b", "", None, "<&>\"'", "中 é 😀", "a\r\nb", "\x01\ufffe", " kept  blanks ", "'quoted"]
    rows = [(k, t, Decimal("12.50") if k % 2 else None, float(k) / 4, k % 3 == 0) for k, t in enumerate(texts)] + [(99, "nan", Decimal("-0.01"), float("nan"), None), (-5, "inf", None, float("-inf"), True)]
    df = spark.createDataFrame(rows, "`=k` long, `a``b` string, price decimal(10,2), x double, flag boolean").coalesce(1)
    export.export_xlsx(df, str(tmp_path / "out"), rows=9)
    (file,) = (tmp_path / "out").iterdir()
    book = decode.xlsx(file.read_bytes())
    assert [n for n, _ in book] == ["Sheet1", "Sheet2", "Sheet3"] and all([c[1] for c in own[0][1]] == ["'=k", "a`b", "price", "x", "flag"] for _, own in book)
    got = [[c[1] for c in cells] + [None] * (5 - len(cells)) for _, own in book for _, cells in own[1:]]
    shown = [f"'{t}" if t is not None and k in range(9) else t for k, t in enumerate(texts)]
    shown[16], shown[15] = "\ufffd\ufffd", "a\r\nb"
    assert [r[1] for r in got][: len(texts)] == shown and [r[0] for r in got] == [str(r[0]) for r in rows]
    assert [r[2] for r in got] == [None if r[2] is None else str(r[2]) for r in rows] and [r[4] for r in got] == [None if r[4] is None else str(r[4]).lower() for r in rows]
    assert [r[3] for r in got][-2:] == [None, "-inf"] and [float(r[3]) for r in got[:-2]] == [r[3] for r in rows[:-2]]
    export.export_xlsx(df.limit(0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists() or not list((tmp_path / "none").iterdir())
    with pytest.raises(ValueError, match="not a cell's kind: n"):
        export.export_xlsx(spark.sql("select array(1) as n"), str(tmp_path / "x"))
    failing = df.repartition(2).selectExpr("`=k`", "case when `=k` = 3 then raise_error('stop') else 'x' end as t")
    with pytest.raises(Exception, match="stop"):
        export.export_xlsx(failing, str(tmp_path / "failed"))
    assert not (tmp_path / "failed").exists() or not [f for f in (tmp_path / "failed").iterdir() if not f.name.startswith(".")]
    csv = export.exported(df).select("`a``b`").where("`a``b` is not null").write.csv
    csv(str(tmp_path / "csv"), quoteAll=True)
    assert "'=1+1" in {r[0] for r in spark.read.csv(str(tmp_path / "csv")).collect()}


def csv_text(rng, rows):
    field = lambda: rng.choice(["", "a", "é 中 😀", '"x"', '"a ""b"" c"', '"line\nline"', '"\n"', '""', '",,"', '"\r\n"', '"x\n\n,y"', "x" * 50])
    return "".join(",".join(field() for _ in range(rng.randint(1, 4))) + rng.choice(["\n", "\r\n", "\n\n"]) for _ in range(rows))


@pytest.mark.parametrize("stretch", [1, 2, 7, 40, 1 << 20])
def test_csv_stretches(spark, tmp_path, stretch):
    """However a file is cut, its records and their numbers are those of one reader of the whole."""
    rng = random.Random(stretch)
    (tmp_path / "deep").mkdir()
    texts = {f"{k}.csv": csv_text(rng, 6 if stretch < 3 else 40) for k in range(3)} | {"bom.csv": "\ufeffa,b\n1,2", "end.csv": "a", "empty.csv": "", "deep/one.csv": '"only\none"', "deep/blank.csv": "\n\n"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "_skipped.csv").write_text("x")
    got = {}
    for r in csv_files.read_csv(spark, str(tmp_path), stretch=stretch).collect():
        assert r.error is None and r.sheet is None
        got.setdefault(r.file.removeprefix(f"{tmp_path}/"), []).append((r.row_no, [c.s for c in r.cells]))
    for name, text in texts.items():
        want = [(k, [v or None for v in row]) for k, row in enumerate(csv.reader(io.StringIO(text.removeprefix("\ufeff"), newline="")), 1)]
        assert sorted(got.get(name, [])) == want, name


def test_csv_records(spark, tmp_path, monkeypatch):
    files = {"good.csv": 'Title;ISBN;\n"One;\n1";9780306406157;x\n;;\n\nTwo;1;y;beyond\n', "twice.csv": "a;a\n1;2\n", "short.csv": "", "other.csv": "Title\nThree\n"}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    rows = csv_files.read_csv(spark, str(tmp_path), delimiter=";", stretch=5)
    for most in (spreadsheet.FILES, 0):
        monkeypatch.setattr(spreadsheet, "FILES", most)
        found = sorted(spreadsheet.from_csv(rows, "V").collect(), key=lambda r: (r.source_filename, r.locator.row or 0))
        assert [(r.source_filename.rpartition("/")[2], r.format, r.locator.row, r.error, r.detail) for r in found] == [("good.csv", "csv", 2, None, None), ("good.csv", "csv", 5, None, None), ("other.csv", "csv", 2, None, None), ("twice.csv", "csv", None, "duplicate_headers", "a")]
        assert {k: v and v.s for k, v in found[1].raw_row.items()} == {"Title": "Two", "ISBN": "1", "__unnamed_column_3": "y", "__unnamed_column_4": "beyond"} and found[0].raw_row["Title"].s == "One;\n1"
    offers = process(spreadsheet.from_csv(rows).where("error is null").drop("error", "detail"), parse_rows)
    assert sorted(r.titles[0].text for r in offers.collect()) == ["One;\n1", "Three", "Two"]
    assert [r.error for r in spreadsheet.from_csv(rows, header_row=9).collect()] == ["header_row_not_found"] * 3
    monkeypatch.setattr(csv_files, "RECORD", 20), monkeypatch.setattr(csv_files, "MORE", 4)
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "open.csv").write_text('a\n"' + "never closed " * 20), (broken / "bytes.csv").write_bytes(b"a\n\xff\n")
    assert [r.error for r in csv_files.read_csv(spark, str(broken), stretch=8).where("error is not null").collect()] == ["invalid_encoding"]
    with pytest.raises(decode.DecodeError, match="record_too_long: from byte 2"):
        csv_files.records(io.BytesIO((broken / "open.csv").read_bytes()), csv_files.Stretch("open.csv", 0, 8))
    with pytest.raises(FileNotFoundError):
        csv_files.read_csv(spark, str(tmp_path / "nowhere"))
    (tmp_path / "none").mkdir()
    assert csv_files.read_csv(spark, str(tmp_path / "none")).count() == 0


def test_an_archive_is_opened_once(monkeypatch):
    opened, real = [], zipfile.ZipFile
    book = sheet_book("<row r='1'><c r='A1'><v>1</v></c></row>")
    want = list(decode.xlsx_rows(book))
    monkeypatch.setattr(decode.zipfile, "ZipFile", lambda *a: opened.append(1) or real(*a))
    assert list(decode.xlsx_rows(book)) == want and len(opened) == 1
    monkeypatch.setattr(decode, "SMALL", 0)  # by readers
    assert list(decode.xlsx_rows(book)) == want and len(opened) == 2


def test_small_members_are_what_readers_give(monkeypatch):
    for kind in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", kind) as z:
            z.writestr("a.xml", "é" * 500)
            z.writestr("ü.xml", "x")
            z.writestr("none.xml", "")
        good = b"before" + out.getvalue()
        z = decode.opened(good, "broken")
        assert [decode.member(z, n, "none", "broken") for n in z.namelist()] == [b"".join(decode.member_pieces(z, n, "none", "broken")) for n in z.namelist()] == [("é" * 500).encode(), b"x", b""]
        size = z.getinfo("a.xml").compress_size
        for at in range(6, 6 + 35 + size, 1 if size < 100 else 37):
            bad = good[:at] + bytes([good[at] ^ 0x55]) + good[at + 1 :]
            z, got = decode.opened(bad, "broken"), []
            for most in (1 << 14, 0):
                monkeypatch.setattr(decode, "SMALL", most)
                try:
                    got.append(decode.member(z, "a.xml", "none", "broken"))
                except decode.DecodeError as e:
                    got.append((e.reason, e.detail))
            assert got[0] == got[1]


def test_files_of_a_small_table_are_made_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(derived, "FILES", 50)
    for made in (derived.workbooks, derived.docx_files, derived.mods_responses):
        assert made(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4
