"""Vendor-shaped tables made from the star schema, by the same expressions in Spark and in DuckDB.

The test tables hold no offer lists, so lines, rows, records and plans are derived from
``part``, ``customer`` and ``orders`` by rules that leave out, break or repeat each kind of line
for some keys.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import PARAGRAPH

#: ISBN-13 of a part: every fifth has a wrong check digit.
ISBN = """
    concat('978', lpad(cast(p_partkey as string), 9, '0'), cast((
      (10 - (38 + {digits}) % 10) + case when p_partkey % 5 = 0 then 1 else 0 end
    ) % 10 as string))
""".format(digits=" + ".join(f"{1 if i % 2 else 3} * (cast(floor(p_partkey / {10 ** (8 - i)}) as bigint) % 10)" for i in range(9)))
CENTS = "cast(round(p_retailprice * 100) as bigint)"
PRICE = f"""
    case when p_partkey % 4 = 1 then concat('$ ', cast(cast(floor({CENTS} / 100) as bigint) as string), ',5 (net) / HB')
    else concat('USD : ', cast(cast(floor({CENTS} / 100) as bigint) as string), '.', lpad(cast({CENTS} % 100 as string), 2, '0'), ' / PB') end
"""
_LINE = (
    (10, "case when p_partkey % 6 = 0 then p_name else concat(p_name, ' / ', p_brand) end", "null", "true"),
    (15, "concat('Series ', p_brand)", "null", "p_partkey % 6 = 1"),
    (20, "concat('Springfield : Press ', cast(p_partkey % 50 as string), ', ', cast(1990 + p_partkey % 35 as string))", "null", "p_partkey % 9 <> 0"),
    (30, "concat(cast(50 + p_partkey % 400 as string), ' p. ; ', cast(18 + p_partkey % 10 as string), ' cm.')", "null", "p_partkey % 8 <> 0"),
    (40, "concat('Arts and ', p_type)", "null", "p_partkey % 3 = 0"),
    (50, "concat(p_type, ' goods')", "'ListParagraph'", "p_partkey % 4 <> 3"),
    (60, ISBN, "null", "p_partkey % 11 <> 0"),
    (65, "'  '", "null", "p_partkey % 3 = 1"),
    (70, PRICE, "null", "p_partkey % 13 <> 0"),
    (75, "'BND 8.00 / PB'", "null", "p_partkey % 19 = 0"),
    (80, "concat(cast(100 + p_partkey as string), ' gm.')", "null", "p_partkey % 2 = 0"),
    (85, "case when p_partkey % 2 = 0 then 'Includes Bibliography' else concat('(', p_type, ' note)') end", "null", "p_partkey % 7 = 1"),
    (90, "'2nd edition'", "null", "p_partkey % 10 = 3"),
    (95, "concat('A study of ', p_name, ' and ', p_type, ' in the context of modern supply chains and trade')", "null", "p_partkey % 3 <> 1"),
    (97, "concat('https://www.marymartin.com/web?pid=', cast(p_partkey as string))", "null", "p_partkey % 17 <> 0"),
    (99, "concat('Remark ', cast(p_partkey % 3 as string))", "null", "p_partkey % 4 = 2"),
)
#: k, n (place), text, style of the lines of every part's offer.
LINES = " union all ".join(f"select p_partkey as k, {n} as n, {text} as text, {style} as style from {{part}} where {where}" for n, text, style, where in _LINE)
_MARK = (
    (1, "case when p_partkey % 4 = 0 then repeat('-', 30) else p_type end", "case when p_partkey % 4 = 0 then null else 'Heading1' end", "p_partkey % 6 <> 5"),
    (2, "''", "null", "p_partkey % 5 = 0"),
)
#: The same as paragraphs of seven files, with rules and headings between offers. These two are for DuckDB; Spark scans once.
_BOTH = " union all ".join(f"select p_partkey as k, {n} as n, {text} as text, {style} as style from {{part}} where {where}" for n, text, style, where in (*_LINE, *_MARK))
PARAGRAPHS = f"""
    select concat('list', cast(k % 7 as string)) as file, cast(cast(floor(k / 7) as bigint) * 100 + n as int) as index, text, cast(style as string) as style from ({_BOTH}) t
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _exploded(spark: SparkSession, sf_dir: str, rows: tuple) -> DataFrame:
    """k, n, text and style of all rows whose condition holds, from one scan of ``part``."""
    every = ", ".join(f"case when {where} then named_struct('n', {n}, 'text', {text}, 'style', cast({style} as string)) end" for n, text, style, where in rows)
    return table(spark, sf_dir, "part").selectExpr("p_partkey as k", f"inline(array_compact(array({every})))")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(spark, sf_dir, _LINE)


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _exploded(spark, sf_dir, (*_LINE, *_MARK))
    return rows.selectExpr("concat('list', cast(k % 7 as string)) as file", "cast(cast(floor(k / 7) as bigint) * 100 + n as int) as index", "text", "style")


def _recorded(lines: DataFrame) -> DataFrame:
    paragraph = F.struct(F.col("n").cast("int").alias("index"), "text", F.col("style").cast("string").alias("style"))
    return lines.groupBy("k").agg(F.sort_array(F.collect_list(paragraph)).cast(f"array<{PARAGRAPH}>").alias("raw_paragraphs"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each part, its lines as paragraphs."""
    return _recorded(lines(spark, sf_dir)).withColumn("vendor_category", F.when(F.col("k") % 5 == 0, F.lit("Stock")))


#: Cells of a sheet: kind, text and number by heading; every kind of price occurs.
ROWS = f"""
    select p_partkey as k, concat('P-', cast(p_partkey as string)) as code,
           case when p_partkey % 10 = 0 then '   ' else concat(' ', p_name, ' ') end as title,
           case when p_partkey % 3 = 0 then concat(p_name, ' (translated)') end as translation,
           {ISBN} as isbn, case when p_partkey % 4 = 0 then null else p_brand end as authors,
           case when p_partkey % 3 = 0 then concat('about ', p_name) when p_partkey % 3 = 1 then '' end as content_blank,
           case when p_partkey % 2 = 0 then concat('on ', p_name) end as content,
           case when p_partkey % 5 = 0 then null else concat('Press ', p_brand) end as publisher,
           case when p_partkey % 7 = 0 then null else cast(1990 + p_partkey % 35 as string) end as year,
           case when p_partkey % 2 = 0 then 'vie' end as language,
           case when p_partkey % 3 = 0 then null else '14 x 20 cm' end as size,
           case when p_partkey % 4 = 0 then null else cast(p_size * 10 as string) end as pages,
           case p_partkey % 6 when 0 then 'null' when 1 then 'decimal' when 2 then 'int' else 'string' end as price_kind,
           case p_partkey % 6 when 0 then null when 1 then cast(p_size as string) when 2 then cast(p_size as string) when 3 then concat(' ', cast(p_size as string), '.125 ')
                when 4 then 'on request' else '  ' end as price_text,
           case p_partkey % 6 when 1 then cast(p_size as decimal(38,18)) + cast('0.125' as decimal(38,18)) when 2 then cast(p_size as decimal(38,18)) end as price_number
    from {{part}}
"""


def row_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record with a map of cells for each part; every 50th has none."""
    rows = spark.sql(ROWS, part=table(spark, sf_dir, "part"))
    none = F.lit(None).cast("decimal(38,18)")
    cell = lambda c, kind="string": F.struct(F.when(F.col(c).isNull(), "null").otherwise(F.lit(kind)).alias("kind"), F.col(c).alias("s"), none.alias("d"))
    price = F.struct(F.col("price_kind").alias("kind"), F.col("price_text").alias("s"), F.col("price_number").alias("d"))
    names = {"Code": "code", "Title": "title", "Title (TRANSLATION)": "translation", "ISBN": "isbn", "Authors": "authors", "Content ": "content_blank", "Content": "content", "Publisher": "publisher", "Language": "language", "Size": "size"}
    pairs = [x for name, c in names.items() for x in (F.lit(name), cell(c))]
    pairs += [F.lit("Year"), cell("year", "int"), F.lit("Pages"), cell("pages", "int"), F.lit("Price in EUR"), price]
    return rows.select("k", F.when(F.col("k") % 50 != 49, F.create_map(*pairs)).alias("raw_row"))


#: Cells of four sheets, a header row each; one sheet has a heading twice, one blank headings.
SHEET_ROWS = """
    select concat('s', cast(p_partkey % 4 as string)) as sheet, cast(floor(p_partkey / 4) as int) + 2 as row_no,
           case when p_partkey % 9 = 0 then '  ' else p_name end as a, case when p_partkey % 9 = 0 then null else p_brand end as b,
           case when p_partkey % 18 = 9 then '' when p_partkey % 9 = 0 then null else p_type end as c, case when p_partkey % 36 = 0 then '0' end as d
    from {part}
"""
SHEET_HEADS = (("s0", "Name", "Brand", "Type"), ("s1", "Name", "Name", "Type"), ("s2", "Name", " ", None), ("s3", "Name", "name", "Name "))


def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, sheet, row_no and cells; the fourth cell, where there is one, is a number beyond the header."""
    data = spark.sql(SHEET_ROWS, part=table(spark, sf_dir, "part"))
    heads = spark.createDataFrame([(s, 1, a, b, c, None) for s, a, b, c in SHEET_HEADS], "sheet string, row_no int, a string, b string, c string, d string")
    none = F.lit(None).cast("decimal(38,18)")
    cell = lambda c: F.struct(F.when(F.col(c).isNull(), "null").otherwise("string").alias("kind"), F.col(c).alias("s"), none.alias("d"))
    number = F.struct(F.lit("int").alias("kind"), F.col("d").alias("s"), F.col("d").try_cast("decimal(38,18)").alias("d"))
    three = F.array(cell("a"), cell("b"), cell("c"))
    return data.unionByName(heads).select(F.lit("book").alias("file"), "sheet", "row_no", F.when(F.col("d").isNull(), three).otherwise(F.concat(three, F.array(number))).alias("cells"))


#: Cells of a header row for each part: blank, missing, repeated and generated-looking headings.
HEADS = """
    select p_partkey as k, p_name as a, case when p_partkey % 3 = 0 then '  ' else p_brand end as b,
           case when p_partkey % 4 = 0 then p_name when p_partkey % 4 = 1 then null else p_type end as c,
           case when p_partkey % 5 = 0 then '__unnamed_column_2' when p_partkey % 5 = 1 then concat(p_name, ' ') else p_brand end as d
    from {part}
"""


def header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet for each part, of its header row and one row below."""
    heads = spark.sql(HEADS, part=table(spark, sf_dir, "part"))
    none = F.lit(None).cast("decimal(38,18)")
    cell = lambda c: F.struct(F.when(F.col(c).isNull(), "null").otherwise("string").alias("kind"), F.col(c).alias("s"), none.alias("d"))
    cells = F.array(*map(cell, "abcd"))
    return heads.select(F.lit("book").alias("file"), F.col("k").cast("string").alias("sheet"), F.explode(F.array(F.lit(1), F.lit(2))).alias("row_no"), cells.alias("cells"))


#: A catalogue record of each part; every eleventh lacks its identifier, titles have markup in them.
MODS = f"""
    select p_partkey as k, cast(floor(p_partkey / 5) as bigint) as response, case when p_partkey % 11 <> 0 then concat('r', cast(p_partkey as string)) end as record_id,
           p_name as title, case when p_partkey % 3 <> 0 then p_type end as subtitle, case when p_partkey % 4 <> 0 then p_brand end as creator, {ISBN} as isbn
    from {{part}}
"""
#: Cells of a workbook for each part: two texts, an exact number, a day, a day and time in quarters.
BOOKS = f"""
    select p_partkey as k, p_name as name, p_brand as brand, concat(cast(cast(floor({CENTS} / 100) as bigint) as string), '.', lpad(cast({CENTS} % 100 as string), 2, '0')) as price,
           cast(30000 + p_partkey % 20000 as int) as day, cast(p_partkey % 4 as int) as quarter
    from {{part}}
"""


def _zipped(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


#: Parts whose files a task makes, and decodes: a small table becomes many files.
FILES = 4096


def _tasks(spark: SparkSession, sf_dir: str) -> int:
    return -(-table(spark, sf_dir, "part").count() // FILES) or 1


def _files(rows: DataFrame, path: str, content: Callable[[dict], bytes]) -> DataFrame:
    """path and content of one file for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([str(r[path]) for r in some]), pa.array([content(r) for r in some], pa.binary())], names=["path", "content"])

    return rows.mapInArrow(run, "path string, content binary")


def docx_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each part's offer as a word-processor file."""

    def content(r: dict) -> bytes:
        style = lambda s: f"<w:pPr><w:pStyle w:val={quoteattr(s)}/></w:pPr>" if s else ""
        run = lambda t: "".join(f"<w:r><w:t>{escape(x)}</w:t></w:r>" for x in (t[:5], t[5:]))
        body = "".join(f"<w:p>{style(p['style'])}{run(p['text'])}</w:p>" for p in r["raw_paragraphs"])
        return _zipped({"word/document.xml": f'<w:document xmlns:w="urn:w"><w:body>{body}</w:body></w:document>', "word/other.xml": "<other/>"})

    dealt = lines(spark, sf_dir).repartition(_tasks(spark, sf_dir), "k")
    return _files(_recorded(dealt).select("k", "raw_paragraphs"), "k", content)


def mods_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses of five catalogue records each."""

    def content(r: dict) -> bytes:
        def record(x: dict) -> str:
            head, _, tail = x["title"].partition(" ")
            tag = lambda name, value, more="": "" if value is None else f"<{name}{more}>{escape(value)}</{name}>"
            title = f"<titleInfo><title> {escape(head)}{f' <i>{escape(tail)}</i>' if tail else ''}</title>{tag('subTitle', x['subtitle'])}</titleInfo>"
            name = "" if x["creator"] is None else f"<name usage='primary'>{tag('namePart', x['creator'])}</name><name><namePart>Other</namePart></name>"
            return f"<mods>{title}{name}{tag('identifier', x['isbn'], ' type=\"ISBN\"')}<identifier type='issn'>1</identifier><recordInfo>{tag('recordIdentifier', x['record_id'])}</recordInfo></mods>"

        return f'<r xmlns="urn:m">{"".join(map(record, r["records"]))}</r>'.encode()

    rows = spark.sql(MODS, part=table(spark, sf_dir, "part"))
    grouped = rows.repartition(_tasks(spark, sf_dir), "response").groupBy("response").agg(F.sort_array(F.collect_list(F.struct("k", "record_id", "title", "subtitle", "creator", "isbn"))).alias("records"))
    return _files(grouped, "response", content)


def workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook of two sheets for each part."""

    def content(r: dict) -> bytes:
        half = f"{r['day']}.{'0 25 5 75'.split()[r['quarter']]}"
        stock = f"<row r='2'><c r='A2' t='s'><v>1</v></c><c r='C2' t='inlineStr'><is><t>{escape(r['brand'])}</t><rPh><t>no</t></rPh></is></c><c r='D2'><v>{r['price']}</v></c></row>"
        days = f"<row r='1'><c r='A1' s='1'><v>{r['day']}</v></c><c r='B1' s='2'><v>{half}</v></c><c r='C1'><v>{r['day']}</v></c></row>"
        sheet = lambda rows: f"<worksheet><sheetData>{rows}</sheetData></worksheet>"
        return _zipped({
            "xl/workbook.xml": "<workbook xmlns:r='urn:r'><sheets><sheet name='Stock' r:id='a'/><sheet name='Days' r:id='b'/></sheets></workbook>",
            "xl/_rels/workbook.xml.rels": "<Relationships><Relationship Id='a' Target='worksheets/s1.xml'/><Relationship Id='b' Target='/xl/worksheets/s2.xml'/></Relationships>",
            "xl/sharedStrings.xml": f"<sst><si><t>other</t></si><si><r><t>{escape(r['name'][:3])}</t></r><r><t xml:space='preserve'>{escape(r['name'][3:])}</t></r></si></sst>",
            "xl/styles.xml": "<styleSheet><numFmts><numFmt numFmtId='170' formatCode='d/m/yy hh:mm'/></numFmts><cellXfs><xf numFmtId='0'/><xf numFmtId='14'/><xf numFmtId='170'/></cellXfs></styleSheet>",
            "xl/worksheets/s1.xml": sheet(stock), "xl/worksheets/s2.xml": sheet(days),
        })

    rows = spark.sql(BOOKS, part=table(spark, sf_dir, "part"))
    return _files(rows.repartition(_tasks(spark, sf_dir), "k"), "k", content)


CATALOG = f"select 'parts' as source, cast(p_partkey as string) as record_id, p_name as title, p_brand as creator, {ISBN} as isbn from {{part}}"
_CORE = "lpad(cast(p_partkey as string), 9, '0')"
_TEN = "({digits}) % 11".format(digits=" + ".join(f"{i + 1} * (cast(floor(p_partkey / {10 ** (8 - i)}) as bigint) % 10)" for i in range(9)))
#: A part's ISBN-10; every seventh has a wrong check digit.
ISBN10 = f"concat({_CORE}, case when ({_TEN} + case when p_partkey % 7 = 0 then 1 else 0 end) % 11 = 10 then 'x' else cast(({_TEN} + case when p_partkey % 7 = 0 then 1 else 0 end) % 11 as string) end)"
_HYPHENS = f"concat(substr({ISBN10}, 1, 4), '-', substr({ISBN10}, 5, 5), '- ', substr({ISBN10}, 10, 1))"
#: Offers' ISBNs (first and second) with placeholders, broken and missing ones; and records that a library holds, some of them twice under one ISBN.
OFFERED = f"""
    select p_partkey as offer_id, case p_partkey % 9 when 3 then '978-0-00-000000-2' when 4 then 'n/a' when 5 then null when 6 then ' ' else {ISBN} end as first,
           case when p_partkey % 3 = 1 then {ISBN10} end as second from {{part}}
"""
HELD = f"""
    select concat('h', cast(p_partkey as string)) as record_id, case when p_partkey % 50 = 0 then '9780000000002' when p_partkey % 2 = 0 then {ISBN} else {_HYPHENS} end as isbn from {{part}} where p_partkey % 5 <> 1
    union all select concat('d', cast(p_partkey as string)), {ISBN10} from {{part}} where p_partkey % 11 = 0
"""
#: Amounts selected for plans: some unknown, some in another currency or for no plan.
SELECTED = """
    select o_custkey + case when o_orderkey % 101 = 0 then 100000000 else 0 end as order_plan_id, case when o_orderkey % 29 <> 0 then cast(o_totalprice as decimal(14,2)) end as amount,
           case when o_orderkey % 17 = 0 then 'CHF' when o_custkey % 5 = 0 then 'USD' when o_custkey % 5 = 1 then 'EUR' else 'BND' end as currency from {orders} where o_custkey % 3 <> 1
"""
BUDGETS = """
    select c_custkey as id, case c_custkey % 5 when 0 then 'USD' when 1 then 'EUR' when 2 then null else 'BND' end as base_currency, case when c_custkey % 4 <> 0 then cast(c_acctbal as decimal(14,2)) end as budget
    from {customer}
"""
PLANS = """
    select c_custkey as id, case when c_custkey % 40 = 0 then '  ' else concat(' ', c_name, ' ') end as name, cast(c_acctbal as decimal(14,2)) as budget,
           case c_custkey % 5 when 0 then ' usd' when 1 then 'EUR' when 2 then 'Euro' when 3 then '' else 'BND' end as base_currency,
           cast(c_custkey * 7919 % 1009 as int) as day
    from {customer}
"""
LISTS = "select o_orderkey as id, concat('List ', cast(o_orderkey % 9 as string)) as name, o_custkey + case when o_orderkey % 101 = 0 then 100000000 else 0 end as order_plan_id, o_orderdate as inserted_at from {orders} where o_custkey % 13 <> 0"


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CATALOG, part=table(spark, sf_dir, "part"))


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spark.sql(PLANS, customer=table(spark, sf_dir, "customer"))
    return found.withColumn("inserted_at", F.expr("timestampadd(DAY, day, timestamp_ntz'2024-01-01 00:00:00')").cast("timestamp")).drop("day")


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LISTS, orders=table(spark, sf_dir, "orders")).withColumn("inserted_at", F.col("inserted_at").cast("timestamp"))
