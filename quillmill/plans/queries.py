"""A query for each operator over derived tables, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signals as S
from ..functions.isbn import is_valid_isbn
from ..functions.text import blank, clean, grapheme_len, locator_text, shortened, utrim, ws_normalize
from ..operators import catalog, import_quality, interpret, planning, spreadsheet
from ..operators.budgets import budget_summary
from ..operators.catalog_index import CatalogIndex
from ..operators.line_offers import offer_candidate, parse_lines, split_title, text_lines, without_preamble
from ..operators.row_offers import parse_rows
from ..operators.matching import matched
from ..operators.segment import segment
from ..operators.substring_join import counted
from ..sources import csv_files, export, offer_files, readers
from ..sources.shared import scratch_path
from ..types import OFFER, schema
from . import derived
from .imports import placed, process, split

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _duck(sql: str) -> str:
    for name in ("part", "customer", "orders"):
        sql = sql.replace(f"{{{name}}}", name)
    return sql


LINES, ROWS, PARAGRAPHS = _duck(derived.LINES), _duck(derived.ROWS), _duck(derived.PARAGRAPHS)
PRICE = r"^\s*(USD|BND|\$)\s*:?\s*(\d+(?:[.,]\d+)?)\s*(?:\(([^)]+)\))?\s*/\s*([A-Za-z0-9-]+)\s*$"
URL = r"https?://(www\.)?marymartin\.com/web\?pid=\d+"
_SIG = {
    "url": f"regexp_matches(text, '{URL}', 'i')",
    "price": f"regexp_matches(text, '{PRICE}')",
    "weight": r"regexp_matches(text, '^\s*\d+([.,]\d+)?\s*(gm\.?|kg\.?)\s*$', 'i')",
    "id": r"regexp_matches(regexp_replace(text, '[\s-]', '', 'g'), '^(\d{9}[\dXx]|\d{11,13})$')",
    "pub": r"regexp_matches(text, ':\s*.+(19|20)\d{2}\s*$')",
    "phys": r"regexp_matches(text, '(\d+\s*p\.?|[ivxlcdm]+\s*[,+.]\s*\d+\s*p\.?|\d+\s*v\.)', 'i')",
    "edition": r"regexp_matches(text, '\b(edition|edisi)\b', 'i')",
    "note": r"(regexp_matches(text, '^Includes?\s+(Bibliography|Index)\.?$', 'i') or (text like '(%)' and length(text) <= 120))",
    "topic": "(length(text) between 2 and 100 and not contains(text, '.') and not contains(text, ':'))",
    "long": "length(text) >= 60",
}
_VALID = """(length(v) = 13 and (
    list_sum(list_transform(range(1, 14), lambda i: (case when i % 2 = 1 then 1 else 3 end) * cast(substr(v, cast(i as int), 1) as int))) % 10 = 0))"""
_AMOUNT = f"round(try_cast(replace(nullif(regexp_extract(text, '{PRICE}', 2), ''), ',', '.') as decimal(20,4)), 2)"
_TRIMMED = f"select k, n, trim(text) as text, coalesce(style = 'ListParagraph', false) as listed from ({LINES}) where trim(text) <> ''"
_SIGNALS = f"select k, n, text, listed, {', '.join(f'{e} as {n}' for n, e in _SIG.items())}, row_number() over (partition by k order by n) - 2 as i from ({_TRIMMED})"
_CANDIDATE = "select k, (bool_or(url)::int + bool_or(price)::int + bool_or(pub)::int) >= 2 as ok from lines group by k"


def _cascade() -> str:
    """Line fields by exclusion, one window for each slot."""
    free = "not id_used and not listed"
    steps = [("u", "url", "not listed"), ("p", "price", "not listed"), ("w", "weight", "not listed")]
    sql = f"with lines as ({_SIGNALS}), good as ({_CANDIDATE}), a0 as (select lines.*, min(case when pub then i end) over (partition by k) as pub_at, min(case when id then i end) over (partition by k) as id_at from lines join good using (k) where ok and i >= 0)"
    last, slots = "a0", []

    def step(name: str, where: str) -> None:
        nonlocal sql, last
        out = f"a{len(slots) + 1}"
        other = "".join(f" and i is distinct from {s}" for s in slots)
        sql += f", {out} as (select *, min(case when {where}{other} then i end) over (partition by k) as {name} from {last})"
        last = out
        slots.append(name)

    for name, signal, where in steps:
        step(name, f"{signal} and {where}")
    sql += f", b as (select *, id and not listed and i is distinct from u and i is distinct from p and i is distinct from w as id_used from {last})"
    last = "b"
    step("pb", f"pub and {free}")
    step("ph", f"phys and {free}")
    step("c", f"i > ph and i < id_at and topic and not (id or price or weight or note or url) and {free}")
    step("e", f"edition and {free}")
    left = free + "".join(f" and i is distinct from {s}" for s in slots)
    sql += f""", left_ as (select *, {left} as open, coalesce(i < pub_at, false) as before, coalesce(i > least(p, w), false) and long and not url as told from {last}),
      heads as (select k, text as head from lines where i = -1),
      agg as (select k, max(case when i = u then regexp_extract(text, '{URL}', 0, 'i') end) as vendor_url, max(case when i = pb then text end) as publication,
        max(case when i = ph then text end) as physical, max(case when i = c then text end) as topic_, max(case when i = e then text end) as edition,
        max(case when i = w then text end) as weight, max(case when i = p then text end) as price_line,
        coalesce(string_agg(case when id_used then text end, '|' order by i), '') as identifiers, coalesce(string_agg(case when listed then text end, '|' order by i), '') as subjects,
        coalesce(string_agg(case when open and note then text end, '|' order by i), '') as notes,
        coalesce(string_agg(case when open and not note and before then text end, '|' order by i), '') as series,
        coalesce(string_agg(case when open and not note and not before and told then text end, '|' order by i), '') as descriptions,
        coalesce(string_agg(case when open and not note and not before and not told then text end, '|' order by i), '') as unparsed
        from left_ group by k),
      offers as (select k, case when regexp_matches(head, '/') then trim(regexp_extract(head, '^(.*)/([^/]*)$', 1)) else head end as title,
        case when regexp_matches(head, '/') then trim(regexp_extract(head, '^(.*)/([^/]*)$', 2)) end as responsibility, vendor_url, publication, physical, edition, weight,
        identifiers, subjects, notes, series, descriptions, unparsed, coalesce(case when k % 5 = 0 then 'Stock' end, topic_) as category,
        cast({_AMOUNT.replace('text', 'price_line')} * 100 as bigint) as cents, nullif(regexp_extract(price_line, '{PRICE}', 1), '') as currency,
        nullif(regexp_extract(price_line, '{PRICE}', 3), '') as qualifier, nullif(regexp_extract(price_line, '{PRICE}', 4), '') as binding
        from heads join agg using (k))"""
    return sql


_OFFERS = _cascade()


def _cents(amount):
    return (amount * 100).cast("long")


def _fields() -> dict:
    return {n: F.col(n) for n in schema(OFFER).names}


def _bar(c):
    return F.array_join(c, "|")


def _line_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return process(derived.records(spark, sf_dir), parse_lines)


def _one_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.lines(spark, sf_dir).select("k", F.col("n").cast("int").alias("n"), utrim(F.col("text")).alias("text"))


_ALL = f"select k, n, trim(text) as text from ({LINES})"


@query(f"""select k, n, cast({_AMOUNT} * 100 as bigint) as cents, regexp_extract(text, '{PRICE}', 1) as currency,
    nullif(regexp_extract(text, '{PRICE}', 3), '') as qualifier, regexp_extract(text, '{PRICE}', 4) as binding from ({_ALL}) where {_SIG["price"]}""")
def price_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    priced = _one_line(spark, sf_dir).withColumn("p", S.price(F.col("text"))).where("p is not null")
    return priced.select("k", "n", _cents(F.col("p.amount")).alias("cents"), "p.currency", "p.qualifier", "p.binding")


@query(f"select k, n, text from ({_ALL}) where {_SIG['id']}")
def id_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_line(spark, sf_dir).where(S.is_identifier(F.col("text")))


@query(f"""with v as (select v from (select trim(text) as v from ({LINES}) where n = 60))
    select case when {_VALID} then 'valid' else 'invalid' end as status, count(*) as n from v group by 1""")
def isbn_status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = derived.lines(spark, sf_dir).where("n = 60")
    status = F.when(is_valid_isbn(F.col("text")), "valid").otherwise("invalid")
    return lines.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(f"select k, n, text from ({_ALL}) where {_SIG['phys']}")
def physical_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_line(spark, sf_dir).where(S.is_physical(F.col("text")))


@query(f"select k, n, text from ({_ALL}) where {_SIG['pub']}")
def publication_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_line(spark, sf_dir).where(S.is_publication(F.col("text")))


@query(f"select k, n, text from ({_ALL}) where {_SIG['weight']}")
def weight_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_line(spark, sf_dir).where(S.is_weight(F.col("text")))


@query(f"select k, n, regexp_extract(text, '{URL}', 0, 'i') as url from ({_ALL}) where {_SIG['url']}")
def vendor_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_line(spark, sf_dir).select("k", "n", S.vendor_url(F.col("text")).alias("url")).where("url is not null")


@query(f"select k, n, {_SIG['edition']} as edition, {_SIG['note']} as note, {_SIG['topic']} as topic, {_SIG['long']} as long from ({_ALL})")
def line_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _one_line(spark, sf_dir).select("k", "n", S.is_edition(t).alias("edition"), S.is_note(t).alias("note"), S.is_category_text(t).alias("topic"), (grapheme_len(t) >= 60).alias("long"))


@query(f"""select k, case when contains(text, '/') then trim(regexp_extract(text, '^(.*)/([^/]*)$', 1)) else text end as title,
    case when contains(text, '/') then trim(regexp_extract(text, '^(.*)/([^/]*)$', 2)) end as responsibility from ({_ALL}) where n = 10""")
def title_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    title, responsibility = split_title(F.col("text"))
    return _one_line(spark, sf_dir).where("n = 10").select("k", title.alias("title"), responsibility.alias("responsibility"))


_SEGMENTS = f"""
    with p as (select *, coalesce(style = 'Heading1', false) as heading from ({PARAGRAPHS})),
    b as (select *, heading or regexp_matches(trim(text), '^[-_]{{20,}}$') as boundary from p),
    s as (select *, sum(boundary::int) over w as grp, last_value(case when heading then trim(text) end ignore nulls) over w as category from b
          window w as (partition by file order by index rows between unbounded preceding and current row)),
    r as (select *, min(case when trim(text) <> '' then index end) over (partition by file, grp) as first, max(case when trim(text) <> '' then index end) over (partition by file, grp) as last from s where not boundary),
    seg as (select file, first as paragraph_start, last as paragraph_end, min(category) as category, count(*) as paragraphs, string_agg(text, '|' order by index) as text
            from r where index between first and last group by file, grp, first, last)
"""


@query(f"{_SEGMENTS} select file, paragraph_start, paragraph_end, category, paragraphs, text from seg")
def segment_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segment(derived.paragraphs(spark, sf_dir))
    texts = F.transform("raw_paragraphs", lambda p: p["text"])
    return found.select(F.col("source_filename").alias("file"), "locator.paragraph_start", "locator.paragraph_end", F.col("vendor_category").alias("category"), F.size("raw_paragraphs").cast("long").alias("paragraphs"), _bar(texts).alias("text"))


@query(f"{_SEGMENTS} select category, count(*) as records from seg group by category")
def segment_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment(derived.paragraphs(spark, sf_dir)).groupBy(F.col("vendor_category").alias("category")).agg(F.count(F.lit(1)).alias("records"))


@query(f"with lines as ({_SIGNALS}) {_CANDIDATE}")
def offer_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.records(spark, sf_dir).select("k", offer_candidate(without_preamble(text_lines(F.col("raw_paragraphs")))).alias("ok"))


_ADDRESS = [("Mary Martin Booksellers Pte Ltd",), ("Blk 231",), ("see WWW.marymartin.com for more",)]


@query(f"""select k, count(*) as lines,
    max(case when i = -1 then text end) as head from ({_SIGNALS}) group by k""")
def preamble_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An address block is put before every third record's lines and taken off again."""
    block = F.array(*(F.struct(F.lit(0).alias("index"), F.lit(t).alias("text"), F.lit(None).cast("string").alias("style")) for (t,) in _ADDRESS))
    records = derived.records(spark, sf_dir)
    raw = F.when(F.col("k") % 3 == 0, F.concat(block, "raw_paragraphs")).otherwise(F.col("raw_paragraphs"))
    found = without_preamble(text_lines(raw))
    return records.select("k", F.size(found).cast("long").alias("lines"), F.get(found, F.lit(0))["text"].alias("head"))


_FIELDS = "title, responsibility, vendor_url, publication, physical, edition, weight, identifiers, subjects, notes, series, descriptions, unparsed, category, cents, currency, qualifier, binding"


@query(f"{_OFFERS} select k, {_FIELDS} from offers")
def cascade_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _fields()
    texts = lambda c: _bar(F.transform(c, lambda x: x["text"]))
    return _line_offers(spark, sf_dir).where("error is null").select(
        "source.k", texts(o["titles"]).alias("title"), o["responsibility_statement"].alias("responsibility"), o["vendor_url"].alias("vendor_url"), o["publication_statement"].alias("publication"),
        o["physical_description"].alias("physical"), o["edition_statement"].alias("edition"), o["weight"].alias("weight"), _bar(F.transform(o["identifiers"], lambda i: i["value"])).alias("identifiers"),
        _bar(o["subjects"]).alias("subjects"), _bar(o["notes"]).alias("notes"), _bar(o["series_statements"]).alias("series"), texts(o["descriptions"]).alias("descriptions"),
        _bar(o["unparsed"]).alias("unparsed"), o["vendor_category"].alias("category"), _cents(o["price_amount"]).alias("cents"), o["price_currency"].alias("currency"), o["price_qualifier"].alias("qualifier"), o["binding"].alias("binding"),
    )


@query(f"{_OFFERS} select unnest(string_split(unparsed, '|')) as value, count(*) as n from offers where unparsed <> '' group by 1 order by n desc, value limit 10")
def cascade_unparsed_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return import_quality.frequent_unparsed(_line_offers(spark, sf_dir).where("error is null"))


_ROW_SQL = f"""
    select k, code as vendor_code, nullif(trim(title), '') as title, translation, coalesce(nullif(trim(content_blank), ''), content) as description, isbn, authors as responsibility,
      language, nullif(concat_ws(', ', publisher, year), '') as publication, nullif(concat_ws('; ', 'Pages: ' || pages, 'Size: ' || size), '') as physical,
      cast(case price_kind when 'decimal' then cast(round(price_number, 2) as decimal(20,6)) when 'int' then cast(price_number as decimal(20,6)) when 'string' then try_cast(trim(price_text) as decimal(20,6)) end * 1000 as bigint) as mills,
      case when price_kind <> 'null' then 'EUR' end as currency
    from ({ROWS}) where k % 50 <> 49
"""


def _row_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return process(derived.row_records(spark, sf_dir), parse_rows)


@query(_ROW_SQL)
def row_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _fields()
    role = lambda c, name: F.get(F.transform(F.filter(c, lambda x: x["role"] == name), lambda x: x["text"]), F.lit(0))
    return _row_offers(spark, sf_dir).where("error is null").select(
        "source.k", o["vendor_code"].alias("vendor_code"), role(o["titles"], "primary_title").alias("title"), role(o["titles"], "translated_title").alias("translation"),
        role(o["descriptions"], "description").alias("description"), F.get(o["identifiers"], F.lit(0))["value"].alias("isbn"), o["responsibility_statement"].alias("responsibility"),
        F.get(o["language_statements"], F.lit(0)).alias("language"), o["publication_statement"].alias("publication"), o["physical_description"].alias("physical"),
        (o["price_amount"] * 1000).cast("long").alias("mills"), o["price_currency"].alias("currency"),
    )


@query(f"select publication, count(*) as n from ({_ROW_SQL}) group by 1")
def publication_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _row_offers(spark, sf_dir).where("error is null").groupBy(F.col("publication_statement").alias("publication")).agg(F.count(F.lit(1)).alias("n"))


@query(f"select physical, count(*) as n from ({_ROW_SQL}) group by 1")
def physical_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _row_offers(spark, sf_dir).where("error is null").groupBy(F.col("physical_description").alias("physical")).agg(F.count(F.lit(1)).alias("n"))


_HEADS = f"""with c as (select k, [a, b, c, d] as own from ({_duck(derived.HEADS)})),
    h as (select k, list_transform(own, lambda x, i: case when trim(coalesce(x, '')) = '' then '__unnamed_column_' || i else x end) as h from c),
    p as (select k::varchar as sheet, array_to_string(h, '|') as headers, list_filter(h, lambda x, i: len(list_filter(h, lambda y: y = x)) > 1 and list_position(h, x) = i) as twice from h)"""


@query(f"{_HEADS} select sheet, headers, array_to_string(twice, '|') as twice from p")
def header_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = derived.header_rows(spark, sf_dir).where("row_no = 1").select("sheet", spreadsheet.prepared(F.col("cells")).alias("h"))
    return heads.select("sheet", _bar(F.col("h")).alias("headers"), _bar(spreadsheet.duplicates(F.col("h"))).alias("twice"))


@query(f"{_HEADS} select sheet, 'duplicate_headers' as error, array_to_string(twice, ', ') as detail from p where len(twice) > 0")
def header_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spreadsheet.from_rows(derived.header_rows(spark, sf_dir)).where("error is not null")
    return found.select("locator.sheet", "error", "detail")


_SHEET = _duck(derived.SHEET_ROWS)


@query(f"""select sheet, count(*) as rows_, sum(case when coalesce(trim(a), '') = '' and coalesce(trim(b), '') = '' and coalesce(trim(c), '') = '' and d is null then 1 else 0 end)::bigint as empty
    from ({_SHEET}) group by sheet""")
def empty_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.sheet_rows(spark, sf_dir).where("row_no > 1")
    return rows.groupBy("sheet").agg(F.count(F.lit(1)).alias("rows_"), F.count_if(spreadsheet.is_empty_row(F.col("cells"))).alias("empty"))


@query(f"""select sheet, row_no, a as name, case when sheet = 's0' then b end as brand, case when sheet = 's2' then b end as unnamed, d as beyond from ({_SHEET})
    where sheet <> 's1' and not (coalesce(trim(a), '') = '' and coalesce(trim(b), '') = '' and coalesce(trim(c), '') = '' and d is null)""")
def sheet_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spreadsheet.from_rows(derived.sheet_rows(spark, sf_dir)).where("error is null")
    text = lambda name: F.try_element_at("raw_row", F.lit(name))["s"]
    return found.select("locator.sheet", F.col("locator.row").alias("row_no"), text("Name").alias("name"), text("Brand").alias("brand"), text("__unnamed_column_2").alias("unnamed"), text("__unnamed_column_4").alias("beyond"))


@query(f"""select sheet, row_no, a as name, row_number() over (order by sheet, row_no) as place from ({_SHEET})
    where sheet <> 's1' and not (coalesce(trim(a), '') = '' and coalesce(trim(b), '') = '' and coalesce(trim(c), '') = '' and d is null)""")
def record_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each sheet's record in the order of all files."""
    records = spreadsheet.from_rows(derived.sheet_rows(spark, sf_dir)).where("error is null").drop("error", "detail")
    found = placed(process(records, parse_rows))
    return found.select("source.locator.sheet", F.col("source.locator.row").alias("row_no"), F.try_element_at("source.raw_row", F.lit("Name"))["s"].alias("name"), "place")


@query(f"""select 'offers' as side, count(*) as n, sum(k)::bigint as keys from ({ROWS}) where k % 50 <> 49
    union all select 'invalid_raw_record', count(*), sum(k)::bigint from ({ROWS}) where k % 50 = 49""")
def process_many_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers, errors = split(_row_offers(spark, sf_dir))
    count = lambda df, side: df.groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"), F.sum("source.k").alias("keys"))
    return count(offers, F.lit("offers")).unionByName(count(errors, F.col("error")))


@query(f"""{_OFFERS} select (select count(*) from good) as candidates, count(*) as offers, (select count(*) from good where not ok) as failures, count(category) as with_category, count(*) - count(category) as without_category,
    count(*) filter (where identifiers <> '') as with_identifiers, count(cents) as with_price, count(*) filter (where descriptions <> '') as with_description, count(*) filter (where unparsed <> '') as with_unparsed,
    sum(case when unparsed <> '' then len(string_split(unparsed, '|')) else 0 end)::bigint as unparsed_statements from offers""")
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return import_quality.totals(_line_offers(spark, sf_dir))


@query(f"""{_OFFERS}, ids as (select unnest(string_split(identifiers, '|')) as v from offers where identifiers <> '')
    select case when {_VALID} then 'valid' else 'invalid' end as status, count(*) as n from ids group by 1""")
def identifier_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return import_quality.status_histogram(_line_offers(spark, sf_dir).where("error is null"))


@query(f"""{_OFFERS}, bad as (select k, count(*) filter (where not {_VALID}) as n from (select k, unnest(string_split(identifiers, '|')) as v from offers where identifiers <> '') group by k)
    select k, unparsed <> '' as has_unparsed, identifiers = '' as lacks_identifier, coalesce(n, 0) > 0 as has_invalid from offers left join bad using (k)
    where unparsed <> '' or identifiers = '' or coalesce(n, 0) > 0""")
def offer_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers = _line_offers(spark, sf_dir).where("error is null")
    flags = {"has_unparsed": import_quality.with_unparsed, "lacks_identifier": import_quality.without_identifiers, "has_invalid": import_quality.with_invalid_identifier}
    found = [f(offers).select("source.k", F.lit(name).alias("flag")) for name, f in flags.items()]
    every = found[0].unionByName(found[1]).unionByName(found[2])
    return every.groupBy("k").agg(*(F.max(F.col("flag") == name).alias(name) for name in flags))


@query(f"""{_SEGMENTS}, w as (select file, unnest(range(paragraph_start, paragraph_end + 1)) as index from seg)
    select w.file, (w.index)::int as index, coalesce(p.text, '<missing>') as text from w left join ({PARAGRAPHS}) p on w.file = p.file and w.index = p.index""")
def missing_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    paragraphs = derived.paragraphs(spark, sf_dir)
    return import_quality.paragraphs_of(segment(paragraphs), paragraphs)


_KINDS = "case when url then 'url' when weight then 'weight' when price then 'price' when id then 'identifier' when phys then 'physical' when pub then 'publication' else 'rest' end"


@query(f"""with t as (select *, {_KINDS} as kind from ({_SIGNALS}))
    select k, max_by(regexp_extract(text, '{URL}', 0, 'i'), i) filter (where kind = 'url') as vendor_url, max_by(text, i) filter (where kind = 'weight') as weight, max_by(text, i) filter (where kind = 'price') as price_source,
      coalesce(string_agg(text, '|' order by i) filter (where kind = 'identifier'), '') as identifiers, max_by(text, i) filter (where kind = 'physical') as physical, max_by(text, i) filter (where kind = 'publication') as publication,
      coalesce(string_agg(text, '|' order by i) filter (where kind = 'rest'), '') as remaining, count(*) as lines from t group by k""")
def interpret_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("deterministic")
    return interpret.prepare(derived.records(spark, sf_dir)).select(
        "k", d["vendor_url"].alias("vendor_url"), d["weight"].alias("weight"), d["price_source"].alias("price_source"), _bar(d["identifiers"]).alias("identifiers"),
        d["physical_description"].alias("physical"), d["publication_statement"].alias("publication"), _bar(F.col("remaining_lines")).alias("remaining"), F.size("source_lines").cast("long").alias("lines"),
    )


_RESULTS = """
    select doc_id, coalesce(text, '') as text, case when doc_id % 4 = 0 then concat('#', substr(coalesce(text, ''), 3, 30)) else substr(coalesce(text, ''), 3, 30) end as title,
      case when doc_id % 5 = 0 then '' else substr(coalesce(text, ''), 20, 25) end as note, case when doc_id % 7 = 0 then 'nowhere to be found' else substr(coalesce(text, ''), 1, 12) end as description
    from {documents}
"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_RESULTS, documents=derived.table(spark, sf_dir, "documents"))
    none = F.array().cast("array<string>")
    return rows.select("doc_id", F.split("text", "\n").alias("source_lines"), "title", F.lit(None).cast("string").alias("responsibility_statement"), none.alias("vendor_classifications"), F.array("description").alias("descriptions"), F.array("note").alias("notes"), none.alias("unresolved"))


_GROUNDED = r"""
    with r as (select doc_id, trim(regexp_replace(replace(text, chr(10), ' '), '\s+', ' ', 'g')) as source, text,
        unnest([{'o': 1, 'field': 'title', 'value': title}, {'o': 2, 'field': 'descriptions', 'value': description}, {'o': 3, 'field': 'notes', 'value': note}]) as f from (RESULTS)),
    v as (select doc_id, f.o as o, f.field as field, f.value as value, trim(regexp_replace(f.value, '\s+', ' ', 'g')) as own, source from r),
    g as (select doc_id, o, field, value, (own <> '' and contains(source, own)) or (field = 'title' and value = '') as grounded from v)
""".replace("RESULTS", _RESULTS.replace("{documents}", "documents"))


@query(f"{_GROUNDED} select doc_id, field, value, grounded from g")
def grounding_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = ws_normalize(F.concat_ws(" ", "source_lines"))
    pairs = F.array(*(F.struct(F.lit(n).alias("field"), v.alias("value")) for n, v in (("title", F.col("title")), ("descriptions", F.get("descriptions", F.lit(0))), ("notes", F.get("notes", F.lit(0))))))
    rows = _results(spark, sf_dir).select("doc_id", source.alias("source"), F.explode(pairs).alias("p"))
    return rows.select("doc_id", "p.field", "p.value", (S.is_grounded(F.col("p.value"), F.col("source")) | ((F.col("p.field") == "title") & (F.col("p.value") == ""))).alias("grounded"))


@query(f"{_GROUNDED} select doc_id, arg_min(field, o) as field, arg_min(value, o) as value from g where not grounded group by doc_id")
def grounding_first_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpret.grounded(_results(spark, sf_dir)).where("ungrounded is not null").select("doc_id", "ungrounded.field", "ungrounded.value")


_VALUES = _RESULTS.replace("{documents}", "documents")


@query(rf"""with d as (select doc_id, trim(regexp_replace(replace(text, chr(10), ' '), '\s+', ' ', 'g')) as text, unnest([title, note, description]) as value from ({_VALUES})),
    v as (select distinct trim(regexp_replace(value, '\s+', ' ', 'g')) as value from d),
    s as (select distinct doc_id, text from d)
    select value, count(*) as records, min(doc_id) as first from v join s on contains(s.text, v.value) where v.value <> '' group by value""")
def grounded_anywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each value of any record's reading, in how many records' sources it lies, whosever they are."""
    rows = _results(spark, sf_dir)
    sources = rows.select(F.col("doc_id").alias("source_id"), ws_normalize(F.concat_ws(" ", "source_lines")).alias("text"))
    values = rows.select(F.explode(F.array("title", F.get("notes", F.lit(0)), F.get("descriptions", F.lit(0)))).alias("value")).select(ws_normalize(F.col("value")).alias("value"))
    return counted(values, sources)


_CATALOG = _duck(derived.CATALOG)


@query(f"select record_id, title, creator, isbn from ({_CATALOG}) where contains(lower(concat_ws(' ', title, creator, isbn)), 'ring brand#2')")
def catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.TableAdapter(derived.catalog(spark, sf_dir)).search("  RING Brand#2 ").records.drop("source")


@query(f"""with c as (select record_id, title, isbn, lower(concat_ws(' ', title, creator, isbn)) as hay from ({_CATALOG})),
    q as (select distinct unnest(string_split(title, ' ') || [left(title, 1), right(title, 2), ' ' || upper(title) || '  ', substr(isbn, 4, 8)]) as query from c where record_id::bigint % 50 = 0)
    select query, record_id from q join c on contains(hay, lower(trim(query)))""")
def catalog_search_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every 50th title, the title, its first and last characters and a part of its isbn as queries, against all records."""
    records = derived.catalog(spark, sf_dir)
    title = F.col("title")
    asked = F.concat(F.split(title, " "), F.array(F.left(title, F.lit(1)), F.right(title, F.lit(2)), F.concat(F.lit(" "), F.upper(title), F.lit("  ")), F.substring("isbn", 4, 8)))
    queries = records.where("cast(record_id as long) % 50 = 0").select(F.explode(asked).alias("query"))
    return CatalogIndex.build(records).search(queries).select("query", "record_id")


@query(f"select source, record_id, title, creator, isbn from ({_CATALOG}) where record_id = '17' or isbn = '17' order by record_id limit 1")
def catalog_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.Catalog("parts", parts=catalog.TableAdapter(derived.catalog(spark, sf_dir))).lookup(" 17 ").records


#: A canonical ISBN of a value ``c`` in capitals without hyphens and blanks.
_THIRTEEN = """case when regexp_matches(c, '^[0-9]{13}$') and list_sum(list_transform(range(1, 14), lambda i: (case when i % 2 = 1 then 1 else 3 end) * substr(c, i::int, 1)::int)) % 10 = 0 then c
    when regexp_matches(c, '^[0-9]{9}[0-9X]$') and list_sum(list_transform(range(1, 11), lambda i: i * (case substr(c, i::int, 1) when 'X' then 10 else ascii(substr(c, i::int, 1)) - 48 end))) % 11 = 0
    then '978' || left(c, 9) || (10 - (38 + list_sum(list_transform(range(1, 10), lambda i: (case when i % 2 = 1 then 3 else 1 end) * substr(c, i::int, 1)::int))) % 10) % 10 end"""


@query(f"""with o as (select offer_id, value, upper(regexp_replace(value, '[\\s-]', '', 'g')) as c from (select offer_id, unnest([first, second]) as value from ({_duck(derived.OFFERED)}))),
    e as (select distinct offer_id, trim(value) <> '' as given, {_THIRTEEN} as isbn from o),
    h as (select isbn, count(distinct record_id) as n, min(record_id) as first from (select record_id, {_THIRTEEN} as isbn from (select record_id, upper(regexp_replace(isbn, '[\\s-]', '', 'g')) as c from ({_duck(derived.HELD)}))) where isbn is not null group by isbn),
    g as (select offer_id, coalesce(bool_or(given), false) as given, count(e.isbn) as valid, coalesce(sum(n), 0)::bigint as records, min(h.first) as record_id from e left join h on e.isbn = h.isbn group by offer_id)
    select offer_id, case when not given or valid = 0 then 'failed' when records = 0 then 'not_found' when records = 1 then 'exact_edition' else 'ambiguous' end as state,
      case when not given then 'no_identifier' when valid = 0 then 'invalid_identifier' end as reason, records, record_id from g""")
def offer_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = derived.table(spark, sf_dir, "part")
    offers = spark.sql(derived.OFFERED, part=part).select("offer_id", F.array("first", "second").alias("isbns"))
    return matched(offers, catalog.Answer(spark.sql(derived.HELD, part=part)))


@query(f"""with s as (select order_plan_id, currency, count(*) as items, count(amount) as amounts, sum(amount) as amount from ({_duck(derived.SELECTED)}) group by all),
    p as (select b.id, b.base_currency, b.budget, coalesce(sum(items), 0) as items, coalesce(sum(amounts) filter (where currency = base_currency), 0) as known, coalesce(sum(amount) filter (where currency = base_currency), 0) as selected
        from ({_duck(derived.BUDGETS)}) b left join s on s.order_plan_id = b.id group by all),
    g as (select case when grouping(id) = 0 then 'plan' when grouping(base_currency) = 0 then 'currency' else 'all' end as level, id as order_plan_id, base_currency as currency, count(*) as plans, sum(budget) as budget, count(*) - count(budget) as unbudgeted,
        sum(items)::bigint as items, sum(selected) as selected, sum(items - known)::bigint as unknown from p group by grouping sets ((id, base_currency), (base_currency), ()))
    select level, order_plan_id, currency, plans, case when level <> 'all' then cast(budget * 100 as bigint) end as budget, unbudgeted, items, case when level <> 'all' then cast(selected * 100 as bigint) end as selected, unknown,
      case when level <> 'all' and unbudgeted = 0 and unknown = 0 then cast((budget - selected) * 100 as bigint) end as remaining from g""")
def budget_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = spark.sql(derived.BUDGETS, customer=derived.table(spark, sf_dir, "customer"))
    out = budget_summary(plans, spark.sql(derived.SELECTED, orders=derived.table(spark, sf_dir, "orders")))
    return out.select("level", "order_plan_id", "currency", "plans", _cents(F.col("budget")).alias("budget"), "unbudgeted", "items", _cents(F.col("selected")).alias("selected"), "unknown", _cents(F.col("remaining")).alias("remaining"))


_PLANS = f"select id, name, budget, base_currency, timestamp '2024-01-01 00:00:00' + to_days(day) as inserted_at from ({_duck(derived.PLANS)})"
_LISTS = _duck(derived.LISTS)


@query(f"select id, name, cast(cast(inserted_at as date) as varchar) as day from ({_PLANS}) order by inserted_at desc, id desc")
def plans_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = planning.newest_first(derived.plans(spark, sf_dir))
    return newest.select("id", "name", F.col("inserted_at").cast("date").cast("string").alias("day"))


@query(f"""select p.id, coalesce(string_agg(l.id::varchar, ',' order by l.inserted_at, l.id), '') as order_lists, count(l.id) as n
    from ({_PLANS}) p left join ({_LISTS}) l on p.id = l.order_plan_id group by p.id""")
def plan_with_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = planning.with_lists(derived.plans(spark, sf_dir), derived.lists(spark, sf_dir))
    ids = F.transform("order_lists", lambda x: x["id"].cast("string"))
    return found.select("id", F.array_join(ids, ",").alias("order_lists"), F.size("order_lists").cast("long").alias("n"))


@query(f"select id, name, cast(cast(inserted_at as date) as varchar) as day from ({_LISTS}) where order_plan_id = 7")
def lists_for_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.lists_of(derived.lists(spark, sf_dir), 7).select("id", "name", F.col("inserted_at").cast("date").cast("string").alias("day"))


@query(f"""with p as (select id, trim(name) as name, budget, upper(trim(base_currency)) as currency from ({_PLANS}))
    select id, name, currency, concat_ws('|', case when name = '' then 'name can''t be blank' end, case when currency = '' then 'base_currency can''t be blank' end,
      case when budget < 0 then 'budget must be greater than or equal to 0' end, case when currency <> '' and not regexp_matches(currency, '^[A-Z]{{3}}$') then 'base_currency must be a three-letter uppercase currency code' end) as errors from p""")
def plan_validation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = planning.checked_plans(derived.plans(spark, sf_dir))
    said = F.transform("errors", lambda e: F.concat_ws(" ", e["field"], e["message"]))
    return found.select("id", "name", F.col("base_currency").alias("currency"), _bar(said).alias("errors"))


@query(f"""with l as (select *, count(*) over (partition by order_plan_id, name) as uses from ({_LISTS}))
    select l.id, concat_ws('|', case when p.id is null then 'order_plan_id does not exist' end, case when uses > 1 then 'name has already been used in this order plan' end) as errors
    from l left join ({_PLANS}) p on l.order_plan_id = p.id where p.id is null or uses > 1""")
def list_name_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = derived.lists(spark, sf_dir)
    found = planning.checked_lists(lists, derived.plans(spark, sf_dir), lists.limit(0)).where(F.size("errors") > 0)
    return found.select("id", _bar(F.transform("errors", lambda e: F.concat_ws(" ", e["field"], e["message"]))).alias("errors"))


@query(f"select p.id, p.name from ({_PLANS}) p where not exists (select 1 from ({_LISTS}) l where l.order_plan_id = p.id)")
def deletable_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.deletable(derived.plans(spark, sf_dir), derived.lists(spark, sf_dir)).select("id", "name")


#: Plans that pass the checks with the ids that they get, and lists in the order in which they are inserted: three commits.
_LOG = f"""with p as (select id as k, row_number() over (order by id) as id from (select id, trim(name) as name, budget, upper(trim(base_currency)) as currency from ({_PLANS}))
        where name <> '' and (budget is null or budget >= 0) and regexp_matches(currency, '^[A-Z]{{3}}$')),
    l as (select l.id as k, l.name, p.id as plan_id, row_number() over (order by l.id % 3, l.id) as turn from ({_LISTS}) l left join p on l.order_plan_id = p.k),
    own as (select *, plan_id is not null and row_number() over (partition by plan_id, name order by turn) = 1 as good from l)"""


def _store(spark: SparkSession, sf_dir: str) -> tuple[planning.PlanStore, DataFrame, list[DataFrame]]:
    """A store of the derived plans, and of the lists in three commits; what the inserts gave."""
    store = planning.PlanStore(spark, scratch_path(spark))
    placed = store.insert_plans(derived.plans(spark, sf_dir).withColumnRenamed("id", "k"), "k")
    ids = placed.where("id is not null").select(F.col("k").alias("order_plan_id"), F.col("id").alias("plan_id"))
    lists = derived.lists(spark, sf_dir).withColumnRenamed("id", "k").join(ids, "order_plan_id", "left").withColumn("order_plan_id", F.coalesce("plan_id", F.lit(-1)))
    given = [store.insert_lists(lists.where(F.col("k") % 3 == turn).select("k", "name", "order_plan_id"), "k") for turn in range(3)]
    return store, placed, given


@query(f"{_LOG} select row_number() over (order by turn) as id, name, plan_id as order_plan_id from own where good")
def lists_in_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists of the last version."""
    store, _, _ = _store(spark, sf_dir)
    return store.lists().select("id", "name", "order_plan_id")


@query(f"""{_LOG} select k, case when good then '' when plan_id is null then 'order_plan_id does not exist' || case when turn > first then '|name has already been used in this order plan' else '' end
    else 'name has already been used in this order plan' end as errors from (select *, min(turn) over (partition by k % 3, coalesce(plan_id, -1), name) as first from own)""")
def lists_refused_by_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each list's insertion said."""
    _, _, given = _store(spark, sf_dir)
    every = given[0].unionByName(given[1]).unionByName(given[2])
    return every.select("k", _bar(F.transform("errors", lambda e: F.concat_ws(" ", e["field"], e["message"]))).alias("errors"))


@query(f"{_LOG} select p.id, p.k from p where p.id % 2 = 0 and not exists (select 1 from own where good and plan_id = p.id)")
def plans_deleted_in_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of even ids that are gone after an attempt to delete all of these."""
    store, placed, _ = _store(spark, sf_dir)
    before = store.log.snapshot().version
    store.delete_plans(store.plans().where("id % 2 = 0").select("id"))
    gone = store.plans(before).join(store.plans().select("id"), "id", "left_anti").select("id")
    return gone.join(placed.select("id", "k"), "id")


@query(f"""select k, n, case when length(flat) > 12 then substr(flat, 1, 12) || '…' else flat end as shown, flat = '' as blank_, nullif(flat, '') as clean_
    from (select k, n, trim(regexp_replace(text, '\\s+', ' ', 'g')) as flat from ({LINES}))""")
def display_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return derived.lines(spark, sf_dir).select("k", F.col("n").cast("int").alias("n"), shortened(t, 12).alias("shown"), blank(t).alias("blank_"), clean(t).alias("clean_"))


@query(f"{_SEGMENTS} select file, 'paragraph_end=' || paragraph_end || ', paragraph_start=' || paragraph_start as place from seg")
def display_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segment(derived.paragraphs(spark, sf_dir))
    return found.select(F.col("source_filename").alias("file"), locator_text(F.col("locator"), ["sheet", "row", "paragraph_start", "paragraph_end"]).alias("place"))


@query(f"""select k::varchar as file, (row_number() over (partition by k order by n))::int as index, text, style from ({LINES})""")
def docx_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.paragraphs(derived.docx_files(spark, sf_dir)).where("error is null").select("file", "index", "text", "style")


@query(f"""select response::varchar as file, record_id, case when subtitle is null then title else title || ': ' || subtitle end as title, creator, isbn from ({_duck(derived.MODS)})""")
def mods_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.catalogue_records(derived.mods_responses(spark, sf_dir)).where("error is null").select("file", "record_id", "title", "creator", "isbn")


@query(f"""with b as (select *, date '1899-12-30' + day as d from ({_duck(derived.BOOKS)})),
    c as (select k, unnest([{{'sheet': 'Stock', 'n': 2, 'at': 1, 'kind': 'string', 's': name}}, {{'sheet': 'Stock', 'n': 2, 'at': 2, 'kind': 'null', 's': null}}, {{'sheet': 'Stock', 'n': 2, 'at': 3, 'kind': 'string', 's': brand}},
      {{'sheet': 'Stock', 'n': 2, 'at': 4, 'kind': 'decimal', 's': price}}, {{'sheet': 'Days', 'n': 1, 'at': 1, 'kind': 'string', 's': d::date::varchar}},
      {{'sheet': 'Days', 'n': 1, 'at': 2, 'kind': 'string', 's': d::date::varchar || case quarter when 0 then '' when 1 then ' 06:00:00' when 2 then ' 12:00:00' else ' 18:00:00' end}}, {{'sheet': 'Days', 'n': 1, 'at': 3, 'kind': 'int', 's': day::varchar}}]) as x from b)
    select k::varchar as file, x.sheet as sheet, x.n as row_no, x."at" as place, x.kind as kind, x.s as shown, case when x.kind in ('int', 'decimal') then (try_cast(x.s as decimal(20,2)) * 100)::bigint end as hundredths from c""")
def xlsx_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readers.worksheet_rows(derived.workbooks(spark, sf_dir)).where("error is null")
    return rows.select("file", "sheet", "row_no", F.posexplode("cells").alias("place", "c")).select(
        "file", "sheet", "row_no", (F.col("place") + 1).alias("place"), "c.kind", F.col("c.s").alias("shown"), (F.col("c.d") * 100).cast("long").alias("hundredths")
    )


@query(f"""select k::varchar as file, (row_number() over (partition by k order by i))::int as place, v from (select k, 1 as i, name as v from ({_duck(derived.BOOKS)}) union all select k, 2, brand from ({_duck(derived.BOOKS)}) union all select k, 3, price from ({_duck(derived.BOOKS)}))""")
def xlsx_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sheet by name, its cells that aren't empty."""
    rows = readers.worksheet_rows(derived.workbooks(spark, sf_dir), "Stock").where("error is null")
    kept = F.filter("cells", lambda c: c["kind"] != "null")
    return rows.select("file", F.posexplode(kept).alias("place", "c")).select("file", (F.col("place") + 1).alias("place"), F.col("c.s").alias("v"))


_EXPORTED = """
    select k, case k % 8 when 0 then '=' when 1 then '+' when 2 then '-' when 3 then '@' when 4 then ' =' when 5 then chr(9) when 6 then '<&>' else '' end || p_name as name,
      case when k % 3 <> 0 then p_brand end as brand, price from (select p_partkey as k, p_name, p_brand, case when p_partkey % 5 <> 0 then cast(p_retailprice as decimal(12,2)) end as price from {part})
"""


@query(f"""with x as ({_duck(_EXPORTED)})
    select k, case when k % 8 < 6 then chr(39) else '' end || name as name, brand, cast(price * 100 as bigint) as hundredths from x""")
def exported_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as they are read from the workbooks that they were exported to."""
    path = scratch_path(spark)
    export.export_xlsx(spark.sql(_EXPORTED, part=derived.table(spark, sf_dir, "part")), path, rows=1000)
    offer_files.register(spark)
    rows = spark.read.format("quillmill_files").option("kind", "xlsx").load(path).where("error is null and row_no > 1")
    cell = lambda k, of="s": F.get("cells", F.lit(k))[of]
    return rows.select(cell(0).cast("long").alias("k"), cell(1).alias("name"), cell(2).alias("brand"), (cell(3, "d") * 100).cast("long").alias("hundredths"))


_CSV = """
    select p_partkey as k, case when p_partkey % 6 = 0 then concat(p_name, chr(10), 'second "line", ', p_brand) else p_name end as title, case when p_partkey % 4 <> 0 then p_brand end as brand,
      case when p_partkey % 9 = 0 then concat('"', p_type, '"') else p_type end as type from {part}
"""


@query(f"""with x as ({_duck(_CSV)}) select k, 'invalid' as status, title, brand, type from x""".replace("'invalid' as status", "case when k % 5 = 0 then 'file' else 'row' end as status"))
def csv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of CSV files made of the table, read by stretches of 32 KB: lines' ends, quotes and delimiters lie within fields."""
    path = scratch_path(spark)
    rows = spark.sql(_CSV, part=derived.table(spark, sf_dir, "part")).withColumn("status", F.when(F.col("k") % 5 == 0, "file").otherwise("row"))
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).option("nullValue", "").csv(path)
    found = spreadsheet.from_csv(csv_files.read_csv(spark, path, stretch=1 << 15)).where("error is null")
    cell = lambda name: F.try_element_at("raw_row", F.lit(name))["s"]
    return found.select(cell("k").cast("long").alias("k"), cell("status").alias("status"), cell("title").alias("title"), cell("brand").alias("brand"), cell("type").alias("type"))
