"""Schemas of source records, offers, catalogue records and plans."""

from __future__ import annotations

from pyspark.sql.types import StructType

#: A spreadsheet cell: ``kind`` is string, int, float, decimal or null; ``s`` the plain text; ``d`` the exact number.
CELL = "struct<kind:string,s:string,d:decimal(38,18)>"
PARAGRAPH = "struct<index:int,text:string,style:string>"
LOCATOR = "struct<sheet:string,row:int,paragraph_start:int,paragraph_end:int>"
SOURCE_RECORD = (
    f"format string, source_filename string, vendor string, locator {LOCATOR}, raw_row map<string,{CELL}>, "
    f"raw_paragraphs array<{PARAGRAPH}>, original_headers array<string>, vendor_category string"
)
TEXT_CONTENT = "struct<role:string,text:string,language:string,metadata:map<string,string>>"
IDENTIFIER = "struct<scheme:string,value:string,validation_status:string,metadata:map<string,string>>"
OFFER = (
    f"vendor_code string, vendor_url string, titles array<{TEXT_CONTENT}>, descriptions array<{TEXT_CONTENT}>, "
    "responsibility_statement string, publication_statement string, physical_description string, edition_statement string, "
    f"identifiers array<{IDENTIFIER}>, language_statements array<string>, series_statements array<string>, subjects array<string>, "
    "notes array<string>, vendor_category string, price_amount decimal(38,18), price_currency string, price_qualifier string, "
    "binding string, weight string, unparsed array<string>, warnings array<string>, metadata map<string,string>"
)
CATALOG_RECORD = "source string, record_id string, title string, creator string, isbn string"
ORDER_PLAN = "id long, name string, budget decimal(14,2), base_currency string, inserted_at timestamp, updated_at timestamp"
ORDER_LIST = "id long, name string, order_plan_id long, inserted_at timestamp, updated_at timestamp"


def schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)
