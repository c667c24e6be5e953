"""Offer records of line lists to offers.

Every field takes the first line that fits and isn't taken yet, in a fixed order of
fields. As each field takes one line at most, the order is kept by excluding the lines
of the fields before it; no state runs along the lines, and no row leaves its partition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import signals as S
from ..functions.text import grapheme_len, let, utrim
from ..types import IDENTIFIER, OFFER, TEXT_CONTENT, schema

NO_TEXT = f"array<{TEXT_CONTENT}>"


def text_lines(paragraphs: Column) -> Column:
    """Non-empty trimmed lines of the paragraphs, with index and style of their paragraph."""
    split = lambda p: F.transform(F.split(F.coalesce(p["text"], F.lit("")), r"\R"), lambda t: F.struct(p["index"].alias("index"), p["style"].alias("style"), utrim(t).alias("text")))
    return F.filter(F.flatten(F.transform(F.coalesce(paragraphs, F.array()), split)), lambda x: x["text"] != "")


def without_preamble(lines: Column) -> Column:
    """The lines after the vendor's address block, if there is one with its end."""

    def without(own: Column) -> Column:
        there = F.exists(own, lambda x: x["text"] == S.PREAMBLE)
        places = F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: F.contains(F.lower(F.get(own, i)["text"]), F.lit(S.PREAMBLE_END)))
        return F.when(there, let(F.array_min(places), lambda at: F.when(at.isNull(), own).otherwise(F.slice(own, at + 2, F.size(own))))).otherwise(own)

    return let(lines, without)


def split_title(line: Column) -> tuple[Column, Column]:
    """Title and responsibility around the last slash; the whole line is the title if a side is empty."""
    part = lambda k: utrim(F.regexp_extract(line, r"(?s)\A(.*)/([^/]*)\z", k))
    both = (part(1) != "") & (part(2) != "")
    return F.when(both, part(1)).otherwise(line), F.when(both, part(2))


def offer_candidate(lines: Column) -> Column:
    """At least two of a vendor link, a price and a publication statement are among the lines."""
    there = lambda test: F.exists(lines, lambda x: test(x["text"])).cast("int")
    return F.coalesce(there(S.is_url) + there(S.is_price) + there(S.is_publication) >= 2, F.lit(False))


def _content(role: str, text: Column) -> Column:
    none = F.create_map().cast("map<string,string>")
    return F.struct(F.lit(role).alias("role"), text.alias("text"), F.lit(None).cast("string").alias("language"), none.alias("metadata"))


def _signals(line: Column, i: Column) -> Column:
    t = line["text"]
    return F.struct(
        i.alias("i"), t.alias("text"), F.coalesce(line["style"] == S.LIST_STYLE, F.lit(False)).alias("listed"),
        S.is_url(t).alias("url"), S.is_price(t).alias("price"), S.is_weight(t).alias("weight"), S.is_identifier(t).alias("id"),
        S.is_publication(t).alias("pub"), S.is_physical(t).alias("phys"), S.is_edition(t).alias("edition"), S.is_note(t).alias("note"),
        S.is_category_text(t).alias("topic"), (grapheme_len(t) >= 60).alias("long"),
    )


def _first(lines: Column, where: Callable[[Column], Column]) -> Column:
    """Place of the first line that fits, or null."""
    return F.array_min(F.transform(F.filter(lines, where), lambda x: x["i"]))


def _among(x: Column, places: list[Column]) -> Column:
    held = F.lit(False)
    for place in places:
        held = held | x["i"].eqNullSafe(place)
    return held


#: Slots in the order in which they take a line, and the signal of each.
SLOTS = ("url", "price", "weight", "pub", "phys", "topic", "edition")


def classified(rest: Column) -> Column:
    """Places of the slots' lines and the texts of all other fields, for the lines after the title."""

    def slots(env: Column, taken: list[Column]) -> Column:
        own = lambda x: x["id"] & ~_among(x, taken[:3])  # noqa: E731  an identifier, as soon as the first three slots are known
        if len(taken) == len(SLOTS):
            return fields(env, taken, own)
        name = SLOTS[len(taken)]

        def fits(x: Column) -> Column:
            ok = x[name] & ~_among(x, taken)
            if len(taken) >= 3:
                ok = ok & ~own(x)
            if name == "topic":
                between = F.coalesce((x["i"] > taken[4]) & (x["i"] < env["id_at"]), F.lit(False))
                ok = ok & between & ~(x["id"] | x["price"] | x["weight"] | x["note"] | x["url"])
            return ok

        return let(_first(env["free"], fits), lambda place: slots(env, [*taken, place]))

    def fields(env: Column, taken: list[Column], own: Callable[[Column], Column]) -> Column:
        left = F.filter(env["free"], lambda x: ~_among(x, taken) & ~own(x))
        before = lambda x: F.coalesce(x["i"] < env["pub_at"], F.lit(False))
        told = lambda x: F.coalesce(x["i"] > F.least(taken[1], taken[2]), F.lit(False)) & x["long"] & ~x["url"]
        line = lambda place: F.get(F.transform(F.filter(env["rest"], lambda x: x["i"] == place), lambda x: x["text"]), F.lit(0))
        texts = lambda lines, where: F.transform(F.filter(lines, where), lambda x: x["text"])
        return let(
            left,
            lambda open_: F.struct(
                *(line(place).alias(name) for name, place in zip(SLOTS, taken, strict=True)),
                texts(env["free"], own).alias("identifiers"),
                texts(env["rest"], lambda x: x["listed"]).alias("subjects"),
                texts(open_, lambda x: x["note"]).alias("notes"),
                texts(open_, lambda x: ~x["note"] & before(x)).alias("series"),
                texts(open_, lambda x: ~x["note"] & ~before(x) & told(x)).alias("descriptions"),
                texts(open_, lambda x: ~x["note"] & ~before(x) & ~told(x)).alias("unparsed"),
            ),
        )

    env = lambda r: F.struct(
        r.alias("rest"), F.filter(r, lambda x: ~x["listed"]).alias("free"), _first(r, lambda x: x["pub"]).alias("pub_at"), _first(r, lambda x: x["id"]).alias("id_at")
    )
    return let(rest, lambda r: let(env(r), lambda e: slots(e, [])))


def given(ok: Column, fields: tuple[Column, ...]) -> list[Column]:
    """Offer fields, in the schema's order, null unless ``ok``."""
    return [F.when(ok, c).alias(n) for c, n in zip(fields, schema(OFFER).names, strict=True)]


def parse_lines(records: DataFrame) -> DataFrame:
    """For each record its ``source`` (all its columns), the fields of its offer, and ``error``.

    The fields are null where there is an error: it is ``invalid_raw_record`` for a record
    without paragraphs as its source, and ``not_offer`` if its lines aren't an offer.
    """
    lines, there = without_preamble(text_lines(F.col("raw_paragraphs"))), F.col("raw_paragraphs").isNotNull()
    base = records.select(F.struct(*records.columns).alias("source"), F.when(there, lines).alias("lines"))
    # each line's patterns are tried once: a condition on the error isn't pushed below a generator, where they would be tried again
    base = base.select("source", F.explode(F.array(F.transform("lines", _signals))).alias("lines"))
    there = lambda name: F.exists("lines", lambda x: x[name]).cast("int")
    base = base.select("source", "lines", F.coalesce(there("url") + there("price") + there("pub") >= 2, F.lit(False)).alias("ok"))
    rest = F.slice("lines", 2, F.greatest(F.size("lines"), F.lit(1)))
    base = base.select("source", "ok", F.get("lines", F.lit(0))["text"].alias("head"), F.when(F.col("ok"), classified(rest)).alias("c"))
    base = base.select("*", S.price(F.col("c.price")).alias("price"))
    c, none, metadata = F.col("c"), F.array().cast("array<string>"), F.create_map().cast("map<string,string>")
    title, responsibility = split_title(F.col("head"))
    identifier = lambda v: F.struct(F.lit("isbn").alias("scheme"), v.alias("value"), F.lit("unchecked").alias("validation_status"), metadata.alias("metadata"))
    fields = (
        F.lit(None).cast("string"),
        S.vendor_url(c["url"]),
        F.array(_content("primary_title", title)).cast(NO_TEXT),
        F.transform(c["descriptions"], lambda t: _content("description", t)).cast(NO_TEXT),
        responsibility,
        c["pub"],
        c["phys"],
        c["edition"],
        F.transform(c["identifiers"], identifier).cast(f"array<{IDENTIFIER}>"),
        none,
        c["series"],
        c["subjects"],
        c["notes"],
        F.coalesce("source.vendor_category", c["topic"]),
        F.col("price.amount"),
        F.col("price.currency"),
        F.col("price.qualifier"),
        F.col("price.binding"),
        c["weight"],
        c["unparsed"],
        none,
        metadata,
    )
    error = F.when(F.col("source.raw_paragraphs").isNull(), "invalid_raw_record").when(~F.col("ok"), "not_offer")
    return base.select("source", *given(F.col("ok"), fields), error.alias("error"))
