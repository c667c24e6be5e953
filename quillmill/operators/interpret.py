"""Input for interpreters, and the check that what they return is in the source."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import signals as S
from ..functions.text import let, utrim, ws_normalize

#: Kinds of error that an interpreter may report.
ERRORS = ("unsupported_source", "invalid_source", "invalid_model_output", "backend_error")


class Interpreter(Protocol):
    """Adds ``result`` or ``error`` to prepared input; none is implemented here."""

    def interpret(self, prepared: DataFrame) -> DataFrame: ...


def prepare(records: DataFrame) -> DataFrame:
    """``records`` with ``source_lines``, ``deterministic`` fields and ``remaining_lines``.

    A line belongs to the first of link, weight, price, identifier, extent and imprint
    that it looks like. Of several such lines the last counts, but identifiers all do.
    """
    split = lambda p: F.transform(F.split(F.coalesce(p["text"], F.lit("")), r"\r?\n"), utrim)
    lines = F.filter(F.flatten(F.transform(F.coalesce("raw_paragraphs", F.array()), split)), lambda x: x != "")
    kind = lambda x: (
        F.when(S.is_url(x), "url").when(S.is_weight(x), "weight").when(S.is_price(x), "price").when(S.is_identifier(x), "identifier")
        .when(S.is_physical(x), "physical").when(S.is_publication(x), "publication").otherwise("rest")
    )
    base = records.withColumn("source_lines", lines)
    base = base.withColumn("_kinds", F.transform("source_lines", lambda x: F.struct(kind(x).alias("kind"), x.alias("text"))))
    of = lambda name: F.transform(F.filter("_kinds", lambda x: x["kind"] == name), lambda x: x["text"])
    last = lambda name: F.try_element_at(of(name), F.lit(-1))
    base = base.withColumn("_price", S.price(last("price")))
    fields = F.struct(
        S.vendor_url(last("url")).alias("vendor_url"),
        last("weight").alias("weight"),
        last("price").alias("price_source"),
        F.col("_price.amount").alias("price_amount"),
        F.col("_price.currency").alias("price_currency"),
        F.col("_price.qualifier").alias("price_qualifier"),
        F.col("_price.binding").alias("binding"),
        of("identifier").alias("identifiers"),
        last("physical").alias("physical_description"),
        last("publication").alias("publication_statement"),
    )
    return base.select(*records.columns, "source_lines", of("rest").alias("remaining_lines"), fields.alias("deterministic"))


FIELDS = ("vendor_classifications", "descriptions", "notes", "unresolved")


def first_ungrounded() -> Column:
    """(field, value) of the first value that isn't in the source lines, or null.

    Title and responsibility come first and may be missing or empty; in the lists an
    empty value is ungrounded.
    """
    one = lambda name: F.array(F.struct(F.lit(name).alias("field"), F.col(name).alias("value")))
    single = [F.filter(one(n), lambda x: x["value"].isNotNull() & (x["value"] != "")) for n in ("title", "responsibility_statement")]
    each = lambda name: F.transform(F.coalesce(name, F.array().cast("array<string>")), lambda v: F.struct(F.lit(name).alias("field"), v.alias("value")))
    many = [each(n) for n in FIELDS]
    source = ws_normalize(F.concat_ws(" ", "source_lines"))
    return let(source, lambda s: F.get(F.filter(F.concat(*single, *many), lambda x: ~S.is_grounded(x["value"], s)), F.lit(0)))


def grounded(results: DataFrame) -> DataFrame:
    """``results`` with ``ungrounded``: the first value without a place in the source, null if all have one."""
    return results.withColumn("ungrounded", first_ungrounded())
