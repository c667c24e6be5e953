"""What a catalogue's records mean for offers: matching by canonical ISBN.

An offer's state is ``exact_edition`` (one record), ``ambiguous`` (several), ``not_found`` (none) or ``failed``: nothing could be
looked up, for the ``reason`` given. Not found and failed are different things. No rule tells an older edition.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.isbn import is_valid_isbn
from ..functions.text import let
from ..sources.shared import written
from .catalog import Answer

#: Rows of one ISBN that a task gets; an ISBN with more (a placeholder in a vendor's list) is salted.
PART = 100_000
#: ISBNs that hold more than one of so many of all rows are salted, so that there are no more of them.
SHARE = 1024


def canonical_isbn(value: Column) -> Column:
    """The 13 digits of a valid ISBN-10 or ISBN-13, written with hyphens and white space or without; null for any other value."""
    compact = F.upper(F.regexp_replace(value, r"(?U)[\s-]+", ""))

    def thirteen(c: Column) -> Column:
        core = F.concat(F.lit("978"), F.substring(c, 1, 9))
        total = reduce(add, ((F.ascii(F.substring(core, k, 1)) - 48) * (1 if k % 2 else 3) for k in range(1, 13)))
        return F.when(F.length(c) == 13, c).otherwise(F.concat(core, ((10 - total % 10) % 10).cast("string")))

    return F.when(is_valid_isbn(value), let(compact, thirteen))


def salted_join(rows: DataFrame, unique: DataFrame, key: str, part: int = PART) -> DataFrame:
    """``rows`` left join ``unique`` (one row a key), with each key's rows in several tasks if there are more than ``part`` of them.

    Which keys are so frequent is counted first; they are at most ``SHARE``, and broadcast. A row's task follows from the row, so that
    it is the same when a lost task is run again.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    total = rows.count()
    hot = counts.where(F.col("_rows") > max(part, total // SHARE)).select(key, F.ceil(F.col("_rows") / part).cast("int").alias("_parts"))
    hot = F.broadcast(hot)
    dealt = rows.join(hot, key, "left").withColumn("_salt", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*rows.columns), "_parts").cast("int"))).drop("_parts")
    copies = unique.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copies, [key, "_salt"], "left").drop("_salt")


def matched(offers: DataFrame, answer: Answer, part: int = PART) -> DataFrame:
    """offer_id, state, reason (of failed ones), records (their number) and record_id (the smallest) of each offer_id.

    ``offers`` has offer_id and isbns (array of texts as the vendor wrote them); rows of one offer_id count together. ``answer`` is what
    a catalogue gave: its records (record_id, isbn), or why it failed. A record without a valid ISBN matches nothing; one that is listed twice counts once.
    """
    every = offers.select("offer_id", F.explode_outer("isbns").alias("value"))
    each = every.select("offer_id", (F.trim("value") != "").alias("given"), canonical_isbn(F.col("value")).alias("isbn")).distinct()
    each = written(each)  # it is counted before it is joined
    if answer.ok:
        held = answer.records.select("record_id", canonical_isbn(F.col("isbn")).alias("isbn")).where("isbn is not null").distinct()
        found = salted_join(each, held.groupBy("isbn").agg(F.count(F.lit(1)).alias("_records"), F.min("record_id").alias("_first")), "isbn", part)
    else:
        found = each.withColumn("_records", F.lit(None).cast("long")).withColumn("_first", F.lit(None).cast("string"))
    out = found.groupBy("offer_id").agg(
        F.coalesce(F.bool_or("given"), F.lit(False)).alias("given"), F.count("isbn").alias("valid"), F.coalesce(F.sum("_records"), F.lit(0)).alias("records"), F.min("_first").alias("record_id"),
    )
    failed = F.when(~F.col("given"), "no_identifier").when(F.col("valid") == 0, "invalid_identifier").otherwise(F.lit(answer.reason).cast("string"))
    state = F.when(failed.isNotNull(), "failed").when(F.col("records") == 0, "not_found").when(F.col("records") == 1, "exact_edition").otherwise("ambiguous")
    return out.select("offer_id", state.alias("state"), failed.alias("reason"), "records", "record_id")
