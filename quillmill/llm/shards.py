"""Sharding by weighted rendezvous hashing of record keys.

Each shard draws a number for a key from a hash of both, and the key goes to the shard
with the largest draw. A shard more only draws for itself: it takes rows and moves none
between the others. Shards may have weights; their shares are in proportion to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Parts that each shard's rows are numbered in; the counts of all parts are the only thing gathered.
PARTS = 512


def hash52(text: Column) -> Column:
    """The first 13 hex digits of the MD5 as a long."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def draw(key: Column, shard: Column, weight: Column | None = None) -> Column:
    """ln(u) / weight, where u in (0, 1] comes from 52 bits of an MD5 of key and shard. The largest wins."""
    drawn = F.log((hash52(F.concat_ws("/", key, shard.cast("string"))) + 1) / F.lit(float(1 << 52)))
    return drawn if weight is None else drawn / weight


def best_draw(key: Column, shards: int, weights: list[float] | None = None) -> Column:
    """Draw (d) and number (s) of the shard, 0 to shards - 1, that wins a key (text). Equal draws go to the larger number."""
    if shards < 1 or weights is not None and (len(weights) != shards or min(weights) <= 0):
        raise ValueError("one positive weight for each of one or more shards")
    at = F.sequence(F.lit(0), F.lit(shards - 1))
    if weights is None:
        return F.array_max(F.transform(at, lambda s: F.struct(draw(key, s).alias("d"), s.alias("s"))))
    known = F.array(*map(F.lit, weights))
    return F.array_max(F.transform(at, lambda s: F.struct(draw(key, s, F.get(known, s)).alias("d"), s.alias("s"))))


def assign(key: Column, shards: int, weights: list[float] | None = None) -> Column:
    """The shard, 0 to shards - 1, of a key (text)."""
    return best_draw(key, shards, weights)["s"]


def shard_documents(docs: DataFrame, shards: int = 24, weights: list[float] | None = None, parts: int = PARTS) -> DataFrame:
    """Shard and slot of every row of ``docs`` by its doc_id (a null id counts as empty text).

    slot numbers a shard's rows without gaps from 0. The rows of a shard are numbered in
    ``parts`` parts (by a hash of doc_id and text, so that rows with one id are spread),
    each from the number of rows in the parts before it; the counts are aggregated
    before they are shuffled. size is the text's UTF-8 bytes plus 8 and text_crc32 the
    CRC-32 of those bytes (null: none). Only doc_id and text are read, once: what is drawn
    and digested is written, and only that is counted and shuffled. Repeated rows have
    slots of their own; an empty table gives no rows.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    weight = None if weights is None else F.lit(sum(weights) / len(weights))
    drawn = docs.select(
        "doc_id",
        (F.octet_length(data) + 8).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        best_draw(key, shards, weights).alias("best"),
        F.struct(draw(key, F.lit(shards), weight).alias("d"), F.lit(shards).alias("s")).alias("more"),
        (hash52(F.concat_ws("/", key, F.md5(data))) % parts).cast("int").alias("part"),
    )
    rows, _ = written(drawn.select("doc_id", "size", "text_crc32", F.col("best.s").alias("shard"), F.greatest("best", "more")["s"].alias("grown_shard"), "part"))
    count = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = count.select("shard", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    number = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size"))
    return (
        rows.withColumn("n", number)
        .join(F.broadcast(before), ["shard", "part"])  # shards x parts rows at most
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("n") - 1).cast("long").alias("slot"), "grown_shard")
    )
