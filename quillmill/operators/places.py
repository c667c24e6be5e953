"""Gapless numbers over a whole table, without a task that sees all rows."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written


def numbered(df: DataFrame, *order: Column | str, name: str = "place", first: int = 0) -> DataFrame:
    """``df`` with ``name`` (long): ``first``, ``first`` + 1, ... in this order over all rows.

    Rows are dealt by ranges of the order and sorted within them; a range's numbers begin after the rows of the ranges
    before it, which are counted. Of rows that are equal in the order any one comes first, and many equal ones can lie in several ranges.
    The numbered table is written once, so that it stays as it is.
    """
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    tie, at = (next(c for k in range(len(df.columns) + 1) if (c := f"{n}{k}") not in (*df.columns, name)) for n in ("_tie", "_at"))
    plain = [f.name for f in df.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]  # others have no hash
    dealt = df.withColumn(tie, F.xxhash64(*(F.col(f"`{c}`") for c in plain)) if plain else F.lit(0)).repartitionByRange(*keys, tie).sortWithinPartitions(*keys, tie).drop(tie)
    held = written(dealt.withColumn(at, F.monotonically_increasing_id()))
    part = F.shiftright(at, 33).cast("int")
    counts = dict(held.groupBy(part).count().collect())  # one row for each range
    begins = itertools.accumulate((counts.get(k, 0) for k in range(max(counts, default=0))), initial=first)
    before = F.get(F.expr(f"array({', '.join(f'{b}L' for b in begins)})"), part)
    return held.withColumn(name, before + F.col(at).bitwiseAND((1 << 33) - 1)).drop(at)
