"""ISBN-10 and ISBN-13 checksums as column arithmetic."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def _digit(c: Column, at: int) -> Column:
    """Value of the character at a place; X is ten. Only for texts that the pattern has admitted."""
    one = F.substring(c, at, 1)
    return F.when(one == "X", 10).otherwise(F.ascii(one) - 48)


def is_valid_isbn(value: Column) -> Column:
    """Whether the value, without hyphens and white space, is an ISBN with a right check digit. Null isn't."""

    def check(c: Column) -> Column:
        ten = reduce(add, (_digit(c, k) * k for k in range(1, 11))) % 11 == 0
        thirteen = reduce(add, (_digit(c, k) * (1 if k % 2 else 3) for k in range(1, 14))) % 10 == 0
        return F.when(c.rlike(r"\A[0-9]{9}[0-9X]\z"), ten).when(c.rlike(r"\A[0-9]{13}\z"), thirteen)

    compact = F.upper(F.regexp_replace(value, r"(?U)[\s-]+", ""))
    return F.coalesce(let(compact, check), F.lit(False))


def validated(identifiers: Column) -> Column:
    """Identifiers with the status that their scheme can give; values stay as they are."""
    status = lambda i: F.when(i["scheme"] == "isbn", F.when(is_valid_isbn(i["value"]), "valid").otherwise("invalid")).otherwise(i["validation_status"])
    return F.transform(identifiers, lambda i: i.withField("validation_status", status(i)))
