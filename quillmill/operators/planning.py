"""Acquisition plans and their order lists, as tables with explicit constraint checks.

Spark enforces no keys: ``PlanStore`` validates against one version of the tables and commits the
next one only if no other writer has (``sources.commit_log``); otherwise it validates again. So names stay unique, lists
have a plan and plans with lists stay, however many programs write. A deletion is a row as well, so a crash leaves the tables
as they were or as they should be.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import grapheme_len, utrim
from ..sources.commit_log import Change, CommitLog, Snapshot
from ..sources.shared import written
from ..types import ORDER_LIST, ORDER_PLAN
from .places import numbered

# Messages that users of these checks see.
BLANK, LONG, NEGATIVE = "can't be blank", "should be at most 255 character(s)", "must be greater than or equal to 0"
BAD_CURRENCY = "must be a three-letter uppercase currency code"
TAKEN, NO_PLAN = "has already been used in this order plan", "does not exist"
IN_USE = "cannot be deleted while order lists still belong to this plan"


def _problem(when: Column, field: str, message: str) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(message).alias("message")))


def _name_problems(name: Column) -> list[Column]:
    missing = name.isNull() | (name == "")
    length = grapheme_len(name)
    return [_problem(missing, "name", BLANK), _problem(length > 255, "name", LONG)]


def checked_plans(plans: DataFrame) -> DataFrame:
    """``plans`` (name, budget, base_currency) with name and currency trimmed, currency in capitals, and ``errors``.

    A budget may be missing: unknown isn't zero.
    """
    own = plans.withColumn("name", utrim(F.col("name"))).withColumn("base_currency", F.upper(utrim(F.col("base_currency"))))
    currency = F.col("base_currency")
    problems = [
        *_name_problems(F.col("name")),
        _problem(currency.isNull() | (currency == ""), "base_currency", BLANK),
        _problem(F.col("budget") < 0, "budget", NEGATIVE),
        _problem((currency != "") & ~currency.rlike(r"\A[A-Z]{3}\z"), "base_currency", BAD_CURRENCY),
    ]
    return own.withColumn("errors", F.array_compact(F.array(*problems)))


def checked_lists(lists: DataFrame, plans: DataFrame, existing: DataFrame) -> DataFrame:
    """``lists`` (name, order_plan_id) with the name trimmed and ``errors``.

    A name may be used once in a plan, counting the ``existing`` lists and the rows
    given here; the plan must be among ``plans``.
    """
    own = lists.withColumn("name", utrim(F.col("name")))
    used = (
        existing.select("order_plan_id", "name").unionByName(own.select("order_plan_id", "name"))
        .where("order_plan_id is not null and name is not null").groupBy("order_plan_id", "name").agg(F.count(F.lit(1)).alias("_uses"))
    )
    known = plans.select(F.col("id").alias("order_plan_id"), F.lit(True).alias("_known")).distinct()
    joined = own.join(used, ["order_plan_id", "name"], "left").join(known, "order_plan_id", "left")
    plan = F.col("order_plan_id")
    problems = [
        *_name_problems(F.col("name")),
        _problem(plan.isNull(), "order_plan_id", BLANK),
        _problem(plan.isNotNull() & F.col("_known").isNull(), "order_plan_id", NO_PLAN),
        _problem(F.col("_uses") > 1, "name", TAKEN),
    ]
    return joined.withColumn("errors", F.array_compact(F.array(*problems))).select(*lists.columns, "errors")


def newest_first(plans: DataFrame) -> DataFrame:
    return plans.orderBy(F.desc("inserted_at"), F.desc("id"))


def lists_of(lists: DataFrame, plan_id: int) -> DataFrame:
    return lists.where(F.col("order_plan_id") == plan_id).orderBy("inserted_at", "id")


def with_lists(plans: DataFrame, lists: DataFrame) -> DataFrame:
    """``plans`` with ``order_lists``, oldest first; a plan without lists has an empty array."""
    kind = "array<struct<inserted_at:timestamp,id:bigint,name:string>>"
    nested = lists.groupBy("order_plan_id").agg(F.sort_array(F.collect_list(F.struct("inserted_at", "id", "name"))).alias("order_lists"))
    joined = plans.join(nested, plans["id"] == nested["order_plan_id"], "left").drop("order_plan_id")
    return joined.withColumn("order_lists", F.coalesce("order_lists", F.array().cast(kind)))


def deletable(plans: DataFrame, lists: DataFrame) -> DataFrame:
    """Plans that no list belongs to."""
    return plans.join(lists.select("order_plan_id"), plans["id"] == lists["order_plan_id"], "left_anti")


class ConstraintError(ValueError):
    """(field, message) of every check that failed."""

    def __init__(self, problems: list[tuple[str, str]]):
        super().__init__("; ".join(f"{f} {m}" for f, m in problems))
        self.problems = problems


class PlanStore:
    """Plans, lists, and the ids of deleted plans: versioned tables under one path, for any number of writers."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.log = CommitLog(spark, path, {"order_plans": ORDER_PLAN, "order_lists": ORDER_LIST, "order_plans_deleted": "id long"})

    def _plans(self, at: Snapshot) -> DataFrame:
        return at.table("order_plans").join(at.table("order_plans_deleted"), "id", "left_anti")

    def plans(self, version: int | None = None) -> DataFrame:
        return self._plans(self.log.snapshot(version))

    def lists(self, version: int | None = None) -> DataFrame:
        return self.log.snapshot(version).table("order_lists")

    def list_order_plans(self) -> DataFrame:
        return newest_first(self.plans())

    def _plan(self, at: Snapshot, plan_id: int) -> DataFrame:
        found = self._plans(at).where(F.col("id") == plan_id)
        if found.isEmpty():
            raise LookupError(f"no order plan {plan_id}")
        return found

    def get_order_plan(self, plan_id: int) -> DataFrame:
        return self._plan(self.log.snapshot(), plan_id)

    def get_order_plan_with_lists(self, plan_id: int) -> DataFrame:
        at = self.log.snapshot()
        return with_lists(self._plan(at, plan_id), at.table("order_lists").where(F.col("order_plan_id") == plan_id))

    def list_order_lists(self, plan_id: int) -> DataFrame:
        return lists_of(self.lists(), plan_id)

    def _added(self, table: str, checked: DataFrame, at: Snapshot, order: list[str]) -> Change:
        """The rows without errors under the next ids, in this order; those of deleted rows aren't given again.

        The result has all rows, with their id where they have one.
        """
        first, now = at.numbers.get(table, 1), F.current_timestamp()
        checked = written(checked)
        good = numbered(checked.where(F.size("errors") == 0), *order, name="id", first=first)
        added = good.count()
        every = good.unionByName(checked.where(F.size("errors") > 0).withColumn("id", F.lit(None).cast("long")))
        if not added:
            return Change(result=every)
        stamped = written(good.withColumn("inserted_at", now).withColumn("updated_at", now))
        return Change({table: stamped}, {table: first + added}, every)

    def insert_plans(self, plans: DataFrame, *order: str) -> DataFrame:
        """Inserts all rows (name, budget, base_currency, ...) that pass the checks, in one version; all rows with ``errors`` and ``id``.

        Ids follow ``order``, columns that tell rows apart.
        """
        return self.log.commit(lambda at: self._added("order_plans", checked_plans(plans), at, list(order)))

    def insert_lists(self, lists: DataFrame, *order: str) -> DataFrame:
        """The same of lists (name, order_plan_id, ...). Of rows with one plan and name the first in ``order`` may take it."""
        given = numbered(lists.withColumn("name", utrim(F.col("name"))), *order, name="_place")

        def change(at: Snapshot) -> Change:
            # a taken name is told by a row's place, so that no name is a join's key for all of its rows
            named = given.where("order_plan_id is not null and name is not null").groupBy("order_plan_id", "name").agg(F.min("_place").alias("_place"))
            free = named.join(at.table("order_lists").select("order_plan_id", "name"), ["order_plan_id", "name"], "left_anti")
            first = free.select("_place", F.lit(True).alias("_first"))
            known = self._plans(at).select(F.col("id").alias("order_plan_id"), F.lit(True).alias("_known"))
            joined = given.join(first, "_place", "left").join(known, "order_plan_id", "left")
            plan, name = F.col("order_plan_id"), F.col("name")
            problems = [
                *_name_problems(name),
                _problem(plan.isNull(), "order_plan_id", BLANK),
                _problem(plan.isNotNull() & F.col("_known").isNull(), "order_plan_id", NO_PLAN),
                _problem(plan.isNotNull() & name.isNotNull() & F.col("_first").isNull(), "name", TAKEN),
            ]
            checked = joined.withColumn("errors", F.array_compact(F.array(*problems))).select(*lists.columns, "_place", "errors")
            made = self._added("order_lists", checked, at, ["_place"])
            made.result = made.result.drop("_place")
            return made

        return self.log.commit(change)

    def delete_plans(self, ids: DataFrame) -> DataFrame:
        """Takes out all plans among ``ids`` (id) that no list belongs to, in one version; the ids that were taken out."""

        def change(at: Snapshot) -> Change:
            gone = written(deletable(self._plans(at).join(ids.select("id").distinct(), "id", "left_semi"), at.table("order_lists")).select("id"))
            return Change({} if gone.isEmpty() else {"order_plans_deleted": gone}, result=gone)

        return self.log.commit(change)

    def _one(self, table: str, check: Callable[[Snapshot], DataFrame]) -> int:
        """Inserts the one row that ``check`` gives with its errors; its id."""

        def change(at: Snapshot) -> Change:
            checked = check(at)
            errors = checked.first()["errors"]
            if errors:
                raise ConstraintError([(e["field"], e["message"]) for e in errors])
            new, now = at.numbers.get(table, 1), F.current_timestamp()
            row = checked.withColumn("id", F.lit(new).cast("long")).withColumn("inserted_at", now).withColumn("updated_at", now)
            return Change({table: row.coalesce(1)}, {table: new + 1}, new)

        return self.log.commit(change)

    def create_order_plan(self, name: str | None, base_currency: str | None, budget=None) -> int:
        """The new plan's id; ConstraintError if a check fails."""
        given = self.spark.createDataFrame([(name, budget, base_currency)], "name string, budget decimal(14,2), base_currency string")
        return self._one("order_plans", lambda at: checked_plans(given))

    def create_order_list(self, plan_id: int, name: str | None) -> int:
        given = self.spark.createDataFrame([(name, plan_id)], "name string, order_plan_id long")
        return self._one("order_lists", lambda at: checked_lists(given, self._plans(at), at.table("order_lists")))

    def delete_order_plan(self, plan_id: int) -> None:
        """Takes the plan out; LookupError if it isn't there, ConstraintError while it has lists."""

        def change(at: Snapshot) -> Change:
            self._plan(at, plan_id)
            if not at.table("order_lists").where(F.col("order_plan_id") == plan_id).isEmpty():
                raise ConstraintError([("order_lists", IN_USE)])
            return Change({"order_plans_deleted": self.spark.createDataFrame([(plan_id,)], "id long").coalesce(1)})

        self.log.commit(change)
