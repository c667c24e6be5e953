"""Budgets of plans against what is selected for them, in exact decimals.

What isn't known is counted, not taken for zero: a plan without a budget, an amount that is missing, and one in another
currency than the plan's (there are no rates to convert it by). Sums are of what is known; what remains is null where anything isn't.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(38,2)"


def budget_summary(plans: DataFrame, selections: DataFrame) -> DataFrame:
    """level (plan, currency or all), order_plan_id, currency, plans, budget, unbudgeted, items, selected, unknown, remaining.

    ``plans`` has id, base_currency and budget, ``selections`` order_plan_id, amount and currency; those of no plan count nowhere. Selections are
    summed by plan before they meet the plans. Over all plans sums are given only if there is but one currency. A plan without a currency
    is one of the currency null. Rows of ``plans`` that repeat wholly are one plan; others with one id count each by itself.
    """
    own = selections.groupBy("order_plan_id", "currency").agg(
        F.count(F.lit(1)).alias("items"), F.count("amount").alias("amounts"), F.sum(F.col("amount").cast(MONEY)).alias("amount")
    )
    same = F.col("base_currency") == F.col("currency")
    per_plan = (
        plans.select(F.col("id").alias("order_plan_id"), "base_currency", F.col("budget").cast(MONEY).alias("budget")).distinct().join(own, "order_plan_id", "left")
        .groupBy("order_plan_id", "base_currency", "budget").agg(
            F.first("base_currency").alias("currency"), F.coalesce(F.sum("items"), F.lit(0)).alias("items"),
            F.coalesce(F.sum(F.when(same, F.col("amounts"))), F.lit(0)).alias("known"), F.coalesce(F.sum(F.when(same, F.col("amount"))), F.lit(0)).cast(MONEY).alias("selected"),
        )
    )
    level = F.when(F.grouping("order_plan_id") == 0, "plan").when(F.grouping("currency") == 0, "currency").otherwise("all")
    mixed = (F.grouping("currency") == 1) & (F.countDistinct(F.coalesce("own", F.lit(""))) > 1)
    unknown, unbudgeted = F.sum(F.col("items") - F.col("known")), F.count(F.lit(1)) - F.count("budget")
    sums = per_plan.withColumn("own", F.col("currency")).withColumn("_budget", F.col("budget")).groupingSets([["order_plan_id", "_budget", "currency"], ["currency"], []], "order_plan_id", "_budget", "currency").agg(
        level.alias("level"), F.count(F.lit(1)).alias("plans"), F.when(~mixed, F.sum("budget").cast(MONEY)).alias("budget"), unbudgeted.alias("unbudgeted"), F.sum("items").alias("items"),
        F.when(~mixed, F.sum("selected").cast(MONEY)).alias("selected"), unknown.alias("unknown"), ((unknown == 0) & (unbudgeted == 0)).alias("sure"),
    )
    remaining = F.when(F.col("sure"), (F.col("budget") - F.col("selected")).cast(MONEY))
    return sums.select("level", "order_plan_id", "currency", "plans", "budget", "unbudgeted", "items", "selected", "unknown", remaining.alias("remaining"))
