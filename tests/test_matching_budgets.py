"""Matching offers with a catalogue, and budgets, at their edges."""

from decimal import Decimal

from pyspark.sql import functions as F

from quillmill.operators import budgets, matching
from quillmill.operators.catalog import Answer


def test_canonical_isbn(spark):
    cases = {"0-306-40615-2": "9780306406157", "9780306406157": "9780306406157", "978 0306-40615 7": "9780306406157", "080442957x": "9780804429573", "0306406153": None, "9780306406158": None, "": None, None: None, "12345": None, "979-10-90636-07-1": "9791090636071", "٩٧٨٠٣٠٦٤٠٦١٥٧": None}
    df = spark.createDataFrame([(k,) for k in cases], "v string").withColumn("c", matching.canonical_isbn(F.col("v")))
    assert {r.v: r.c for r in df.collect()} == cases


def test_matched(spark):
    a, b, c, d = "9780306406157", "9780804429573", "9791090636071", "9780000000002"
    records = spark.createDataFrame([("r1", "0306406152"), ("r2", "0-8044-2957-X"), ("r3", b), ("r3", b), ("r4", "broken"), ("r5", None), ("r6", d)], "record_id string, isbn string")
    offers = [(1, [a]), (2, [b]), (3, [c]), (4, ["x"]), (5, []), (6, None), (7, [None, " "]), (8, ["x", "0306406152", a]), (9, [a, d]), (10, [a]), (10, [c]), (11, [d])] + [(k, [d]) for k in range(100, 400)]
    df = spark.createDataFrame(offers, "offer_id long, isbns array<string>")
    want = {1: ("exact_edition", None, 1, "r1"), 2: ("ambiguous", None, 2, "r2"), 3: ("not_found", None, 0, None), 4: ("failed", "invalid_identifier", 0, None), 5: ("failed", "no_identifier", 0, None)}
    want |= {6: want[5], 7: want[5], 8: want[1], 9: ("ambiguous", None, 2, "r1"), 10: want[1], 11: ("exact_edition", None, 1, "r6")} | {k: ("exact_edition", None, 1, "r6") for k in range(100, 400)}
    for part in (matching.PART, 7):
        assert {r[0]: tuple(r)[1:] for r in matching.matched(df, Answer(records), part).collect()} == want
    gone = {r[0]: tuple(r)[1:3] for r in matching.matched(df, Answer(None, "timeout")).collect()}
    assert gone == {k: ("failed", w[1] or "timeout") for k, w in want.items()}
    assert matching.matched(df.limit(0), Answer(records)).count() == 0
    assert {r.state for r in matching.matched(df.where("offer_id < 4"), Answer(records.limit(0))).collect()} == {"not_found"}


def test_budgets(spark):
    plans = [(1, "EUR", Decimal("10.00")), (2, "EUR", None), (3, "USD", Decimal("0.00")), (4, None, Decimal("1.00")), (5, "EUR", Decimal("99999999999.99"))]
    chosen = [(1, Decimal("0.10"), "EUR")] * 3 + [(1, None, "EUR"), (3, Decimal("2.50"), "USD"), (2, Decimal("1.00"), "USD"), (9, Decimal("1.00"), "EUR"), (None, Decimal("1.00"), "EUR"), (4, Decimal("1.00"), None)]
    out = budgets.budget_summary(spark.createDataFrame(plans, "id long, base_currency string, budget decimal(14,2)"), spark.createDataFrame(chosen, "order_plan_id long, amount decimal(14,2), currency string"))
    D = Decimal
    got = {(r.level, r.order_plan_id, r.currency): tuple(r)[3:] for r in out.collect()}
    assert got == {
        ("plan", 1, "EUR"): (1, D("10.00"), 0, 4, D("0.30"), 1, None), ("plan", 2, "EUR"): (1, None, 1, 1, D("0.00"), 1, None), ("plan", 3, "USD"): (1, D("0.00"), 0, 1, D("2.50"), 0, D("-2.50")),
        ("plan", 4, None): (1, D("1.00"), 0, 1, D("0.00"), 1, None), ("plan", 5, "EUR"): (1, D("99999999999.99"), 0, 0, D("0.00"), 0, D("99999999999.99")),
        ("currency", None, "EUR"): (3, D("100000000009.99"), 1, 5, D("0.30"), 2, None), ("currency", None, "USD"): (1, D("0.00"), 0, 1, D("2.50"), 0, D("-2.50")), ("currency", None, None): (1, D("1.00"), 0, 1, D("0.00"), 1, None),
        ("all", None, None): (5, None, 1, 7, None, 3, None),
    }
    one = budgets.budget_summary(spark.createDataFrame(plans[2:3], "id long, base_currency string, budget decimal(14,2)"), spark.createDataFrame(chosen, "order_plan_id long, amount decimal(14,2), currency string"))
    assert {(r.level, r.remaining) for r in one.collect()} == {("plan", D("-2.50")), ("currency", D("-2.50")), ("all", D("-2.50"))}
