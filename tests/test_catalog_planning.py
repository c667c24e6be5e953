"""Catalogue adapters, plans, lists and their constraints."""

import subprocess
import sys
import threading
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillmill.operators import catalog, planning
from quillmill.operators.places import numbered
from quillmill.sources import commit_log, shared


def test_catalog(spark):
    c = catalog.Catalog("sample", sample=catalog.sample_catalog(spark), remote=catalog.UnavailableAdapter())
    ids = lambda q: [r.record_id for r in c.search(q).records.orderBy("record_id").collect()]
    assert ids("  pĀṆINI ") == ["fake-3"] and ids("中國") == ["fake-2"] and ids("example author") == ["fake-1", "fake-2"] and ids("") == ["fake-1", "fake-2", "fake-3"] and ids("unknown") == []
    assert ids("Author 9780000000001") == ["fake-1"]
    assert c.lookup(" 9780000000002 ").records.first().record_id == "fake-2" and c.lookup("fake-1").records.count() == 1 and c.lookup("x").records.count() == 0
    c.default = "remote"
    assert (c.search("x").ok, c.search("x").reason, c.lookup("x").records) == (False, "unavailable", None)
    with pytest.raises(TypeError):
        c.search(None)


NAMES = ["Южная Азия", "مكتبة", "ספרייה", "中文書", "日本語", "한국어", "မြန်မာ", "ไทย", "हिन्दी", "বাংলা", "தமிழ்", "ქართული", "é", "é"]


def test_plans(spark, tmp_path):
    store = planning.PlanStore(spark, str(tmp_path))
    assert store.list_order_plans().count() == 0
    first = store.create_order_plan("  Asia  ", " usd ", Decimal("0.00"))
    second = store.create_order_plan("No budget", "EUR")
    got = {r.id: r for r in store.list_order_plans().collect()}
    assert (got[first].name, got[first].base_currency, got[first].budget, got[second].budget) == ("Asia", "USD", Decimal("0.00"), None)
    assert [r.id for r in store.list_order_plans().collect()] == [second, first]
    one = store.create_order_list(first, " List ")
    store.create_order_list(second, "List")
    with pytest.raises(planning.ConstraintError, match=planning.TAKEN):
        store.create_order_list(first, "List")
    with pytest.raises(planning.ConstraintError, match=planning.NO_PLAN):
        store.create_order_list(99, "List")
    with pytest.raises(planning.ConstraintError, match="name can't be blank"):
        store.create_order_list(first, " 　")
    assert [r.id for r in store.list_order_lists(first).collect()] == [one]
    assert [x.name for x in store.get_order_plan_with_lists(first).first().order_lists] == ["List"]
    with pytest.raises(planning.ConstraintError, match="cannot be deleted"):
        store.delete_order_plan(first)
    third = store.create_order_plan("Empty", "BND")
    assert store.get_order_plan_with_lists(third).first().order_lists == []
    store.delete_order_plan(third)
    assert sorted(r.id for r in store.plans().collect()) == [first, second]
    with pytest.raises(LookupError):
        store.get_order_plan(third)
    with pytest.raises(planning.ConstraintError, match=planning.NO_PLAN):
        store.create_order_list(third, "x")
    assert store.create_order_plan("Next", "BND") == third + 1  # an id isn't given again


def test_plan_checks(spark):
    cases = [
        (("x", None, "eur"), []), ((None, None, None), [("name", "can't be blank"), ("base_currency", "can't be blank")]), (("x" * 255, Decimal("-0.01"), "EUR"), [("budget", planning.NEGATIVE)]),
        (("x" * 256, None, "EURO"), [("name", planning.LONG), ("base_currency", planning.BAD_CURRENCY)]), (("é" * 255, None, "usd"), []),
    ]
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, name string, budget decimal(14,2), base_currency string")
    got = [[tuple(e) for e in r.errors] for r in planning.checked_plans(df).orderBy("i").collect()]
    assert got == [w for _, w in cases]
    names = planning.checked_plans(spark.createDataFrame([(i, n, None, "EUR") for i, n in enumerate(NAMES)], "i int, name string, budget decimal(14,2), base_currency string"))
    assert [(r.name, r.errors) for r in names.orderBy("i").collect()] == [(n, []) for n in NAMES]


def test_list_checks(spark):
    plans = spark.createDataFrame([(1,), (2,)], "id long")
    old = spark.createDataFrame([("a", 1)], "name string, order_plan_id long")
    new = spark.createDataFrame([(0, " a", 1), (1, "a", 2), (2, "b", 2), (3, "b ", 2), (4, "c", None), (5, "A", 1)], "i int, name string, order_plan_id long")
    got = {r.i: [tuple(e) for e in r.errors] for r in planning.checked_lists(new, plans, old).collect()}
    taken = [("name", planning.TAKEN)]
    assert got == {0: taken, 1: [], 2: taken, 3: taken, 4: [("order_plan_id", planning.BLANK)], 5: []}


def test_bulk_inserts(spark, tmp_path):
    store = planning.PlanStore(spark, str(tmp_path / "store"))
    plans = spark.createDataFrame([(k, f" P{k} " if k % 4 else " ", None, "eur") for k in range(12)], "k int, name string, budget decimal(14,2), base_currency string")
    got = {r.k: (r.id, [tuple(e) for e in r.errors]) for r in store.insert_plans(plans, "k").collect()}
    good = [k for k in range(12) if k % 4]
    assert got == {k: (good.index(k) + 1, []) if k in good else (None, [("name", planning.BLANK)]) for k in range(12)}
    lists = spark.createDataFrame([(0, " a", 1), (1, "a", 1), (2, "a ", 2), (3, None, 1), (4, "b", 99), (5, "b", None), (6, "b", 99)], "k int, name string, order_plan_id long")
    taken, none = ("name", planning.TAKEN), ("order_plan_id", planning.NO_PLAN)
    got = {r.k: (r.id, [tuple(e) for e in r.errors]) for r in store.insert_lists(lists, "k").collect()}
    assert got == {0: (1, []), 1: (None, [taken]), 2: (2, []), 3: (None, [("name", planning.BLANK)]), 4: (None, [none]), 5: (None, [("order_plan_id", planning.BLANK)]), 6: (None, [none, taken])}
    got = {r.k: (r.id, [tuple(e) for e in r.errors]) for r in store.insert_lists(lists.where("k < 2 or k = 4"), "k").collect()}
    assert got == {0: (None, [taken]), 1: (None, [taken]), 4: (None, [none])}
    assert sorted(r.id for r in store.delete_plans(store.plans().select("id")).collect()) == list(range(3, 10))
    assert sorted(r.id for r in store.plans().collect()) == [1, 2] and store.create_order_plan("x", "EUR") == 10 and store.create_order_list(10, "a") == 3
    assert store.insert_plans(plans.limit(0), "k").count() == 0 and store.delete_plans(plans.selectExpr("1000L as id")).count() == 0


def test_versions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commit_log, "MANY", 4)
    store = planning.PlanStore(spark, str(tmp_path / "store"))
    ids = [store.create_order_plan(f"p{k}", "EUR") for k in range(6)]
    assert ids == list(range(1, 7)) and len(store.log.snapshot().folders["order_plans"]) < 4
    assert sorted(r.id for r in store.plans().collect()) == ids
    assert [store.plans(v).count() for v in store.log.versions()][:3] == [1, 2, 3]  # merging leaves older versions as they are
    with pytest.raises(LookupError):
        store.plans(99)
    rows = {f for f in shared.names(spark, f"{tmp_path}/store/rows")}
    store.log.expire(1)
    assert len(store.log.versions()) == 1 and sorted(r.id for r in store.plans().collect()) == ids
    assert set(shared.names(spark, f"{tmp_path}/store/rows")) < rows
    assert store.create_order_plan("next", "EUR") == 7
    with pytest.raises(planning.ConstraintError):
        store.create_order_plan("", "EUR")


def test_one_writer_puts_a_version(spark, tmp_path):
    shared.make_folder(spark, str(tmp_path / "v"))
    said = []
    threads = [threading.Thread(target=lambda k=k: said.append((shared.put_if_absent(spark, f"{tmp_path}/v/1", f"{k}é"), k))) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    (winner,) = [k for ok, k in said if ok]
    assert len(said) == 8 and shared.read_text(spark, f"{tmp_path}/v/1") == f"{winner}é" and shared.names(spark, str(tmp_path / "v")) == ["1"]


def at_once(monkeypatch, *calls):
    """Runs calls in threads; each one has checked its change before any of them commits for the first time."""
    ready, put, waited, said = threading.Barrier(len(calls), timeout=60), shared.put_if_absent, set(), []

    def held(*given):
        if threading.get_ident() not in waited:
            waited.add(threading.get_ident())
            ready.wait()
        return put(*given)

    monkeypatch.setattr(commit_log, "put_if_absent", held)

    def run(call):
        try:
            said.append(call())
        except planning.ConstraintError as e:
            said.append(e.problems)

    threads = [threading.Thread(target=run, args=(c,)) for c in calls]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    monkeypatch.setattr(commit_log, "put_if_absent", put)
    return said


def test_writers_at_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    store = planning.PlanStore(spark, path)
    plan = store.create_order_plan("p", "EUR")
    own = lambda: planning.PlanStore(spark, path)
    said = at_once(monkeypatch, lambda: own().create_order_list(plan, "same"), lambda: own().create_order_list(plan, " same "))
    assert [("name", planning.TAKEN)] in said and 1 in said and store.lists().count() == 1
    said = at_once(monkeypatch, lambda: own().create_order_plan("a", "EUR"), lambda: own().create_order_plan("b", "EUR"))
    assert sorted(said) == [2, 3] and store.plans().count() == 3
    said = at_once(monkeypatch, lambda: own().delete_order_plan(3), lambda: own().create_order_list(3, "new"))
    left, lists = {r.id for r in store.plans().collect()}, [r.order_plan_id for r in store.lists().collect()]
    assert set(lists) <= left  # no list without its plan, whoever was first
    assert ([("order_lists", planning.IN_USE)] in said and 3 in left) or ([("order_plan_id", planning.NO_PLAN)] in said and 3 not in left)


def test_two_drivers(spark, tmp_path):
    """Two programs insert the same names."""
    path = str(tmp_path / "store")
    plan = planning.PlanStore(spark, path).create_order_plan("p", "EUR")
    program = f"""
from pyspark.sql import SparkSession
from quillmill.operators import planning
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").config("spark.sql.warehouse.dir", {str(tmp_path)!r}).getOrCreate()
store = planning.PlanStore(spark, {path!r})
for k in range(3):
    try:
        print("said", store.create_order_list({plan}, f"n{{k}}"))
    except planning.ConstraintError as e:
        print("said", e.problems[0][1])
"""
    root = str(Path(__file__).parent.parent)
    both = [subprocess.Popen([sys.executable, "-c", program], cwd=root, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True) for _ in range(2)]
    said = [line for p in both for line in p.communicate(timeout=240)[0].splitlines() if line.startswith("said")]
    assert sorted(said) == sorted([f"said {k}" for k in (1, 2, 3)] + [f"said {planning.TAKEN}"] * 3)
    assert sorted(r.name for r in planning.PlanStore(spark, path).lists().collect()) == ["n0", "n1", "n2"]


def test_numbered(spark):
    rows = [(k * 7919 % 1000, k % 3) for k in range(1000)] + [(5000, 1)] * 300
    df = spark.createDataFrame(rows, "a int, _at0 int").repartition(9)
    got = sorted(tuple(r) for r in numbered(df, F.desc("a"), "_at0", name="n", first=1).select("n", "a", "_at0").collect())
    assert [n for n, _, _ in got] == list(range(1, 1301)) and [(a, b) for _, a, b in got] == sorted(rows, key=lambda r: (-r[0], r[1]))
    assert numbered(df.limit(0), "a").columns == ["a", "_at0", "place"] and numbered(df.limit(0), "a").count() == 0
