"""The batch plans on invented screens."""

import json

from pyspark.sql import functions as F

from tallywright.plans import reconcile, screens


def batch(spark, *raws):
    rows = [("b", f"{i}.png", i, json.dumps(r, ensure_ascii=False) if r is not None else "no rows", "", f"Screenshot_{i}_Sky.png") for i, r in enumerate(raws)]
    return spark.createDataFrame(rows, "batch_id string, file string, screen_no int, raw string, evidence string, fname string")


PRODUCTS = [{"name": "국내주식", "value": 300}, {"name": "해외주식", "value": 500}]
FIRST = [{"name": "Alpha", "value": 100, "qty": 2}, {"name": "Beta", "value": 200, "cost": 150}]
SECOND = [{"name": "Gamma", "value": 500}]


def run(spark, *raws):
    out = reconcile.reconcile(batch(spark, *raws))
    holdings = {r.name: r.value for r in out.holdings.collect()}
    return holdings, {(r.code, r.file) for r in out.warnings.collect() if r.code not in ("UNKNOWN_BROKER", "NONCANONICAL_BROKER")}, out


def test_clean_batch_is_silent(spark):
    holdings, warnings, out = run(spark, PRODUCTS, FIRST, SECOND)
    assert holdings == {"Alpha": 100.0, "Beta": 200.0, "Gamma": 500.0} and warnings == set()
    assert {(r.file, r.matched) for r in out.checks.collect()} == {("1.png", True), ("2.png", True)}
    assert {r.broker_src for r in out.holdings.collect()} == {"filename"}


def test_controls_warn(spark):
    """A screen that is missing, one that is empty and a row that is made up."""
    assert {("UNMATCHED_TOTAL", "해외주식"), ("EMPTY_SCREEN", "2.png")} <= run(spark, PRODUCTS, FIRST, None)[1]
    assert ("SUM_NEAR_TOTAL", "1.png") in run(spark, PRODUCTS, [*FIRST, {"name": "Made up", "value": 99}], SECOND)[1]


def test_order_of_screens_does_not_matter(spark):
    assert run(spark, SECOND, FIRST, PRODUCTS)[0] == {"Alpha": 100.0, "Beta": 200.0, "Gamma": 500.0}


def test_captures_of_one_holding_merge(spark):
    again = [{"name": "Alpha", "value": 100, "cost": 80}, {"name": "Beta", "value": 200}]
    holdings, _, out = run(spark, PRODUCTS, FIRST, SECOND, again)
    assert len(holdings) == 3
    alpha = out.holdings.where("name = 'Alpha'").first()
    assert (alpha.qty, alpha.cost, alpha.captures) == (2.0, 80.0, 2)


def test_own_total_is_checked(spark):
    """A screen's own total is held against its rows, and spares the warning that no other total is near."""
    right = [{"name": "__screen_total__", "value": 300}, *FIRST]
    wrong = [{"name": "__screen_total__", "value": 400}, *FIRST]
    assert run(spark, right)[:2] == ({"Alpha": 100.0, "Beta": 200.0}, set())
    assert run(spark, wrong)[1] == {("SCREEN_TOTAL_MISMATCH", "0.png")}


def test_weak_key_keeps_both_values(spark):
    """The same broker, type and name with another value may be another account."""
    _, warnings, out = run(spark, FIRST, [{"name": "Alpha", "value": 150}])
    assert sorted(r.value for r in out.holdings.where("name = 'Alpha'").collect()) == [100.0, 150.0]
    assert ("DUPLICATE_SUSPECT", "Alpha") in warnings


def test_strong_key_keeps_the_confirmed_value(spark):
    """One account number: one row, with the value of the screen whose own total fits, and the other's quantity."""
    named = lambda value, **more: {"broker": "1234-5678-01 Sky증권", "name": "Alpha", "value": value, **more}
    _, warnings, out = run(spark, [named(100, qty=2)], [{"name": "__screen_total__", "value": 150}, named(150)])
    row = out.holdings.first()
    assert out.holdings.count() == 1 and (row.value, row.qty, row.conflict, row.captures) == (150.0, 2.0, True, 2)
    assert ("VALUE_CONFLICT", "Alpha") in warnings


def test_cash_account_becomes_a_holding(spark):
    accounts = [{"name": "1111-2222-33 ISA [Sky CMA]", "value": 700}, {"name": "4444-5555-66 IRP [Plain]", "value": 300}]
    holdings, warnings, _ = run(spark, accounts, [{"name": "Alpha", "value": 300, "accountType": "IRP"}])
    assert holdings == {"Alpha": 300.0, "현금(Sky CMA)": 700.0} and not any(c == "UNMATCHED_TOTAL" for c, _ in warnings)


def test_app_spreads_the_one_broker_it_is_known_by(spark):
    _, _, out = run(spark, [{"name": "Alpha", "value": 100, "broker": "Sky증권"}], [{"name": "Beta", "value": 200}])
    assert {r.name: (r.broker, r.broker_src) for r in out.holdings.collect()} == {"Alpha": ("Sky증권", "screen"), "Beta": ("Sky증권", "filename")}


def test_deposit_echoes_fold_onto_the_total(spark):
    screen = [{"name": "예수금", "value": 488}, {"name": "추정예수금(D+2)", "value": 442}, {"name": "현금", "value": 402}]
    assert run(spark, [{"name": "원화예수금", "value": 442}, {"name": "국내주식", "value": 300}], screen, FIRST)[0] == {"추정예수금(D+2)": 442.0, "Alpha": 100.0, "Beta": 200.0}


def box_rows():
    rows, k = [], 0
    for i, (name, qty, value, pnl) in enumerate([("Alpha Fund", "3주", "1,200원", "+200(20.0%)"), ("Beta Fund", "1.5주", "900", "-100(10.0%)"), ("Gamma", None, "500", None)]):
        y = 300 + i * 120
        for text, x, dy in ((name, 20, 0), (qty, 20, 24), (value, 800, 0), (pnl, 780, 24)):
            if text:
                rows.append(("b", "a.png", k, text, x, y + dy, 150, 20))
                k += 1
    rows += [("b", "a.png", 90, "12:30", 20, 5, 60, 20), ("b", "a.png", 91, "123-45-6789", 20, 240, 200, 20), ("b", "a.png", 92, "KOSPI 2,500", 20, 700, 300, 20)]
    return rows


def test_list_rows_and_geometry(spark):
    schema = "batch_id string, file string, box_id int, text string, x int, y int, w int, h int"
    want = {("Alpha Fund", 3.0, 1200.0, 200.0), ("Beta Fund", 1.5, 900.0, -100.0), ("Gamma", None, 500.0, None)}
    boxes = spark.createDataFrame(box_rows(), schema)
    got = screens.list_rows(boxes).collect()
    assert {(r.name, r.qty, r.value, r.pnl) for r in got} == want and {r.account for r in got} == {"123-45-6789"}
    for factor in (0.5,):  # a screen of another density gives the same rows
        scaled = boxes.select("batch_id", "file", "box_id", "text", *[(F.col(c) * factor).cast("int").alias(c) for c in "xywh"])
        assert {(r.name, r.qty, r.value, r.pnl) for r in screens.list_rows(scaled).collect()} == want


def test_rows_without_a_symbol_are_no_single_task(spark):
    from tallywright.operators import matching

    rows = spark.range(4000).select("id", F.when(F.col("id") % 10 == 0, F.lit("s")).alias("symbol"), F.col("id").cast("double").alias("v"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = matching.transfer_first(rows, "symbol", ["id"], F.when(F.col("symbol").isNotNull(), F.col("v")), "unit")
        parts = out.where("symbol is null").groupBy(F.spark_partition_id()).agg(F.count("*").alias("count"), F.max("unit")).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sum(r["count"] for r in parts) == 3600 and max(r["count"] for r in parts) < 1200
    assert {(r.symbol, r.unit) for r in out.collect()} == {("s", 0.0), (None, None)}
