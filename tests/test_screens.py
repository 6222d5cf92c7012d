"""Screens with headers, cards and labels, box by box."""

import random
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.functions import numbers
from tallywright.operators import matching, sequences
from tallywright.plans import bind, headered, screen_queries, screens, sheets

BOXES = "batch_id string, file string, box_id long, text string, x double, y double, w double, h double"


def placed(spark, *texts, file="a.png"):
    """Boxes (text, x or right edge as a negative number, y[, w]) of one screen, 40 high, as placed() gives them."""
    rows = []
    for i, (text, x, y, *w) in enumerate(texts):
        w = w[0] if w else 150.0
        rows.append(("b", file, i, text, float(x if x >= 0 else -x - w), float(y), w, 40.0))
    return spark.createDataFrame(rows, BOXES)


TOP = [("9:41", 40, 0), ("KOSPI 2,500", 40, 100)]
HEADER = [("종목명", 40, 200), ("매입금액", -700, 200), ("평가금액", -1040, 200), ("평가손익", -1043, 250)]


def rows_of(boxes):
    b = screens.placed(boxes)
    return sorted(headered.header_rows(b, headered.frames(b)).collect(), key=lambda r: r.row)


def row(k, name="Alpha", value="1,000원", pnl="+100", cost="900", y=None):
    y = 300 + 200 * k if y is None else y
    return [(name, 40, y + 25), (value, -1050, y), (pnl, -1050, y + 50), (cost, -705, y)]


def test_rows_keep_their_own_cells(spark):
    """A row without a profit does not shift those behind it, as rows part at gaps and not by number."""
    cells = row(0, "One") + row(1, "Two") + [("Three", 40, 725), ("3,000원", -1050, 700)] + row(3, "Four", "4,000", "-5") + row(4, "Five")
    got = rows_of(placed(spark, *TOP, *HEADER, *cells))
    assert [(r.name, r.value, r.pnl, r.cost) for r in got] == [
        ("One", 1000.0, 100.0, 900.0), ("Two", 1000.0, 100.0, 900.0), ("Three", 3000.0, None, None), ("Four", 4000.0, -5.0, 900.0), ("Five", 1000.0, 100.0, 900.0),
    ]


def test_wrapped_names_quantities_and_rates(spark):
    header = HEADER[:2] + [("수익률", -697, 250)] + HEADER[2:]
    cells = [("S&P", 40, 260), ("500 Fund", 40, 310), ("1,200.5주", 40, 350), ("1,234.567원", -1050, 275), ("+10", -1050, 325), ("1,000", -705, 275), ("23.4%", -705, 325)]
    got = rows_of(placed(spark, *TOP, *[(t, x, y - 50, *w) for t, x, y, *w in header], *cells))
    assert [(r.name, r.qty, r.value, r.pnl, r.cost, r.rate) for r in got] == [("S&P500 Fund", 1200.5, 1234567.0, 10.0, 1000.0, "23.4%")]


@pytest.mark.parametrize(
    ("header", "n"),
    [
        ([("종목명", 40, 200), ("평가금액 순", -1040, 200)], 0),  # a sorting tab is no header word
        ([("종목명", 40, 200)], 0),  # one hit
        ([("상태", 40, 200), ("잔고구분", -700, 200), ("종목명", 300, 200), ("평가금액", -1040, 200)], 2),  # categories are no columns
    ],
)
def test_what_is_a_header(spark, header, n):
    assert len(rows_of(placed(spark, *TOP, *header, ("Alpha", 40, 300), ("1,000", -1050, 300), ("Beta", 40, 500), ("2,000", -1050, 500)))) == n


def test_navigation_bar_is_no_header(spark):
    assert rows_of(placed(spark, *TOP, ("Alpha", 40, 300), ("1,000", -1050, 300), ("잔고", 40, 900), ("현재가", 400, 900))) == []


def test_bands_keep_their_first_anchor(spark):
    """Marks 30 apart would chain into one column; the first mark's edge decides."""
    marks = spark.createDataFrame([(1, float(r), y, k) for r, y, k in [(100, 1, "a"), (130, 2, "b"), (160, 0, "c"), (190, 1, "d"), (100, 0, "e")]], "g int, r double, y int, k string")
    got = headered.bands(marks, ["g"], "r", "k", ["y"], F.lit(50.0)).orderBy("band").collect()
    assert [(r.band, r.anchor, r.kinds) for r in got] == [(0, 100.0, ["e", "a", "b"]), (1, 160.0, ["c", "d"])]


def test_jump_counts_gaps_of_zero(spark):
    df = spark.createDataFrame([(g, float(v)) for g, vs in {1: [0, 0, 5, 10, 15], 2: [0, 10, 20], 3: [0, 1, 2, 3, 4, 5, 6, 7, 8, 109], 4: [3]}.items() for v in vs], "g int, v double")
    assert {r.g: r.threshold for r in sequences.jump(df, ["g"], ["v"], "v").collect()} == {1: 5.0, 2: None, 3: None}


def test_rows_without_pitch_are_chunks(spark):
    """Evenly spaced amounts are parted by the number of kinds in their column."""
    cells = [("Alpha", 40, 320), ("1,000", -1050, 300), ("+1", -1050, 360), ("2,000", -1050, 420), ("+2", -1050, 480), ("Beta", 40, 450)]
    assert [(r.value, r.pnl) for r in rows_of(placed(spark, *TOP, *HEADER, *cells))] == [(1000.0, 1.0), (2000.0, 2.0)]


def bound(spark, *texts):
    rows = bind.bind(placed(spark, *TOP, *texts)).orderBy("row_no").collect()
    return [r for r in rows if r.name != bind.SCREEN_TOTAL], {r.value for r in rows if r.name == bind.SCREEN_TOTAL}


def test_binds_both_layouts(spark):
    label = ("[Sky] 1234-5678-01 IRP", 40, 150, 400.0)
    table, total = bound(spark, label, *[(t, x, y + 50, *w) for t, x, y, *w in HEADER], *row(0, y=400), *row(1, "Beta 채권", y=600))
    assert [(r.name, r.value, r.cost, r.accountType, r.broker, r.assetClass) for r in table] == [
        ("Alpha", 1000.0, 900.0, "IRP", label[0], None), ("Beta 채권", 1000.0, 900.0, "IRP", label[0], "채권"),
    ]
    assert total == set()
    listed, total = bound(spark, ("평가금액", 40, 200), ("3,000", -1040, 200), ("Alpha", 40, 300), ("1,000원", -1040, 300), ("+5", -1040, 340), ("Beta", 40, 500), ("2,000원", -1040, 500))
    assert [(r.name, r.value) for r in listed] == [("Alpha", 1000.0), ("Beta", 2000.0)] and total == {3000.0}


def test_total_by_sum_and_unit_prices(spark):
    header = [("종목명", 40, 300), ("보유수량", -500, 300), ("매입단가", -1040, 300), ("현재가", -1043, 350)]
    rows, total = bound(spark, ("5,010", 40, 200), *header, ("Alpha", 40, 430), ("10", -500, 425), ("90", -1050, 400), ("100", -1050, 450), ("Beta", 40, 630), ("20", -500, 625), ("190", -1050, 600), ("200", -1050, 650))
    assert [(r.name, r.qty, r.value, r.cost) for r in rows] == [("Alpha", 10.0, 1000.0, 900.0), ("Beta", 20.0, 4000.0, 3800.0)]
    assert total == {5010.0}


def test_leftovers_are_taken_once(spark):
    """Every label has its nearest behind it, not what an earlier label took, and nothing out of reach."""
    labels = spark.createDataFrame([("s", 1, 0.0), ("s", 2, 1.0), ("s", 3, 50.0), ("s", 4, 200.0), ("t", 5, 0.0)], "s string, label int, y double")
    amounts = spark.createDataFrame([("s", 10, 5.0), ("s", 11, 6.0), ("s", 12, 0.5), ("s", 13, 49.0), ("s", 14, 260.0), ("t", 15, 0.0)], "s string, amount int, y double")
    got = matching.leftover_assigned(labels, amounts, ["s"], "y", "label", "amount", 40.0).collect()
    assert sorted((r.label, r.amount) for r in got) == [(1, 12), (2, 10)]


def _broadcasts(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") + df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_boxes_are_placed_by_one_shuffle(spark):
    """Nothing is joined, whatever sizes Spark estimates, and equal boxes under one id stay two."""
    boxes = placed(spark, *TOP, *HEADER, *row(0)).unionByName(placed(spark, ("Alpha", 40, 900)).withColumn("box_id", F.lit(99).cast("long")))
    b = screens.placed(boxes.unionByName(boxes.where("box_id = 99")))
    plan = b._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan
    assert [r.n for r in b.where("box_id = 99").groupBy("line").agg(F.count("*").alias("n")).collect()] == [2]


def test_headers_and_tables_are_not_broadcast(spark):
    b = screens.placed(placed(spark, *TOP, *HEADER, *row(0), *row(1, "Beta")))
    columns = headered.frames(b)
    assert _broadcasts(columns) == _broadcasts(headered.table_boxes(b, columns)) == _broadcasts(headered.header_rows(b, columns)) == 0


def test_cards_are_not_broadcast(spark):
    b = screens.placed(placed(spark, *TOP, ("총자산", 40, 200), ("3,000", -1040, 200)))
    totals = bind.card_totals(bind.top_lines(b, headered.frames(b)))
    assert _broadcasts(totals) == 0 and [r.total for r in totals.collect()] == [3000.0]


def test_bound_rows_are_not_broadcast(spark):
    assert _broadcasts(bind.bind(placed(spark, *TOP, *HEADER, *row(0), *row(1, "Beta")))) == 0


def test_no_boxes(spark):
    assert bind.bind(spark.createDataFrame([], BOXES)).count() == 0


def _screen_of(rng, k):
    """Boxes of a screen that is mostly in order: rows of two pitches, missing cells, ties, lines of an index, and sometimes no header."""
    out = [*TOP, *(HEADER if rng.random() < 0.8 else HEADER[:1])]
    y = 300
    for i in range(rng.randrange(1, 7)):
        cells = row(i, f"Name {i}", rng.choice(["1,000원", "2.000", "-30", "(5%)-7", ""]), rng.choice(["+1", "3.5%", "-2(1%)"]), rng.choice(["900", "10주", "x"]), y)
        out += [c for c in cells if rng.random() < 0.85] + ([("12주", 40, y + 60)] if rng.random() < 0.4 else []) + ([("1,0", -1050, y), ("2,0", -1050, y)] if rng.random() < 0.2 else [])
        y += rng.choice([55, 90, 200, 200, 200])
    return [*out, *([("KOSDAQ", 40, y)] if rng.random() < 0.3 else [])]


def test_screens_read_in_one_pass_are_the_same(spark):
    """Arrays give what windows and joins give, also where a screen goes over several batches."""
    rng = random.Random(5)
    boxes = reduce(DataFrame.unionByName, [placed(spark, *_screen_of(rng, k), file=f"{k}.png") for k in range(12)]).localCheckpoint()
    b = screens.placed(boxes).localCheckpoint()
    columns = headered.frames(b).localCheckpoint()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        read = sheets.read(sheets.by_screen(boxes)).localCheckpoint()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = read.select("batch_id", "file", F.inline("rows")).withColumns(headered.typed(F.col("name"), F.col("shares"), {k: F.col(k) for k in headered.FIELDS}) | {"_v": F.col("value")}).where("name != '' or _v is not null")
    told = lambda df, c: sorted(map(repr, df.select(*c).collect()))
    assert len(told(columns, ["file"])) >= 4
    assert told(rows, ["file", "row", "name", *headered.FIELDS]) == told(headered.header_rows(b, columns), ["file", "row", "name", *headered.FIELDS])
    unframed = ["file", "line", "box_id", "text", "x", "cy", "h0", "x0", "span", "top"]
    assert told(read.where("not framed").select("file", F.inline("boxes")), unframed) == told(b.join(columns, "file", "left_anti"), unframed)
    top = bind.top_lines(b, columns).groupBy("file").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "cells"))), lambda c: F.transform(c["cells"], lambda x: x["text"])).alias("top"))
    assert told(read.where("size(top) > 0"), ["file", "top"]) == told(top, ["file", "top"])


def test_bind_stores_a_screen_once(spark, monkeypatch):
    """Boxes are neither stored nor shuffled again and again: one table of screens is."""
    kept = []
    for module in (bind, headered):
        monkeypatch.setattr(module, "stored", lambda df, name, f=module.stored: kept.append(name) or f(df, name))
    bind.bind(placed(spark, *TOP, *HEADER, *row(0)))
    assert kept == ["read"]


def test_amounts_are_told_by_their_shape(spark):
    texts = ["1", "1,000원", "+1 000", "원-3.5", ",", "+,", ",.5", "1.", "1.5.5", "1\n", "1 ", "", "원", "3.4%", "+1(2%)", "(5%)-7", "a|1", "1|2)", "1 . 5", "--1", "1-", "١", None, "9" * 400]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", numbers.is_amount(F.col("t")).alias("is"), numbers.amount(F.col("t")).isNotNull().alias("was"))
    assert [r.t for r in df.collect() if r["is"] != r.was] == []


def test_header_rows_deal_lines_out_once(spark):
    """Boxes are made where an order's lines lie; neither they nor rows are shuffled or joined."""
    plan = screen_queries.header_rows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
