"""Text and number functions, record repair and the operators without SQL, on invented rows."""

import pytest
from pyspark.sql import functions as F

from tallywright.functions import numbers as N
from tallywright.functions import text as S
from tallywright.operators import asof, compare, matching, merge, sequences, totals
from tallywright.plans import currency, enrich
from tallywright.sources import connectors, records
from tallywright.streaming import jobs


def of(spark, make, *values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("v"))).collect()]


@pytest.mark.parametrize(
    ("make", "cases"),
    [
        (S.squashed, {" A-b (C).": "abc", None: ""}),
        (S.bare_name, {"Fund (note) X": "fundx"}),
        (S.script_runs, {"알파벳ABC x 가": ["알파벳", "ABC"]}),
        (S.account_type, {"퇴직연금(IRP)": "IRP", "none": "일반", None: "일반"}),
        (S.known_account_type, {"ISA 1": "ISA", "none": None}),
        (S.asset_class, {"미국나스닥100": "성장주", "채권혼합": "혼합(주식·채권)", "x": None}),
        (S.header_kind, {"평가손익": "pnl", "잔고구분": None, "현재가": "price"}),
        (S.is_header, {"수익률 (%)": True, "기타": False}),
        (S.is_field_label, {"평가금액": True, "원화예수금": False, "환율 1,482.00": True, "접기›": True, "나스닥100": False}),
        (lambda c: S.ticker(c), {"Meta (META)": "META", "VOO": "VOO", "AAPL apple": None}),
        (lambda c: S.ticker(c, True), {"AAPL apple": "AAPL"}),
        (S.canonical_broker, {"관련증권 다음 하늘증권": "하늘증권", "x": None}),
        (S.is_placeholder, {"broker": True, " - ": True, "하늘": False}),
        (S.brand_token, {"[하늘] 123-456-789": "하늘", "[연금저축]": None, "broker": None}),
        (S.file_brand, {"Screenshot_20260709_1601_ SMART.jpg": "SMART", "IMG_1234.png": None}),
        (S.account_tokens, {"123-45-678 연금저축": ["123-45-678", "연금저축"], None: []}),
        (S.html_text, {"<p>a</p><script>x</script> b": "a b"}),
        (S.source_kind, {"derived:close(1)": "derived", "screen(x)": "screen", None: None}),
        (S.char_width, {"ab": 2, "가b": 3}),
        (N.parse_number, {"1,234원": 1234.0, "-": None, "x": None, ".5": 0.5}),
        (N.money, {"1,234.567": 1234567.0, "12원": 12.0, "a": None}),
        (N.amount, {"+1,200(3.4%)": 1200.0, "-3.4% | 1,200": -1200.0, "%": None}),
        (N.share_quantity, {"0.5주": 0.5, "1,000 주": 1000.0, "주": None}),
    ],
)
def test_text_cases(spark, make, cases):
    assert of(spark, make, *cases) == list(cases.values())


def test_variants(spark):
    (found,) = of(spark, S.confusable_variants, "IWV")
    assert "IVV" in found and "IWV" not in found and len(found) <= 48
    assert of(spark, S.confusable_variants, "005930", "가나") == [[], []]


def test_support(spark):
    rows = spark.createDataFrame([("하늘증권", "계좌 하늘 1,234 증권"), ("없는", "계좌"), ("x", None)], "l string, e string")
    assert [r[0] for r in rows.select(S.supported(F.col("l"), F.col("e"))).collect()] == [True, False, True]


def test_tiers_and_costs(spark):
    rows = spark.createDataFrame([(100.0, 10.0), (104.9, 10.0), (102.0, 10.0), (10.0, 0.0), (None, 1.0)], "v double, u double")
    got = [tuple(r.t) for r in rows.select(N.residual_tier(F.col("v"), F.col("u")).alias("t")).collect()]
    assert got == [(10.0, 0.0, "high"), (None, None, None), (10.0, 0.2, "estimated"), (None, None, None), (None, None, None)]
    rows = spark.createDataFrame([(100.0, None, 10.0), (100.0, -5.0, None), (100.0, 50.0, 10.0), (100.0, 90.0, 10.0)], "v double, c double, p double")
    got = [tuple(r.t) for r in rows.select(N.repaired_cost(*map(F.col, "vcp")).alias("t")).collect()]
    assert got == [(90.0, 10.0, "computed:value-pnl"), (105.0, -5.0, "computed:value-pnl"), (90.0, 10.0, "computed:value-pnl"), (90.0, 10.0, "screen")]


def test_record_repair(spark):
    raw = [
        '```json\n[{"name": "a", "value": +1,234,567,}]\n```',
        'text [{"name": "a", "value": 1}, {bad}, {"name": "b", "value": 2}] more',
        '[["b","t","n","c","KRW",1,2,3,4,5,0.9], [1,2]]',
        "[]",
        None,
        '[{"name": "o"}, ["b","t","n","c","KRW",1,2,3,4,5,0.9]]',
    ]
    got = of(spark, lambda c: F.transform(records.rows(c), lambda r: F.struct(r["name"], r["value"])), *raw)
    assert [[tuple(x) for x in r] for r in got] == [[("a", 1234567.0)], [("a", 1.0), ("b", 2.0)], [("n", 3.0)], [], [], [("o", None), ("n", 3.0)]]


def test_connectors(spark, tmp_path):
    head = "level\tpage\tblock\tpar\tline\tword\tleft\ttop\twidth\theight\tconf\ttext\n"
    (tmp_path / "a.tsv").write_text(head + "5\t1\t1\t1\t1\t1\t10\t20\t30\t40\t95.5\tHi\n5\t1\t1\t1\t1\t2\t1\t2\t3\t4\t-1\t\n")
    assert [tuple(r)[1:] for r in connectors.boxes_from_tsv(spark, str(tmp_path)).collect()] == [("Hi", 10, 20, 30, 40, 0.955)]
    (symbols,) = of(spark, connectors.watchlist, '["A", {"symbol": "B", "name": "b"}, {"name": "c"}]')
    assert [tuple(s) for s in symbols] == [("A", None), ("B", "b")]
    assert str(of(spark, connectors.file_time, "shot_20260709-160155.png")[0]) == "2026-07-09 16:01:55"
    assert not connectors.publish(spark.range(0), str(tmp_path / "none"))
    assert connectors.publish(spark.range(2), str(tmp_path / "some")) and spark.read.json(str(tmp_path / "some")).count() == 2


def test_greedy_matches_consume(spark):
    groups = spark.createDataFrame([(1, 1, 100.0), (1, 2, 100.5), (1, 3, 7.0)], "b int, pos long, amount double")
    sums = spark.createDataFrame([(1, 0, 100.0), (1, 1, 101.0), (1, 2, 500.0)], "b int, total_pos long, total double")
    out = matching.greedy_match(groups, sums, "b")
    assert [(r.pos, r.total_pos, r.matched) for r in out.orderBy("pos").collect()] == [(1, 0, True), (2, 1, True), (3, 2, False)]
    assert [r.total for r in matching.unmatched_totals(sums, out, "b").collect()] == [500.0]


def test_slips_and_totals(spark):
    rows = spark.createDataFrame([(1, 1, 1000.0), (1, 2, 50.0), (2, 1, 5.0), (2, 2, 6.0)], "g int, k int, v double")
    sums = spark.createDataFrame([(1, 150.0), (2, 11.0)], "g int, total double")
    got = {(r.g, r.k): (r.v, r.slip) for r in totals.repaired_slips(rows, sums, "g", "k", "v").collect()}
    assert got == {(1, 1): (100.0, 0.1), (1, 2): (50.0, None), (2, 1): (5.0, None), (2, 2): (6.0, None)}
    echo = spark.createDataFrame([(1, 1, 10.0, True), (1, 2, 99.5, True), (1, 3, 5.0, False)], "g int, k int, v double, c boolean")
    only = totals.deposit_echoes_dropped(echo, spark.createDataFrame([(1, 100.0)], "g int, total double"), "g", "k", "v", F.col("c"))
    assert sorted(r.k for r in only.collect()) == [2, 3]
    groups = spark.createDataFrame([(1,), (2,)], "g int")
    kinds = totals.classified(groups, spark.createDataFrame([(1, ["1"]), (1, ["2"])], "g int, t array<string>"), "g", F.lit(False), "t")
    assert {tuple(r) for r in kinds.collect()} == {(1, "account_summary"), (2, "empty")}


def test_merge_keeps_every_field(spark):
    rows = spark.createDataFrame([("a", 1, 10.0, None, 5.0), ("a", 2, 10.01, 3.0, None), ("b", 1, 10.0, None, None), ("b", 2, 20.0, 3.0, 4.0)], "k string, o int, v double, q double, c double")
    got = {r.k: (r.v, r.q, r.c, r.conflict) for r in merge.survivors(rows, ["k"], ["v", "q", "c"], ["o"], "v").collect()}
    assert got == {"a": (10.0, 3.0, 5.0, False), "b": (20.0, 3.0, 4.0, True)}


def test_asof_edges(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9)], "i int, k string, t int")
    right = spark.createDataFrame([("a", 5, 1.0), ("a", 2, 0.5), ("a", 6, 2.0)], "k string, t int, v double")
    assert {(r.i, r.v) for r in asof.asof_join(left, right, ["k"], "t", ["v"]).collect()} == {(1, 1.0), (2, None), (3, None)}
    assert {(r.i, r.v) for r in asof.nearest_join(left, right, ["k"], "t", "v", 2).collect()} == {(1, 1.0), (2, 0.5), (3, None)}
    assert of(spark, asof.intraday_rung, 3, 8, 60, 100, kind="int") == ["1m", "5m", "1h", None]


def test_sequences(spark):
    rows = spark.createDataFrame([(1, float(x)) for x in (0, 1, 2, 50, 51, 100)], "g int, x double")
    got = sequences.mean_clusters(rows, "g", "x", F.lit(2.0)).orderBy("cluster").collect()
    assert [(r.center, r.n) for r in got] == [(1.0, 3), (50.5, 2), (100.0, 1)]
    assert sequences.gap_split(rows, "g", "x").first().threshold == 48.0
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "g int, t string")
    assert [r.t for r in sequences.unrepeated(twice, ["g"], "t").collect()] == ["b"]


def test_enrichment_stages(spark):
    schema = "pos int, name string, assetClass string, currency string, qty double, price double, value double, cost double, pnl double, symbol string, market string, close double"
    rows = [
        (1, "x", "", None, 10.0, None, 1000.0, None, 100.0, "A", "KR", 99.0),
        (2, "x", "", None, None, None, 500.0, None, None, "A", "KR", 99.0),
        (3, "y", "", None, None, None, 1000.0, None, None, "B", "KR", 290.0),
        (4, "z", "", None, 10.0, None, 1000.0, None, None, "C", "KR", 5000.0),
    ]
    got = {r.pos: r for r in enrich.enriched(spark.createDataFrame(rows, schema), 1300.0, "2024-01-02").collect()}
    assert (got[1].qty_src, got[1].confidence, got[1].cost, got[1].price) == ("screen", "exact", 900.0, 100.0)
    assert (got[2].qty, got[2].qty_src, got[2].confidence) == (5.0, "derived:cross-account(100.0)", "high")
    assert (got[3].qty, got[3].confidence) == (None, "unreproducible")
    assert got[4].symbol is None and got[4].symbol_note
    quotes = spark.createDataFrame([("A", 110.0)], "symbol string, price double")
    again = {r.pos: (r.value, r.reprice_note) for r in enrich.repriced(spark.createDataFrame(rows, schema), quotes).collect()}
    assert again == {1: (1100.0, None), 2: (500.0, "no quantity"), 3: (1000.0, "no quantity"), 4: (1000.0, "no price")}


def test_comparison(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.001), (3, 3.0)], "k int, v double")
    assert {(r.k, r.kind) for r in compare.difference(a, b, "k", "v").collect()} == {(2, "only_a"), (3, "only_b")}
    assert compare.score(a, a, "k", "v").first().passed and not compare.score(a, b, "k", "v").first().passed
    assert tuple(compare.same_rows(a, b).first()) == (2, 2)


def test_streams_with_windows(spark, tmp_path):
    import datetime as dt

    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    spark.createDataFrame([("a", at(0)), ("a", at(30)), ("a", at(900)), ("b", at(2000))], "k string, ts timestamp").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "e"))
    out = jobs.run_to_table(jobs.sessions(stream, "ts", "k", "5 minutes", "0 seconds"), "append", str(tmp_path / "c1"))
    assert sorted((r.k, r.n) for r in out.collect()) == [("a", 1), ("a", 2)]  # the last one is still open
    out = jobs.run_to_table(jobs.windows(stream, "ts", "k", "10 minutes", "0 seconds"), "update", str(tmp_path / "c2"))
    assert sorted((r.k, r.n) for r in out.collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_lines_do_not_drift(spark):
    """Boxes that follow each other at small steps do not become one line."""
    rows = [("a", k, 10.0 + 5 * k, k, 8.0) for k in range(6)] + [("b", 0, 1.0, 0, 8.0), ("b", 1, 100.0, 0, 8.0)]
    d = spark.createDataFrame(rows, "s string, box_id int, cy double, x int, near double")
    got = {(r.s, r.box_id): r.line for r in sequences.mean_lines(d, ["s"], ["cy", "x"], "cy", "box_id", "near").collect()}
    want, lines = {}, []
    for s, k, cy, _, near in rows:
        if s == "a":
            at = next((i for i, line in enumerate(lines) if abs(sum(line) / len(line) - cy) <= near), None)
            lines = [*lines, [cy]] if at is None else [[*line, cy] if i == at else line for i, line in enumerate(lines)]
            want[s, k] = len(lines) - 1 if at is None else at
    assert {k: v for k, v in got.items() if k[0] == "a"} == want and len(set(want.values())) > 1
    assert got["b", 0] != got["b", 1]


def test_publish_replaces_a_snapshot(spark, tmp_path):
    path = str(tmp_path / "snapshot")
    frame = lambda *v: spark.createDataFrame([(x,) for x in v], "v int")
    assert connectors.publish(frame(1, 2), path) and connectors.publish(frame(3), path)
    assert not connectors.publish(frame(), path)
    assert [r.v for r in spark.read.json(path).collect()] == [3]
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["snapshot"]


def test_cash_pairs_and_rates(spark):
    """A dollar row takes the first plausible won row, a won row is taken once; null and zero values take no part."""
    schema = "g int, pos int, currency string, qty double, price double, value double, cost double, pnl double"
    rows = [(1, 1, "USD", 100.0), (1, 2, "USD", 101.0), (1, 3, None, 130_000.0), (1, 4, "KRW", 131_000.0), (1, 5, "KRW", 0.0), (1, 6, "USD", None), (2, 1, "USD", 100.0), (2, 2, "KRW", 9e6)]
    df = spark.createDataFrame([(g, p, c, None, None, v, None, None) for g, p, c, v in rows], schema)
    merged = currency.cash_pairs_merged(df, "g", "pos", F.lit(True))
    assert sorted((r.g, r.pos, r.currency, r.qty) for r in merged.collect()) == [
        (1, 2, "USD", None), (1, 3, "USD", 100.0), (1, 4, "KRW", None), (1, 5, "KRW", None), (1, 6, "USD", None), (2, 1, "USD", None), (2, 2, "KRW", None),
    ]
    assert [tuple(r) for r in currency.captured_rate(merged, "g", "pos", F.lit(True)).collect()] == [(1, 1300.0)]
    assert currency.cash_pairs_merged(df.limit(0), "g", "pos", F.lit(True)).count() == 0
    one = spark.createDataFrame([(1, 1, "USD", 2.0, 1300.0, 2600.0, 1300.0, None)], schema)
    got = currency.unified(one, F.lit(1300.0), F.lit(True), F.lit(True)).first()
    assert (got.value, got.cost, got.pnl, got.price, got.fx_applied) == (2.0, 1.0, None, 1.0, 1300.0)


def test_pairs_of_rows(spark):
    """Golden rows by name first, then by equal fields and value; one by one, in order."""
    schema = "batch int, pos int, broker string, name string, value double"
    golden = spark.createDataFrame([(1, 1, "a", "alpha", 100.0), (1, 2, "a", "beta", 200.0), (1, 3, "b", None, 300.0), (2, 1, "a", "alpha", 1.0)], schema)
    got = spark.createDataFrame([(1, 1, "a", "x", 100.2), (1, 2, "a", "beta fund", 100.0), (1, 3, "b", "y", 301.0), (1, 4, "a", "alpha", None)], schema)
    rounds = [([], True, None), (["broker"], False, 0.005)]
    assert sorted(tuple(r) for r in compare.paired(golden, got, "batch", rounds).collect()) == [(1, 1, 4), (1, 2, 2), (1, 3, 3)]
    values = [(["broker", "name"], False, None), (["broker"], False, 0.01)]
    assert sorted(tuple(r) for r in compare.paired(golden, got, "batch", values, by_row=True).collect()) == [(1, 1, 4), (1, 3, 3)]


def test_aligned_labels(spark):
    """An aligned label beyond the limit is no match, and no other is tried."""
    left = spark.createDataFrame([(1, 1, 0.0, 0.0), (2, 1, 50.0, 100.0), (3, 2, 0.0, 0.0)], "i int, s int, y double, x double")
    right = spark.createDataFrame([(1, 40.0, 1.0, "far"), (1, 5.0, 60.0, "near"), (1, 52.0, 70.0, "low")], "s int, y double, x double, t string")
    got = asof.nearest_aligned(left, right, ["s"], "i", "y", "x", "t", 10.0, 20.0)
    assert {(r.i, r.t) for r in got.collect()} == {(1, None), (2, "low"), (3, None)}
