"""Queries over batches that are made of the driver's tables: merge keys, referee, consensus, cash accounts, nested JSON, corrections; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywright.functions import numbers as N
from tallywright.operators import compare, matching, merge
from tallywright.plans.queries import _run, _stream, query, scratch_folder
from tallywright.plans.reconcile import uncovered_cash as cash_of
from tallywright.sources import records
from tallywright.sources.tables import table
from tallywright.streaming import jobs


@query("""
WITH c AS (SELECT c_custkey AS k, c_custkey % 7 AS m, round(c_acctbal * 100) + 1000000 AS v FROM customer)
SELECT k AS c_custkey, CASE WHEN m IN (0, 1, 2, 4) THEN 1 WHEN m = 6 THEN 3 ELSE 2 END::BIGINT AS n,
       (CASE m WHEN 0 THEN v WHEN 1 THEN v + 50000 WHEN 2 THEN v WHEN 3 THEN v + v + 50000 WHEN 4 THEN v WHEN 5 THEN v + v WHEN 6 THEN v + v + 1 + v + 50000 END)::DOUBLE AS value,
       (CASE m WHEN 0 THEN 7 WHEN 1 THEN 7 WHEN 2 THEN 7 WHEN 3 THEN 7 WHEN 4 THEN 7 WHEN 5 THEN 15 WHEN 6 THEN 7 END)::DOUBLE AS qty,
       (m = 1)::INT::BIGINT AS conflicts, (m IN (3, 5))::INT::BIGINT AS suspects
FROM c
""")
def survivorship_keys(spark, sf):
    """Every customer's balance captured in two files, by account number, by broker, or by neither; equal or not; and twice in one file."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 7).alias("m"), (F.round(F.col("c_acctbal") * 100) + 1_000_000).alias("v"))
    m, v, k = F.col("m"), F.col("v"), F.col("k").cast("string")
    none = F.lit(None).cast("double")

    def capture(pos: int, file, tokens, broker, value, qty, cost):
        return F.struct(
            F.lit(pos).alias("pos"), file.alias("file"), tokens.alias("tokens"), broker.alias("broker"), F.lit("일반").alias("kind"), F.lit(None).cast("boolean").alias("ok"),
            value.cast("double").alias("value"), qty.alias("qty"), cost.alias("cost"), none.alias("pnl"),
        )

    numbers = F.when(m.isin(0, 1, 6), F.array(F.concat(F.lit("1234567-"), k))).otherwise(F.array().cast("array<string>"))
    more = F.when(m.isin(0, 1), F.array(F.concat(F.lit("1234567-"), k), F.lit("99999999"))).otherwise(numbers)
    broker = F.when(m.isin(2, 3), F.lit("Sky증권"))
    changed = F.when(m.isin(1, 3), v + 50_000).when(m == 6, v + 1).otherwise(v)
    first = capture(1, F.lit("a.png"), numbers, broker, v, F.when(m == 5, F.lit(8.0)), none)
    second = capture(2, F.when(m == 6, F.lit("a.png")).otherwise(F.lit("b.png")), more, broker, changed, F.lit(7.0), F.when(m == 1, F.lit(1.0)))
    third = F.when(m == 6, capture(3, F.lit("a.png"), numbers, broker, v + 50_000, none, none))
    rows = c.select(F.lit("b").alias("batch_id"), k.alias("name"), F.explode(F.array_compact(F.array(first, second, third))).alias("r")).select("batch_id", "name", "r.*")
    out = merge.captures_merged(rows, ["batch_id", "name"], ["value", "qty", "cost", "pnl"])
    return out.groupBy(F.col("name").cast("long").alias("c_custkey")).agg(
        F.count("*").alias("n"), F.sum("value").alias("value"), F.sum("qty").alias("qty"), F.count_if("conflict").alias("conflicts"), F.count_if("suspect").alias("suspects")
    )


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey % 50 AS name, round(l_extendedprice, 2) AS v, l_quantity AS q, l_orderkey % 5 AS m FROM lineitem),
r AS (SELECT *, CASE m WHEN 0 THEN v WHEN 1 THEN v / 2 WHEN 2 THEN v / 2 WHEN 3 THEN NULL WHEN 4 THEN v / 2 END AS mine, CASE WHEN m = 2 THEN v * 0.9 ELSE v END AS theirs FROM l),
s AS (SELECT l_orderkey, sum(v) AS total, coalesce(sum(mine), 0) AS mine, sum(theirs) AS theirs, bool_and(m <> 4) AS domestic FROM r GROUP BY l_orderkey),
f AS (SELECT l_orderkey FROM s WHERE total <> 0 AND abs(theirs - total) / total <= 0.02 AND (mine = 0 OR abs(mine - total) / total > 0.10) AND domestic),
u AS (SELECT l_orderkey, name, any_value(theirs) AS theirs, any_value(q) AS q FROM r JOIN f USING (l_orderkey) GROUP BY ALL HAVING count(*) = 1)
SELECT r.l_orderkey, r.l_linenumber, round(CASE WHEN u.name IS NULL THEN r.mine ELSE u.theirs END, 4) AS value, CASE WHEN u.name IS NULL THEN NULL ELSE u.q END AS qty
FROM r LEFT JOIN u ON u.l_orderkey = r.l_orderkey AND u.name = r.name
""")
def total_referee(spark, sf):
    """Lines read wrong in some orders, put right from a second reading where the order's total refutes the first and confirms the second."""
    m = F.col("l_orderkey") % 5
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 50).alias("name"), F.round("l_extendedprice", 2).alias("v"), F.col("l_quantity").cast("double").alias("q"), m.alias("m"))
    rows = lines.select("l_orderkey", "l_linenumber", "name", F.when(F.col("m") == 0, F.col("v")).when(F.col("m") != 3, F.col("v") / 2).alias("value"), F.lit(None).cast("double").alias("qty"), "m")
    other = lines.select("l_orderkey", "name", F.when(F.col("m") == 2, F.col("v") * 0.9).otherwise(F.col("v")).alias("value"), F.col("q").alias("qty"))
    totals = lines.groupBy("l_orderkey").agg(F.sum("v").alias("total"))
    out = matching.refereed(rows, other, totals, ["l_orderkey"], "name", "value", ["value", "qty"], F.col("m") != 4)
    return out.select("l_orderkey", "l_linenumber", F.round("value", 4).alias("value"), "qty")


@query("""
WITH o AS (SELECT o_orderkey, o_custkey, CASE o_orderkey % 4 WHEN 0 THEN 'screen' WHEN 1 THEN 'brand' WHEN 2 THEN 'filename' END AS src,
                  CASE WHEN o_orderkey % 4 < 3 THEN o_orderstatus END AS broker FROM orders),
g AS (SELECT o_custkey, list_sort(list_distinct(list(broker) FILTER (src = 'screen'))) AS s, list_sort(list_distinct(list(broker) FILTER (src = 'brand'))) AS b FROM o GROUP BY o_custkey),
a AS (SELECT o_custkey, CASE WHEN coalesce(len(s), 0) = 1 THEN s[1] WHEN coalesce(len(s), 0) = 0 AND coalesce(len(b), 0) = 1 THEN b[1] END AS agreed FROM g)
SELECT o_orderkey, CASE WHEN agreed IS NOT NULL AND (broker IS NULL OR src = 'filename') THEN agreed ELSE broker END AS broker,
       CASE WHEN agreed IS NOT NULL AND (broker IS NULL OR src = 'filename') THEN 'filename' ELSE src END AS src FROM o JOIN a USING (o_custkey)
""")
def brand_consensus(spark, sf):
    """The status of every order, known, guessed or missing, filled where the customer's other orders agree on one."""
    k = F.col("o_orderkey") % 4
    rows = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.when(k < 3, F.col("o_orderstatus")).alias("broker"), F.when(k == 0, "screen").when(k == 1, "brand").when(k == 2, "filename").alias("src")
    )
    out = matching.consensus_filled(rows, ["o_custkey"], "broker", "src", F.col("src") == "screen", F.col("src") == "brand", "filename")
    return out.select("o_orderkey", "broker", "src")


@query("""
WITH a AS (SELECT c_custkey, c_nationkey, CASE c_custkey % 3 WHEN 0 THEN 'IRP' WHEN 1 THEN 'ISA' ELSE '일반' END AS kind, round(c_acctbal, 2) AS total,
                  c_custkey % 4 AS w FROM customer),
h AS (SELECT DISTINCT s_nationkey AS c_nationkey, CASE s_suppkey % 3 WHEN 0 THEN 'IRP' WHEN 1 THEN 'ISA' ELSE '일반' END AS kind FROM supplier WHERE s_suppkey % 2 = 0)
SELECT c_custkey, CASE WHEN w = 1 THEN '현금(Best CMA)' ELSE '현금(' || kind || ')' END AS name, kind AS type, total AS value FROM a
WHERE w > 0 AND total <> 0 AND NOT EXISTS (SELECT 1 FROM h WHERE h.c_nationkey = a.c_nationkey AND h.kind = a.kind)
""")
def uncovered_cash(spark, sf):
    """Cash accounts of every nation's customers whose type no supplier of the nation has, as holdings."""
    kind = lambda c: F.when(F.col(c) % 3 == 0, "IRP").when(F.col(c) % 3 == 1, "ISA").otherwise("일반")
    w = F.col("c_custkey") % 4
    nick = F.when(w == 0, "그냥 계좌").when(w == 1, "CMA [Best CMA]").when(w == 2, "현금 계좌").otherwise("예수금 계좌")
    accounts = table(spark, sf, "customer").select(F.col("c_nationkey").alias("batch_id"), F.col("c_custkey").alias("total_pos"), kind("c_custkey").alias("key"), nick.alias("nick"), F.round("c_acctbal", 2).alias("total"))
    held = table(spark, sf, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_nationkey").alias("batch_id"), kind("s_suppkey").alias("accountType"))
    return cash_of(accounts, held).select(F.col("total_pos").alias("c_custkey"), "name", F.col("accountType").alias("type"), "value")


@query(r"""
WITH e AS (SELECT event_id, event_id % 4 AS m, TRY_CAST(regexp_extract(props, ':\s*(-?\d+)', 1) AS DOUBLE) AS v FROM events)
SELECT event_id, CASE WHEN v IS NULL THEN 0 WHEN m = 3 THEN 1 ELSE 2 END::BIGINT AS n, v AS qty, CASE WHEN v IS NOT NULL THEN 'part ' || event_id || ' {' || m || '}' END AS name FROM e
""")
def nested_salvage(spark, sf):
    """Objects with objects in them, out of JSON that is broken beside them, with braces in strings and thousands commas."""
    value, m = F.regexp_extract("props", r":\s*(-?\d+)", 1), F.col("event_id") % 4
    name = F.concat(F.lit("part "), F.col("event_id").cast("string"), F.lit(" {"), m.cast("string"), F.lit("}"))
    good = F.concat(F.lit('{"name": "'), name, F.lit('", "more": {"at": {"x": [1, 2], "s": "}\\" {"}, "n": null}, "qty": '), value, F.lit("}"))
    raw = (
        F.when(m == 0, F.concat(F.lit('text ['), good, F.lit(', {"name": "other", "more": {"a": 1},},] more')))
        .when(m == 1, F.concat(F.lit('```json\n['), good, F.lit(', {"name": broken, "a": {"b": }, {"name": "other", "qty": +1,234}]\n```')))
        .when(m == 2, F.concat(F.lit('[{"a": {"b" 1}}, '), good, F.lit(', {"name": "other"}, {"name": "cut]')))
        .otherwise(F.concat(F.lit('[{bad}, '), good, F.lit("]")))
    )
    rows = F.filter(records.objects(raw), lambda o: F.try_element_at(o, F.lit("name")).isNotNull())
    found = table(spark, sf, "events").select("event_id", F.when(value != "", rows).otherwise(F.array().cast("array<map<string,string>>")).alias("r"))
    own = F.get(F.filter("r", lambda o: F.startswith(F.try_element_at(o, F.lit("name")), F.lit("part "))), F.lit(0))
    return found.select("event_id", F.size("r").cast("long").alias("n"), N.parse_number(own["qty"]).alias("qty"), own["name"].alias("name"))


@query("""
SELECT 'charged' AS rule, count(*) AS checked, count(*) FILTER (NOT (l_extendedprice > 0)) AS broken, min(l_orderkey) FILTER (NOT (l_extendedprice > 0)) AS first FROM lineitem
UNION ALL SELECT 'discount below tax', count(*), count(*) FILTER (NOT (l_discount <= l_tax)), min(l_orderkey) FILTER (NOT (l_discount <= l_tax)) FROM lineitem
UNION ALL SELECT 'whole quantity', count(*), count(*) FILTER (NOT (l_quantity = floor(l_quantity))), min(l_orderkey) FILTER (NOT (l_quantity = floor(l_quantity))) FROM lineitem
UNION ALL SELECT 'returned lines are dear', count(*) FILTER (l_returnflag = 'R'), count(*) FILTER (l_returnflag = 'R' AND NOT l_extendedprice > 1000),
  min(l_orderkey) FILTER (l_returnflag = 'R' AND NOT l_extendedprice > 1000) FROM lineitem
""")
def invariants(spark, sf):
    """What must hold of every line, and how often it does not."""
    rules = {
        "charged": F.col("l_extendedprice") > 0,
        "discount below tax": F.col("l_discount") <= F.col("l_tax"),
        "whole quantity": F.col("l_quantity") == F.floor("l_quantity"),
        "returned lines are dear": F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice") > 1000),
    }
    return compare.invariants(table(spark, sf, "lineitem"), rules, "l_orderkey")


@query("""
SELECT o_orderkey, round(o_totalprice, 2) AS before, round(CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 10 ELSE o_totalprice END, 2) AS after FROM orders
UNION ALL SELECT -o_orderkey - 1, NULL, round(o_totalprice, 2) FROM orders WHERE o_orderkey % 11 = 0
""")
def stream_correction(spark, sf):
    """Orders as of two versions: as they came, and after a batch of corrections, stale repeats and new orders."""
    folder = scratch_folder(spark, "corrections")
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    feed = lambda df: df.write.mode("append").parquet(f"{folder}/in")
    run = lambda: jobs.corrected(spark.readStream.schema("o_orderkey long, price double, at long").parquet(f"{folder}/in"), ["o_orderkey"], "at", f"{folder}/table")
    feed(orders.select("o_orderkey", "price", F.lit(10).cast("long").alias("at")))
    run()
    late = orders.where("o_orderkey % 7 = 0").select("o_orderkey", (F.col("price") + 10).alias("price"), F.lit(20).cast("long").alias("at"))
    stale = orders.where("o_orderkey % 5 = 0").select("o_orderkey", (F.col("price") - 99).alias("price"), F.lit(5).cast("long").alias("at"))
    new = orders.where("o_orderkey % 11 = 0").select((-F.col("o_orderkey") - 1).alias("o_orderkey"), "price", F.lit(20).cast("long").alias("at"))
    feed(late.unionByName(stale).unionByName(new))
    run()
    before, after = (jobs.version(spark, f"{folder}/table", n).select("o_orderkey", F.round("price", 2).alias(name)) for n, name in ((0, "before"), (1, "after")))
    return after.join(before, "o_orderkey", "left").select("o_orderkey", "before", "after")


@query("""
WITH g AS (SELECT user_id, epoch_us(ts) AS t, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 1800 * 1000000::BIGINT AS late FROM events),
s AS (SELECT user_id, t, count(*) FILTER (late) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM g),
l AS (SELECT user_id, max(s) AS expired FROM s GROUP BY user_id)
SELECT s.user_id, min(t) AS started, max(t) AS last, count(*) AS n, expired FROM s JOIN l ON l.user_id = s.user_id AND s.s = expired GROUP BY s.user_id, expired
""")
def stream_ttl(spark, sf):
    """Every user's running job, whose state is gone half an hour after its last event, over a stream."""
    rows = _run(spark, jobs.expiring(_stream(spark, sf, "events"), "user_id", "ts", 1800), "ttl", "update")
    return rows.groupBy("user_id").agg(F.max_by(F.struct("started", "last", "n", "expired"), F.struct("expired", "n", "last")).alias("r")).select("user_id", "r.*")
