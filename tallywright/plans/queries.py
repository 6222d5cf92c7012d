"""Queries over the driver's tables, one per operator, each over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywright.functions import numbers as N
from tallywright.functions import text as S
from tallywright.functions import vocabulary as V
from tallywright.operators import asof, compare, matching, merge, sequences, totals
from tallywright.plans import currency, enrich
from tallywright.sources import connectors, records
from tallywright.sources.tables import table
from tallywright.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if SQL can express it."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _events(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    return table(spark, sf, "events").where(F.col("event_type") == kind)


# As-of ---------------------------------------------------------------------------------------


@query("""
SELECT p.event_id, p.user_id, round(v.value, 6) AS view_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts
""")
def asof_last_value(spark, sf):
    """Every purchase with the value of the user's last view."""
    views = _events(spark, sf, "view").select("user_id", "ts", F.col("value").alias("view_value"))
    out = asof.asof_join(_events(spark, sf, "purchase").select("event_id", "user_id", "ts"), views, ["user_id"], "ts", ["view_value"])
    return out.select("event_id", "user_id", F.round("view_value", 6).alias("view_value"))


_CLOSES = "c AS (SELECT event_type, ts::DATE AS day, max_by(value, ts) AS value FROM events GROUP BY ALL)"


@query(f"""
WITH {_CLOSES},
e AS (SELECT event_id, event_type, (ts::DATE - CASE WHEN hour(ts) + minute(ts) / 60.0 + second(ts) / 3600.0 < 20 THEN 1 ELSE 0 END) AS day FROM events)
SELECT e.event_id, e.day::DATE AS day, round(c.value, 6) AS close
FROM e ASOF LEFT JOIN c ON e.event_type = c.event_type AND e.day >= c.day
""")
def asof_session_close(spark, sf):
    """Every event with the close of its type's last finished session."""
    events = table(spark, sf, "events")
    bars = events.select("event_type", "ts", F.col("value").alias("close"))
    out = asof.asof_session(events.select("event_id", "event_type", "ts"), bars, ["event_type"], "ts", "close", V.SESSIONS["USD"][1])
    return out.select("event_id", "day", F.round("close", 6).alias("close"))


@query(f"""
WITH {_CLOSES},
p AS (SELECT *, hour(ts) + minute(ts) / 60.0 + second(ts) / 3600.0 AS h FROM events WHERE event_type = 'purchase'),
s AS (SELECT p.event_id, p.ts, p.h, (p.ts::DATE - CASE WHEN h < 20 THEN 1 ELSE 0 END)::DATE AS day, v.value AS spot
      FROM p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts),
d AS (SELECT user_id, ts::DATE AS day, max_by(value, ts) AS value FROM events WHERE event_type = 'view' GROUP BY ALL),
j AS (SELECT s.*, p.user_id FROM s JOIN p USING (event_id))
SELECT j.event_id,
       round(CASE WHEN h >= 13.5 AND h < 20 AND spot IS NOT NULL THEN spot ELSE d.value END, 6) AS price,
       CASE WHEN h >= 13.5 AND h < 20 AND spot IS NOT NULL THEN 'intraday' WHEN d.value IS NOT NULL THEN 'session-close' END AS price_src
FROM j ASOF LEFT JOIN d ON j.user_id = d.user_id AND j.day >= d.day
""")
def asof_ladder(spark, sf):
    """Every purchase priced by the last view inside the session, else by the session's close."""
    bars = _events(spark, sf, "view").select("user_id", "ts", F.col("value").alias("price"))
    out = asof.asof_ladder(_events(spark, sf, "purchase").select("event_id", "user_id", "ts"), bars, ["user_id"], "ts", "price", *V.SESSIONS["USD"])
    return out.select("event_id", F.round("price", 6).alias("price"), "price_src")


@query("""
SELECT p.event_id,
       round(least(coalesce(epoch(p.ts) - epoch(b.ts), 1e18), coalesce(epoch(a.ts) - epoch(p.ts), 1e18)), 3) AS seconds,
       CASE WHEN coalesce(epoch(p.ts) - epoch(b.ts), 1e18) <= coalesce(epoch(a.ts) - epoch(p.ts), 1e18) THEN b.event_id ELSE a.event_id END AS signup
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') b ON p.user_id = b.user_id AND p.ts >= b.ts
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') a ON p.user_id = a.user_id AND p.ts <= a.ts
WHERE least(coalesce(epoch(p.ts) - epoch(b.ts), 1e18), coalesce(epoch(a.ts) - epoch(p.ts), 1e18)) <= 864000
""")
def nearest_label(spark, sf):
    """Every purchase with the user's signup nearest in time, ten days away at most."""
    second = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    left = _events(spark, sf, "purchase").select("event_id", "user_id", second.alias("at"))
    right = _events(spark, sf, "signup").select("user_id", second.alias("at"), F.col("event_id").alias("signup"))
    out = asof.nearest_join(left, right, ["user_id"], "at", "signup", 864_000.0)
    return out.where("signup is not null").select("event_id", F.round("distance", 3).alias("seconds"), "signup")


@query("""
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS)
       OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS user_length
FROM conversations
""")
def carry_forward(spark, sf):
    """Every turn with the length of the last user text so far."""
    turns = table(spark, sf, "conversations")
    value = F.when(F.col("role") == "user", F.length("text").cast("long"))
    return asof.carried_forward(turns, ["conv_id"], ["turn"], value, "user_length").select("conv_id", "turn", "user_length")


@query("""
WITH l AS (SELECT user_id, max(ts) AS ts, max_by(value, ts) AS value FROM events GROUP BY user_id), n AS (SELECT max(ts) AS now FROM events)
SELECT user_id, round(value, 6) AS value, (now - ts > INTERVAL 4 DAY) AS stale FROM l, n
""")
def stale_flag(spark, sf):
    """Every user's newest value, and whether it is more than four days older than the newest of all."""
    events = table(spark, sf, "events")
    now = events.agg(F.max("ts").alias("now"))  # one row
    out = jobs.latest(events, "user_id", "ts", "value").crossJoin(F.broadcast(now))
    return out.select("user_id", F.round("value", 6).alias("value"), (F.col("ts") < F.col("now") - F.expr(f"interval {V.STALE_DAYS} days")).alias("stale"))


# Quantities and prices -----------------------------------------------------------------------


def _priced_lines(spark, sf) -> DataFrame:
    """Lines with their part's price. Parts grow with the data; the join is left to Spark's estimate."""
    return table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice / p_retailprice AS q FROM lineitem JOIN part ON l_partkey = p_partkey),
t AS (SELECT *, round_even(q, 0) AS n, round_even(abs(q - round_even(q, 0)), 3) AS resid FROM r)
SELECT l_orderkey, l_linenumber, CASE WHEN n > 0 AND resid < 1.0/3 THEN n END AS qty, CASE WHEN n > 0 AND resid < 1.0/3 THEN resid END AS resid,
       CASE WHEN n > 0 AND resid < 0.10 THEN 'high' WHEN n > 0 AND resid < 1.0/3 THEN 'estimated' END AS confidence
FROM t
""")
def qty_residual_tier(spark, sf):
    """Quantity of every line from its amount and the part's price, with its confidence."""
    tier = N.residual_tier(F.col("l_extendedprice"), F.col("p_retailprice"))
    return _priced_lines(spark, sf).select("l_orderkey", "l_linenumber", tier.alias("t")).select("l_orderkey", "l_linenumber", "t.*")


@query("""
SELECT l_orderkey, l_linenumber,
       coalesce(abs(l_quantity - l_extendedprice / p_retailprice) / greatest(l_extendedprice / p_retailprice, 1.0) <= 0.35, false) AS fits
FROM lineitem JOIN part ON l_partkey = p_partkey
""")
def qty_gross_gate(spark, sf):
    """Whether every line's quantity is near what amount and price suggest."""
    fits = N.gross_fits(F.col("l_quantity"), F.try_divide("l_extendedprice", "p_retailprice"))
    return _priced_lines(spark, sf).select("l_orderkey", "l_linenumber", F.coalesce(fits, F.lit(False)).alias("fits"))


@query("""
WITH f AS (SELECT l_partkey, min_by(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_extendedprice)) AS unit FROM lineitem GROUP BY l_partkey)
SELECT l_orderkey, l_linenumber, round(unit, 6) AS unit FROM lineitem JOIN f USING (l_partkey)
""")
def unit_price_transfer(spark, sf):
    """Every line with the unit price of the first line of its part."""
    lines = table(spark, sf, "lineitem")
    unit = F.try_divide("l_extendedprice", "l_quantity")
    out = matching.transfer_first(lines, "l_partkey", ["l_orderkey", "l_linenumber", "l_extendedprice"], unit, "unit")
    return out.select("l_orderkey", "l_linenumber", F.round("unit", 6).alias("unit"))


@query("""
WITH b AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS value,
                  CASE WHEN l_orderkey % 5 = 0 THEN NULL WHEN l_orderkey % 7 = 0 THEN l_extendedprice * 0.5 ELSE l_extendedprice * (1 - l_discount) END AS cost,
                  l_extendedprice * l_discount AS pnl FROM lineitem),
w AS (SELECT *, coalesce(cost < 0 OR abs(cost - pnl) < 1, false) AS was FROM b),
k AS (SELECT *, CASE WHEN was OR coalesce(abs(value - cost - pnl) > greatest(1.0, abs(value) * 0.001), false) THEN NULL ELSE cost END AS kept FROM w)
SELECT CASE WHEN kept IS NOT NULL THEN 'screen' ELSE 'computed:value-pnl' END AS cost_src, count(*) AS n,
       round(sum(coalesce(kept, round_even(value - pnl, 2))), 0) AS cost
FROM k GROUP BY ALL
""")
def accounting_identity(spark, sf):
    """Costs of lines, some missing or wrong, repaired by value - cost = pnl."""
    value, pnl = F.col("l_extendedprice"), F.col("l_extendedprice") * F.col("l_discount")
    cost = F.when(F.col("l_orderkey") % 5 == 0, F.lit(None)).when(F.col("l_orderkey") % 7 == 0, value * 0.5).otherwise(value * (1 - F.col("l_discount")))
    fixed = table(spark, sf, "lineitem").select(N.repaired_cost(value, cost, pnl).alias("c")).select("c.*")
    return fixed.groupBy("cost_src").agg(F.count("*").alias("n"), F.round(F.sum("cost"), 0).alias("cost"))


@query("""
WITH r AS (SELECT avg(s_acctbal) AS fx FROM supplier) SELECT s_suppkey, round(s_acctbal * fx, 2) AS converted FROM supplier, r
""")
def fx_broadcast(spark, sf):
    """Every balance at one rate that is itself a query of one row."""
    rate = table(spark, sf, "supplier").agg(F.avg("s_acctbal").alias("fx"))
    return table(spark, sf, "supplier").crossJoin(F.broadcast(rate)).select("s_suppkey", F.round(F.col("s_acctbal") * F.col("fx"), 2).alias("converted"))


def _holdings(spark, sf) -> DataFrame:
    """Lines as holdings: some without quantity, some with a wrong one."""
    qty = F.when(F.col("l_orderkey") % 3 == 0, F.lit(None)).when(F.col("l_orderkey") % 11 == 0, F.col("l_quantity") * 9).otherwise(F.col("l_quantity"))
    return _priced_lines(spark, sf).select(
        "l_orderkey",
        "l_linenumber",
        F.struct("l_orderkey", "l_linenumber", "l_extendedprice").alias("pos"),
        F.col("p_name").alias("name"),
        F.lit("").alias("assetClass"),
        F.lit(None).cast("string").alias("currency"),
        qty.alias("qty"),
        F.lit(None).cast("double").alias("price"),
        F.col("l_extendedprice").alias("value"),
        F.lit(None).cast("double").alias("cost"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("pnl"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("symbol"),
        F.when(F.col("l_partkey") % 4 == 0, "US").otherwise("KR").alias("market"),
        F.col("p_retailprice").alias("close"),
    )


@query()
def holdings_enriched(spark, sf):
    """All stages of enrichment over lines as holdings: counts by the sources of quantity and price."""
    out = enrich.enriched(_holdings(spark, sf), 1350.0, "2024-01-02")
    return out.groupBy(S.source_kind(F.col("qty_src")).alias("qty_src"), "price_src", "confidence", "currency", "qty_note").agg(F.count("*").alias("n"))


@query("""
WITH h AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS value, CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_partkey END AS symbol,
                  CASE WHEN l_linenumber % 4 = 0 THEN 0 ELSE l_quantity END AS qty FROM lineitem),
q AS (SELECT p_partkey AS symbol, p_retailprice AS price FROM part WHERE p_partkey % 5 <> 0)
SELECT l_orderkey, l_linenumber, round(CASE WHEN symbol IS NOT NULL AND qty <> 0 AND price IS NOT NULL THEN round_even(qty * price, 2) ELSE value END, 2) AS value,
       CASE WHEN symbol IS NULL THEN 'no symbol' WHEN qty = 0 THEN 'no quantity' WHEN price IS NULL THEN 'no price' END AS reprice_note
FROM h LEFT JOIN q USING (symbol)
""")
def reprice_notes(spark, sf):
    """Lines revalued at quotes that some parts lack, with the reason where they are not."""
    holdings = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_extendedprice").alias("value"),
        F.when(F.col("l_partkey") % 9 != 0, F.col("l_partkey")).alias("symbol"),
        F.when(F.col("l_linenumber") % 4 == 0, 0.0).otherwise(F.col("l_quantity")).alias("qty"),
    )
    quotes = table(spark, sf, "part").where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("symbol"), F.col("p_retailprice").alias("price"))
    return enrich.repriced(holdings, quotes).select("l_orderkey", "l_linenumber", F.round("value", 2).alias("value"), "reprice_note")


# Totals --------------------------------------------------------------------------------------


@query("""
SELECT l_orderkey, l_linenumber FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, round_even(l_extendedprice / 1000, 0) ORDER BY l_linenumber, l_extendedprice) AS n FROM lineitem) WHERE n = 1
""")
def value_dedupe(spark, sf):
    """The first line of every rounded amount within an order."""
    lines = table(spark, sf, "lineitem")
    return totals.first_per_value(lines, ["l_orderkey"], F.bround(F.col("l_extendedprice") / 1000, 0), ["l_linenumber", "l_extendedprice"]).select("l_orderkey", "l_linenumber")


@query("""
WITH a AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS v FROM lineitem
           UNION ALL SELECT l_orderkey, 0, round(sum(l_extendedprice), 2) FROM lineitem GROUP BY l_orderkey),
m AS (SELECT *, coalesce(v <> 0 AND count(*) OVER g >= 2 AND abs(sum(v) OVER g - v - v) / v <= 0.02, false) AS total FROM a WINDOW g AS (PARTITION BY l_orderkey)),
k AS (SELECT *, count(*) FILTER (NOT total) OVER (PARTITION BY l_orderkey) AS stay FROM m)
SELECT l_orderkey, l_linenumber, round(v, 2) AS v FROM k WHERE NOT total OR stay = 0
""")
def total_row_drop(spark, sf):
    """Lines and their sums as further lines, without those that are the sum of the rest."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("v"))
    sums = lines.groupBy("l_orderkey").agg(F.lit(0).alias("l_linenumber"), F.round(F.sum("v"), 2).alias("v"))
    return totals.without_total_rows(lines.unionByName(sums), ["l_orderkey"], "v").select("l_orderkey", "l_linenumber", F.round("v", 2).alias("v"))


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS v0, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice) AS k FROM lineitem),
r AS (SELECT l_orderkey, l_linenumber, k, v0, CASE WHEN k = 1 AND l_orderkey % 10 = 0 THEN v0 * 10 ELSE v0 END AS v FROM l),
s AS (SELECT l_orderkey, sum(v) AS s, sum(v0) AS t FROM r GROUP BY l_orderkey),
c AS (SELECT r.l_orderkey, r.k, f FROM r JOIN s USING (l_orderkey), (VALUES (0.1::DOUBLE), (0.01::DOUBLE), (10.0::DOUBLE), (100.0::DOUBLE)) x(f)
      WHERE s <> 0 AND abs(t - s) > 0.01 * abs(t) AND v <> 0 AND abs(s - v + v * f - t) <= 0.001 * abs(t)),
o AS (SELECT l_orderkey, any_value(k) AS k, any_value(f) AS f FROM c GROUP BY l_orderkey HAVING count(*) = 1)
SELECT r.l_orderkey, r.l_linenumber, round(CASE WHEN f IS NOT NULL THEN round_even(v * f, 2) ELSE v END, 2) AS v, f AS slip
FROM r LEFT JOIN o USING (l_orderkey, k)
""")
def digit_slip_repair(spark, sf):
    """Lines of which every tenth order's first is ten times too large, put right by the order's total."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("v0"), F.row_number().over(w).alias("k"))
    slipped = lines.withColumn("v", F.when((F.col("k") == 1) & (F.col("l_orderkey") % 10 == 0), F.col("v0") * 10).otherwise(F.col("v0")))
    sums = lines.groupBy("l_orderkey").agg(F.sum("v0").alias("total"))
    return totals.repaired_slips(slipped, sums, "l_orderkey", "k", "v").select("l_orderkey", "l_linenumber", F.round("v", 2).alias("v"), "slip")


@query("""
WITH ids AS (SELECT unnest(range(0, (SELECT max(conv_id) + 2 FROM conversations))) AS conv_id),
t AS (SELECT conv_id, list_sort(list_distinct(regexp_extract_all(text, '\\d+'))) AS tokens, role = 'system' AS c FROM conversations),
g AS (SELECT conv_id, count(*) AS n, count(*) FILTER (c) AS c, count(*) FILTER (len(tokens) > 0) AS w, count(DISTINCT CASE WHEN len(tokens) > 0 THEN tokens END) AS s FROM t GROUP BY conv_id)
SELECT conv_id, CASE WHEN n IS NULL THEN 'empty' WHEN c >= greatest(2.0, n / 2.0) THEN 'product_summary'
                     WHEN n >= 2 AND w = n AND s = n THEN 'account_summary' ELSE 'detail' END AS class
FROM ids LEFT JOIN g USING (conv_id)
""")
def screen_classify(spark, sf):
    """Every conversation number up to the last, and one more that is empty, by the kinds of its turns."""
    turns = table(spark, sf, "conversations")
    last = spark.range((turns.agg(F.max("conv_id")).first()[0] or 0) + 2).withColumnRenamed("id", "conv_id")
    tokens = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\d+"), F.lit(0))))
    return totals.classified(last, turns.withColumn("tokens", tokens), "conv_id", F.col("role") == "system", "tokens")


@query("""
WITH c AS (SELECT *, count(*) OVER g AS n, count(*) FILTER (role = 'user') OVER g AS u, count(*) FILTER (role = 'assistant') OVER g AS a FROM conversations WINDOW g AS (PARTITION BY conv_id))
SELECT conv_id, turn FROM c
WHERE CASE WHEN u >= 2 AND 2 * u >= n THEN role = 'user' WHEN a >= 2 AND 2 * a >= n THEN role = 'assistant' ELSE true END
""")
def coherence(spark, sf):
    """Turns of the role that has the majority of a conversation."""
    turns = table(spark, sf, "conversations")
    return totals.coherent(turns, ["conv_id"], F.col("role") == "user", F.col("role") == "assistant").select("conv_id", "turn")


@query()
def greedy_total_match(spark, sf):
    """Per region, sums of nations' balances against totals that are slightly off, one to one."""
    by_nation = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.sum("s_acctbal").alias("amount"))
    sums = table(spark, sf, "nation").join(by_nation, "n_nationkey").select("n_regionkey", F.col("n_nationkey").cast("long").alias("pos"), "amount")
    off = sums.select("n_regionkey", F.col("pos").alias("total_pos"), (F.col("amount") * (1 + (F.col("pos") % 4) / 100.0)).alias("total"))
    return matching.greedy_match(sums, off, "n_regionkey").withColumns({c: F.round(c, 2) for c in ("amount", "total")})


# Matching ------------------------------------------------------------------------------------


@query("""
WITH d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{10,}'))) AS t FROM documents),
b AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{10,}'))) AS t FROM benchmark),
j AS (SELECT doc_id, item_id, count(*) AS overlap FROM d JOIN b USING (t) GROUP BY ALL)
SELECT doc_id, item_id, overlap FROM j QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY overlap DESC, item_id) = 1
""")
def best_overlap(spark, sf):
    """The benchmark item that shares most long words with a document."""
    tokens = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{10,}"), F.lit(0))
    docs = table(spark, sf, "documents").select("doc_id", tokens.alias("t"))
    items = table(spark, sf, "benchmark").select("item_id", tokens.alias("t"))
    return matching.best_overlap(docs, items, "doc_id", "item_id", "t")


@query("""
WITH n AS (SELECT s_nationkey, avg(s_acctbal) AS m FROM supplier GROUP BY ALL),
h AS (SELECT s.s_suppkey, n.s_nationkey AS owner FROM supplier s JOIN n ON n.m <> 0 AND s.s_acctbal <> 0 AND abs(s.s_acctbal - n.m) / abs(n.m) <= 0.02)
SELECT s_suppkey, CASE WHEN count(DISTINCT owner) = 1 THEN any_value(owner) END AS owner FROM supplier LEFT JOIN h USING (s_suppkey) GROUP BY s_suppkey
""")
def band_owner(spark, sf):
    """The one nation whose average balance is within 2 % of a supplier's."""
    suppliers = table(spark, sf, "supplier")
    means = suppliers.groupBy(F.col("s_nationkey").alias("owner")).agg(F.avg("s_acctbal").alias("m"))
    return matching.unique_in_band(suppliers.select("s_suppkey", "s_acctbal"), means, [], "s_acctbal", "m", "owner", V.OWNER_BAND).select("s_suppkey", "owner")


@query("""
WITH k AS (SELECT o_custkey, round(o_totalprice, -3) AS amount, any_value(o_orderpriority) AS p FROM orders GROUP BY ALL HAVING count(*) = 1)
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN k.p ELSE o.o_orderpriority END AS priority
FROM orders o LEFT JOIN k ON o.o_custkey = k.o_custkey AND round(o.o_totalprice, -3) = k.amount
""")
def unique_fill_join(spark, sf):
    """Priorities of every third order, taken away, filled from the order of the same customer and amount if it is unique."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.round("o_totalprice", -3).alias("amount"), F.col("o_orderpriority").alias("priority"))
    gaps = orders.withColumn("priority", F.when(F.col("o_orderkey") % 3 != 0, F.col("priority")))
    return matching.fill_from_unique(gaps, orders, ["o_custkey", "amount"], ["priority"]).select("o_orderkey", "priority")


_CODE = "translate(lpad(c_custkey::VARCHAR, greatest(4, length(c_custkey::VARCHAR))::INTEGER, '0'), '0123456789', 'VWUYOQSBEF')"


@query(f"""
WITH c AS (SELECT c_custkey, {_CODE} AS code, c_acctbal AS close FROM customer),
r AS (SELECT c_custkey, close * 1.05 AS seen, left(code, -1) || translate(right(code, 1), 'VWUY', 'WUYV') AS token FROM c),
g(cls) AS (VALUES ('VWUY'), ('Il1T'), ('O0DQ'), ('S5'), ('B8'), ('G6C'), ('Z2'), ('PR'), ('EF'), ('MN'), ('XK')),
i AS (SELECT c_custkey, seen, token, unnest(range(1, length(token) + 1)) AS i FROM r WHERE length(token) <= 6),
v AS (SELECT c_custkey, seen, token AS symbol FROM r
      UNION SELECT c_custkey, seen, left(token, i - 1) || ch || substr(token, i + 1)
            FROM (SELECT i.*, unnest(string_split(cls, '')) AS ch FROM i JOIN g ON contains(cls, substr(token, i, 1)))
      UNION SELECT c_custkey, seen, left(token, i - 1) || substr(token, i + 1) FROM i JOIN g ON i > 1 AND contains(cls, substr(token, i, 1)) AND contains(cls, substr(token, i - 1, 1))
      UNION SELECT c_custkey, seen, left(token, i) || substr(token, i) FROM i WHERE contains('VWIl1', substr(token, i, 1))),
h AS (SELECT v.c_custkey, count(*) AS n, min(symbol) AS symbol FROM v JOIN c ON c.code = v.symbol AND abs(seen - close) <= 0.10 * abs(close) GROUP BY ALL)
SELECT c_custkey, CASE WHEN n = 1 THEN symbol END AS symbol, coalesce(n, 0) AS n FROM r LEFT JOIN h USING (c_custkey)
""")
def symbol_arbitration(spark, sf):
    """Codes of customers with a misread last glyph, settled by the balance."""
    number = F.col("c_custkey").cast("string")
    code = F.translate(F.lpad(number, F.greatest(F.lit(4), F.length(number)), F.lit("0")), "0123456789", "VWUYOQSBEF")
    customers = table(spark, sf, "customer").select("c_custkey", code.alias("symbol"), F.col("c_acctbal").alias("close"))
    last = F.translate(F.right("symbol", F.lit(1)), "VWUY", "WUYV")
    rows = customers.select("c_custkey", (F.col("close") * 1.05).alias("seen"), F.concat(F.expr("left(symbol, length(symbol) - 1)"), last).alias("token"))
    return matching.arbitrate(rows, customers.select("symbol", "close"), "c_custkey", "token", "seen", "close")


@query("""
WITH f AS (SELECT split_part(p_type, ' ', 1) AS word, min(p_type) AS full FROM part GROUP BY ALL), e AS (SELECT DISTINCT p_type FROM part WHERE p_partkey % 2 = 0)
SELECT p_partkey, coalesce(e.p_type, f.full) AS found, CASE WHEN e.p_type IS NOT NULL THEN 'exact' WHEN f.full IS NOT NULL THEN 'prefix' END AS rung
FROM part LEFT JOIN e ON part.p_type = e.p_type LEFT JOIN f ON split_part(part.p_type, ' ', 1) = f.word
""")
def name_lookup_ladder(spark, sf):
    """Types looked up exactly, and by their first word where that fails."""
    parts = table(spark, sf, "part").select("p_partkey", "p_type", F.split_part("p_type", F.lit(" "), F.lit(1)).alias("word"))
    exact = parts.where("p_partkey % 2 = 0").select("p_type").distinct().withColumn("exact", F.col("p_type"))
    prefix = parts.groupBy("word").agg(F.min("p_type").alias("prefix"))
    out = parts.join(exact, "p_type", "left").join(prefix, "word", "left")
    return out.select("p_partkey", F.coalesce("exact", "prefix").alias("found"), F.when(F.col("exact").isNotNull(), "exact").when(F.col("prefix").isNotNull(), "prefix").alias("rung"))


@query("""
WITH b AS (SELECT DISTINCT p_brand AS symbol FROM part WHERE p_partkey % 3 = 0), f AS (SELECT p_brand AS symbol, min(p_partkey) AS k FROM part GROUP BY ALL)
SELECT symbol, 'kept' AS name FROM b UNION ALL SELECT symbol, k::VARCHAR FROM f WHERE symbol NOT IN (SELECT symbol FROM b)
""")
def watchlist_upsert(spark, sf):
    """Brands on a list, and those not yet on it under the first part's number."""
    parts = table(spark, sf, "part")
    base = parts.where("p_partkey % 3 = 0").select(F.col("p_brand").alias("symbol")).distinct().withColumn("name", F.lit("kept"))
    fresh = parts.select(F.col("p_brand").alias("symbol"), F.col("p_partkey").cast("string").alias("name"), "p_partkey")
    return matching.anti_append(base, fresh, "symbol", "p_partkey")


@query("""
SELECT s_name AS symbol, CASE WHEN s_acctbal >= 0 THEN round(s_acctbal, 2) END AS price, CASE WHEN s_acctbal < 0 THEN 'negative' END AS error FROM supplier
""")
def quotes_map(spark, sf):
    """A snapshot of quotes with maps of prices and errors, as rows again."""
    quotes = table(spark, sf, "supplier").select(
        F.col("s_name").alias("symbol"),
        F.round("s_acctbal", 2).alias("price"),
        *[F.lit(None).cast("string").alias(c) for c in ("currency", "name", "marketTime")],
        F.lit(False).alias("stale"),
        F.when(F.col("s_acctbal") < 0, "negative").alias("error"),
        (F.col("s_suppkey") % 100).alias("part"),
    )
    # One snapshot per hundredth, as one list is one owner's.
    parts = quotes.groupBy("part").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("error").isNull(), F.struct("symbol", "price")))).alias("prices"),
        F.map_from_entries(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("symbol", "error")))).alias("errors"),
    )
    good = parts.select(F.explode("prices").alias("symbol", "price")).withColumn("error", F.lit(None).cast("string"))
    bad = parts.select(F.explode("errors").alias("symbol", "error")).select("symbol", F.lit(None).cast("double").alias("price"), "error")
    return good.unionByName(bad)


@query()
def name_similarity(spark, sf):
    """How much of every part's name its type holds, by matching blocks."""
    pairs = table(spark, sf, "part").select("p_partkey", S.evidence_key(F.col("p_name")).alias("name"), S.evidence_key(F.col("p_type")).alias("evidence"))
    return matching.similar_names(pairs, "name", "evidence").select("p_partkey", F.round("similarity", 6).alias("similarity"))


@query("""
WITH a AS (SELECT c_custkey, 1 AS o, c_name, NULL::DOUBLE AS bal, c_mktsegment AS seg, c_nationkey AS nat FROM customer
           UNION ALL SELECT c_custkey, 2, c_name, c_acctbal * CASE WHEN c_custkey % 10 = 0 THEN 1.1 ELSE 1 END, NULL, c_nationkey FROM customer
           UNION ALL SELECT c_custkey, 3, c_name, c_acctbal, c_mktsegment, NULL FROM customer WHERE c_custkey % 4 = 0)
SELECT c_custkey, round(min_by(bal, o) FILTER (bal IS NOT NULL), 4) AS bal, min_by(seg, o) FILTER (seg IS NOT NULL) AS seg,
       min_by(nat, o) FILTER (nat IS NOT NULL) AS nat, count(*) AS captures FROM a GROUP BY c_custkey
""")
def survivorship_merge(spark, sf):
    """Three partial captures of customers merged without losing a field."""
    c = table(spark, sf, "customer")
    field = lambda o, bal, seg, nat: c.select("c_custkey", F.lit(o).alias("o"), bal.cast("double").alias("bal"), seg.cast("string").alias("seg"), nat.cast("int").alias("nat"))
    none = F.lit(None)
    more = F.col("c_acctbal") * F.when(F.col("c_custkey") % 10 == 0, 1.1).otherwise(1.0)
    rows = field(1, none, F.col("c_mktsegment"), F.col("c_nationkey")).union(field(2, more, none, F.col("c_nationkey")))
    rows = rows.union(field(3, F.col("c_acctbal"), F.col("c_mktsegment"), none).where("c_custkey % 4 = 0"))
    out = merge.survivors(rows, ["c_custkey"], ["bal", "seg", "nat"], ["o"], "nat")
    return out.select("c_custkey", F.round("bal", 4).alias("bal"), "seg", "nat", "captures")


# Text ----------------------------------------------------------------------------------------


@query("""
SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS text_md5
FROM pages
""")
def html_text(spark, sf):
    """Digest of every page's text."""
    return table(spark, sf, "pages").select("page_id", F.md5(S.html_text(F.col("html"))).alias("text_md5"))


@query("""
SELECT page_id, TRY_CAST(nullif(regexp_replace(url, '[^0-9.\\-]', '', 'g'), '') AS DOUBLE) AS parsed,
       TRY_CAST(regexp_extract(url, '/(\\d+)', 1) AS DOUBLE) AS number FROM pages
""")
def number_parse(spark, sf):
    """Numbers in the addresses of pages: all digits together, and the first after a slash."""
    return table(spark, sf, "pages").select("page_id", N.parse_number(F.col("url")).alias("parsed"), F.regexp_extract("url", r"/(\d+)", 1).try_cast("double").alias("number"))


@query("""
SELECT event_id, TRY_CAST(regexp_extract(props, ':\\s*(-?\\d+)', 1) AS DOUBLE) AS value FROM events
""")
def json_salvage(spark, sf):
    """The number in every event's properties, out of JSON broken in four ways."""
    value = F.regexp_extract("props", r":\s*(-?\d+)", 1)
    k = F.col("event_id") % 4
    raw = (
        F.when(k == 0, F.concat(F.lit('```json\n[{"qty": '), value, F.lit("},]\n```")))
        .when(k == 1, F.concat(F.lit('here: [{"name": "x", bad}, {"qty": +'), value, F.lit("}] done")))
        .when(k == 2, F.concat(F.lit('[["b","t","n","a","c",'), value, F.lit(",1,2,3,4,5], [1]]")))
        .otherwise(F.concat(F.lit('[{"qty": '), value, F.lit("}]")))
    )
    return table(spark, sf, "events").select("event_id", records.rows(raw).alias("r")).select("event_id", F.try_element_at("r", F.lit(1))["qty"].alias("value"))


@query("""
SELECT doc_id, md5(lower(regexp_replace(text, '[\\s·\\-_.,()]', '', 'g'))) AS squashed, md5(lower(regexp_replace(text, '[\\s\\[\\]()·\\-_.,:/]', '', 'g'))) AS evidence FROM documents
""")
def text_normalize(spark, sf):
    """Digests of every document's normal forms."""
    return table(spark, sf, "documents").select("doc_id", F.md5(S.squashed(F.col("text"))).alias("squashed"), F.md5(S.evidence_key(F.col("text"))).alias("evidence"))


@query("""
WITH r AS (SELECT doc_id, list_filter(regexp_extract_all(text, '[가-힣]+|[A-Za-z][A-Za-z0-9.&]*'), lambda x: length(x) > 1) AS runs FROM documents)
SELECT doc_id, len(runs)::BIGINT AS n, md5(array_to_string(runs, '|')) AS digest FROM r
""")
def script_runs(spark, sf):
    """Number and digest of every document's script runs."""
    runs = table(spark, sf, "documents").select("doc_id", S.script_runs(F.col("text")).alias("r"))
    return runs.select("doc_id", F.size("r").cast("long").alias("n"), F.md5(F.array_join("r", "|")).alias("digest"))


@query("""
SELECT page_id, contains(lower(regexp_replace(html, '[\\s\\[\\]()·\\-_.,:/]', '', 'g')), lower(regexp_replace(regexp_extract(url, '/([0-9]+)', 1), '[\\s\\[\\]()·\\-_.,:/]', '', 'g'))) AS held
FROM pages
""")
def evidence_contains(spark, sf):
    """Whether a page holds the number in its own address."""
    label = F.regexp_extract("url", r"/([0-9]+)", 1)
    held = F.contains(S.evidence_key(F.col("html")), S.evidence_key(label))
    return table(spark, sf, "pages").select("page_id", held.alias("held"))


@query("""
SELECT p_partkey, CASE WHEN contains(lower(p_type), 'brass') OR contains(lower(p_type), 'copper') THEN 'warm' WHEN contains(lower(p_type), 'steel') THEN 'hard'
                       WHEN contains(lower(p_type), 'plated') THEN 'plated' ELSE 'other' END AS class FROM part
""")
def keyword_class(spark, sf):
    """Parts by ordered words in their type."""
    rules = ((("BRASS", "COPPER"), "warm"), (("STEEL",), "hard"), (("PLATED",), "plated"))
    return table(spark, sf, "part").select("p_partkey", S.first_rule(F.col("p_type"), rules, "other", lower=True).alias("class"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), c AS (SELECT doc_id, line, count(*) AS n FROM l GROUP BY ALL)
SELECT doc_id, count(*) FILTER (n = 1) AS once, count(*) FILTER (n > 1) AS repeated FROM c GROUP BY doc_id
""")
def repeated_text(spark, sf):
    """Numbers of lines that occur once, and that repeat, in every document."""
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    counts = lines.groupBy("doc_id", "line").agg(F.count("*").alias("n"))
    return counts.groupBy("doc_id").agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") > 1).alias("repeated"))


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY md5(text)")
def doc_dedupe(spark, sf):
    """The first of every distinct document."""
    return merge.deduplicated(table(spark, sf, "documents"), "text", "doc_id")


# Sequences -----------------------------------------------------------------------------------


_GAPS = """
g AS (SELECT user_id, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
s AS (SELECT user_id, gap, lag(gap) OVER (PARTITION BY user_id ORDER BY gap) AS p, row_number() OVER (PARTITION BY user_id ORDER BY gap) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM g WHERE gap > 0),
t AS (SELECT user_id, count(*) AS n_gaps, min(CASE WHEN gap >= 1.8 * p AND n - k + 1 >= 0.25 * n THEN gap END) AS threshold FROM s GROUP BY user_id)
"""


def _seconds(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))


@query(f"WITH {_GAPS} SELECT user_id, n_gaps, round(threshold, 3) AS threshold FROM t")
def gap_split(spark, sf):
    """The gap that parts the short from the long gaps of every user."""
    return sequences.gap_split(_seconds(spark, sf), "user_id", "at").select("user_id", "n_gaps", F.round("threshold", 3).alias("threshold"))


@query(f"""
WITH {_GAPS},
e AS (SELECT e.user_id, e.event_id, threshold, epoch(e.ts) - lag(epoch(e.ts)) OVER w AS gap, row_number() OVER w - 1 AS k
      FROM events e LEFT JOIN t USING (user_id) WINDOW w AS (PARTITION BY e.user_id ORDER BY e.ts, e.event_id))
SELECT event_id, (CASE WHEN threshold IS NULL THEN k // 4
       ELSE sum(CASE WHEN gap >= threshold THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY k) END)::BIGINT AS segment FROM e
""")
def gap_segments(spark, sf):
    """Events in segments parted by long gaps, or by fours where there are none."""
    events = _seconds(spark, sf)
    split = sequences.gap_split(events, "user_id", "at").select("user_id", "threshold")
    out = sequences.gap_segments(events.join(split, "user_id", "left"), "user_id", ["at", "event_id"], "at", F.col("threshold"), 4)
    return out.select("event_id", F.col("segment").cast("long").alias("segment"))


@query()
def running_mean_cluster(spark, sf):
    """Values of every user in clusters around running means."""
    out = sequences.mean_clusters(table(spark, sf, "events"), "user_id", "value", F.lit(5.0))
    return out.select("user_id", "cluster", F.round("center", 4).alias("center"), "n")


@query("""
WITH e AS (SELECT user_id, epoch(ts) AS s, epoch(ts) + 3600 * (1 + event_id % 3) AS f FROM events),
g AS (SELECT *, s - max(f) OVER (PARTITION BY user_id ORDER BY s, f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM e),
r AS (SELECT *, sum(CASE WHEN gap < -0.2 * 36000 OR gap > 36000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, f ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT user_id, run::BIGINT AS run, round(min(s), 3) AS first, round(max(f), 3) AS last, count(*) AS n FROM r GROUP BY user_id, run
""")
def phrase_merge(spark, sf):
    """Intervals of every user merged across small gaps."""
    events = _seconds(spark, sf).select("user_id", F.col("at").alias("first"), (F.col("at") + 3600 * (1 + F.col("event_id") % 3)).alias("last"))
    out = sequences.merged_runs(events, "user_id", "first", "last", F.lit(36_000.0))
    return out.select("user_id", "run", F.round("first", 3).alias("first"), F.round("last", 3).alias("last"), "n")


@query("""
SELECT conv_id, turn, (role = 'user' AND coalesce(min(CASE WHEN role = 'user' THEN turn END) OVER w < coalesce(min(CASE WHEN role = 'assistant' THEN turn END) OVER w, 2147483648), false)) AS separator
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
""")
def separator_exists(spark, sf):
    """User turns with another user turn before the next answer."""
    turns = table(spark, sf, "conversations")
    return sequences.between_exists(turns, "conv_id", "turn", F.col("role") == "user", F.col("role") == "assistant").select("conv_id", "turn", "separator")


# Comparison ----------------------------------------------------------------------------------


@query("""
WITH p AS (SELECT doc_id, (n_chars >= 200)::INT AS label FROM documents),
j AS (SELECT g.doc_id AS a, p.doc_id AS b, g.quality AS x, p.label AS y FROM labels g FULL JOIN p ON g.doc_id = p.doc_id)
SELECT count(a) AS golden, count(b) AS got, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND x = y) AS matched, count(*) FILTER (b IS NULL) AS missing,
       count(*) FILTER (a IS NULL) AS extra, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND x <> y) AS wrong, false AS passed FROM j
""")
def golden_score(spark, sf):
    """Labels of quality against a rule on length."""
    got = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") >= 200).cast("int").alias("quality"))
    return compare.score(table(spark, sf, "labels"), got, "doc_id", "quality")


@query("""
WITH a AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS v FROM lineitem GROUP BY ALL),
j AS (SELECT coalesce(a.k, b.k) AS k, a.v AS a, b.v AS b, a.k AS ka, b.k AS kb FROM a FULL JOIN b ON a.k = b.k)
SELECT k AS o_orderkey, CASE WHEN kb IS NULL THEN 'only_a' WHEN ka IS NULL THEN 'only_b' ELSE 'differs' END AS kind, round(a, 2) AS a, round(b, 2) AS b
FROM j WHERE ka IS NULL OR kb IS NULL OR abs(a - b) > 0.01 * greatest(abs(a), abs(b))
""")
def diff_two_paths(spark, sf):
    """Orders whose total and sum of lines differ, or which one side lacks."""
    a = table(spark, sf, "orders").where("o_orderkey % 7 <> 0").select("o_orderkey", F.col("o_totalprice").alias("v"))
    b = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("v"))
    return compare.difference(a, b, "o_orderkey", "v").select("o_orderkey", "kind", F.round("a", 2).alias("a"), F.round("b", 2).alias("b"))


@query("SELECT 0::BIGINT AS only_a, 0::BIGINT AS only_b")
def order_invariance(spark, sf):
    """The total rows of lines in their order, and shuffled, are the same."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("v"))
    run = lambda df: totals.without_total_rows(df, ["l_orderkey"], "v")
    return compare.same_rows(run(lines), run(lines.repartition("l_linenumber").sortWithinPartitions(F.xxhash64("l_orderkey", "v"))))


# Spark rounds halves of the decimal text up, DuckDB those of the binary number: hence the 1e-9 in the SQL.
_BALANCES = """
c AS (SELECT o_custkey AS g, o_orderkey AS pos, CASE WHEN o_orderkey % 2 = 0 THEN 'USD' ELSE 'KRW' END AS currency,
             CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice / 100 ELSE o_totalprice * 10 END AS value FROM orders),
m AS (SELECT u.g, u.pos AS u, min(k.pos) AS k FROM c u JOIN c k ON u.g = k.g AND u.currency = 'USD' AND k.currency <> 'USD'
      AND u.value < 1e6 AND k.value > 1e5 AND k.value / u.value > 500 AND k.value / u.value < 3000 GROUP BY ALL),
f AS (SELECT g, k, min(u) AS u FROM m GROUP BY ALL),
r AS (SELECT c.g, c.pos, CASE WHEN f.u IS NULL THEN c.currency ELSE 'USD' END AS currency, d.value AS qty, c.value
      FROM c LEFT JOIN f ON c.g = f.g AND c.pos = f.k LEFT JOIN c d ON d.g = f.g AND d.pos = f.u
      WHERE NOT EXISTS (SELECT 1 FROM f x WHERE x.g = c.g AND x.u = c.pos))
"""


def _balances(spark, sf) -> DataFrame:
    """Orders of a customer as cash rows of a screen, every second one in dollars."""
    dollars = F.col("o_orderkey") % 2 == 0
    none = F.lit(None).cast("double")
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("g"),
        F.col("o_orderkey").alias("pos"),
        F.when(dollars, "USD").otherwise("KRW").alias("currency"),
        F.when(dollars, F.col("o_totalprice") / 100).otherwise(F.col("o_totalprice") * 10).alias("value"),
        *[none.alias(c) for c in ("qty", "price", "cost", "pnl")],
    )


@query(f"WITH {_BALANCES} SELECT g, pos, currency, round(qty, 4) AS qty, round(value, 4) AS value FROM r")
def cash_pairs(spark, sf):
    """Cash rows of every customer with the pairs of one balance merged."""
    out = currency.cash_pairs_merged(_balances(spark, sf), "g", "pos", F.lit(True))
    return out.select("g", "pos", "currency", F.round("qty", 4).alias("qty"), F.round("value", 4).alias("value"))


@query(f"""
WITH {_BALANCES}, x AS (SELECT g, min_by(round(value / qty, 2), pos) AS fx FROM r WHERE currency = 'USD' AND value / qty > 500 AND value / qty < 3000 GROUP BY g)
SELECT r.g, r.pos, x.fx, round(CASE WHEN currency = 'USD' AND abs(value / qty - fx) / fx < 0.02 THEN value / fx ELSE value END + 1e-9, 2) AS value FROM r LEFT JOIN x ON r.g = x.g
""")
def foreign_cash_value(spark, sf):
    """Merged cash rows in their own currency, by the rate that the customer's first pair gives."""
    rows = currency.cash_pairs_merged(_balances(spark, sf), "g", "pos", F.lit(True))
    rates = currency.captured_rate(rows, "g", "pos", F.lit(True))
    out = currency.foreign_cash(rows.join(rates, "g", "left"), F.col("fx"), F.lit(True))
    return out.select("g", "pos", "fx", F.round("value", 2).alias("value"))


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_linenumber % 2 = 0 AS won, l_extendedprice AS v, l_quantity AS q, l_extendedprice / l_quantity AS p FROM lineitem),
t AS (SELECT *, CASE WHEN won THEN round(v / 1300 + 1e-9, 2) ELSE v END AS w FROM r)
SELECT l_orderkey, l_linenumber, w AS value,
       CASE WHEN won AND abs(p / 1300 - w / q) < abs(p - w / q) THEN round(p / 1300 + 1e-9, 2) ELSE p END AS price, CASE WHEN won THEN 1300.0::DOUBLE END AS fx_applied FROM t
""")
def currency_unified(spark, sf):
    """Every second line as a won amount of a dollar holding, in dollars."""
    none = F.lit(None).cast("double")
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("value"), F.col("l_quantity").alias("qty"), F.try_divide("l_extendedprice", "l_quantity").alias("price"), none.alias("cost"), none.alias("pnl")
    )
    out = currency.unified(rows, F.lit(1300.0), F.lit(True), F.col("l_linenumber") % 2 == 0)
    return out.select("l_orderkey", "l_linenumber", "value", "price", "fx_applied")


@query("""
SELECT l_orderkey, l_linenumber, round(l_quantity * l_discount, 4) AS cost, round(coalesce(CASE WHEN l_linenumber % 3 = 0 THEN l_extendedprice END, l_quantity * l_tax), 4) AS value FROM lineitem
""")
def screen_arithmetic(spark, sf):
    """Cost and value of every line from quantity and unit prices; every third has a value of its own."""
    own = F.when(F.col("l_linenumber") % 3 == 0, F.col("l_extendedprice"))
    got = N.screen_arithmetic(F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), own)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", got.alias("s")).select("l_orderkey", "l_linenumber", F.round("s.cost", 4).alias("cost"), F.round("s.value", 4).alias("value"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def iso_time(spark, sf):
    """The instant of every event as text."""
    return table(spark, sf, "events").select("event_id", N.iso_z(F.col("ts")).alias("at"))


@query("""
WITH l AS (SELECT conv_id, turn, count(*) FILTER (role = 'user') AS n FROM conversations GROUP BY ALL)
SELECT conv_id, turn, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS later FROM l
""")
def suffix_count(spark, sf):
    """For every turn, how many user turns come after it."""
    return sequences.following_count(table(spark, sf, "conversations"), "conv_id", "turn", F.col("role") == "user", "later")


@query(f"""
WITH {_GAPS},
w AS (SELECT g.user_id, gap, row_number() OVER (PARTITION BY g.user_id ORDER BY gap) AS k, count(*) OVER (PARTITION BY g.user_id) AS n FROM g JOIN t USING (user_id) WHERE gap > 0 AND gap >= threshold),
m AS (SELECT user_id, gap AS pitch FROM w WHERE k = n // 2 + 1),
p AS (SELECT u.user_id, coalesce(pitch, 3600.0 * 4) AS pitch FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN m USING (user_id))
SELECT user_id, round(pitch, 3) AS pitch, round(greatest(1.6 * 3600, 0.6 * pitch), 3) AS reach FROM p
""")
def row_pitch(spark, sf):
    """The middle of the long gaps of every user, and the reach that follows from it."""
    out = sequences.row_pitch(_seconds(spark, sf), "user_id", "at", F.lit(3600.0))
    return out.select("user_id", F.round("pitch", 3).alias("pitch"), F.round("reach", 3).alias("reach"))


@query("""
WITH e AS (SELECT event_id, user_id, epoch(ts) AS a, epoch(ts) + 600 AS b, 60.0 * (1 + event_id % 5) AS h FROM events),
g AS (SELECT event_id, (a - lag(b) OVER w) / greatest(h, lag(h) OVER w, 1) AS share FROM e WINDOW w AS (PARTITION BY user_id ORDER BY a, b, event_id))
SELECT count(*) AS n, round(min(share), 4) AS low, round(max(share), 4) AS high, round(avg(share), 4) AS mean FROM g WHERE share IS NOT NULL
""")
def gap_distribution(spark, sf):
    """Gaps between the events of a user, measured in sizes."""
    events = _seconds(spark, sf).select("event_id", "user_id", "at", (F.col("at") + 600).alias("until"), (60.0 * (1 + F.col("event_id") % 5)).alias("size"))
    out = sequences.gap_shares(events, "user_id", "at", "until", "size")
    return out.agg(F.count("*").alias("n"), *[F.round(f("share"), 4).alias(k) for k, f in (("low", F.min), ("high", F.max), ("mean", F.avg))])


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL)
SELECT user_id, event_type, n FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) = 1
""")
def most_frequent(spark, sf):
    """The most frequent type of event of every user, the first of equal ones."""
    return sequences.most_frequent(table(spark, sf, "events"), "user_id", "event_type", "event_id")


@query("SELECT conv_id, string_agg(text, ' ' ORDER BY turn, text) AS text FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def reading_text(spark, sf):
    """The texts of every conversation in their order."""
    return sequences.reading_text(table(spark, sf, "conversations"), ["conv_id"], ["turn"], "text")


@query("""
WITH s AS (SELECT l_orderkey, sum(l_extendedprice) AS s, count(*) AS n FROM lineitem WHERE l_extendedprice <> 0 GROUP BY l_orderkey),
a AS (SELECT l_orderkey, l_linenumber, l_extendedprice * l_linenumber AS amount FROM lineitem),
h AS (SELECT a.* FROM a JOIN s USING (l_orderkey) WHERE n >= 2 AND s > 0 AND l_linenumber < 8 AND amount <> 0 AND abs(amount - s) <= 0.02 * s)
SELECT l_orderkey, round(min_by(amount, (l_linenumber, amount)), 2) AS total FROM h GROUP BY l_orderkey
""")
def sum_match_total(spark, sf):
    """The first of an order's made-up amounts that is the sum of its lines."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("v"), (F.col("l_extendedprice") * F.col("l_linenumber")).alias("amount"))
    out = totals.sum_matched(lines, lines, "l_orderkey", "v", ["l_linenumber", "amount"], "l_linenumber", "amount")
    return out.select("l_orderkey", F.round("total", 2).alias("total"))


@query("""
WITH b AS (SELECT event_id, user_id, epoch(ts) AS moment, value AS x FROM events WHERE event_type = 'purchase'),
l AS (SELECT event_id AS label, user_id, epoch(ts) AS moment, value AS x FROM events WHERE event_type = 'view'),
j AS (SELECT b.event_id, l.label, abs(b.moment - l.moment) AS d, l.moment, abs(b.x - l.x) <= 20 AS aligned FROM b JOIN l USING (user_id)),
p AS (SELECT * FROM j QUALIFY aligned OR NOT bool_or(aligned) OVER (PARTITION BY event_id)),
n AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY d, moment, label) = 1)
SELECT b.event_id, CASE WHEN d <= 200000 THEN label END AS label, round(CASE WHEN d <= 200000 THEN d END, 3) AS seconds FROM b LEFT JOIN n USING (event_id)
""")
def nearest_aligned(spark, sf):
    """Every purchase with the user's nearest view in time, of those of a like value if there are any."""
    rows = _seconds(spark, sf)
    left = rows.where("event_type = 'purchase'").select("event_id", "user_id", "at", F.col("value").alias("x"))
    right = rows.where("event_type = 'view'").select("user_id", "at", F.col("value").alias("x"), F.col("event_id").alias("label"))
    out = asof.nearest_aligned(left, right, ["user_id"], "event_id", "at", "x", "label", 20.0, 200_000.0)
    return out.select("event_id", "label", F.round("distance", 3).alias("seconds"))


@query("""
SELECT p_partkey, CASE WHEN abs(p_retailprice - 1000) <= abs(p_retailprice - 1400) AND abs(p_retailprice - 1000) <= abs(p_retailprice - 1900) THEN 0
       WHEN abs(p_retailprice - 1400) <= abs(p_retailprice - 1900) THEN 1 ELSE 2 END AS band FROM part
""")
def nearest_band(spark, sf):
    """Every part with the nearest of three prices."""
    edges = F.array(F.lit(1000.0), F.lit(1400.0), F.lit(1900.0))
    return table(spark, sf, "part").select("p_partkey", asof.nearest_edge(edges, F.col("p_retailprice")).alias("band"))


@query("""
WITH p AS (SELECT l_extendedprice AS av, l_extendedprice * (1 + l_tax / 4) AS bv, l_quantity AS aq, l_quantity + (l_linenumber = 7)::INT AS bq, l_returnflag AS ar, l_linestatus AS br FROM lineitem)
SELECT 'value' AS field, count(*) AS compared, count(*) FILTER (abs(av - bv) / av > 0.01) AS mismatched, round(max(abs(av - bv) / av), 6) AS worst FROM p
UNION ALL SELECT 'qty', count(*), count(*) FILTER (aq <> bq), NULL FROM p
UNION ALL SELECT 'flag', count(*), count(*) FILTER (ar <> br), NULL FROM p
""")
def field_report(spark, sf):
    """Lines against changed copies, field by field."""
    pairs = table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("a_value"), (F.col("l_extendedprice") * (1 + F.col("l_tax") / 4)).alias("b_value"),
        F.col("l_quantity").alias("a_qty"), (F.col("l_quantity") + (F.col("l_linenumber") == 7).cast("int")).alias("b_qty"),
        F.col("l_returnflag").alias("a_flag"), F.col("l_linestatus").alias("b_flag"),
    )
    return compare.field_report(pairs, ["qty", "flag"], {"value": V.GOLDEN_VALUE}).withColumn("worst", F.round("worst", 6))


# Streams -------------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream. The pattern lets it be one file as well as a folder of files."""
    path = f"{sf.rstrip('/')}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[t]")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the session names for checkpoints; a local session without one gets a temporary folder."""
    import tempfile
    import uuid

    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(folder or tempfile.mkdtemp(prefix='tallywright-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _run(spark: SparkSession, stream: DataFrame, name: str, mode: str) -> DataFrame:
    return jobs.run_to_table(stream, mode, scratch_folder(spark, name))


@query("SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS done FROM events GROUP BY user_id")
def stream_progress(spark, sf):
    """Rows and purchases so far of every user, over a stream."""
    return _run(spark, jobs.progress(_stream(spark, sf, "events"), "user_id", F.col("event_type") == "purchase"), "progress", "complete")


@query("SELECT user_id, max(ts) AS ts, round(max_by(value, ts), 6) AS value FROM events GROUP BY user_id")
def stream_latest(spark, sf):
    """The newest event of every user, over a stream."""
    return _run(spark, jobs.latest(_stream(spark, sf, "events"), "user_id", "ts", "value"), "latest", "complete").withColumn("value", F.round("value", 6))
