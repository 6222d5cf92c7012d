"""Holdings in two currencies: pairs of one balance, the rate that they give, amounts in the own currency.

Holdings have (group, pos, currency, qty, price, value, cost, pnl); ``group`` is a screen. The pairs come first,
since a paired row gives the rate that the later stages take.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions import numbers as N
from tallywright.functions import text as S
from tallywright.functions import vocabulary as V

MONEY = ("value", "cost", "pnl")


def cash_pairs_merged(df: DataFrame, group: str, pos: str, cash: Column) -> DataFrame:
    """Of a balance shown in dollars and in won only the won row stays, with the dollars as its quantity.

    Each dollar row takes the first won row whose value is a plausible rate times its own, and a won row is taken once,
    by the first. Both meet by group and by logarithmic bucket of the value, an equi-join with a rest condition.
    """
    width = math.log(V.FX_HIGH / V.FX_LOW)
    # The rate lies in a stretch of this width, hence in two buckets or three.
    low = math.floor(math.log(V.FX_LOW) / width)
    bucket = F.floor(F.log("value") / width)
    money = df.where(cash & (F.col("value") > 0))
    dollars = money.where((F.col("currency") == "USD") & (F.col("value") < V.DOLLAR_CASH)).select(
        group, F.col(pos).alias("_u"), F.col("value").alias("_dollars"), F.explode(F.array(*[bucket + low + k for k in range(3)])).alias("_bucket")
    )
    won = money.where(~F.col("currency").eqNullSafe("USD") & (F.col("value") > V.WON_CASH)).select(group, F.col(pos).alias("_k"), F.col("value").alias("_won"), bucket.alias("_bucket"))
    found = dollars.join(won, [group, "_bucket"]).where(N.plausible_rate(F.col("_won") / F.col("_dollars")))
    first = found.groupBy(group, "_u", "_dollars").agg(F.min("_k").alias("_k"))
    taken = first.groupBy(group, "_k").agg(F.min(F.struct("_u", "_dollars")).alias("_t"))
    merged = df.join(taken.select(group, F.col("_k").alias(pos), F.col("_t._dollars").alias("_dollars")), [group, pos], "left")
    paired = F.col("_dollars").isNotNull()
    fixed = {"qty": F.col("_dollars"), "currency": F.lit("USD"), "price": F.lit(1.0)}
    merged = merged.withColumns({c: F.when(paired, v).otherwise(F.col(c)) for c, v in fixed.items()}).drop("_dollars")
    return merged.join(taken.select(group, F.col("_t._u").alias(pos)), [group, pos], "left_anti").select(df.columns)


def captured_rate(df: DataFrame, batch: str, pos: str, cash: Column) -> DataFrame:
    """(batch, fx): the rate of the batch's first dollar cash row with a quantity and a plausible one."""
    rate = F.try_divide("value", "qty")
    rows = df.where(cash & (F.col("currency") == "USD") & N.plausible_rate(rate))
    return rows.groupBy(batch).agg(F.min_by(F.round(rate, 2), pos).alias("fx"))


def unified(df: DataFrame, fx: Column, native_usd: Column, in_won: Column) -> DataFrame:
    """Won amounts of dollar holdings in dollars; the price too, where that brings it nearer to value / qty."""
    turn = F.coalesce(native_usd & in_won & (fx != 0), F.lit(False))
    out = df.withColumn("_turn", turn).withColumn("_fx", fx)
    out = out.withColumns({c: F.when(F.col("_turn"), F.round(F.col(c) / F.col("_fx"), 2)).otherwise(F.col(c)) for c in MONEY})
    per, there = F.try_divide("value", "qty"), F.try_divide("price", "_fx")
    judged = F.col("_turn") & S.truthy(F.col("price")) & S.truthy(F.col("qty")) & S.truthy(F.col("value"))
    nearer = F.coalesce(judged & (F.abs(there - per) < F.abs(F.col("price") - per)), F.lit(False))
    return out.withColumns({"price": F.when(nearer, F.round(there, 2)).otherwise(F.col("price")), "fx_applied": F.when(F.col("_turn"), F.col("_fx"))}).drop("_turn", "_fx")


def foreign_cash(df: DataFrame, fx: Column, cash: Column) -> DataFrame:
    """The value of dollar cash in dollars, where value / qty is the rate within FOREIGN_CASH; adds ``fx_applied``."""
    rate = F.try_divide("value", "qty")
    turn = F.coalesce(cash & (F.col("currency") == "USD") & (F.try_divide(F.abs(rate - fx), fx) < V.FOREIGN_CASH), F.lit(False))
    before = F.col("fx_applied") if "fx_applied" in df.columns else F.lit(None).cast("double")
    return df.withColumns({"value": F.when(turn, F.round(F.col("value") / fx, 2)).otherwise(F.col("value")), "fx_applied": F.when(turn, fx).otherwise(before)})
