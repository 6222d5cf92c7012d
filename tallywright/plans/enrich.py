"""Enrichment of holdings, one stage after the other; each reads the columns of those before it.

Holdings have (pos, name, assetClass, currency, qty, price, value, cost, pnl, symbol, market, close),
``close`` being the as-of close of the symbol. Values and their sources are written together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions import numbers as N
from tallywright.functions import text as S
from tallywright.functions import vocabulary as V
from tallywright.operators import matching


def cash(df: DataFrame) -> Column:
    return S.is_cash_name(F.col("name")) | F.coalesce(F.col("assetClass") == "현금", F.lit(False))


def costs(df: DataFrame) -> DataFrame:
    """Accounting identity: value - cost = pnl."""
    fixed = N.repaired_cost(F.col("value"), F.col("cost"), F.col("pnl"))
    return df.withColumn("_c", fixed).withColumns({c: F.col(f"_c.{c}") for c in ("cost", "pnl", "cost_src")}).drop("_c")


def currencies(df: DataFrame) -> DataFrame:
    """The market decides the currency of what has a symbol."""
    listed = F.col("symbol").isNotNull() & ~cash(df)
    return df.withColumn("currency", F.when(listed, F.when(F.col("market") == "US", "USD").otherwise("KRW")).otherwise(F.coalesce("currency", F.when(F.col("value").isNotNull(), "KRW"))))


def screen_quantities(df: DataFrame) -> DataFrame:
    have = S.truthy(F.col("qty"))
    return df.withColumns({"qty_src": F.when(have, "screen"), "confidence": F.when(have, "exact")})


def symbol_gate(df: DataFrame, fx: Column) -> DataFrame:
    """A symbol whose price does not explain value / qty goes, unless the quantity may be part of the name."""
    error = N.price_error(F.try_divide(F.col("value"), F.col("qty")), F.col("close"), fx)
    judged = S.truthy(F.col("qty")) & F.col("close").isNotNull() & ~S.quantity_in_name(F.col("name"), F.col("qty"))
    bad = F.coalesce(judged & (error > V.SYMBOL_GATE), F.lit(False))
    return df.withColumns({"symbol_note": F.when(bad, "price does not explain the symbol"), "close": F.when(~bad, F.col("close")), "symbol": F.when(~bad, F.col("symbol"))})


def quantity_gate(df: DataFrame, fx: Column) -> DataFrame:
    """A quantity far from value / close in either currency goes, with the price."""
    here, there = F.try_divide(F.col("value"), F.col("close")), F.try_divide(F.col("value"), F.col("close") * fx)
    fits = N.gross_fits(F.col("qty"), here) | F.coalesce(N.gross_fits(F.col("qty"), there), F.lit(False))
    bad = F.coalesce(S.truthy(F.col("qty")) & F.col("close").isNotNull() & ~fits, F.lit(False))
    return df.withColumns({c: F.when(~bad, F.col(c)) for c in ("qty", "price", "qty_src", "confidence")} | {"qty_note": F.when(bad, "quantity rejected")})


def derived(df: DataFrame, fx: Column, as_of: Column) -> DataFrame:
    """Missing quantities: from the first unit price of the symbol in another row, then from the close."""
    unit = F.when(S.truthy(F.col("qty")), F.try_divide(F.col("value"), F.col("qty")))
    # Aggregated per symbol and joined: rows without a symbol meet nothing and stay where they are.
    df = matching.transfer_first(df, "symbol", ["pos"], F.when(F.col("symbol").isNotNull(), unit), "_unit")
    need = ~S.truthy(F.col("qty")) & F.col("symbol").isNotNull()
    foreign = F.when(F.col("currency") == "USD", fx).otherwise(F.lit(1.0))
    across = N.residual_tier(F.col("value"), F.col("_unit"))
    close = N.residual_tier(F.col("value"), F.col("close") * foreign, "estimated", "estimated-low")
    df = df.withColumns({"_a": across, "_b": close}).withColumn("_pick", F.when(F.col("_a.qty").isNotNull(), F.struct("_a.*")).otherwise(F.struct("_b.*")))
    source = F.when(F.col("_a.qty").isNotNull(), F.concat(F.lit("derived:cross-account("), F.col("_unit").cast("string"), F.lit(")"))).when(
        F.col("_b.qty").isNotNull(), F.concat(F.lit("derived:capture-close("), as_of, F.lit(")"))
    )
    return df.withColumns(
        {
            "qty": F.when(need, F.col("_pick.qty")).otherwise(F.col("qty")),
            "qty_src": F.when(need, source).otherwise(F.col("qty_src")),
            "qty_resid": F.when(need, F.col("_pick.resid")),
            "confidence": F.when(need, F.coalesce("_pick.confidence", F.lit("unreproducible"))).otherwise(F.coalesce("confidence", F.lit("unreproducible"))),
        }
    ).drop("_unit", "_a", "_b", "_pick")


def prices(df: DataFrame) -> DataFrame:
    """A price must show the value: qty x price within 2 %, else it is computed."""
    made = F.bround(F.try_divide(F.col("value"), F.col("qty")), 2)
    off = F.abs(F.col("qty") * F.col("price") - F.col("value")) > V.DISPLAY * F.abs(F.col("value"))
    again = S.truthy(F.col("qty")) & (F.col("price").isNull() | F.coalesce(off, F.lit(False)))
    return df.withColumns({"price_src": F.when(again, "computed:value/qty").when(F.col("price").isNotNull(), "screen"), "price": F.when(again, made).otherwise(F.col("price"))})


def enriched(holdings: DataFrame, fx: float, as_of: str) -> DataFrame:
    """All stages in their order."""
    rate, day = F.lit(fx), F.lit(as_of)
    out = screen_quantities(currencies(costs(holdings)))
    return prices(derived(quantity_gate(symbol_gate(out, rate), rate), rate, day))


def repriced(holdings: DataFrame, quotes: DataFrame) -> DataFrame:
    """Values at current prices, with the reason where there is none."""
    priced = holdings.join(quotes.select("symbol", F.col("price").alias("_now")), "symbol", "left")
    can = F.col("symbol").isNotNull() & S.truthy(F.col("qty")) & F.col("_now").isNotNull()
    note = F.when(can, F.lit(None)).when(F.col("symbol").isNull(), "no symbol").when(~S.truthy(F.col("qty")), "no quantity").otherwise("no price")
    return priced.withColumns(
        {
            "value_src": F.when(can, "reprice:qty*price@current").otherwise("kept"),
            "reprice_note": note,
            "value": F.when(can, F.bround(F.col("qty") * F.col("_now"), 2)).otherwise(F.col("value")),
        }
    ).drop("_now")
