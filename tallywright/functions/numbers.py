"""Numbers in texts, and arithmetic with explicit tolerances. Failures are null, never errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallywright.functions import vocabulary as V
from tallywright.functions.text import blank_to_null, truthy


def parse_number(s: Column) -> Column:
    """Digits, dots and minus signs of a text as a double."""
    return F.regexp_replace(s, r"[^0-9.\-]", "").try_cast("double")


def money(s: Column) -> Column:
    """An amount in which a thousands comma may have been read as a dot."""
    t = F.regexp_replace(s, r"[원\s+]", "")
    t = F.when(t.rlike(r"[.,]\d{3}\.\d{3}$"), F.regexp_replace(t, r"\.(?=\d{3}$)", ",")).otherwise(t)
    return F.when(t.rlike(r"^-?[\d,.]+$"), F.regexp_replace(t, ",", "").try_cast("double"))


def amount(s: Column) -> Column:
    """The amount of a cell such as '+1,200(3.4%)': before or after the percentage, whose sign it
    takes if it has none itself."""
    bare, shape = F.regexp_replace(s, r"[원\s]", ""), r"^[+\-]?[\d,]+(\.\d+)?$"
    number = lambda c: F.regexp_replace(c, "[,+]", "").try_cast("double")
    parts = F.filter(F.split(bare, r"[|(]"), lambda p: p != "")
    clean = F.transform(parts, lambda p: F.regexp_replace(p, r"\)", ""))
    plain = F.filter(clean, lambda p: p.rlike(shape))
    first = F.try_element_at(plain, F.lit(1))
    rate_first = F.coalesce(F.contains(F.try_element_at(clean, F.lit(1)), F.lit("%")), F.lit(False))
    minus = rate_first & F.startswith(F.try_element_at(clean, F.lit(1)), F.lit("-")) & ~F.coalesce(first.rlike(r"^[+\-]"), F.lit(False))
    value = number(first)
    # Most cells are words or one plain number; only what has parts, and one of them without letters, is taken apart.
    single = ~s.rlike(r"[|()]")
    may = s.rlike(r"(?:^|[|(])[원\s)+\-,.\u0085\u2028\u2029]*\d[원\s)+\-\d,.\u0085\u2028\u2029]*(?:$|[|(])")
    return F.when(single, F.when(bare.rlike(shape), number(bare))).when(may, F.when(minus, -value).otherwise(value))


def is_plain_amount(s: Column) -> Column:
    """Whether a cell without parts is an amount, by its shape; false for null."""
    whole = ~(F.contains(s, F.lit("|")) | F.contains(s, F.lit("(")) | F.contains(s, F.lit(")")))
    return F.coalesce(whole & s.rlike(r"^(?=[^\d]*\d)[원\s]*[+\-]?[원\s]*[\d,][\d,원\s]*(?:\.[원\s]*\d[\d원\s]*)?\z"), F.lit(False))


def is_amount(s: Column) -> Column:
    """Whether amount() finds one; false for null."""
    parts = F.contains(s, F.lit("|")) | F.contains(s, F.lit("(")) | F.contains(s, F.lit(")"))
    return is_plain_amount(s) | F.coalesce(F.when(parts, amount(s).isNotNull()), F.lit(False))


def is_share_quantity(s: Column) -> Column:
    """Whether share_quantity() finds one; false for null."""
    return F.coalesce(F.contains(s, F.lit("주")) & s.rlike(r"^(?=[,.]*\d)[\d,]+(?:\.\d+)?\s*주$"), F.lit(False))


def cell_number(s: Column) -> Column:
    """The amount of a cell in which a thousands comma may have been read as a dot."""
    return amount(F.regexp_replace(s, r"([.,]\d{3})\.(\d{3})(?!\d)", "$1,$2"))


def share_quantity(s: Column) -> Column:
    """N of 'N주'; fractions count."""
    return F.regexp_replace(blank_to_null(F.regexp_extract(s, r"^([\d,]+(?:\.\d+)?)\s*주$", 1)), ",", "").try_cast("double")


def foreign_balance(s: Column) -> Column:
    """(amount, currency) of 'N USD' and the like; null for zero."""
    shape = r"^([\d,]+(?:\.\d+)?)\s*(USD|JPY|EUR|CNY|HKD)$"
    value = F.regexp_replace(F.regexp_extract(s, shape, 1), ",", "").try_cast("double")
    return F.when(truthy(value), F.struct(value.alias("amount"), F.regexp_extract(s, shape, 2).alias("currency")))


def residual_tier(value: Column, unit: Column, sure: str = "high", unsure: str = "estimated") -> Column:
    """(qty, resid, confidence) of value / unit rounded; from a residual of 1/3 on there is none."""
    ratio = F.try_divide(value, unit)
    qty, resid = F.bround(ratio, 0), F.bround(F.abs(ratio - F.bround(ratio, 0)), 3)
    fits = truthy(unit) & (qty > 0) & (resid < V.QTY_BLANK)
    return F.struct(
        F.when(fits, qty).alias("qty"),
        F.when(fits, resid).alias("resid"),
        F.when(fits & (resid < V.QTY_SURE), sure).when(fits, unsure).alias("confidence"),
    )


def price_error(unit: Column, close: Column, fx: Column) -> Column:
    """Relative error of a unit price against a close, in either currency; 9.0 without a close."""
    here, there = F.try_divide(F.abs(unit - close), close), F.try_divide(F.abs(unit - close * fx), close * fx)
    return F.coalesce(F.least(here, there), F.lit(9.0))


def gross_fits(qty: Column, expected: Column, tolerance: float = V.QTY_GROSS) -> Column:
    """Whether a quantity is near what value and price suggest; the error is relative to that, or 1."""
    return F.abs(qty - expected) / F.greatest(expected, F.lit(1.0)) <= tolerance


def repaired_cost(value: Column, cost: Column, pnl: Column) -> Column:
    """(cost, pnl, cost_src): a negative cost or one equal to the profit was the profit; a cost that
    breaks value - cost = pnl goes; a missing one follows from the identity."""
    was_pnl = (cost < 0) | (F.abs(cost - pnl) < 1)
    profit = F.when(F.coalesce(was_pnl & pnl.isNull(), F.lit(False)), cost).otherwise(pnl)
    kept = F.when(F.coalesce(was_pnl, F.lit(False)), F.lit(None)).otherwise(cost)
    broken = F.abs(value - kept - profit) > F.greatest(F.lit(1.0), F.abs(value) * V.IDENTITY)
    kept = F.when(F.coalesce(broken, F.lit(False)), F.lit(None)).otherwise(kept)
    made = F.bround(value - profit, 2)
    return F.struct(
        F.coalesce(kept, made).alias("cost"),
        profit.alias("pnl"),
        F.when(kept.isNotNull(), "screen").when(made.isNotNull(), "computed:value-pnl").alias("cost_src"),
    )


def plausible_rate(ratio: Column) -> Column:
    """Strictly between the bounds of an exchange rate."""
    return (ratio > V.FX_LOW) & (ratio < V.FX_HIGH)


def within(a: Column, b: Column, tolerance: float) -> Column:
    """|a - b| / |b| <= tolerance; false if b is zero or either is null."""
    return F.coalesce(F.try_divide(F.abs(a - b), F.abs(b)) <= tolerance, F.lit(False))


def session_date(ts: Column, close_hour: Column | float) -> Column:
    """Trading day of an instant: before the close it is the day before."""
    close = F.lit(close_hour) if isinstance(close_hour, float) else close_hour
    hour = F.hour(ts) + F.minute(ts) / 60.0 + F.second(ts) / 3600.0
    return F.date_sub(F.to_date(ts), F.when(hour < close, 1).otherwise(0))


def seconds_to_next(now: Column, hours: tuple[float, ...], least: int = 60) -> Column:
    """Seconds from ``now`` to the next of the daily UTC hours."""
    at = F.hour(now) * 3600 + F.minute(now) * 60 + F.second(now)
    return F.greatest(F.lit(least), F.array_min(F.array(*[F.pmod(F.lit(int(h * 3600)) - at - 1, F.lit(86_400)) + 1 for h in hours])))


def snapped(v: Column, step: int = 28) -> Column:
    return F.greatest(F.lit(step), (F.bround(v / step, 0) * step).cast("int"))


def filled_fields(*fields: Column) -> Column:
    """Number of fields that are not null."""
    return sum((f.isNotNull().cast("int") for f in fields), F.lit(0))


def upper_median(values: Column) -> Column:
    """The middle of a sorted array, the upper one of two."""
    return F.try_element_at(F.sort_array(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def screen_arithmetic(qty: Column, unit_cost: Column, price: Column, value: Column) -> Column:
    """struct(cost, value): what quantity and unit prices of a screen come to; a value that is there stays."""
    return F.struct((qty * unit_cost).alias("cost"), F.coalesce(value, F.when(qty != 0, qty * price)).alias("value"))


def iso_z(ts: Column) -> Column:
    """An instant as text in UTC, to the second."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
