"""As-of, carry-forward and nearest joins by one shuffle on the key.

Both sides are unioned and a window carries the last right row forward, so there is no range join.
A key whose rows are too many for a task needs a finer key (for series: key and month).
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.functions import vocabulary as V
from tallywright.functions.numbers import session_date


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], ts: str, values: list[str], right_ts: str | None = None) -> DataFrame:
    """``left`` with the ``values`` of the last right row of the same keys at or before ``ts``.

    Right rows of one instant: the largest values win. Left rows without a match get nulls.
    """
    moment = right_ts or ts
    rows = left.select("*", F.lit(1).alias("_side"), F.lit(None).cast(right.select(F.struct(moment, *values)).schema[0].dataType).alias("_hit"))
    other = right.select(*keys, F.col(moment).alias(ts), F.lit(0).alias("_side"), F.struct(moment, *values).alias("_hit"))
    order = Window.partitionBy(*keys).orderBy(ts, "_side", "_hit").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(other, allowMissingColumns=True).withColumn("_last", F.last("_hit", ignorenulls=True).over(order))
    return both.where("_side = 1").select(*left.columns, *[F.col(f"_last.{v}").alias(v) for v in values])


def daily_closes(bars: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    """(keys, day, value): the last non-null value of each day."""
    return bars.where(F.col(value).isNotNull()).groupBy(*keys, F.to_date(ts).alias("day")).agg(F.max_by(value, ts).alias(value))


def asof_session(left: DataFrame, bars: DataFrame, keys: list[str], ts: str, value: str, close_hour: Column | float) -> DataFrame:
    """The close of the last finished session at ``ts``.

    The as-of step goes over the calendar, one row for each key and day that occurs; rows meet it by an equi-join, so a
    key with a large share of all rows is no single task.
    """
    dated = left.withColumn("day", session_date(F.col(ts), close_hour))
    calendar = asof_join(dated.select(*keys, "day").distinct(), daily_closes(bars, keys, ts, value), keys, "day", [value])
    calendar = calendar.select(F.col(value), *[F.col(c).alias(f"_{c}") for c in (*keys, "day")])
    same = [dated[c].eqNullSafe(calendar[f"_{c}"]) for c in (*keys, "day")]
    return dated.join(calendar, reduce(and_, same), "left").drop(*[f"_{c}" for c in (*keys, "day")])


def asof_ladder(left: DataFrame, bars: DataFrame, keys: list[str], ts: str, value: str, open_hour: float, close_hour: float) -> DataFrame:
    """Inside the session the last bar at or before ``ts``, else or failing that the session's close."""
    hour = F.hour(ts) + F.minute(ts) / 60.0 + F.second(ts) / 3600.0
    spot = asof_join(left, bars.where(F.col(value).isNotNull()).select(*keys, ts, F.col(value).alias("spot")), keys, ts, ["spot"])
    both = asof_session(spot, bars, keys, ts, value, close_hour)
    inside = (hour >= open_hour) & (hour < close_hour) & F.col("spot").isNotNull()
    return both.withColumns({"price_src": F.when(inside, "intraday").when(F.col(value).isNotNull(), "session-close"), value: F.when(inside, F.col("spot")).otherwise(F.col(value))}).drop("spot", "day")


def intraday_rung(age_days: Column) -> Column:
    """The finest interval of intraday bars that reaches back ``age_days``."""
    chain = F.when(age_days <= V.INTRADAY[0][0], V.INTRADAY[0][1])
    for days, interval in V.INTRADAY[1:]:
        chain = chain.when(age_days <= days, interval)
    return chain


def nearest_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, limit: float) -> DataFrame:
    """``left`` with the ``value`` and the distance of the right row nearest along ``at``, within ``limit``.

    Ties go to the earlier right row, then to the smaller value.
    """
    side = left.select("*", F.lit(1).alias("_side"), F.lit(None).cast(right.select(F.struct(at, value)).schema[0].dataType).alias("_hit"))
    other = right.select(*keys, at, F.lit(0).alias("_side"), F.struct(at, value).alias("_hit"))
    rows = side.unionByName(other, allowMissingColumns=True)
    before = Window.partitionBy(*keys).orderBy(at, "_side", F.desc("_hit")).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys).orderBy(F.desc(at), "_side", F.desc("_hit")).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumns({"_down": F.last("_hit", True).over(before), "_up": F.last("_hit", True).over(after)}).where("_side = 1")
    gap = lambda c: F.abs(F.col(f"{c}.{at}") - F.col(at))
    far = F.lit(float("inf"))
    down = F.coalesce(gap("_down").cast("double"), far) <= F.coalesce(gap("_up").cast("double"), far)
    hit = F.when(down, F.col("_down")).otherwise(F.col("_up"))
    distance = F.abs(hit[at] - F.col(at)).cast("double")
    return found.select(*left.columns, F.when(distance <= limit, hit[value]).alias(value), F.when(distance <= limit, distance).alias("distance"))


def carried_forward(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The last non-null ``value`` before or at each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def nearest_aligned(left: DataFrame, right: DataFrame, keys: list[str], row: str, at: str, x: str, value: str, reach: float, limit: float) -> DataFrame:
    """``left`` with the ``value`` and distance of the nearest right row along ``at``, from those aligned with it if there are any.

    Aligned is |x - x| <= reach. Where aligned ones exist but the nearest is beyond the limit there is no match. Ties go
    to the earlier right row, then to the smaller value. Rows meet by key and bucket of x; ``row`` identifies left rows.
    """
    bucket = F.floor(F.col(x) / F.lit(reach)).alias("_bucket")
    other = right.select(*keys, F.col(at).alias("_at"), F.col(x).alias("_x"), F.col(value).alias("_v"), F.explode(F.array(*[bucket + k for k in (-1, 0, 1)])).alias("_bucket"))
    near = left.select(*keys, row, at, x, bucket).join(other, [*keys, "_bucket"]).where(F.abs(F.col("_x") - F.col(x)) <= reach)
    gap = F.abs(F.col("_at") - F.col(at)).cast("double")
    best = near.groupBy(*keys, row).agg(F.min(F.struct(gap.alias("d"), F.col("_at"), F.col("_v"))).alias("_b"))
    marked = left.join(best, [*keys, row], "left")
    inside = F.col("_b.d") <= limit
    columns = [F.col(c) for c in left.columns]
    aligned = marked.where("_b is not null").select(*columns, F.when(inside, F.col("_b._v")).alias(value), F.when(inside, F.col("_b.d")).alias("distance"))
    return aligned.unionByName(nearest_join(marked.where("_b is null").select(*columns), right.select(*keys, at, value), keys, at, value, limit))


def nearest_edge(edges: Column, at: Column) -> Column:
    """The 0-based number of the edge nearest to ``at``, the first on ties; null without edges."""
    return F.array_min(F.transform(edges, lambda e, i: F.struct(F.abs(e - at).alias("d"), i.alias("i"))))["i"]
