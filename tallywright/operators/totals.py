"""Detail rows against the totals of their group: which rows are totals, copies or slips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.functions import vocabulary as V
from tallywright.functions.text import truthy


def first_per_value(df: DataFrame, group: list[str], value: Column, order: list[str]) -> DataFrame:
    """The first row of every value within a group; two different rows of one value collapse."""
    w = Window.partitionBy(*group, value).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def without_total_rows(df: DataFrame, group: list[str], value: str, tolerance: float = V.TOTAL_ROW) -> DataFrame:
    """Without rows equal to the sum of the others; all stay if none would be left.

    The tolerance is relative to the row's own value, so negative rows of groups of two or more go.
    """
    g = Window.partitionBy(*group)
    rest = F.sum(F.coalesce(value, F.lit(0.0))).over(g) - F.coalesce(value, F.lit(0.0))
    total = truthy(F.col(value)) & (F.count("*").over(g) >= 2) & (F.try_divide(F.abs(rest - F.col(value)), F.col(value)) <= tolerance)
    marked = df.withColumn("_total", F.coalesce(total, F.lit(False)))
    return marked.withColumn("_left", F.count_if(~F.col("_total")).over(g)).where("not _total or _left = 0").drop("_total", "_left")


def repaired_slips(rows: DataFrame, totals: DataFrame, group: str, row_id: str, value: str) -> DataFrame:
    """``rows`` with a slipped digit put right and ``slip``, the factor, where one was.

    A group whose sum misses its nearest total by more than SLIP_BROKEN is repaired if exactly one
    row and factor bring it within SLIP_FIXED. ``totals`` has (group, total).
    """
    sums = rows.groupBy(group).agg(F.sum(value).alias("_sum"))
    near = (
        sums.join(totals.where(truthy(F.col("total"))), group)
        .groupBy(group, "_sum")
        .agg(F.min_by("total", F.struct(F.abs(F.col("total") - F.col("_sum")), "total")).alias("_near"))
        .where((F.col("_sum") != 0) & (F.abs(F.col("_sum") - F.col("_near")) > V.SLIP_BROKEN * F.abs(F.col("_near"))))
    )
    tried = (
        rows.where(truthy(F.col(value)))
        .join(near, group)
        .withColumn("slip", F.explode(F.array(*map(F.lit, V.SLIP_FACTORS))))
        .where(F.abs(F.col("_sum") - F.col(value) + F.col(value) * F.col("slip") - F.col("_near")) <= V.SLIP_FIXED * F.abs(F.col("_near")))
        .groupBy(group)
        .agg(F.count("*").alias("_n"), F.first(row_id).alias(row_id), F.first("slip").alias("slip"))
        .where("_n = 1")
        .drop("_n")
    )
    return rows.join(tried, [group, row_id], "left").withColumn(value, F.when(F.col("slip").isNotNull(), F.bround(F.col(value) * F.col("slip"), 2)).otherwise(F.col(value)))


def classified(groups: DataFrame, rows: DataFrame, group: str, category: Column, tokens: str) -> DataFrame:
    """(group, class): empty, product_summary, account_summary or detail; groups without rows too."""
    n, categories = F.count(tokens), F.count_if(category)
    sets = F.count_distinct(F.when(F.size(tokens) > 0, F.array_sort(tokens)))
    facts = rows.groupBy(group).agg(n.alias("n"), categories.alias("c"), sets.alias("sets"), F.count_if(F.size(tokens) > 0).alias("with"))
    kind = (
        F.when(F.coalesce("n", F.lit(0)) == 0, "empty")
        .when(F.col("c") >= F.greatest(F.lit(2.0), F.col("n") / 2), "product_summary")
        .when((F.col("n") >= 2) & (F.col("with") == F.col("n")) & (F.col("sets") == F.col("n")), "account_summary")
        .otherwise("detail")
    )
    return groups.join(facts, group, "left").select(group, kind.alias("class"))


def coherent(df: DataFrame, group: list[str], *flags: Column) -> DataFrame:
    """In groups where two rows or more, and half of them, have a flag, only these; flags in order."""
    g = Window.partitionBy(*group)
    chosen = F.lit(0)
    for k, flag in reversed(list(enumerate(flags, 1))):
        hits = F.count_if(flag).over(g)
        chosen = F.when((hits >= 2) & (hits * 2 >= F.count("*").over(g)), k).otherwise(chosen)
    out = df.withColumn("_keep", chosen)
    keep = F.col("_keep") == 0
    for k, flag in enumerate(flags, 1):
        keep = keep | ((F.col("_keep") == k) & F.coalesce(flag, F.lit(False)))
    return out.where(keep).drop("_keep")


def deposit_echoes_dropped(df: DataFrame, totals: DataFrame, group: str, pos: str, value: str, cash: Column) -> DataFrame:
    """Of several cash rows of a group only the first that equals one of its totals; without such, all."""
    marked = df.withColumn("_cash", F.coalesce(cash, F.lit(False)))
    near = F.exists("_totals", lambda t: (t != 0) & (F.abs(F.col(value) - t) <= V.DEPOSIT_ANCHOR * F.abs(t)))
    known = totals.groupBy(group).agg(F.collect_list("total").alias("_totals"))
    g = Window.partitionBy(group)
    out = marked.join(known, group, "left").withColumn("_anchor", F.min(F.when(F.col("_cash") & F.coalesce(near, F.lit(False)), F.col(pos))).over(g))
    many = F.count_if("_cash").over(g)
    out = out.withColumn("_many", many)
    stay = ~F.col("_cash") | (F.col("_many") < 2) | F.col("_anchor").isNull() | (F.col(pos) == F.col("_anchor"))
    return out.where(stay).select(df.columns)


def sum_matched(rows: DataFrame, amounts: DataFrame, group: str, value: str, order: list[str], line: str, amount: str) -> DataFrame:
    """(group, total): the first amount of the top lines that is the sum of the group's rows, within SUM_MATCH.

    Groups of fewer than two rows have none: one row would only confirm itself. Rows without a value do not count.
    """
    sums = rows.where(truthy(F.col(value))).groupBy(group).agg(F.sum(value).alias("_sum"), F.count("*").alias("_n")).where("_n >= 2 and _sum > 0")
    top = amounts.where((F.col(line) < V.TOP_LINES) & truthy(F.col(amount))).hint("merge").join(sums, group)
    hits = top.where(F.abs(F.col(amount) - F.col("_sum")) <= V.SUM_MATCH * F.col("_sum"))
    return hits.groupBy(group).agg(F.min_by(amount, F.struct(*order)).alias("total"))
