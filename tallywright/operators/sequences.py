"""Gaps, clusters and merges along one axis, per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.functions import vocabulary as V


def gap_split(df: DataFrame, group: str, at: str, ratio: float = V.JUMP_RATIO, mass: float = V.JUMP_MASS) -> DataFrame:
    """(group, n_gaps, threshold): the first sorted gap that is ``ratio`` times its predecessor while a
    share of at least ``mass`` of the gaps is still to come; null where there is none."""
    w = Window.partitionBy(group).orderBy(at)
    gaps = df.select(group, (F.col(at) - F.lag(at).over(w)).alias("gap")).where("gap > 0")
    s = Window.partitionBy(group).orderBy("gap")
    ranked = gaps.select(group, "gap", F.lag("gap").over(s).alias("_p"), F.row_number().over(s).alias("_k"), F.count("*").over(Window.partitionBy(group)).alias("_n"))
    jump = (F.col("gap") >= ratio * F.col("_p")) & ((F.col("_n") - F.col("_k") + 1) >= mass * F.col("_n"))
    return ranked.groupBy(group).agg(F.count("*").alias("n_gaps"), F.min(F.when(jump, F.col("gap"))).alias("threshold"))


def with_jump(df: DataFrame, group: list[str], order: list[str], at: str, ratio: float = V.JUMP_RATIO, mass: float = V.JUMP_MASS) -> DataFrame:
    """``df`` with ``gap``, the distance to the row before, and ``threshold`` of its group as jump(), by windows over one shuffle."""
    g, w = Window.partitionBy(*group), Window.partitionBy(*group).orderBy(*order)
    s = Window.partitionBy(*group).orderBy(F.col("gap").asc_nulls_last())
    gaps = df.withColumn("gap", (F.col(at) - F.lag(at).over(w)).cast("double"))
    ranked = gaps.withColumns({"_p": F.lag("gap").over(s), "_k": F.row_number().over(s), "_n": F.count("gap").over(g)})
    jumps = F.col("_p").isNotNull() & (F.col("gap") >= ratio * F.greatest("_p", F.lit(1e-9))) & (F.col("_n") - F.col("_k") + 1 >= mass * F.col("_n"))
    return ranked.withColumn("threshold", F.min(F.when(jumps, F.col("gap"))).over(g)).drop("_p", "_k", "_n")


def jump(df: DataFrame, group: list[str], order: list[str], at: str, ratio: float = V.JUMP_RATIO, mass: float = V.JUMP_MASS) -> DataFrame:
    """(group, threshold) as gap_split(), gaps of zero counted like any other: the first positive gap after them is a jump."""
    return with_jump(df, group, order, at, ratio, mass).where("gap is not null").groupBy(*group).agg(F.max("threshold").alias("threshold"))


def gap_segments(df: DataFrame, group: str, order: list[str], at: str, threshold: Column, depth: int) -> DataFrame:
    """``df`` with ``segment``: a new one after every gap of the threshold or more; where the threshold
    is null, runs of ``depth`` rows."""
    w = Window.partitionBy(group).orderBy(*order)
    marked = df.withColumns({"_new": (F.col(at) - F.lag(at).over(w) >= threshold).cast("int"), "_k": F.row_number().over(w) - 1})
    by_gap = F.sum(F.coalesce("_new", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("segment", F.when(threshold.isNull(), F.floor(F.col("_k") / depth)).otherwise(by_gap)).drop("_new", "_k")


def mean_clusters(df: DataFrame, group: str, at: str, tolerance: Column) -> DataFrame:
    """(group, cluster, center, n): sorted values join the first cluster whose running mean is near.

    The mean moves with every member, so this is a fold; groups are screens, or small in their way.
    """
    kind = "array<struct<sum:double,n:int>>"
    values = F.array_sort(F.collect_list(F.col(at).cast("double")))
    rows = df.groupBy(group).agg(values.alias("_v"), F.max(tolerance).alias("_t"))

    def put(acc: Column, v: Column) -> Column:
        near = F.transform(acc, lambda c: F.abs(c["sum"] / c["n"] - v) <= F.col("_t"))
        at_first = F.array_position(near, F.lit(True)) - 1

        def placed(f: Column) -> Column:
            joined = F.transform(acc, lambda c, i: F.when(i == f, F.struct((c["sum"] + v).alias("sum"), (c["n"] + 1).alias("n"))).otherwise(c))
            return F.when(f >= 0, joined).otherwise(F.concat(acc, F.array(F.struct(v.alias("sum"), F.lit(1).alias("n")))))

        # Looked for once a value, not once a cluster.
        return F.transform(F.array(at_first), placed)[0]

    folded = F.aggregate("_v", F.array().cast(kind), put)
    return rows.select(group, F.posexplode(folded).alias("cluster", "_c")).select(group, "cluster", (F.col("_c.sum") / F.col("_c.n")).alias("center"), F.col("_c.n").alias("n"))


def line_starts(rows: Column, at: str, tolerance: Column) -> Column:
    """Where lines begin, from 1 on, in an array of rows sorted by ``at``: rows join the first line whose running mean is within ``tolerance``.

    A line's mean and not its last member decides, so lines cannot drift from box to box. As values rise, a line that one
    row has missed is out of reach for all behind it, so each row is held against the last line only and lines are
    stretches of the array. The array is a screen's.
    """
    start = F.struct(F.lit(None).cast("double").alias("sum"), F.lit(1).alias("n"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("starts"))

    def put(acc: Column, m: Column) -> Column:
        v, i = m[at].cast("double"), acc["i"] + 1
        near = F.abs(acc["sum"] / acc["n"] - v) <= tolerance
        grown = F.struct((acc["sum"] + v).alias("sum"), (acc["n"] + 1).alias("n"), i.alias("i"), acc["starts"].alias("starts"))
        return F.when(near, grown).otherwise(F.struct(v.alias("sum"), F.lit(1).alias("n"), i.alias("i"), F.concat(acc["starts"], F.array(i)).alias("starts")))

    return F.aggregate(rows, start, put)["starts"]


def stretches(rows: str, starts: str) -> Column:
    """The array ``rows`` as arrays that begin at ``starts``, counted from 1."""
    ends = lambda k: F.coalesce(F.get(starts, k + 1), F.size(rows) + 1)
    return F.transform(starts, lambda s, k: F.slice(rows, s, ends(k) - s))


def mean_lines(df: DataFrame, group: list[str], order: list[str], at: str, key: str, tolerance: str, name: str = "line") -> DataFrame:
    """``df`` with the number of the line that each row is in, as line_starts(); ``order`` begins with ``at``, ``key`` tells ties apart."""
    if order[0] != at:
        raise ValueError("rows must be in the order of the axis that makes lines")
    first = list(dict.fromkeys([*order, key]))
    row = F.struct(*first, *[c for c in df.columns if c not in (*group, *first)])
    rows = df.groupBy(*group).agg(F.sort_array(F.collect_list(row)).alias("_rows"), F.max(tolerance).cast("double").alias("_t"))
    rows = rows.withColumn("_starts", line_starts(F.col("_rows"), at, F.col("_t")))
    lines = rows.select(*group, F.posexplode(stretches("_rows", "_starts")).alias(name, "_l")).select(*group, name, F.explode("_l").alias("_c"))
    return lines.select(*[c if c in group else F.col("_c")[c].alias(c) for c in df.columns], name)


def merged_runs(df: DataFrame, group: str, start: str, end: str, size: Column, ratio: float = V.PHRASE_RATIO) -> DataFrame:
    """(group, run, start, end, n): intervals join their predecessors while the gap to what is merged
    so far lies in [-0.2 size, ratio size]."""
    w = Window.partitionBy(group).orderBy(start, end)
    gap = F.col(start) - F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(((gap < V.PHRASE_OVERLAP * size) | (gap > ratio * size)).cast("int"), F.lit(0))
    runs = df.withColumn("_new", fresh).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(group, "run").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n"))


def unrepeated(df: DataFrame, group: list[str], text: str, exempt: Column | None = None) -> DataFrame:
    """Rows whose text occurs once in its group; exempt rows stay."""
    once = F.count("*").over(Window.partitionBy(*group, text)) == 1
    return df.withColumn("_once", once if exempt is None else once | exempt).where("_once").drop("_once")


def between_exists(df: DataFrame, group: str, order: str, is_label: Column, is_amount: Column) -> DataFrame:
    """``df`` with ``separator``: a label with another label strictly between it and the next amount."""
    after = Window.partitionBy(group).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    marked = df.withColumns({"_amount": F.min(F.when(is_amount, F.col(order))).over(after), "_label": F.min(F.when(is_label, F.col(order))).over(after)})
    return marked.withColumn("separator", is_label & F.coalesce(F.col("_label") < F.coalesce("_amount", F.lit(2**31)), F.lit(False))).drop("_amount", "_label")


def following_count(df: DataFrame, group: str, line: str, flag: Column, name: str) -> DataFrame:
    """(group, line, name): how many rows with the flag stand in later lines."""
    lines = df.groupBy(group, line).agg(F.count_if(flag).alias("_n"))
    below = Window.partitionBy(group).orderBy(F.desc(line)).rowsBetween(Window.unboundedPreceding, -1)
    return lines.select(group, line, F.coalesce(F.sum("_n").over(below), F.lit(0)).alias(name))


def row_pitch(df: DataFrame, group: str, at: str, height: Column) -> DataFrame:
    """(group, pitch, reach): the upper median of the gaps between rows, and how far a label may be away.

    Gaps between rows are those from the first jump of the sorted gaps on; without a jump the pitch is four heights.
    """
    w, s = Window.partitionBy(group).orderBy(at), Window.partitionBy(group).orderBy("_gap")
    gaps = df.select(group, (F.col(at) - F.lag(at).over(w)).alias("_gap")).where("_gap > 0")
    wide = gaps.join(gap_split(df, group, at), group).where("_gap >= threshold")
    ranked = wide.withColumns({"_k": F.row_number().over(s), "_n": F.count("*").over(Window.partitionBy(group))})
    middle = ranked.where("_k = floor(_n / 2) + 1").select(group, F.col("_gap").alias("_pitch"))
    heights = df.groupBy(group).agg(F.max(height).alias("_h")).join(middle, group, "left")
    pitch = F.coalesce("_pitch", F.col("_h") * V.PITCH_HEIGHTS)
    return heights.select(group, pitch.alias("pitch"), F.greatest(F.col("_h") * V.PITCH_LEAST, pitch * V.PITCH_SHARE).alias("reach"))


def gap_shares(df: DataFrame, group: str, start: str, end: str, size: str) -> DataFrame:
    """Every interval but its group's first with ``share``: the gap to the one before, by the larger of both sizes."""
    w = Window.partitionBy(group).orderBy(start, end)
    gap = F.col(start) - F.lag(end).over(w)
    larger = F.greatest(F.col(size), F.lag(size).over(w), F.lit(1))
    return df.withColumn("share", F.try_divide(gap, larger)).where("share is not null")


def most_frequent(df: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """(group, value, n): the most frequent value of a group; of equal ones that which comes first."""
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    best = F.max_by(F.struct(value, "n"), F.struct("n", (-F.col("_first")).alias("f")))
    return counts.groupBy(group).agg(best.alias("_b")).select(group, f"_b.{value}", "_b.n")


def reading_text(df: DataFrame, group: list[str], order: list[str], text: str) -> DataFrame:
    """(group, text): the texts of a group, a screen, in reading order with a space between them."""
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_text"))))
    return df.where(F.col(text).isNotNull()).groupBy(*group).agg(F.array_join(F.transform(parts, lambda p: p["_text"]), " ").alias(text))
