"""From text boxes to rows of a table with stacked headers.

A header cell may hold two words above each other ("value" over "cost"); below, the cells of a row are stacked in the
same order. Boxes are as ``screens.placed`` gives them. All steps are windows, aggregates and equi-joins by screen;
row windows are met by buckets of their height, so nothing is compared with all rows of a screen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.functions import numbers as N
from tallywright.functions import text as S
from tallywright.functions import vocabulary as V
from tallywright.operators import asof, sequences
from tallywright.sources.scratch import stored

SCREEN = ["batch_id", "file"]
# Hits and amounts that make a line a header, the name column's share of the width, the row window in
# heights where rows have no pitch of their own, and its share of the pitch where they have.
HITS, BELOW, NAME_SHARE, WINDOW_HEIGHTS, WINDOW_SHARE = 2, 2, 0.42, 1.3, 0.5
FIELDS = ("qty", "value", "cost", "pnl", "price", "cost_unit", "rate")


def header_lines(b: DataFrame) -> DataFrame:
    """(screen, line, low, edge): the first line that is a header, and the line below if it belongs to it.

    A header has two exact header words or more and two amounts or more somewhere below; a navigation bar has none.
    The next line is part of it if it holds a header word and no amount. ``low`` is the line's lowest middle, ``edge`` the
    name column's share of the width. Boxes are only counted by line.
    """
    lines = b.groupBy(*SCREEN, "line").agg(
        F.count_if(S.is_header(F.col("text"))).alias("hits"), F.count_if(N.amount(F.col("text")).isNotNull()).alias("amounts"), F.max("cy").alias("low"),
        F.max(F.col("x0") + NAME_SHARE * F.col("span")).alias("edge"),
    )
    screen, down = Window.partitionBy(*SCREEN), Window.partitionBy(*SCREEN).orderBy("line")
    below = F.coalesce(F.sum("amounts").over(down.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    joins = (F.lead("hits").over(down) >= 1) & (F.lead("amounts").over(down) == 0)
    seen = lines.withColumns({"below": below, "next": F.when(joins, F.lead("line").over(down))})
    first = F.min(F.when((F.col("hits") >= HITS) & (F.col("below") >= BELOW), F.struct("line", "next"))).over(screen)
    mine = (F.col("line") == F.col("_h.line")) | F.coalesce(F.col("line") == F.col("_h.next"), F.lit(False))
    return seen.withColumn("_h", first).where(mine).select(*SCREEN, "line", "low", "edge")


def bands(marks: DataFrame, group: list[str], right: str, kind: str, order: list[str], reach: Column) -> DataFrame:
    """(group, band, anchor, kinds): header marks in columns by their right edges, kinds from top to bottom.

    A mark joins the column while its right edge is less than ``reach`` from the column's first mark; that first mark
    stays the anchor, so a column cannot drift. The fold goes over the header cells of one group, which are few.
    ``order`` is where a mark stands from top to bottom.
    """
    rows = marks.groupBy(*group).agg(
        F.sort_array(F.collect_list(F.struct(F.col(right).cast("double").alias("right"), F.struct(*order).alias("o"), F.col(kind).alias("kind")))).alias("m"), F.max(reach).alias("reach")
    )
    order_type = marks.select(F.struct(*order)).schema[0].dataType.simpleString()
    kind_of = f"struct<anchor:double,n:int,out:array<struct<band:int,anchor:double,o:{order_type},kind:string>>>"

    def put(acc: Column, m: Column) -> Column:
        fresh = F.coalesce(F.abs(m["right"] - acc["anchor"]) >= F.col("reach"), F.lit(True))
        at = F.struct(F.when(fresh, m["right"]).otherwise(acc["anchor"]).alias("anchor"), F.when(fresh, acc["n"] + 1).otherwise(acc["n"]).alias("n"))
        made = lambda a: F.struct(a["anchor"], a["n"], F.concat(acc["out"], F.array(F.struct(a["n"].alias("band"), a["anchor"].alias("anchor"), m["o"], m["kind"]))).alias("out"))
        return F.transform(F.array(at), made)[0]

    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("n"), F.array().cast(kind_of[kind_of.index("out:") + 4 : -1]).alias("out"))
    marked = rows.select(*group, F.explode(F.aggregate("m", start, put)["out"]).alias("b")).select(*group, "b.*")
    kinds = F.transform(F.sort_array(F.collect_list(F.struct("o", "kind"))), lambda x: x["kind"])
    return marked.groupBy(*group, "band").agg(F.min("anchor").alias("anchor"), kinds.alias("kinds"))


def frames(b: DataFrame) -> DataFrame:
    """(screen, anchors, kinds, name_x1, header_y): the columns of every screen that has a header.

    ``anchors`` and ``kinds`` are arrays over the columns from the left; they are empty if no header word has a kind.
    """
    lines = stored(header_lines(b), "header-lines")
    marks = b.withColumns({"kind": S.header_kind(F.col("text")), "right": F.col("x") + F.col("w")}).where("kind is not null")
    marks = marks.select(*SCREEN, "line", "kind", "right", "cy", "x", "box_id", "h0").hint("merge").join(lines.select(*SCREEN, "line"), [*SCREEN, "line"])
    wide = marks.where("kind = 'name'").groupBy(*SCREEN).agg(F.max("right").alias("wide"))
    facts = lines.groupBy(*SCREEN).agg(F.floor(F.max("edge")).cast("double").alias("edge"), F.max("low").alias("header_y")).hint("merge").join(wide, SCREEN, "left")
    facts = facts.select(*SCREEN, F.greatest(F.col("wide").cast("double"), "edge").alias("name_x1"), "header_y")
    found = bands(marks, SCREEN, "right", "kind", ["cy", "line", "x", "box_id"], V.BAND_MERGE * F.col("h0"))
    by_band = F.sort_array(F.collect_list(F.struct("band", "anchor", "kinds")))
    columns = found.groupBy(*SCREEN).agg(by_band.alias("c")).select(*SCREEN, F.transform("c", lambda c: c["anchor"]).alias("anchors"), F.transform("c", lambda c: c["kinds"]).alias("kinds"))
    none = lambda kind: F.array().cast(kind)
    return facts.hint("merge").join(columns, SCREEN, "left").select(
        *SCREEN, F.coalesce("anchors", none("array<double>")).alias("anchors"), F.coalesce("kinds", none("array<array<string>>")).alias("kinds"), "name_x1", "header_y"
    )


def row_windows(amounts: DataFrame) -> DataFrame:
    """(screen, row, lo, hi): rows of the amounts in the last column, and the window of each.

    Rows part where the gap jumps: the sorted gaps' first value that is JUMP_RATIO times the one before it. Without a
    jump every ``depth`` amounts are a row. The window reaches half a pitch beyond, so never into the next row.
    """
    w = Window.partitionBy(*SCREEN).orderBy("cy", "line", "x", "box_id")
    marked = amounts.withColumns({"_new": (F.col("cy") - F.lag("cy").over(w) >= F.col("threshold")).cast("int"), "_k": F.row_number().over(w) - 1})
    by_gap = F.sum(F.coalesce("_new", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    row = F.when(F.col("threshold").isNull(), F.floor(F.col("_k") / F.col("depth"))).otherwise(by_gap)
    rows = marked.withColumn("row", row.cast("long")).groupBy(*SCREEN, "row").agg(F.min("cy").alias("y0"), F.max("cy").alias("y1"), F.max("reach").alias("reach"))
    return rows.select(*SCREEN, "row", (F.col("y0") - F.col("reach")).alias("lo"), (F.col("y1") + F.col("reach")).alias("hi"), "reach")


def in_windows(boxes: DataFrame, windows: DataFrame) -> DataFrame:
    """Every box with the rows in whose window its middle lies, met by buckets as high as the window of its screen reaches."""
    bucket = lambda c: F.floor(c / F.col("reach"))
    spread = windows.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("lo")), bucket(F.col("hi"))))).drop("reach")
    met = boxes.withColumn("_bucket", bucket(F.col("cy"))).drop("reach").hint("merge").join(spread, [*SCREEN, "_bucket"])
    return met.where(F.col("cy").between(F.col("lo"), F.col("hi"))).drop("_bucket")


def table_boxes(b: DataFrame, columns: DataFrame) -> DataFrame:
    """The boxes below the headers with their column, what they may be, and their screen's reach, by one shuffle.

    ``mine`` marks the amounts of the last column, ``is_cell`` other amounts and rates of columns that are no names,
    ``is_label`` texts left of the name column's end; boxes that are nothing of it are left out. ``threshold`` is the jump
    of gaps between the last column's amounts; it is null where there is none.
    """
    known = columns.where(F.size("anchors") > 0).select(*SCREEN, "anchors", "kinds", "name_x1", "header_y")
    body = b.select(*SCREEN, "line", "box_id", "text", "x", "cy", "h0", (F.col("x") + F.col("w")).alias("right"))
    body = body.hint("merge").join(known, SCREEN).where(F.col("cy") > F.col("header_y"))
    body = body.withColumns({"is_amount": N.amount(F.col("text")).isNotNull(), "band": asof.nearest_edge(F.col("anchors"), F.col("right"))})
    last = F.size("anchors") - 1
    depth = F.greatest(F.lit(1), F.size(F.get("kinds", last)))
    body = body.withColumns({"mine": F.coalesce(F.col("is_amount") & (F.col("band") == last), F.lit(False)), "depth": depth, "kinds": F.get("kinds", F.col("band"))})
    cell = (F.col("is_amount") | F.contains("text", F.lit("%"))) & ~(F.col("kinds") == F.array(F.lit("name")))
    body = body.withColumns({"is_cell": F.coalesce(cell, F.lit(False)), "is_label": F.coalesce(F.col("right") <= F.col("name_x1"), F.lit(False))})
    body = body.where(F.col("mine") | F.col("is_cell") | F.col("is_label"))
    body = body.select(*SCREEN, "line", "box_id", "text", "x", "cy", "h0", "band", "kinds", "depth", "mine", "is_cell", "is_label")
    body = sequences.with_jump(body, [*SCREEN, "mine"], ["cy", "line", "x", "box_id"], "cy")
    own = F.max(F.when(F.col("mine"), F.col("threshold"))).over(Window.partitionBy(*SCREEN))
    body = body.withColumn("threshold", own)
    return body.withColumn("reach", F.coalesce(F.col("threshold") * WINDOW_SHARE, WINDOW_HEIGHTS * F.col("h0"))).drop("gap", "h0")


def stacked(cells: DataFrame) -> DataFrame:
    """(screen, row, one text per field): the cells of a row's columns under their kinds, from top to bottom.

    A cell with a percent sign is the rate, whatever its place; the others take the other kinds in order, as far as
    both reach. Of a kind that occurs in two columns the right one counts.
    """
    place = F.struct("cy", "line", "x", "box_id")
    rate = F.contains("text", F.lit("%"))
    stacks = cells.groupBy(*SCREEN, "row", "band").agg(
        F.max("kinds").alias("kinds"),
        F.transform(F.sort_array(F.collect_list(F.when(~rate, F.struct(place.alias("o"), "text")))), lambda c: c["text"]).alias("plain"),
        F.min_by("text", F.when(rate, place)).alias("rate"),
    )
    others = F.filter("kinds", lambda k: k != "rate")
    both = F.least(F.size(others), F.size("plain"))
    pairs = F.zip_with(F.slice(others, 1, both), F.slice("plain", 1, both), lambda k, t: F.struct(k.alias("kind"), t.alias("text")))
    own = F.when(F.array_contains("kinds", "rate") & F.col("rate").isNotNull(), F.array(F.struct(F.lit("rate").alias("kind"), F.col("rate").alias("text"))))
    told = stacks.select(*SCREEN, "row", "band", F.posexplode(F.concat(pairs, F.coalesce(own, F.array().cast("array<struct<kind:string,text:string>>")))).alias("i", "c"))
    last = F.struct("band", "i")
    return told.groupBy(*SCREEN, "row").agg(*[F.max_by("c.text", F.when(F.col("c.kind") == k, last)).alias(k) for k in FIELDS])


def names(fragments: DataFrame) -> DataFrame:
    """(screen, row, name, shares): the texts of the name column in reading order, and the last quantity among them."""
    text = F.trim("text")
    shares = N.share_quantity(text)
    place = F.struct("cy", "x", "line", "box_id")
    parts = F.sort_array(F.collect_list(F.when(shares.isNull() & ~F.contains("text", F.lit("%")), F.struct(place.alias("o"), text.alias("t")))))
    name = F.trim(F.regexp_replace(F.array_join(F.transform(parts, lambda p: p["t"]), ""), r"\s+", " "))
    return fragments.groupBy(*SCREEN, "row").agg(name.alias("name"), F.max_by(shares, F.when(shares.isNotNull(), place)).alias("shares"))


def typed(name: Column, shares: Column, texts: dict[str, Column]) -> dict[str, Column]:
    """The fields of a row from its joined name, the quantity beside it, and its texts by field."""
    number = {k: N.cell_number(texts[k]) for k in FIELDS if k not in ("qty", "rate")}
    qty = F.coalesce(N.share_quantity(F.trim(shares)), N.share_quantity(F.trim(texts["qty"])), N.cell_number(texts["qty"]))
    return {"name": F.trim(F.regexp_replace(name, r"\s+", " ")), "qty": qty, **number, "rate": texts["rate"]}


def header_rows(b: DataFrame, columns: DataFrame) -> DataFrame:
    """(screen, row, name, qty, value, cost, pnl, price, cost_unit, rate) of screens with a header.

    ``b`` is as ``screens.placed`` gives it, ``columns`` as ``frames``. A row needs a name or a value. The name column
    is what ends left of its header; a quantity in it, "N shares", goes before one of a column.
    """
    body = stored(table_boxes(b, columns), "table-boxes")
    windows = stored(row_windows(body.where("mine").select(*SCREEN, "line", "box_id", "x", "cy", "depth", "threshold", "reach")), "row-windows")
    fields = stacked(in_windows(body.where("is_cell").select(*SCREEN, "line", "box_id", "text", "x", "cy", "reach", "band", "kinds"), windows))
    labels = names(in_windows(body.where("is_label").select(*SCREEN, "line", "box_id", "text", "x", "cy", "reach"), windows))
    rows = windows.select(*SCREEN, "row").hint("merge").join(fields, [*SCREEN, "row"], "left").join(labels.hint("merge"), [*SCREEN, "row"], "left")
    number = {k: N.cell_number(F.col(k)).alias(k) for k in FIELDS if k not in ("qty", "rate")}
    qty = F.coalesce("shares", N.share_quantity(F.trim("qty")), N.cell_number(F.col("qty"))).alias("qty")
    kept = rows.where((F.coalesce("name", F.lit("")) != "") | F.col("value").isNotNull())
    return kept.select(*SCREEN, "row", F.coalesce("name", F.lit("")).alias("name"), qty, *number.values(), "rate")
