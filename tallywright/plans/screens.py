"""From text boxes to rows of a list without a header: labels left, amounts right.

Boxes are (batch_id, file, box_id, text, x, y, w, h). All steps are windows and joins by screen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywright.functions import numbers as N
from tallywright.functions import text as S
from tallywright.functions import vocabulary as V
from tallywright.operators import asof, sequences

SCREEN = ["batch_id", "file"]
# Zones as shares of the screen's width, heights as multiples of the median height.
LABEL_ZONE, AMOUNT_ZONE, CHROME, REACH = 0.50, 0.45, 2.5, 1.6


def placed(boxes: DataFrame) -> DataFrame:
    """Boxes with their center, the screen's metrics and their line; without the status bar and lines of market indices.

    Metrics are h0, the upper median height, and x0, span and top, the left edge, width and top of what is there. A screen's
    boxes meet in one array by one shuffle; nothing is joined, as sizes of exploded rows are estimated far too low.
    """
    text = F.col("text")
    bar = text.rlike(r"^\d{1,2}:\d{2}") | F.contains(text, F.lit("%")) | (F.length(text) <= 6)
    own = [F.col(c) for c in boxes.columns if c not in (*SCREEN, "x", "box_id")]
    box = F.struct((F.col("y") + F.col("h") / 2).alias("cy"), "x", "box_id", *own, bar.alias("_bar"), S.is_index_line(text).alias("_index"))
    facts = boxes.where(F.col("batch_id").isNotNull() & F.col("file").isNotNull()).groupBy(*SCREEN).agg(
        N.upper_median(F.collect_list("h")).alias("h0"), F.min("x").alias("x0"), F.max(F.col("x") + F.col("w")).alias("_x1"), F.min("y").alias("top"), F.collect_list(box).alias("_all")
    )
    metrics = [F.greatest("h0", F.lit(1)).alias("h0"), "x0", F.greatest(F.col("_x1") - F.col("x0"), F.lit(1)).alias("span"), "top"]
    screens = facts.select(*SCREEN, *metrics, "_all")
    chrome = lambda c: (c["y"] < F.col("top") + CHROME * F.col("h0")) & c["_bar"]
    screens = screens.withColumn("_boxes", F.sort_array(F.filter("_all", lambda c: ~chrome(c)))).drop("_all")
    screens = screens.withColumn("_starts", sequences.line_starts(F.col("_boxes"), "cy", V.LINE_TOLERANCE * F.col("h0")))
    facts = [*SCREEN, "h0", "x0", "span", "top"]
    lines = screens.select(*facts, F.posexplode(sequences.stretches("_boxes", "_starts")).alias("line", "_l")).where(~F.exists("_l", lambda c: c["_index"]))
    names = [c for c in boxes.columns if c not in SCREEN]
    return lines.select(*facts, "line", F.explode("_l").alias("_c")).select(*SCREEN, *[F.col("_c")[c].alias(c) for c in names], *facts[2:], F.col("_c")["cy"].alias("cy"), "line")


def list_rows(boxes: DataFrame) -> DataFrame:
    """(screen, row, name, qty, value, pnl, account) per label that has an unsigned amount near it, numbered from the top."""
    return placed_list_rows(placed(boxes))


def placed_list_rows(b: DataFrame) -> DataFrame:
    """list_rows() of boxes that are placed already."""
    b = b.withColumns({"amount": N.amount(F.col("text")), "qty": N.share_quantity(F.col("text"))})
    signed = F.regexp_replace("text", r"\s", "").rlike(r"^[+\-]")
    account = F.size(S.account_tokens(F.col("text"))) > 0
    plain = F.col("amount").isNull() & F.col("qty").isNull() & (F.length(F.trim("text")) >= 2)
    widest = Window.partitionBy(*SCREEN, "line").orderBy(F.desc("w"), "box_id")
    labels = (
        b.where(plain & (F.col("x") < F.col("x0") + LABEL_ZONE * F.col("span")) & ~S.is_field_label(F.col("text")))
        .withColumn("_k", F.row_number().over(widest))
        .where("_k = 1")
        .withColumn("account", account)
    )
    labels = sequences.unrepeated(labels, SCREEN, "text", F.col("account"))
    labels = asof.carried_forward(labels, SCREEN, ["cy"], F.when(F.col("account"), F.col("text")), "holder").where("not account")
    reach = (REACH * F.col("h0")).alias("reach")
    right = labels.select(*SCREEN, "cy", F.struct("text", "cy", "holder").alias("label"))
    amounts = b.where(F.col("amount").isNotNull() & (F.col("x") + F.col("w") > F.col("x0") + AMOUNT_ZONE * F.col("span")))
    amounts = amounts.select(*SCREEN, "cy", "x", "amount", signed.alias("signed"), reach)
    near = asof.nearest_join(amounts, right, SCREEN, "cy", "label", float("inf")).where(F.col("distance") <= F.col("reach"))
    order = F.struct("cy", "x")
    free, marked = F.col("signed") == F.lit(False), F.col("signed")
    rows = near.groupBy(*SCREEN, "label").agg(
        F.array_sort(F.collect_list(F.when(free, F.struct(order.alias("o"), F.col("amount"))))).alias("_free"), F.min_by("amount", F.when(marked, order)).alias("_signed")
    )
    quantities = b.where("qty is not null").select(*SCREEN, "cy", "qty", "box_id", reach)
    counted = asof.nearest_join(quantities, right, SCREEN, "cy", "label", float("inf")).where(F.col("distance") <= F.col("reach"))
    first = counted.groupBy(*SCREEN, "label").agg(F.min_by("qty", F.struct("distance", "box_id")).alias("qty"))
    out = rows.where(F.size("_free") > 0).hint("merge").join(first, [*SCREEN, "label"], "left")
    number = F.row_number().over(Window.partitionBy(*SCREEN).orderBy(F.col("label.cy"), F.col("label.text"))) - 1
    return out.select(
        *SCREEN,
        number.cast("long").alias("row"),
        F.col("label.text").alias("name"),
        "qty",
        F.col("_free")[0]["amount"].alias("value"),
        F.coalesce("_signed", F.try_element_at("_free", F.lit(2))["amount"]).alias("pnl"),
        F.col("label.holder").alias("account"),
    )
