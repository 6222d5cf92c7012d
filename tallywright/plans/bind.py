"""From text boxes to typed rows of any screen, with the screen's own total and label.

A screen with a header gives the rows of its table (``headered``), one without the rows of its list (``screens``). The
screen's total comes first from a row that is named like one, then from a card above the rows, then from an amount
above them that equals their sum. Boxes are (batch_id, file, box_id, text, x, y, w, h).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.functions import numbers as N
from tallywright.functions import text as S
from tallywright.functions import vocabulary as V
from tallywright.plans import headered, screens, sheets
from tallywright.sources.scratch import stored

SCREEN = ["batch_id", "file"]
# The name of a row that gives its screen's own total, how sure a bound row is, and the letters from which a
# card's word may go on.
SCREEN_TOTAL, SURE, CARD_LETTERS = "__screen_total__", 0.95, 3
ROW_FIELDS = ("row", "name", "qty", "value", "cost", "pnl", "price", "account")
ROWS = "array<struct<row:bigint,name:string,qty:double,value:double,cost:double,pnl:double,price:double,account:string>>"


def _bare(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\(.*?\)", ""), " ", ""))


def is_card_label(text: Column) -> Column:
    """A word of CARD_TOTALS, remarks and spaces dropped; longer words may go on, as accounts are named behind them."""
    words = [w.replace(" ", "") for w in V.CARD_TOTALS]
    goes_on = [F.startswith(_bare(text), F.lit(w)) for w in words if len(w) >= CARD_LETTERS]
    return F.exists(F.array(_bare(text).isin(*words), *goes_on), lambda hit: hit)


def top_lines(b: DataFrame, columns: DataFrame) -> DataFrame:
    """(screen, rank, cells): the first TOP_LINES lines, those above the header where there is one, with their boxes from the left."""
    # Ranked by windows over one shuffle; cells are only read and collected where the line is one of the first.
    own = b.select(*SCREEN, "line", "x", "box_id", "text", "cy").hint("merge").join(columns.select(*SCREEN, "header_y"), SCREEN, "left")
    own = own.withColumn("low", F.max("cy").over(Window.partitionBy(*SCREEN, "line"))).where(F.col("header_y").isNull() | (F.col("low") < F.col("header_y")))
    near = own.withColumn("rank", F.dense_rank().over(Window.partitionBy(*SCREEN).orderBy("line")) - 1).where(F.col("rank") < V.TOP_LINES)
    cell = F.struct("x", "box_id", F.col("text"), N.cell_number(F.col("text")).alias("amount"), is_card_label(F.col("text")).alias("label"))
    return near.groupBy(*SCREEN, "rank").agg(F.sort_array(F.collect_list(cell)).alias("cells"))


def card_totals(top: DataFrame) -> DataFrame:
    """(screen, total): the first card in the top lines: a label and an amount beside it, or alone on the next line."""
    nxt = F.lead("cells").over(Window.partitionBy(*SCREEN).orderBy("rank"))
    with_next = top.withColumn("next", nxt)
    label = F.array_position(F.transform("cells", lambda c: c["label"]), F.lit(True)) - 1
    beside = F.get(F.filter(F.transform("cells", lambda c, i: F.when(i != label, c["amount"])), lambda a: a.isNotNull()), F.lit(0))
    alone = F.when(F.size("next") == 1, F.get("next", F.lit(0))["amount"])
    found = with_next.where(label >= 0).select(*SCREEN, "rank", F.coalesce(beside, alone).alias("total")).where(S.truthy(F.col("total")))
    return found.groupBy(*SCREEN).agg(F.min_by("total", "rank").alias("total"))


def _card(lines: str) -> Column:
    """card_totals() of one screen's lines of (amount, label)."""

    def card(line: Column, i: Column) -> Column:
        label = F.array_position(F.transform(line, lambda c: c["label"]), F.lit(True)) - 1
        beside = _first(F.filter(F.transform(line, lambda c, k: F.when(k != label, c["amount"])), lambda a: a.isNotNull()))
        below = F.get(lines, i + 1)
        return F.when(label >= 0, F.coalesce(beside, F.when(F.size(below) == 1, _first(below)["amount"])))

    return _first(F.filter(F.transform(lines, card), S.truthy))


def _first(found: Column) -> Column:
    return F.get(found, F.lit(0))


def _table_rows() -> Column:
    """ROWS of a screen with a header, from what ``sheets.read`` gives."""

    def told(r: Column) -> Column:
        v = headered.typed(r["name"], r["shares"], {k: r[k] for k in headered.FIELDS})
        return F.struct(r["row"].alias("row"), *[v[k].alias(k) for k in ("name", "qty", "value", "cost", "pnl", "price", "cost_unit")], r["value"].isNotNull().alias("valued"))

    def worked_out(r: Column) -> Column:
        s = N.screen_arithmetic(r["qty"], r["cost_unit"], r["price"], r["value"])
        value, cost = F.round(s["value"], 2).alias("value"), F.coalesce(r["cost"], F.round(s["cost"], 2)).alias("cost")
        return F.struct(r["row"].alias("row"), r["name"].alias("name"), r["qty"].alias("qty"), value, cost, r["pnl"].alias("pnl"), r["price"].alias("price"), F.lit(None).cast("string").alias("account"))

    kept = F.filter(F.transform("rows", told), lambda r: (r["name"] != "") | r["valued"])
    return F.transform(kept, worked_out).cast(ROWS)


def _list_rows(read: DataFrame) -> DataFrame:
    """(screen, rows) of screens without a header."""
    lists = screens.placed_list_rows(read.where("not framed").select(*SCREEN, F.inline("boxes")))
    nothing = F.lit(None).cast("double")
    row = F.struct("row", "name", "qty", "value", nothing.alias("cost"), "pnl", nothing.alias("price"), "account")
    return lists.groupBy(*SCREEN).agg(F.sort_array(F.collect_list(row)).cast(ROWS).alias("rows"))


def _coherent(rows: str) -> Column:
    """Rows as ``totals.coherent`` keeps them: those of accounts, or those of categories, where they are two and half of all."""
    flags = lambda r: [F.size(S.account_tokens(r["name"])) > 0, S.is_category(r["name"])]
    marked = F.transform(rows, lambda r: F.struct(r.alias("r"), *[F.coalesce(f, F.lit(False)).alias(k) for k, f in zip("ac", flags(r), strict=True)]))

    def chosen(m: Column) -> Column:
        n = {"a": F.filter(m, lambda x: x["a"]), "c": F.filter(m, lambda x: x["c"])}
        most = lambda k: (F.size(n[k]) >= 2) & (F.size(n[k]) * 2 >= F.size(m))
        return F.transform(F.when(most("a"), n["a"]).when(most("c"), n["c"]).otherwise(m), lambda x: x["r"])

    return F.transform(F.array(marked), chosen)[0]


def bind(boxes: DataFrame) -> DataFrame:
    """(screen, row_no, broker, accountType, name, assetClass, currency, qty, price, value, cost, pnl, confidence) of boxes in any order, as ``bound``."""
    return bound(sheets.by_screen(boxes))


def bound(pieces: DataFrame) -> DataFrame:
    """bind() of (screen, cells), where a screen's rows lie behind each other in one partition.

    Rows of one screen that are mostly accounts, or mostly categories, are only those. A row that is named like a
    figure of the screen is no holding; one named like a value gives the screen's total, as ``SCREEN_TOTAL``.
    Where a row has the account line above it, that is its broker and account type; else the screen's label.
    A screen is one row from the reading on; only boxes of screens without a header are rows again.
    """
    read = stored(sheets.read(pieces), "read")
    facts = ["label", "firms", "top"]
    table = read.where("framed").select(*SCREEN, *facts, _table_rows().alias("rows"))
    lists = read.where("not framed").select(*SCREEN, *facts).hint("merge").join(_list_rows(read), SCREEN, "left")
    s = table.unionByName(lists.withColumn("rows", F.coalesce("rows", F.array().cast(ROWS))))
    s = s.withColumn("rows", _coherent("rows"))
    named = lambda r: F.struct(*[(F.trim(r[k]) if k == "name" else r[k]).alias(k) for k in ROW_FIELDS], S.is_field_label(F.trim(r["name"])).alias("figure"))
    s = s.withColumn("rows", F.transform(F.filter("rows", lambda r: F.length(F.trim(r["name"])) >= 2), named))
    own = F.filter("rows", lambda r: r["figure"] & F.trim(F.regexp_replace(r["name"], r"\(.*?\)", "")).isin(*V.HEADERS["value"]) & r["value"].isNotNull())
    own = F.array_min(F.transform(own, lambda r: F.struct(r["row"].alias("row"), r["value"].alias("value"))))["value"]
    cells = F.transform("top", lambda line: F.transform(line, lambda c: F.struct(N.cell_number(c).alias("amount"), is_card_label(c).alias("label"))))
    s = s.select(*SCREEN, "label", "firms", "top", own.alias("own"), F.filter("rows", lambda r: ~r["figure"]).alias("rows"), cells.alias("cells"))
    valued = F.filter(F.transform("rows", lambda r: r["value"]), S.truthy)
    s = s.withColumn("_sum", F.when(F.size(valued) >= 2, F.aggregate(valued, F.lit(0.0), lambda a, v: a + v)))
    near = F.filter(F.transform(F.flatten("cells"), lambda c: c["amount"]), lambda a: S.truthy(a) & (F.abs(a - F.col("_sum")) <= V.SUM_MATCH * F.col("_sum")) & (F.col("_sum") > 0))
    total = F.coalesce("own", _card("cells"), _first(near))
    head = F.array_join(F.flatten("top"), " ")
    broker = S.blank_to_null(F.trim(F.concat_ws(" ", S.canonical_broker(F.col("firms")), "label")))
    kind = F.coalesce(S.known_account_type(F.col("label")), S.known_account_type(head))
    s = s.select(*SCREEN, "rows", total.alias("_total"), broker.alias("_broker"), kind.alias("_type"))
    fixed = {"name": F.lit(SCREEN_TOTAL), "value": F.col("_total"), "row": F.lit(-1)}
    last = F.when(F.col("_total").isNotNull(), F.array(F.struct(*[fixed.get(k, F.lit(None)).alias(k) for k in ROW_FIELDS], F.lit(True).alias("figure"))))
    of = "array<struct<" + ROWS[len("array<struct<") : -2] + ",figure:boolean>>"
    rows = s.select(*SCREEN, "_broker", "_type", F.inline(F.concat(F.col("rows").cast(of), F.coalesce(last.cast(of), F.array().cast(of)))))
    told = lambda c: F.when(~F.col("figure"), c)
    return rows.select(
        *SCREEN, F.col("row").alias("row_no"), told(F.coalesce("account", "_broker")).alias("broker"), told(F.coalesce(S.known_account_type(F.col("account")), "_type")).alias("accountType"),
        "name", told(S.asset_class(F.col("name"))).alias("assetClass"), F.lit(None).cast("string").alias("currency"), "qty", "price", "value", "cost", "pnl", F.lit(SURE).alias("confidence"),
    )
