"""From the raw records of many screens to reconciled holdings, checks and warnings.

Screens are (batch_id, file, screen_no, raw, evidence, fname). Screens of one batch belong together; batches are independent,
so every step is keyed by batch or by screen and distributes over both.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.functions import numbers as N
from tallywright.functions import text as S
from tallywright.functions import vocabulary as V
from tallywright.operators import matching, merge, totals
from tallywright.sources import records
from tallywright.sources.scratch import cut

#: Fixed value: the name of a row that gives its screen's own total.
SCREEN_TOTAL = "__screen_total__"
SCREEN = ["batch_id", "file"]


@dataclass
class Reconciled:
    """What a batch of screens comes to; each a DataFrame over steps that are checkpointed, so nothing stays in executors."""

    holdings: DataFrame
    checks: DataFrame
    warnings: DataFrame


def typed_rows(screens: DataFrame) -> DataFrame:
    """One row per record, in the order of screens and records, with its account tokens."""
    rows = screens.select(*SCREEN, "screen_no", F.posexplode(records.rows(F.col("raw"))).alias("row_no", "r")).select(*SCREEN, "screen_no", "row_no", "r.*")
    text = F.concat_ws(" ", "broker", "accountType", "name")
    return rows.withColumns({"tokens": S.account_tokens(text), "pos": F.struct("screen_no", "row_no")})


def screen_kinds(screens: DataFrame, rows: DataFrame) -> DataFrame:
    """(batch_id, file, class) of every screen, empty ones too."""
    named = rows.where(~F.coalesce(F.col("name") == SCREEN_TOTAL, F.lit(False))).withColumn("_s", F.struct(*SCREEN))
    kinds = totals.classified(screens.select(F.struct(*SCREEN).alias("_s")), named, "_s", S.is_category(F.col("name")), "tokens")
    return kinds.select("_s.*", "class")


def reference_totals(rows: DataFrame) -> DataFrame:
    """(batch_id, total_pos, kind, key, tokens, total, tainted) of summary screens, product totals first.

    Of a category that occurs twice the last value counts. A total that is negative, or equal to its
    own profit, is no reference.
    """
    tainted = (F.col("total") < 0) | F.coalesce((F.abs(F.col("total") - F.col("pnl")) < 1) & (F.col("pnl") != 0), F.lit(False))
    products = (
        rows.where((F.col("class") == "product_summary") & S.is_category(F.col("name")))
        .groupBy("batch_id", F.trim("name").alias("key"))
        .agg(F.max_by("value", "pos").alias("total"), F.max_by("pnl", "pos").alias("pnl"), F.min("pos").alias("pos"))
        .select("batch_id", F.lit("product").alias("kind"), "key", F.array().cast("array<string>").alias("tokens"), "total", "pnl", "pos", F.lit(None).cast("string").alias("nick"))
    )
    # A balance in the quantity's place is one in the wrong slot.
    value = F.when(~S.truthy(F.col("value")) & S.truthy(F.col("qty")), F.col("qty")).otherwise(F.col("value"))
    accounts = rows.where(F.col("class") == "account_summary").select(
        "batch_id", F.lit("account").alias("kind"), S.account_type(F.concat_ws(" ", "accountType", "name")).alias("key"), "tokens", value.alias("total"), "pnl", "pos",
        F.concat_ws(" ", "broker", "accountType", "name").alias("nick"),
    )
    order = Window.partitionBy("batch_id").orderBy(F.col("kind") == "account", "pos", "key")
    both = products.unionByName(accounts).where(F.col("total").isNotNull())
    return both.withColumns({"total_pos": F.row_number().over(order).cast("long"), "tainted": tainted}).drop("pos", "pnl")


def uncovered_cash(accounts: DataFrame, held: DataFrame) -> DataFrame:
    """Holdings made of cash accounts: those named as cash whose type no holding of the batch (batch_id, accountType) has.

    ``accounts`` is (batch_id, total_pos, key, nick, total), ``key`` being the account type. What an account of another
    name holds is not known, so it makes no holding.
    """
    named = F.coalesce(S.holds_any(F.col("nick"), V.CASH_ACCOUNT_WORDS), F.lit(False))
    covered = held.select("batch_id", F.col("accountType").alias("key")).distinct()
    open_to = accounts.where(named & S.truthy(F.col("total"))).join(covered, ["batch_id", "key"], "left_anti")
    inner = F.coalesce(S.blank_to_null(F.trim(F.regexp_extract("nick", r"\[([^\]]+)\]", 1))), F.col("key"))
    return open_to.select("batch_id", "total_pos", F.concat(F.lit("현금("), inner, F.lit(")")).alias("name"), F.col("key").alias("accountType"), S.canonical_broker(F.col("nick")).alias("broker"), F.col("total").alias("value"))


def details(rows: DataFrame) -> DataFrame:
    """Rows of detail screens that are holdings: with a value, each value once, without total rows."""
    own = rows.where((F.col("class") == "detail") & S.truthy(F.col("value")) & ~F.col("name").eqNullSafe(SCREEN_TOTAL) & ~F.coalesce(S.is_field_label(F.col("name")), F.lit(False)))
    return totals.without_total_rows(totals.first_per_value(own, SCREEN, F.col("value"), ["pos"]), SCREEN, "value")


def inherited(rows: DataFrame, screens: DataFrame, accounts: DataFrame) -> DataFrame:
    """Account types of detail screens from the account whose tokens they share most."""
    texts = screens.select(F.struct(*SCREEN).alias("_s"), S.account_tokens(F.concat_ws(" ", "evidence", "raw")).alias("t"))
    tagged = lambda c: F.transform(c, lambda t: F.concat_ws("|", F.col("batch_id"), t))
    left = texts.select("_s", F.transform("t", lambda t: F.concat_ws("|", F.col("_s.batch_id"), t)).alias("t"))
    right = accounts.where("kind = 'account'").select(F.concat_ws("|", "batch_id", F.lpad(F.col("total_pos").cast("string"), 9, "0")).alias("account"), F.col("key"), tagged("tokens").alias("t"))
    # Ties go to the first account; ids are texts here, so their order is turned into a number.
    numbered = right.withColumn("n", F.split_part("account", F.lit("|"), F.lit(-1)).cast("long")).drop("account")
    best = matching.best_overlap(left, numbered, "_s", "n", "t").select("_s.*", F.col("n").alias("total_pos"))
    types = best.join(accounts.select("batch_id", "total_pos", F.col("key").alias("inherited")), ["batch_id", "total_pos"]).select(*SCREEN, "inherited")
    return rows.join(types, SCREEN, "left")


def broker_ladder(rows: DataFrame) -> DataFrame:
    """Broker of every row: its own, the one in the screen's text, the screen's brand, the file's; with its source.

    A broker that the evidence does not hold is no broker.
    """
    own = S.canonical_broker(F.col("broker"))
    held = F.when(S.supported(own, F.col("evidence")), own)
    rungs: list[tuple[Column, str]] = [
        (held, "screen"),
        (S.canonical_broker(F.col("evidence")), "screen"),
        (F.when(S.supported(F.col("broker"), F.col("evidence")), S.brand_token(F.col("broker"))), "brand"),
        (S.file_brand(F.col("fname")), "filename"),
    ]
    picked = F.coalesce(*[F.when(c.isNotNull(), F.struct(c.alias("broker"), F.lit(src).alias("src"))) for c, src in rungs])
    return rows.withColumn("_b", picked).withColumns({"broker": F.col("_b.broker"), "broker_src": F.col("_b.src")}).drop("_b")


def own_totals(rows: DataFrame) -> DataFrame:
    """(screen, own_total): what a screen says of its own sum, in rows named SCREEN_TOTAL; the last one counts."""
    named = rows.where(F.col("name").eqNullSafe(SCREEN_TOTAL))
    return named.groupBy(*SCREEN).agg(F.max_by("value", "pos").alias("own_total")).where(S.truthy(F.col("own_total")))


def without_echoes(rows: DataFrame, products: DataFrame, own: DataFrame) -> DataFrame:
    """Rows without the other names of one deposit on its screen, where a total tells which of them is the asset."""
    name = F.trim(F.coalesce("name", F.lit("")))
    screen = F.struct(*[F.col(c) for c in SCREEN])
    known = rows.select(*SCREEN).distinct().join(products.where("kind = 'product'").select("batch_id", "total"), "batch_id").unionByName(own.select(*SCREEN, F.col("own_total").alias("total")))
    marked = rows.withColumns({"_s": screen, "_pos": F.col("pos.row_no")})
    cash = F.contains(name, F.lit("예수금")) | name.isin(*V.DEPOSIT_ECHOES)
    return totals.deposit_echoes_dropped(marked, known.select(screen.alias("_s"), "total"), "_s", "_pos", "value", cash).drop("_s", "_pos")


def unsupported_names(rows: DataFrame) -> DataFrame:
    """Rows whose screen's text, where there is one, does not hold their name."""
    return rows.where(F.col("name").isNotNull() & ~F.coalesce(S.supported(F.col("name"), F.col("evidence")), F.lit(True)))


def reconcile(screens: DataFrame) -> Reconciled:
    """Holdings, checks against totals, and warnings as codes with their screen.

    Each screen is held against its own total, where it gives one, and against the summaries' totals; after that
    captures of one holding merge by the strongest key they have. Cash accounts that no screen details become holdings.
    """
    rows = typed_rows(screens)
    kinds = screen_kinds(screens, rows)
    rows = cut(rows.join(kinds, SCREEN))
    refs = cut(reference_totals(rows))
    good = refs.where("not tainted")
    own = own_totals(rows)
    found = without_echoes(details(rows), good, own)
    found = inherited(found, screens, good).join(screens.select(*SCREEN, "evidence", "fname"), SCREEN)
    found = broker_ladder(found).withColumn("app", S.file_brand(F.col("fname")))
    canonical = (F.col("broker_src") == "screen") & S.canonical_broker(F.col("broker")).isNotNull()
    found = matching.consensus_filled(found, ["batch_id", "app"], "broker", "broker_src", canonical, F.col("broker_src") == "brand", "filename")
    found = found.withColumns(
        {
            "accountType": F.coalesce("inherited", S.account_type(F.concat_ws(" ", "accountType", "broker"))),
            "currency": F.coalesce("currency", F.lit("KRW")),
            "assetClass": F.coalesce("assetClass", S.asset_class(F.col("name"))),
        }
    )
    found = cut(found)
    sums = found.groupBy("batch_id", "file").agg(F.min("screen_no").cast("long").alias("pos"), F.sum("value").alias("amount"))
    confirmed = sums.join(own, SCREEN).withColumn("ok", N.within(F.col("amount"), F.col("own_total"), V.CROSS_CHECK))
    confirmed = cut(confirmed.select(*SCREEN, "pos", "amount", "own_total", "ok"))
    matches = cut(matching.greedy_match(sums, good.select("batch_id", "total_pos", "total"), "batch_id"))
    checks = matches.join(sums.select("batch_id", "pos", "file"), ["batch_id", "pos"])
    cash = uncovered_cash(good.where("kind = 'account'"), found).withColumn("value_src", F.lit("account balance"))
    left = matching.unmatched_totals(good.join(cash.select("batch_id", "total_pos"), ["batch_id", "total_pos"], "left_anti"), matches, "batch_id")
    fields = ["assetClass", "currency", "qty", "price", "value", "cost", "pnl", "broker_src"]
    digits = F.filter("tokens", lambda t: t.rlike(r"^\d"))
    captures = found.join(confirmed.select(*SCREEN, "ok"), SCREEN, "left").select(
        "batch_id", S.bare_name(F.col("name")).alias("_name"), "file", digits.alias("tokens"), "broker", F.col("accountType").alias("kind"), "ok",
        (F.col("pos.screen_no").cast("long") * 1_000_000 + F.col("pos.row_no")).alias("pos"), "name", *fields,
    )
    merged = cut(merge.captures_merged(captures, ["batch_id", "_name"], fields, filled=("qty", "price", "cost", "pnl", "currency", "assetClass")))
    shown = ["batch_id", "accountType", "conflict", "suspect", "name", "broker", "broker_src", "assetClass", "currency", "qty", "price", "value", "cost", "pnl", "captures", "file"]
    made = cash.select(
        "batch_id", "accountType", *[F.lit(False).alias(c) for c in ("conflict", "suspect")], "name", "broker", F.when(F.col("broker").isNotNull(), "screen").alias("broker_src"),
        F.lit("현금").alias("assetClass"), F.lit("KRW").alias("currency"), *[F.lit(None).cast("double").alias(c) for c in ("qty", "price")], "value",
        *[F.lit(None).cast("double").alias(c) for c in ("cost", "pnl")], F.lit(1).cast("long").alias("captures"), F.lit(None).cast("string").alias("file"),
    )
    holdings = cut(merged.withColumnRenamed("kind", "accountType").select(shown).unionByName(made.select(shown)))
    warn = lambda df, code, file: df.select("batch_id", F.lit(code).alias("code"), file.alias("file"))
    none = F.lit(None).cast("string")
    # A screen's own total says more than that no other one fits.
    alone = checks.join(confirmed.select(*SCREEN), SCREEN, "left_anti").where("not matched")
    warnings = (
        warn(kinds.where("class = 'empty'"), "EMPTY_SCREEN", F.col("file"))
        .unionByName(warn(refs.where("tainted and kind = 'product'"), "BAD_PRODUCT_TOTAL", none))
        .unionByName(warn(refs.where("tainted and kind = 'account'"), "BAD_ACCOUNT_TOTAL", none))
        .unionByName(warn(confirmed.where("not ok"), "SCREEN_TOTAL_MISMATCH", F.col("file")))
        .unionByName(warn(alone.where("total is not null"), "SUM_NEAR_TOTAL", F.col("file")))
        .unionByName(warn(alone.where("total is null"), "NO_TOTAL_TO_CHECK", F.col("file")))
        .unionByName(warn(left, "UNMATCHED_TOTAL", F.col("key")))
        .unionByName(warn(unsupported_names(found), "UNSUPPORTED_NAME", F.col("name")))
        .unionByName(warn(holdings.where("conflict"), "VALUE_CONFLICT", F.col("name")))
        .unionByName(warn(holdings.where("suspect"), "DUPLICATE_SUSPECT", F.col("name")))
        .unionByName(warn(holdings.where("broker_src in ('brand', 'filename')"), "NONCANONICAL_BROKER", F.col("name")))
        .unionByName(warn(holdings.where("broker is null"), "UNKNOWN_BROKER", F.col("name")))
    )
    return Reconciled(holdings, checks, warnings.distinct())
