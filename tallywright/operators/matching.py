"""Joins that accept a match only where it is unique, nearest, best or still free."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.functions import vocabulary as V
from tallywright.functions.text import confusable_variants


def unique_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys occur once."""
    first = [F.first(c).alias(c) for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.count("*").alias("_n"), *first).where("_n = 1").drop("_n")


def fill_from_unique(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Null ``fields`` of ``left`` filled from right rows whose keys are unique there."""
    source = unique_rows(right.select(*keys, *fields), keys).select(*keys, *[F.col(f).alias(f"_{f}") for f in fields])
    joined = left.join(source, keys, "left")
    return joined.withColumns({f: F.coalesce(f, f"_{f}") for f in fields}).select(left.columns)


def best_overlap(left: DataFrame, right: DataFrame, left_id: str, right_id: str, tokens: str) -> DataFrame:
    """(left_id, right_id, overlap): the right row that shares most tokens, ties to the smaller id.

    An equi-join on tokens; tokens of either side are distinct per row.
    """
    a = left.select(left_id, F.explode(F.array_distinct(tokens)).alias("_t"))
    b = right.select(right_id, F.explode(F.array_distinct(tokens)).alias("_t"))
    shared = a.join(b, "_t").groupBy(left_id, right_id).agg(F.count("*").alias("overlap"))
    best = F.max_by(F.struct(right_id, "overlap"), F.struct("overlap", (-F.col(right_id)).alias("r")))
    return shared.groupBy(left_id).agg(best.alias("_b")).select(left_id, F.col(f"_b.{right_id}").alias(right_id), F.col("_b.overlap").alias("overlap"))


def unique_in_band(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, owner: str, tolerance: float) -> DataFrame:
    """``left`` with the one ``owner`` whose ``b`` lies within the tolerance of ``a``; null if several.

    Bands are relative to b. Both sides meet by key and by logarithmic bucket, so the join is an
    equi-join with a residual condition.
    """
    import math

    width = math.log1p(2 * tolerance)
    bucket = lambda c: F.floor(F.log(F.abs(c)) / width)
    near = right.where(F.col(b) != 0).withColumn("_bucket", F.explode(F.sequence(bucket(F.col(b)) - 1, bucket(F.col(b)) + 1)))
    at = left.withColumn("_row", F.struct(*left.columns)).withColumn("_bucket", bucket(F.col(a)))
    hits = (
        at.select("_row", "_bucket", *keys, F.col(a).alias("_a"))
        .join(near.select(*keys, "_bucket", F.col(b).alias("_b"), F.col(owner).alias("_owner")), [*keys, "_bucket"])
        .where(F.abs(F.col("_a") - F.col("_b")) / F.abs(F.col("_b")) <= tolerance)
        .groupBy("_row")
        .agg(F.collect_set("_owner").alias("_owners"))
    )
    joined = at.join(hits, "_row", "left")
    return joined.select(*left.columns, F.when(F.size("_owners") == 1, F.col("_owners")[0]).alias(owner))


def greedy_match(groups: DataFrame, totals: DataFrame, batch: str, tolerance: float = V.CROSS_CHECK) -> DataFrame:
    """One-to-one matches of groups (batch, pos, amount) with totals (batch, total_pos, total).

    In the order of ``pos`` each group takes the nearest total that is still free, the first on
    ties, and keeps it if it is near enough. What one group takes the next cannot, so a batch is
    one task; batches are small (the screens of one upload), and there are as many tasks as batches.
    """

    def match(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        free = {int(p): float(t) for p, t in zip(right["total_pos"], right["total"], strict=True) if t}
        rows = []
        for pos, amount in sorted(zip(left["pos"], left["amount"], strict=True)):
            best = min(free, key=lambda p: (abs(free[p] - amount), p), default=None)
            near = best is not None and abs(amount - free[best]) <= tolerance * abs(free[best])
            rows.append((key[0], int(pos), float(amount), best, free[best] if best is not None else None, near))
            if near:
                del free[best]
        return pd.DataFrame(rows, columns=["batch", "pos", "amount", "total_pos", "total", "matched"])

    kind = groups.schema[batch].dataType
    schema = T.StructType([T.StructField("batch", kind), T.StructField("pos", T.LongType()), T.StructField("amount", T.DoubleType()), T.StructField("total_pos", T.DoubleType()), T.StructField("total", T.DoubleType()), T.StructField("matched", T.BooleanType())])
    out = groups.select(batch, "pos", "amount").groupBy(batch).cogroup(totals.select(*[F.col(c).alias(c) for c in (batch, "total_pos", "total")]).groupBy(batch)).applyInPandas(match, schema)
    return out.select(F.col("batch").alias(batch), "pos", "amount", F.col("total_pos").cast("long").alias("total_pos"), "total", "matched")


def unmatched_totals(totals: DataFrame, matches: DataFrame, batch: str) -> DataFrame:
    """Totals that no group has taken."""
    return totals.join(matches.where("matched").select(batch, "total_pos"), [batch, "total_pos"], "left_anti")


def arbitrate(rows: DataFrame, symbols: DataFrame, row_id: str, token: str, evidence: str, close: str, tolerance: float = V.SYMBOL_GATE) -> DataFrame:
    """(row_id, symbol, n): the reading of a token, itself or one glyph away, that the price explains.

    ``symbols`` has (symbol, close). A symbol is given only if exactly one reading survives.
    """
    readings = rows.select(row_id, evidence, F.explode(F.array_union(F.array(token), confusable_variants(F.col(token)))).alias("symbol"))
    fits = readings.join(symbols, "symbol").where(F.abs(F.col(evidence) - F.col(close)) <= tolerance * F.abs(F.col(close)))
    found = fits.groupBy(row_id).agg(F.count("*").alias("n"), F.min("symbol").alias("_s"))
    return rows.select(row_id).join(found, row_id, "left").select(row_id, F.when(F.col("n") == 1, F.col("_s")).alias("symbol"), F.coalesce("n", F.lit(0)).alias("n"))


def transfer_first(df: DataFrame, key: str, order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with the key's first non-null ``value`` in the given order.

    Rows without a key meet nothing; a second key, zero for all others, keeps a shuffle from dealing them to one task.
    """
    first = df.select(F.col(key).alias("_k"), value.alias("_v"), F.struct(*order).alias("_o")).where("_v is not null")
    firsts = first.groupBy("_k").agg(F.min_by("_v", "_o").alias(name))
    spread = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*order), F.lit(4096))).otherwise(F.lit(0)).cast("int")
    left = df.withColumn("_spread", spread)
    # Zero, but no literal, which Spark would take out of the keys again.
    firsts = firsts.withColumn("_zero", F.pmod(F.hash("_k"), F.lit(1)))
    return left.join(firsts, (left[key] == firsts["_k"]) & (left["_spread"] == firsts["_zero"]), "left").drop("_k", "_spread", "_zero")


def anti_append(base: DataFrame, fresh: DataFrame, key: str, order: str) -> DataFrame:
    """``base`` and the fresh rows with unseen non-null keys, each key once, first by ``order``."""
    first = fresh.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1")
    return base.unionByName(first.select(base.columns).join(base.select(key), key, "left_anti").select(base.columns))


def similar_names(pairs: DataFrame, name: str, evidence: str) -> DataFrame:
    """``pairs`` with ``similarity``: the best ratio of matching blocks of the name in windows of the text.

    There is no such function in Spark; it runs on Arrow batches of pairs.
    """
    import difflib

    def rate(names: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for n, t in zip(names.fillna(""), texts.fillna(""), strict=True):
            step, best = max(1, len(n) // 3), 0.0
            for i in range(0, max(1, len(t) - len(n) + 1), step):
                best = max(best, difflib.SequenceMatcher(None, n, t[i : i + len(n) + step], autojunk=False).ratio())
            out.append(best if n else 0.0)
        return pd.Series(out)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(similarity=rate(f[name], f[evidence]))

    schema = T.StructType([*pairs.schema.fields, T.StructField("similarity", T.DoubleType())])
    return pairs.mapInPandas(batches, schema)


def leftover_assigned(labels: DataFrame, amounts: DataFrame, keys: list[str], at: str, label: str, amount: str, reach: float) -> DataFrame:
    """(label, amount): every label in its order takes the nearest amount behind it, within ``reach``, that is still free.

    What one label takes is gone for those after it. Stretches that a gap of more than ``reach`` parts cannot touch each
    other and are swept apart, so a sweep holds a stretch and not all that a key has.
    """
    one = lambda df, ids, own: df.select(*keys, at, F.lit(own).alias("_label"), F.col(ids).alias("_id"))
    rows = one(labels, label, True).unionByName(one(amounts, amount, False))
    w = Window.partitionBy(*keys).orderBy(at, F.desc("_label"), "_id")
    fresh = F.coalesce((F.col(at) - F.lag(at).over(w) > reach).cast("int"), F.lit(0))
    parts = rows.withColumn("_new", fresh).withColumn("_part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    item = F.struct(F.col(at).alias("at"), F.col("_id").alias("id"))
    each = parts.groupBy(*keys, "_part").agg(
        F.array_sort(F.collect_list(F.when(F.col("_label"), item))).alias("l"), F.array_sort(F.collect_list(F.when(~F.col("_label"), item))).alias("a")
    )
    kind = each.schema["a"].dataType.elementType.simpleString()
    out_kind = f"array<struct<label:{each.schema['l'].dataType.elementType['id'].dataType.simpleString()},amount:{each.schema['a'].dataType.elementType['id'].dataType.simpleString()}>>"

    def put(acc: Column, x: Column) -> Column:
        pick = F.get(F.filter(acc["free"], lambda a: (a["at"] > x["at"]) & (a["at"] - x["at"] <= reach)), F.lit(0))
        named = F.struct(pick.alias("p"), acc["free"].alias("free"), acc["out"].alias("out"))
        taken = lambda n: F.when(
            n["p"].isNotNull(),
            F.struct(F.filter(n["free"], lambda a: a["id"] != n["p"]["id"]).alias("free"), F.concat(n["out"], F.array(F.struct(x["id"].alias("label"), n["p"]["id"].alias("amount")))).alias("out")),
        ).otherwise(F.struct(n["free"], n["out"]))
        return F.transform(F.array(named), taken)[0]

    start = F.struct(F.col("a").cast(f"array<{kind}>").alias("free"), F.array().cast(out_kind).alias("out"))
    found = each.where((F.size("l") > 0) & (F.size("a") > 0)).select(F.explode(F.aggregate("l", start, put)["out"]).alias("f"))
    return found.select(F.col("f.label").alias(label), F.col("f.amount").alias(amount))


def consensus_filled(df: DataFrame, group: list[str], value: str, source: str, sure: Column, brand: Column, weak: str) -> DataFrame:
    """``df`` with ``value`` filled in groups that agree on one: where it is missing, or only came from ``weak``.

    The one value of a group's sure rows counts; where the group has no sure row, the one value of its brand rows. Groups
    that know several values, and rows without a group, stay as they are. What is filled has ``weak`` as its source.
    """
    distinct = lambda flag: F.collect_set(F.when(flag, F.col(value)))
    known = df.where(F.col(group[-1]).isNotNull()).groupBy(*group).agg(distinct(sure).alias("_sure"), distinct(brand).alias("_brand"))
    one = F.when(F.size("_sure") == 1, F.get("_sure", F.lit(0))).when((F.size("_sure") == 0) & (F.size("_brand") == 1), F.get("_brand", F.lit(0)))
    agreed = known.select(*group, one.alias("_agreed")).where("_agreed is not null")
    open_to = F.col("_agreed").isNotNull() & (F.col(value).isNull() | F.coalesce(F.col(source) == weak, F.lit(False)))
    joined = df.join(agreed, group, "left").withColumn("_open", open_to)
    return joined.withColumns({value: F.when(F.col("_open"), F.col("_agreed")).otherwise(F.col(value)), source: F.when(F.col("_open"), F.lit(weak)).otherwise(F.col(source))}).drop("_agreed", "_open")


def refereed(rows: DataFrame, other: DataFrame, totals: DataFrame, group: list[str], name: str, value: str, fields: list[str], domestic: Column) -> DataFrame:
    """``rows`` whose figures an independent total refutes take them from ``other``, which the same total confirms.

    In a group whose ``other`` rows sum to the total within CROSS_CHECK while the rows' own sum is off by more than
    REFUTED (or zero), every row whose name occurs once among the others takes all ``fields`` from there, nulls too.
    Groups with a row that is not ``domestic``, and rows without such a namesake, stay as they are.
    """
    mine = rows.groupBy(*group).agg(F.sum(value).alias("_mine"), F.bool_and(F.coalesce(domestic, F.lit(True))).alias("_domestic"))
    theirs = other.groupBy(*group).agg(F.sum(value).alias("_theirs"))
    off = lambda c: F.abs(F.coalesce(F.col(c), F.lit(0.0)) - F.col("total")) / F.col("total")
    refuted = (F.coalesce("_mine", F.lit(0.0)) == 0) | (off("_mine") > V.REFUTED)
    flagged = totals.where(F.col("total") != 0).join(theirs, group).join(mine, group).where((off("_theirs") <= V.CROSS_CHECK) & refuted & F.col("_domestic")).select(group)
    unique = other.groupBy(*group, name).agg(F.count("*").alias("_n"), *[F.first(f).alias(f"_{f}") for f in fields]).where("_n = 1").drop("_n").join(flagged, group)
    joined = rows.join(unique.withColumn("_hit", F.lit(True)), [*group, name], "left")
    return joined.withColumns({f: F.when(F.col("_hit"), F.col(f"_{f}")).otherwise(F.col(f)) for f in fields}).select(rows.columns)
