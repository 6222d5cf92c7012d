"""Survivorship: several captures of one thing become one row without losing a field."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.functions import vocabulary as V


def survivors(df: DataFrame, keys: list[str], fields: list[str], order: list[str], value: str) -> DataFrame:
    """One row per key: the first capture with nulls filled from later ones.

    ``conflict`` tells that the captures' values differ by more than SAME_VALUE of the first; then
    the capture with more filled fields comes first. Captures of a key are few; they are folded as
    aggregates, so nothing is sorted or gathered.
    """
    filled = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))
    ordered = df.withColumn("_o", F.struct(*order)).withColumn("_full", filled)
    first = ordered.groupBy(*keys).agg(F.min_by(value, "_o").alias("_v"), F.max(value).alias("_hi"), F.min(value).alias("_lo"))
    spread = F.greatest(F.abs(F.col("_hi") - F.col("_v")), F.abs(F.col("_v") - F.col("_lo")))
    first = first.select(*keys, F.coalesce(spread > V.SAME_VALUE * F.abs(F.col("_v")), F.lit(False)).alias("conflict"))
    rank = F.struct(F.when(F.col("conflict"), -F.col("_full")).otherwise(F.lit(0)).alias("f"), F.col("_o").alias("o"))
    ranked = ordered.join(first, keys).withColumn("_rank", rank)
    # The first non-null of each field in rank order.
    picks = [F.min_by(f, F.when(F.col(f).isNotNull(), F.col("_rank"))).alias(f) for f in fields]
    return ranked.groupBy(*keys, "conflict").agg(*picks, F.count("*").alias("captures"))


def deduplicated(df: DataFrame, content: str, order: str) -> DataFrame:
    """(order, copies): the first of every distinct content by its digest."""
    return df.groupBy(F.md5(content).alias("digest")).agg(F.min(order).alias(order), F.count("*").alias("copies")).drop("digest")


NOTES = ("conflict", "suspect")


def captures_merged(df: DataFrame, group: list[str], fields: list[str], value: str = "value", compared: tuple[str, ...] = ("value", "qty", "cost", "pnl"), filled: tuple[str, ...] | None = None) -> DataFrame:
    """Captures of one thing in several files become one row, by the strongest key that the rows have.

    ``df`` has the ``group`` columns (a batch and a normalised name), ``file``, ``tokens`` (account numbers, may be
    empty), ``broker``, ``kind`` (account type), ``ok`` (whether the file's own total was confirmed), ``pos`` (the order
    of the captures, a number) and ``fields``. Columns beyond these stay as the kept capture has them.

    * Strong: both have account numbers and share one. One row stays even if the values differ; then the confirmed
      file's, else the one with more fields filled, and ``conflict`` is told.
    * Weak: no numbers, same broker and kind. Merged only if the values are equal too; else both stay and the later
      one is told as ``suspect``.
    * Anonymous: neither numbers nor broker, same kind. Merged only if the values are equal and no other compared
      field contradicts; else both stay, told as ``suspect``.

    Captures of the same file never merge. Equal is within SAME_VALUE of the earlier value. What is merged loses no
    field: nulls are filled from the other capture; ``captures`` counts how many a row stands for. Rows without a name pass through. The outcome depends on the
    order, so a group is one sweep; groups are the captures of one name in one batch.
    """
    filled = filled or tuple(f for f in fields if f != value)
    columns = [c for c in df.columns if c not in (*NOTES, "captures")]
    schema = T.StructType([*(df.schema[c] for c in columns), *(T.StructField(n, T.BooleanType()) for n in NOTES), T.StructField("captures", T.LongType())])
    name = group[-1]

    def fill(kept: dict, other: dict) -> None:
        kept["captures"] += other["captures"]
        for f in filled:
            if kept[f] is None:
                kept[f] = other[f]

    def sweep(rows: list[dict]) -> list[dict]:
        out: list[dict] = []
        strong: list[tuple[set, int]] = []
        by_token: dict[str, list[int]] = {}
        labelled: dict[tuple, int] = {}
        for row in sorted(rows, key=lambda r: r["pos"]):
            row |= dict.fromkeys(NOTES, False) | {"captures": 1}
            tokens = set(row["tokens"] if row["tokens"] is not None else ())
            label = (row["broker"], row["kind"])
            # Of entries that share a number the first one made.
            found = next((strong[k][1] for k in sorted({k for t in tokens for k in by_token.get(t, ())}) if out[strong[k][1]]["file"] != row["file"]), None)
            if not tokens and label in labelled and out[labelled[label]]["file"] != row["file"]:
                found = labelled[label]
            if found is not None and not tokens and not row["broker"]:
                old = out[found]
                agree = old[value] == row[value] and all(old[f] is None or row[f] is None or old[f] == row[f] for f in compared)
                if agree:
                    fill(old, row)
                    continue
                row["suspect"], found = True, None
            if found is None:
                if tokens:
                    for t in tokens:
                        by_token.setdefault(t, []).append(len(strong))
                    strong.append((tokens, len(out)))
                else:
                    labelled[label] = len(out)
                out.append(row)
                continue
            old = out[found]
            if old[value] is not None and row[value] is not None and abs(old[value] - row[value]) <= abs(old[value]) * V.SAME_VALUE:
                fill(old, row)
            elif not tokens:
                row["suspect"] = True
                out.append(row)
            else:
                more = sum(row[f] is not None for f in fields) > sum(old[f] is not None for f in fields)
                better = bool(row["ok"]) and not old["ok"] or row["ok"] == old["ok"] and more
                kept, other = (row, old) if better else (old, row)
                fill(kept, other)
                kept["conflict"] = True
                out[found] = kept
        return out

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by group; one group is held at a time."""
        key, held = None, []
        for batch in batches:
            given = batch.astype(object).where(batch.notna(), None)
            done: list[dict] = []
            for row in given.to_dict("records"):
                now = tuple(row[c] for c in group)
                if now != key:
                    done += sweep(held)
                    key, held = now, []
                held.append(row)
            if done:
                yield pd.DataFrame(done, columns=[f.name for f in schema])
        if held:
            yield pd.DataFrame(sweep(held), columns=[f.name for f in schema])

    unnamed = F.coalesce(F.col(name), F.lit("")) == ""
    apart = df.select(columns).where(~unnamed).repartition(*group).sortWithinPartitions(*group, "pos")
    rest = df.select(*columns, *[F.lit(False).alias(n) for n in NOTES], F.lit(1).cast("long").alias("captures")).where(unnamed)
    return apart.mapInPandas(merged, schema).unionByName(rest)
