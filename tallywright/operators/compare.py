"""Comparison of results: golden scores, differences of two paths, invariance of order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def score(golden: DataFrame, got: DataFrame, key: str, label: str) -> DataFrame:
    """One row: golden, got, matched, missing, extra and wrong rows, and whether the run passes."""
    both = golden.select(key, F.col(label).alias("_g"), F.lit(1).alias("_in_g")).join(got.select(key, F.col(label).alias("_o"), F.lit(1).alias("_in_o")), key, "full_outer")
    in_g, in_o = F.col("_in_g").isNotNull(), F.col("_in_o").isNotNull()
    counts = both.agg(
        F.count_if(in_g).alias("golden"),
        F.count_if(in_o).alias("got"),
        F.count_if(in_g & in_o & F.col("_g").eqNullSafe(F.col("_o"))).alias("matched"),
        F.count_if(in_g & ~in_o).alias("missing"),
        F.count_if(in_o & ~in_g).alias("extra"),
        F.count_if(in_g & in_o & ~F.col("_g").eqNullSafe(F.col("_o"))).alias("wrong"),
    )
    return counts.withColumn("passed", (F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("wrong") == 0))


def difference(a: DataFrame, b: DataFrame, key: str, value: str, tolerance: float = 0.01) -> DataFrame:
    """(key, kind, a, b): only_a, only_b or differs, for keys on which the two don't agree."""
    both = a.select(key, F.col(value).alias("a"), F.lit(1).alias("_a")).join(b.select(key, F.col(value).alias("b"), F.lit(1).alias("_b")), key, "full_outer")
    apart = F.abs(F.col("a") - F.col("b")) > tolerance * F.greatest(F.abs("a"), F.abs("b"))
    kind = F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").when(F.coalesce(apart, ~F.col("a").eqNullSafe(F.col("b"))), "differs")
    return both.withColumn("kind", kind).where("kind is not null").select(key, "kind", "a", "b")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (only_a, only_b): numbers of rows that one side has more often than the other."""
    one = lambda x, y, name: x.exceptAll(y).agg(F.count("*").alias(name))
    return one(a, b, "only_a").crossJoin(one(b, a, "only_b"))  # two single rows


def field_report(pairs: DataFrame, exact: list[str], tolerances: dict[str, float]) -> DataFrame:
    """(field, compared, mismatched, worst) over pairs with columns a_<field> and b_<field>, a being golden.

    Exact fields differ as they are, with 0 for a missing number; the others by their share of the golden value, whose
    largest is ``worst``. A missing golden value is not compared.
    """
    told = []
    for f in [*exact, *tolerances]:
        a, b = F.col(f"a_{f}"), F.col(f"b_{f}")
        error = F.coalesce(F.try_divide(F.abs(a - b), F.abs(a)), F.when(a == b, 0.0)) if f in tolerances else F.lit(None).cast("double")
        if f in tolerances:
            wrong = a.isNotNull() & ~F.coalesce(error <= tolerances[f], F.lit(False))
        else:
            plain = dict(pairs.dtypes)[f"a_{f}"] == "string"
            wrong = ~a.eqNullSafe(b) if plain else F.coalesce(a, F.lit(0)) != F.coalesce(b, F.lit(0))
        told.append(F.struct(F.lit(f).alias("field"), (F.lit(f in exact) | a.isNotNull()).alias("judged"), wrong.alias("wrong"), error.alias("error")))
    rows = pairs.select(F.explode(F.array(*told)).alias("r")).select("r.*")
    return rows.groupBy("field").agg(F.count_if("judged").alias("compared"), F.count_if("wrong").alias("mismatched"), F.max("error").alias("worst"))


def paired(golden: DataFrame, got: DataFrame, batch: str, rounds: list[tuple[list[str], bool, float | None]], by_row: bool = False) -> DataFrame:
    """(batch, golden_pos, got_pos): one-to-one pairs of rows (batch, pos, name, value, ...), each golden row the first that fits.

    A round asks for (equal fields, one name inside the other, relative tolerance of the value or None). All golden rows
    go through one round before the next begins, or with ``by_row`` each row tries all of them. What one row takes the
    next cannot, so a batch (one run's holdings) is a task.
    """

    def fits(a: dict, b: dict, equal: list[str], inside: bool, tolerance: float | None) -> bool:
        if any(a[f] != b[f] for f in equal):
            return False
        if inside and not (a["name"] and b["name"] and (a["name"] in b["name"] or b["name"] in a["name"])):
            return False
        return tolerance is None or bool(a["value"] and b["value"] and abs(a["value"] - b["value"]) <= tolerance * abs(a["value"]))

    def match(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ours = left.astype(object).where(left.notna(), None).sort_values("pos").to_dict("records")
        free = right.astype(object).where(right.notna(), None).sort_values("pos").to_dict("records")
        tries: Iterator = ((a, r) for a in ours for r in rounds) if by_row else ((a, r) for r in rounds for a in ours)
        found: dict[int, int] = {}
        for a, rule in tries:
            hit = next((b for b in free if fits(a, b, *rule)), None) if a["pos"] not in found else None
            if hit is not None:
                found[a["pos"]] = hit["pos"]
                free.remove(hit)
        return pd.DataFrame([(key[0], g, o) for g, o in found.items()], columns=["batch", "golden_pos", "got_pos"])

    kind = golden.schema[batch].dataType.simpleString()
    out = golden.groupBy(batch).cogroup(got.groupBy(batch)).applyInPandas(match, f"batch {kind}, golden_pos long, got_pos long")
    return out.withColumnRenamed("batch", batch)


def invariants(df: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """(rule, checked, broken, first): every rule over all rows in one pass, with the smallest key that breaks it.

    A rule that is null for a row does not speak of it.
    """
    told = [F.struct(F.lit(n).alias("rule"), F.count(c).alias("checked"), F.count_if(~c).alias("broken"), F.min(F.when(~c, F.col(key))).alias("first")).alias(n) for n, c in rules.items()]
    return df.agg(*told).select(F.inline(F.array(*rules)))
