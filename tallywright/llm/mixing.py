"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Slots are counted from 0; each takes one document. A schedule is at all times less than one block
(BLOCK documents) away from every source's share w t of the first t slots, w being the unrounded
target weight (a whole number of 2^-40, so that all arithmetic is exact).

Time is cut into epochs of EPOCH slots. Up to the end of epoch e a source of weight w is owed
w e EPOCH documents; it gets that number rounded down, and those with the largest remainders get
one more, so remainders are carried over and never add up. What an epoch grants follows from its
number alone, and epochs are worked out side by side. Inside an epoch a source with q documents has
release times floor(i EPOCH / q) and deadlines ceil((i + 1) EPOCH / q); in every slot, earliest
deadline first takes the released document that is due first. The grants sum to EPOCH, so no slot
stays empty and every deadline is met: less than one document off the line through the grants,
which are less than one off the target.

Sources below 1 / EPOCH are put together into groups of at least that weight, which take part like
sources; a group's slots are dealt among its members by a schedule of its own. So any number of
sources, of any weight, is mixed. Two documents of deviation come on top per level, and 2^30 sources
have three levels: still less than one block of 8.

Documents are numbered within their source by ranges, so a hot source is no single task, and meet
their slot by a join on source and number. Slots of a source that has run out are left out: the
order stays, the slots close up. Slots are worked out until all sources but the last have run out; the rest
of that one follows.

Defined cases: a null source is a source of its own, as is an empty one; a source without a weight
comes after all others in the order of ids; repeated rows each get a place; rows of equal ids are
ordered by a hash of their text; an empty table gives no rows; extra columns stay, and those named
like the results are not passed on.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.shared import columns_of, numbered, private, stored

#: Documents of a block, and slots of an epoch.
BLOCK, EPOCH = 8, 1024
#: Weights are whole numbers of 1 / WHOLE.
WHOLE = 2**40
#: Exponent that tempers the natural shares when no weights are given.
TEMPER = 0.7

Source = str | None


def whole_weights(weights: dict[Source, float], whole: int = WHOLE) -> dict[Source, int]:
    """Weights as whole numbers of at least 1 that sum to ``whole``, by largest remainders."""
    weights = {s: w for s, w in weights.items() if w > 0}
    if not weights:
        return {}
    total = sum(weights.values())
    exact = {s: w / total * whole for s, w in weights.items()}
    found = {s: max(1, int(x)) for s, x in exact.items()}
    by_rest = sorted(exact, key=lambda s: (found[s] - exact[s], s is None, s or ""))
    missing = whole - sum(found.values())
    for s in by_rest[: max(0, missing)]:
        found[s] += 1
    if missing < 0:
        found[max(found, key=lambda s: (found[s], s or ""))] += missing
    return found


def _grouped(members: list[tuple[int, int]]) -> list[tuple[list[tuple[int, int]], bool]]:
    """(members, owed no more than its whole part) of every party of one schedule.

    Members (source, weight) of at least 1 / EPOCH stand alone, smaller ones are put together. Only a
    lone group can be smaller, when all small ones together are.
    """
    total = sum(n for _, n in members)
    parties = [([m], False) for m in members if m[1] * EPOCH >= total]
    groups: list[list[tuple[int, int]]] = []
    for m in sorted((m for m in members if m[1] * EPOCH < total), key=lambda m: (-m[1], m[0])):
        if not groups or sum(n for _, n in groups[-1]) * EPOCH >= total:
            groups.append([])
        groups[-1].append(m)
    if len(groups) > 1 and sum(n for _, n in groups[-1]) * EPOCH < total:
        groups[-2:] = [groups[-2] + groups[-1]]
    return parties + [(g, sum(n for _, n in g) * EPOCH < total) for g in groups]


def _granted(parties: F.Column, epoch: F.Column) -> F.Column:
    """Array of the documents that each party (n, low) has been granted before ``epoch``."""
    mask = (1 << 20) - 1

    def owed(p: F.Column, i: F.Column) -> F.Column:
        # n epoch EPOCH / WHOLE, in two halves that fit into 64 bits.
        low = p["n"].bitwiseAND(mask) * epoch
        high = F.shiftright(p["n"], 20) * epoch + F.shiftright(low, 20)
        rest = F.shiftleft(high.bitwiseAND(1023), 20) + low.bitwiseAND(mask)
        # Parties are less than 4096; of equal remainders the earlier one comes first.
        rank = F.when(p["low"], F.lit(-1).cast("long")).otherwise(rest * 4096 + 4095 - i)
        return F.struct(F.shiftright(high, 10).alias("whole"), rank.alias("rank"))

    def up(o: F.Column) -> F.Column:
        missing = (epoch * EPOCH - F.aggregate(o, F.lit(0).cast("long"), lambda a, x: a + x["whole"])).cast("int")
        least = F.when(missing > 0, F.element_at(F.sort_array(F.transform(o, lambda x: x["rank"]), asc=False), F.greatest(missing, F.lit(1)))).otherwise(F.lit(2**62))
        return F.transform(F.array(least), lambda least: F.transform(o, lambda x: x["whole"] + (x["rank"] >= least).cast("long")))[0]

    # An array of one value gives the value a name, so that it is computed once.
    return F.transform(F.array(F.transform(parties, owed)), up)[0]


def _dealt(grants: F.Column) -> F.Column:
    """Array over the slots of an epoch: (due, k, had, release) of the party k that has the slot."""

    def turn(k: F.Column, q: F.Column, had: F.Column) -> F.Column:
        left = had < q
        return F.struct(
            F.when(left, F.ceil((had + 1) * EPOCH / q)).otherwise(2**40).cast("long").alias("due"),
            k.cast("int").alias("k"),
            had.cast("int").alias("had"),
            F.when(left, F.floor(had * EPOCH / q)).otherwise(2**40).cast("long").alias("release"),
            q.cast("long").alias("q"),
        )

    entry = "struct<due:bigint,k:int,had:int,release:bigint,q:bigint>"

    def step(acc: F.Column, slot: F.Column) -> F.Column:
        first = F.array_min(F.filter(acc["next"], lambda x: x["release"] <= slot))
        return F.transform(
            F.array(first),
            lambda first: F.struct(
                F.transform(acc["next"], lambda x: F.when(x["k"] == first["k"], turn(x["k"], x["q"], x["had"] + 1)).otherwise(x)).alias("next"),
                F.concat(acc["out"], F.array(first)).alias("out"),
            ),
        )[0]

    start = F.struct(F.transform(grants, lambda q, k: turn(k, q, F.lit(0))).alias("next"), F.array().cast(f"array<{entry}>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(EPOCH - 1)), start, step)["out"]


def _scheduled(epochs: DataFrame) -> DataFrame:
    """(node, k, number, slot, release, due) of (node, epoch, parties)."""
    at = epochs.withColumns({"before": _granted(F.col("parties"), F.col("epoch")), "after": _granted(F.col("parties"), F.col("epoch") + 1)})
    dealt = at.select("node", "epoch", "before", F.posexplode(_dealt(F.zip_with("after", "before", lambda a, b: a - b))).alias("slot", "x"))
    base = F.col("epoch") * EPOCH
    return dealt.select(
        "node",
        F.col("x.k").alias("k"),
        (F.element_at("before", F.col("x.k") + 1) + F.col("x.had")).alias("number"),
        (base + F.col("slot")).alias("slot"),
        (base + F.col("x.release")).alias("release"),
        (base + F.col("x.due")).alias("due"),
    )


def _table(spark: SparkSession, rows: list[dict], kind: str) -> DataFrame:
    """A small table of the driver's, of structs of ``kind``, read as JSON in the JVM."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kind}>>")))


def schedule(spark: SparkSession, weights: dict[Source, int], slots: int) -> DataFrame:
    """(source, number, slot, release, due): the documents that have the first ``slots`` slots, at least.

    ``weights`` sum to WHOLE. ``release`` and ``due`` are those of the source, or of its group.
    """
    sources = sorted(weights, key=lambda s: (s is None, s or ""))
    level, out, above, nodes = [(0, [(i, weights[s]) for i, s in enumerate(sources)], slots)], [], None, 1
    while level:
        tables, kids, below = [], [], []
        for node, members, length in level:
            parties = _grouped(members)
            whole = whole_weights({str(k).zfill(4): float(sum(n for _, n in p)) for k, (p, _) in enumerate(parties)})
            total = sum(n for _, n in members)
            tables.append((node, max(1, -(-length // EPOCH)), [(whole[str(k).zfill(4)], low) for k, (_, low) in enumerate(parties)]))
            for k, (p, _) in enumerate(parties):
                if len(p) == 1:
                    kids.append((node, k, sources[p[0][0]], None))
                else:
                    kids.append((node, k, None, nodes))
                    below.append((nodes, p, int(length * sum(n for _, n in p) / total) + 2 * BLOCK))
                    nodes += 1
        if above is None:
            root = F.array(*[F.struct(F.lit(n).cast("long").alias("n"), F.lit(low).alias("low")) for n, low in tables[0][2]])
            epochs = spark.range(tables[0][1]).select(F.lit(0).alias("node"), F.col("id").alias("epoch"), root.alias("parties"))
        else:
            parties = _table(spark, [{"node": n, "parties": [{"n": w, "low": low} for w, low in p]} for n, _, p in tables], "node:int,parties:array<struct<n:bigint,low:boolean>>")
            lengths = _table(spark, [{"node": n, "epochs": e} for n, e, _ in tables], "node:int,epochs:bigint")
            epochs = lengths.select("node", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)).alias("epoch")).repartition("node", "epoch").join(parties, "node")
        # One row per group and per source, whatever the number of documents is.
        found = stored(_scheduled(epochs).join(_table(spark, [dict(zip(("node", "k", "source", "child"), x, strict=True)) for x in kids], "node:int,k:int,source:string,child:int"), ["node", "k"]), "slots")
        if above is not None:
            outer = above.select(F.col("child").alias("node"), F.col("number").alias("inner"), F.col("slot").alias("o_slot"), F.col("release").alias("o_release"), F.col("due").alias("o_due"))
            found = found.withColumnRenamed("slot", "inner").join(outer, ["node", "inner"]).select("source", "child", "number", F.col("o_slot").alias("slot"), F.col("o_release").alias("release"), F.col("o_due").alias("due"))
        out.append(found.where("child is null").select("source", "number", "slot", "release", "due"))
        above, level = found.where("child is not null"), below
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


def tempered_weights(counts: dict[Source, int], temper: float = TEMPER) -> dict[Source, float]:
    """Natural shares raised to ``temper``."""
    return {s: float(n) ** temper for s, n in counts.items()}


def source_counts(docs: DataFrame) -> dict[Source, int]:
    """Documents of every source: one row per source comes to the driver."""
    return {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.count("*").alias("n")).collect()}


def slots_needed(counts: dict[Source, int], weights: dict[Source, int]) -> int:
    """Slots after which all sources but one have run out, a block over."""
    lasts = sorted((counts[s] + BLOCK) * WHOLE // n + 1 for s, n in weights.items())
    return lasts[-2] if len(lasts) > 1 else 1


def mixed(docs: DataFrame, weights: dict[Source, float] | None = None, block: int = BLOCK) -> DataFrame:
    """(source, doc_id, tie, block, slot, release, due, place) of every row of ``docs`` (source, doc_id, text).

    ``place`` is the 0-based place in the mix; slots count from 0 and are null after all others.
    """
    counts = source_counts(docs)
    whole = whole_weights({s: w for s, w in (tempered_weights(counts) if weights is None else weights).items() if s in counts})
    keys = docs.select("source", "doc_id", F.xxhash64("text").alias("tie"))
    ordered = numbered(keys, ["source", "doc_id", "tie"], "by-source")
    # One row per source and partition at most, aggregated first.
    firsts = ordered.groupBy("source").agg(F.min("pos").alias("first")).withColumnRenamed("source", "of")
    blocks = ordered.join(firsts, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("number", F.col("pos") - F.col("first"))
    blocks = blocks.withColumn("block", F.floor(F.col("number") / block))
    if whole:
        plan = schedule(docs.sparkSession, whole, slots_needed(counts, whole)).withColumnsRenamed({"source": "of", "number": "nth"})
        at = F.col("source").eqNullSafe(F.col("of")) & (F.col("number") == F.col("nth"))
        blocks = blocks.join(plan, at, "left")
    else:
        blocks = blocks.withColumns({c: F.lit(None).cast("long") for c in ("slot", "release", "due")})
    blocks = blocks.select("source", "doc_id", "tie", "block", "slot", "release", "due")
    return numbered(blocks.withColumn("last", F.coalesce("slot", F.lit(2**62))), ["last", "source", "doc_id", "tie"], "mix", "place").drop("last")


def in_mixed_order(docs: DataFrame, weights: dict[str | None, float] | None = None) -> DataFrame:
    """``docs`` themselves in the order of the mix: partitions, and rows in them, follow ``place``.

    No row is dropped or repeated; written files hold the mix in order. Columns stay, whatever they are called.
    """
    i, tie, place = (private(x) for x in ("id", "tie", "place"))
    places = mixed(docs.select("source", "doc_id", "text"), weights).groupBy(F.col("doc_id").alias(i), F.col("tie").alias(tie)).agg(F.min("place").alias(place))
    same = F.col("doc_id").eqNullSafe(F.col(i)) & F.xxhash64("text").eqNullSafe(F.col(tie))
    return docs.join(places, same, "left").repartitionByRange(place, "doc_id").sortWithinPartitions(place, "doc_id").select(columns_of(docs))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` in the order of the mix, weights tempered from the natural shares."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "doc_id", "text")
    return mixed(docs).select("doc_id", "source", "block", "slot", "release", "due", "place")


OP7_SQL = """
WITH RECURSIVE c AS (SELECT source, count(*) AS docs, pow(count(*)::DOUBLE, 0.7) AS w FROM documents GROUP BY source),
x AS (SELECT source, docs, w / (SELECT sum(w) FROM c) * 1099511627776 AS e FROM c),
f AS (SELECT source, docs, floor(e)::BIGINT AS n, row_number() OVER (ORDER BY floor(e) - e, source) AS k FROM x),
s AS (SELECT source, docs, n + (k <= 1099511627776 - (SELECT sum(n) FROM f))::BIGINT AS n FROM f),
a AS (SELECT list(source ORDER BY source) AS names, list(n ORDER BY source) AS n, list((docs + 8) * 1099511627776::HUGEINT // n + 1 ORDER BY source) AS lasts FROM s),
t AS (SELECT unnest(range(0, greatest(1, coalesce((list_sort(lasts)[len(lasts) - 1] + 1023) // 1024, 1))::BIGINT + 1)) AS epoch FROM a),
o AS (SELECT epoch, i, n[i]::HUGEINT * epoch // 1073741824 AS whole, n[i]::HUGEINT * epoch % 1073741824 AS rest FROM t, a, unnest(range(1, len(n) + 1)) u(i)),
g AS (SELECT epoch, i, (whole + (row_number() OVER (PARTITION BY epoch ORDER BY rest DESC, i) <= epoch * 1024 - sum(whole) OVER (PARTITION BY epoch))::BIGINT)::BIGINT AS had FROM o),
q AS (SELECT b.epoch, list(b.had ORDER BY b.i) AS before, list(n.had - b.had ORDER BY b.i) AS q FROM g b JOIN g n ON n.epoch = b.epoch + 1 AND n.i = b.i GROUP BY b.epoch),
r(epoch, slot, had, k) AS (
  SELECT epoch, -1::BIGINT, list_transform(q, lambda v: 0::BIGINT), NULL::BIGINT FROM q
  UNION ALL
  SELECT epoch, slot + 1, list_transform(had, lambda h, i: h + (i = pick)::BIGINT), pick
  FROM (SELECT r.epoch, slot, had, list_min(list_filter(list_transform(range(1, len(q) + 1), lambda i:
               CASE WHEN had[i] < q[i] AND had[i] * 1024 // q[i] <= slot + 1 THEN {'due': ((had[i] + 1) * 1024 + q[i] - 1) // q[i], 'i': i} END),
               lambda v: v IS NOT NULL)).i AS pick FROM r JOIN q ON q.epoch = r.epoch WHERE slot < 1023)),
p AS (SELECT names[k] AS source, before[k] + had[k] - 1 AS number, r.epoch * 1024 + slot AS slot, r.epoch * 1024 + (had[k] - 1) * 1024 // q[k] AS release,
             r.epoch * 1024 + (had[k] * 1024 + q[k] - 1) // q[k] AS due
      FROM r JOIN q ON q.epoch = r.epoch, a WHERE slot >= 0),
d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS number FROM documents),
j AS (SELECT d.doc_id, d.source, d.number // 8 AS block, slot, release, due FROM d LEFT JOIN p ON d.source = p.source AND d.number = p.number)
SELECT *, row_number() OVER (ORDER BY slot NULLS LAST, source, doc_id) - 1 AS place FROM j
"""
