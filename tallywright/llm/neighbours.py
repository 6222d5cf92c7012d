"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected onto a few random orthonormal directions, shifted, quantised and numbered along a Hilbert curve;
this can be done for several projections and shifts. A curve is cut into blocks of rows that follow one
another. A query looks at all blocks within a window of its own place on a curve; what all
curves find merges, ranked by exact inner products in double precision.

Neither the window nor the number of curves is a constant: for a bounded sample of queries (SAMPLE) the true neighbours are
computed against all rows, and the window is the rank distance within which TARGET of these true
pairs lie on their best curve. Of one to CURVES curves that number is taken which makes the least work. Clustered
vectors get narrow windows, isotropic ones one curve and a wide window. Places on a curve are ranks among the keys of
FIT_ROWS sampled rows; every row is indexed and every query uses the same window.

A block is one matrix in one task, and the queries that look at it stream past it. Blocks grow with the window, up to
BLOCK_BYTES, so a query goes to some
twenty blocks a curve at most until that bound is met. Products are taken in single precision first; all that
rounding could bring among the best are computed exactly.

Inner products become distances by one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm,
which candidates have and queries, brought to the norm M, lack. Equal vectors are one class in the index; a class keeps
its k + 1 smallest ids, which is all that any query can need, so no copy group is large.

Defined cases: vectors that are null, zero, of another length than most, or that hold null or
non-finite components take no part, neither as queries nor as candidates; ties go to the smaller id;
fewer candidates than k give them all; rows of the same id and vector are one candidate; an empty
table or one without queries gives no rows; extra columns do not matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.llm.shared import delete, numbered, stored

CURVES, DIMENSIONS, BITS = 10, 8, 7
#: Candidate rows of a block at least, its bytes at most, and the blocks in a window to one side while they are below that.
BLOCK, BLOCK_BYTES, BLOCKS_ASIDE = 2048, 64 << 20, 16
#: Sampled rows whose keys give the places on curves, and how many of them a block holds at least.
FIT_ROWS, FIT_PER_BLOCK = 32768, 16
#: Queries whose true neighbours set the window, and the share of them that it must cover.
SAMPLE, TARGET = 256, 0.99
#: What it takes to index one row on one curve, in products of a pair.
ROW_COST = 4000
#: Queries and candidates of one product of matrices, candidates that give the first bound, and pairs held at once.
QUERIES, TILE, HEAD, PAIRS = 256, 2048, 8192, 2_000_000


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of integer cells [n, dimensions] with ``bits`` bits each.

    The axes-to-transpose steps of Skilling (2004), for all rows at once.
    """
    axes = [c.astype(np.uint64) for c in cells.T]
    one, zero = np.uint64(1), np.uint64(0)
    for level in range(bits - 1, 0, -1):
        high, low = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for i in range(len(axes)):
            flip = (axes[i] & high) != zero
            swap = np.where(flip, zero, (axes[0] ^ axes[i]) & low)
            axes[0] = np.where(flip, axes[0] ^ low, axes[0]) ^ swap
            axes[i] = axes[i] ^ swap
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where((axes[-1] & np.uint64(1 << level)) != zero, turn ^ np.uint64((1 << level) - 1), turn)
    key = np.zeros_like(axes[0])
    for level in range(bits - 1, -1, -1):
        for a in axes:
            key = (key << one) | (((a ^ turn) >> np.uint64(level)) & one)
    return key.astype(np.int64)


def exact_scores(query: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Inner products in double precision, the same for a pair wherever it is computed."""
    return (others * query).sum(axis=-1)


def _matrix(column: pa.Array) -> np.ndarray:
    """[rows, dimensions] of a list column without nulls, in its own precision."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _usable(vectors: DataFrame, cell: str) -> DataFrame:
    """(vec_id, vec, key) of the vectors that take part; equal vectors have equal keys."""
    fine = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{cell}>").alias("vec")).where(
        F.col("vec_id").isNotNull()
        & F.col("vec").isNotNull()
        & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vec", lambda x: x != 0)
    )

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vec = batch.columns
            # Negative zero equals zero as a component; the key is taken after adding it away.
            cells = vec.flatten().to_numpy(zero_copy_only=False) + 0.0
            ends = np.append(0, np.cumsum(vec.value_lengths().to_numpy(zero_copy_only=False))) * cells.itemsize
            data = cells.tobytes()
            keys = pa.array([hashlib.sha256(data[b:e]).digest() for b, e in pairwise(ends.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, vec, keys], names=["vec_id", "vec", "key"])

    fine = stored(fine.mapInArrow(keyed, f"vec_id long, vec array<{cell}>, key binary"), "usable")
    usual = fine.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return fine.where(F.size("vec") == (usual["d"] if usual else 0))


def _classes(fine: DataFrame, k: int, query: F.Column) -> tuple[DataFrame, DataFrame]:
    """(cid, vec, asks) per distinct vector and (cid, vec_id, place, asks) per row, by smallest id."""
    rows = numbered(fine.select("key", "vec_id").distinct(), ["key", "vec_id"], "vectors")
    heads = rows.groupBy("key").agg(F.min("pos").alias("first"), F.min("vec_id").alias("cid"), F.max(query.cast("int")).alias("asks"))
    members = rows.join(heads, "key").select("cid", "vec_id", (F.col("pos") - F.col("first")).alias("place"), query.alias("asks"))
    # One class per id; vectors are shuffled once.
    single = heads.groupBy(F.col("cid").alias("vec_id")).agg(F.min(F.struct("key", "asks")).alias("head")).select("vec_id", "head.*")
    distinct = fine.join(single, ["key", "vec_id"]).dropDuplicates(["key", "vec_id"])
    return distinct.select(F.col("vec_id").alias("cid"), "vec", (F.col("asks") == 1).alias("asks")), members.where(
        F.col("asks") | (F.col("place") <= k)
    )


def _directions(dimensions: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Projections [dimensions + 1, CURVES x DIMENSIONS] and shifts in half a range."""
    rng = np.random.default_rng(seed)
    width = min(DIMENSIONS, dimensions + 1)
    parts = [np.linalg.qr(rng.standard_normal((dimensions + 1, dimensions + 1)))[0][:, :width] for _ in range(CURVES)]
    return np.hstack(parts), rng.random(CURVES * width) * 0.5


@dataclass(frozen=True)
class Curves:
    """What it takes to place a vector: directions, moments, largest norm, and sorted keys of sampled rows by curve."""

    projections: np.ndarray
    shifts: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    top: float
    sample: tuple[np.ndarray, ...] = ()

    def keys(self, x: np.ndarray, curves: int, asked: bool = False) -> np.ndarray:
        """Keys [rows, curves] of candidates, or of queries."""
        x = x.astype(np.float64)
        width = self.projections.shape[1] // CURVES
        used = curves * width
        square = (x * x).sum(1)
        if asked:
            x, lift = x * (self.top / np.sqrt(np.maximum(square, 1e-300)))[:, None], np.zeros(len(x))
        else:
            lift = np.sqrt(np.maximum(self.top**2 - square, 0.0))
        y = np.hstack([x, lift[:, None]]) @ self.projections[:, :used]
        # Three deviations to either side fill two thirds of the cells; the shift moves them.
        unit = np.clip((y - self.mean[:used]) / (6 * self.spread[:used]) + 0.5, 0.0, 1.0)
        cells = np.minimum((unit + self.shifts[:used]) / 1.5 * 2**BITS, 2**BITS - 1).astype(np.int64)
        return np.stack([hilbert_keys(cells[:, c * width : (c + 1) * width], BITS) for c in range(curves)], axis=1)

    def places(self, curve: int, keys: np.ndarray, cids: np.ndarray) -> np.ndarray:
        """Ranks among the sampled keys of a curve; rows of one key spread evenly over its ranks."""
        low, high = (np.searchsorted(self.sample[curve], keys, side=s) for s in ("left", "right"))
        even = ((cids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) / 2.0**53
        return low + (high - low) * even


@dataclass(frozen=True)
class Plan:
    """How many curves are used, the window in sampled ranks, the ranks of one block and the blocks of a curve."""

    curves: int
    window: float
    step: float
    blocks: int


def _moments(classes: DataFrame, projections: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, int, int]:
    """Mean and deviation of every projected coordinate, the largest norm, the number of rows and of queries."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, asks, total, square, top = 0, 0, 0.0, 0.0, 0.0
        for batch in batches:
            x = _matrix(batch.column("vec")).astype(np.float64)
            if len(x):
                y = x @ projections[:-1]
                n, total, square, top = n + len(y), total + y.sum(0), square + (y * y).sum(0), max(top, float((x * x).sum(1).max()))
                asks += int(batch.column("asks").to_numpy(zero_copy_only=False).sum())
        if n:
            columns = [pa.array([n]), pa.array([asks]), pa.array([list(total)]), pa.array([list(square)]), pa.array([top])]
            yield pa.RecordBatch.from_arrays(columns, names=["n", "asks", "total", "square", "top"])

    # One row per partition.
    parts = (
        classes.select("vec", "asks").mapInArrow(part, "n long, asks long, total array<double>, square array<double>, top double").collect()
    )
    n = sum(p["n"] for p in parts)
    if not n:
        return np.zeros(0), np.zeros(0), 0.0, 0, 0
    mean = sum(np.array(p["total"]) for p in parts) / n
    spread = np.sqrt(np.maximum(sum(np.array(p["square"]) for p in parts) / n - mean**2, 1e-30))
    return mean, spread, math.sqrt(max(p["top"] for p in parts)), n, sum(p["asks"] for p in parts)


FOUND = "cid long, back array<double>, other array<long>"


def _first(query: np.ndarray, back: np.ndarray, other: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``keep`` best different hits of every query, by query; ``back`` is the negative score."""
    order = np.lexsort((other, back, query))
    query, back, other = query[order], back[order], other[order]
    new = np.ones(len(query), dtype=bool)
    new[1:] = (query[1:] != query[:-1]) | (other[1:] != other[:-1])
    query, back, other = query[new], back[new], other[new]
    starts = np.flatnonzero(np.diff(query, prepend=query[:1] - 1))
    best = np.arange(len(query)) - np.repeat(starts, np.diff(starts, append=len(query))) < keep
    return query[best], back[best], other[best]


def _lists(query: np.ndarray, back: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
    """One row per query, as FOUND, of hits in the order of queries."""
    starts = np.flatnonzero(np.diff(query, prepend=query[:1] - 1))
    ends = pa.array(np.append(starts, len(query)), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (back, other)]
    return pa.RecordBatch.from_arrays([pa.array(query[starts]), *lists], names=["cid", "back", "other"])


class Block:
    """Candidate rows that queries are compared with."""

    def __init__(self, cids: np.ndarray, x: np.ndarray) -> None:
        # In any order but that of the curve, so that the first rows stand for all.
        order = np.random.default_rng(5).permutation(len(x))
        self.cids, self.x = cids[order], x[order]
        norms = np.concatenate([np.sqrt((part.astype(np.float64) ** 2).sum(1)) for part in np.array_split(self.x, len(x) // TILE + 1)])
        top, middle = float(norms.max()), float(np.median(norms))
        # Single precision holds products of all rows well if none is much longer than most.
        single = x.dtype == np.float32 and 1e-15 < middle and top < min(1e15, 1000 * middle)
        self.rough = self.x if single else self.x.astype(np.float64)
        #: More than two products can be off together.
        self.slack = 4 * (x.shape[1] + 2) * (2.0**-24 if single else 2.0**-53) * top

    def nearest(self, asked: np.ndarray, q: np.ndarray, keep: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, back, other) of the ``keep`` best rows for queries of double precision, by exact scores."""
        if len(q) > QUERIES:
            return [f for b in range(0, len(q), QUERIES) for f in self.nearest(asked[b : b + QUERIES], q[b : b + QUERIES], keep)]
        unit = q / np.abs(q).max(axis=1, keepdims=True)
        unit = (unit / np.sqrt((unit * unit).sum(1, keepdims=True))).astype(self.rough.dtype)
        scores, begin, hits, held = unit @ self.rough[:HEAD].T, 0, [], 0
        head = scores.shape[1]
        floor = np.full(len(q), -np.inf)
        if head > keep:
            floor = np.partition(scores, head - keep, axis=1)[:, head - keep] - self.slack
        floor = floor.astype(self.rough.dtype)[:, None]
        while True:
            flat = np.flatnonzero(scores >= floor)
            row, col = np.divmod(flat, scores.shape[1])
            hits.append((row, col + begin, scores.ravel()[flat]))
            held += len(flat)
            if held > PAIRS and len(q) > 1:
                half = len(q) // 2
                return self.nearest(asked[:half], q[:half], keep) + self.nearest(asked[half:], q[half:], keep)
            begin += scores.shape[1]
            if begin >= len(self.x):
                break
            scores = unit @ self.rough[begin : begin + TILE].T
        row, col, rough = (np.concatenate(h) for h in zip(*hits, strict=True))
        order = np.lexsort((-rough, row))
        row, col, rough = row[order], col[order], rough[order]
        starts = np.searchsorted(row, np.arange(len(q)))
        last = np.minimum(starts + keep, np.append(starts[1:], len(row))) - 1
        # Whatever rounding could tie with the last one kept is ranked by exact scores too.
        tied = rough >= (rough[last] - self.slack).astype(rough.dtype)[row]
        row, col = row[tied], col[tied]
        parts = [slice(b, b + 65536) for b in range(0, len(row), 65536)]
        back = np.concatenate([-exact_scores(q[row[s]], self.x[col[s]].astype(np.float64)) for s in parts])
        return [_first(asked[row], back, self.cids[col], keep)]


def _sample_truth(classes: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """The k + 1 nearest classes of the sampled queries, as FOUND, against all rows in one pass."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            if batch.num_rows:
                found = Block(batch.column("cid").to_numpy(), _matrix(batch.column("vec"))).nearest(ids, q, k + 1)
                best = _first(*(np.concatenate(c) for c in zip(*found, *([best] if best else []), strict=True)), k + 1)
        if best:
            yield _lists(*best)

    return _merged(classes.select("cid", "vec").mapInArrow(nearest, FOUND), k + 1)


def _merged(found: DataFrame, keep: int) -> DataFrame:
    """One row per query of what several blocks found."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: tuple[np.ndarray, ...] = ()
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = batch.column("back").value_lengths().to_numpy(zero_copy_only=False)
            hits = [np.repeat(batch.column("cid").to_numpy(), lengths)] + [batch.column(c).flatten().to_numpy() for c in ("back", "other")]
            if left:
                hits = [np.concatenate(pair) for pair in zip(left, hits, strict=True)]
            done = _first(*hits, keep)
            # The last query may go on in the next batch.
            open_at = int(np.searchsorted(done[0], done[0][-1]))
            left = tuple(d[open_at:] for d in done)
            if open_at:
                yield _lists(*(d[:open_at] for d in done))
        if left:
            yield _lists(*left)

    return found.repartition("cid").sortWithinPartitions("cid").mapInArrow(merge, FOUND)


def fit(classes: DataFrame, curves: Curves, k: int, n: int, asks: int, cell_bytes: int) -> tuple[Curves, Plan]:
    """The sampled keys, and the number of curves and the window that cover TARGET of the sampled pairs with least work."""
    # SAMPLE queries, SAMPLE x k pairs and some FIT_ROWS rows of keys come to the driver.
    asked = classes.where("asks").orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).collect()
    ids, q = np.array([r["cid"] for r in asked]), np.array([r["vec"] for r in asked], dtype=np.float64)
    truth = _sample_truth(classes, ids, q, k).toArrow()
    lists = truth["other"].combine_chunks()
    query, other = np.repeat(truth["cid"].to_numpy(), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
    query, other = query[query != other], other[query != other]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = curves.keys(_matrix(batch.column("vec")), CURVES)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * CURVES, pa.int32()), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("cid"), batch.column("sampled"), lists], names=["cid", "sampled", "keys"])

    parts = 1 << 30
    sampled = F.pmod(F.xxhash64("cid"), F.lit(parts)) < math.ceil(parts * min(1.0, FIT_ROWS / n))
    wanted = classes.sparkSession.createDataFrame(pa.table({"cid": np.unique(other)})).withColumn("wanted", F.lit(True))
    rows = (
        classes.withColumn("sampled", sampled)
        .join(F.broadcast(wanted), "cid", "left")
        .where(F.col("sampled") | F.col("wanted"))
        .select("cid", "sampled", "vec")
        .mapInArrow(keys, "cid long, sampled boolean, keys array<long>")
        .toArrow()
    )
    cids, key, of_sample = rows["cid"].to_numpy(), _matrix(rows["keys"].combine_chunks()), rows["sampled"].to_numpy()
    if not of_sample.any():
        of_sample = ~of_sample
    curves = Curves(curves.projections, curves.shifts, curves.mean, curves.spread, curves.top, tuple(np.sort(key[of_sample, c]) for c in range(CURVES)))
    m, per = int(of_sample.sum()), n / int(of_sample.sum())
    by_cid, by_query = np.argsort(cids), np.argsort(ids)
    at, of = by_cid[np.searchsorted(cids, other, sorter=by_cid)], by_query[np.searchsorted(ids, query, sorter=by_query)]
    own, gap, best = curves.keys(q, CURVES, asked=True), np.full(len(other), np.inf), None
    for c in range(CURVES):
        gap = np.minimum(gap, np.abs(curves.places(c, key[at, c], other) - curves.places(c, own[of, c], query)))
        window = min(float(m), math.ceil(float(np.quantile(gap, TARGET, method="higher"))) + 1.0) if len(gap) else float(m)
        size = max(BLOCK, window * per / BLOCKS_ASIDE, FIT_PER_BLOCK * per)
        size = max(1.0, min(size, BLOCK_BYTES / cell_bytes))
        plan = Plan(c + 1, window, size / per, max(1, math.ceil(m * per / size)))
        share = min(1.0, (window + plan.step) / m)
        work = plan.curves * (ROW_COST * n + asks * n * share * (2 - share))
        if best is None or work < best[0]:
            best = work, plan
    return curves, best[1]


def index(classes: DataFrame, curves: Curves, plan: Plan, cell: str) -> DataFrame:
    """(slot, asks, cid, vec): every class in its block of each curve used, and every query in all blocks of its windows."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = lambda places: np.clip(np.floor(places / plan.step), 0, plan.blocks - 1).astype(np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, cids = _matrix(batch.column("vec")), batch.column("cid").to_numpy()
            vec = batch.column("vec")
            asks = np.flatnonzero(batch.column("asks").to_numpy(zero_copy_only=False))
            keys, asked = curves.keys(x, plan.curves), curves.keys(x[asks], plan.curves, asked=True) if len(asks) else None
            for c in range(plan.curves):
                own = block(curves.places(c, keys[:, c], cids))
                yield batch_of(c, own, False, batch.column("cid"), vec)
                if len(asks):
                    at = curves.places(c, asked[:, c], cids[asks])
                    low, high = block(at - plan.window), block(at + plan.window)
                    count = high - low + 1
                    row = np.repeat(np.arange(len(asks)), count)
                    slots = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                    # Its own class is seen in any case: its members may be copies of the query.
                    away = np.flatnonzero((own[asks] < low) | (own[asks] > high))
                    row, slots = np.append(row, away), np.append(slots, own[asks][away])
                    for begin in range(0, len(row), 10_000):
                        some = pa.array(asks[row[begin : begin + 10_000]])
                        yield batch_of(c, slots[begin : begin + 10_000], True, batch.column("cid").take(some), vec.take(some))

    def batch_of(curve: int, blocks: np.ndarray, asked: bool, cid: pa.Array, vec: pa.Array) -> pa.RecordBatch:
        slots = pa.array((curve * plan.blocks + blocks).astype(np.int32))
        return pa.RecordBatch.from_arrays([slots, pa.array(np.full(len(blocks), asked)), cid, vec], names=["slot", "asks", "cid", "vec"])

    return classes.select("cid", "asks", "vec").mapInArrow(placed, f"slot int, asks boolean, cid long, vec array<{cell}>")


def search(placed: DataFrame, plan: Plan, n: int, keep: int) -> DataFrame:
    """What every query finds in each of its blocks, as FOUND: the queries of a block stream past its rows."""
    slots = plan.curves * plan.blocks
    parts = min(slots, max(64, math.ceil(plan.curves * n / 65536)))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, rows, block = -1, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            state = batch.column("slot").to_numpy() * 2 + batch.column("asks").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(state)) + 1).tolist(), len(state)]
            for begin, end in zip(edges[:-1], edges[1:], strict=True):
                if state[begin] // 2 != slot:
                    slot, rows, block = state[begin] // 2, [], None
                piece = batch.slice(begin, end - begin)
                cids, x = piece.column("cid").to_numpy(), _matrix(piece.column("vec"))
                if not state[begin] % 2:
                    rows.append((cids, x))
                    continue
                if block is None and rows:
                    whole = [np.concatenate(r) for r in zip(*rows, strict=True)]
                    rows = []
                    block = Block(*whole)
                    del whole
                if block is not None:
                    for found in block.nearest(cids, x.astype(np.float64), keep):
                        yield _lists(*found)

    # Blocks that follow one another share a task if there are more blocks than tasks.
    part = F.floor(F.col("slot").cast("long") * parts / slots).cast("int")
    return placed.repartitionById(parts, part).sortWithinPartitions("slot", "asks").mapInArrow(look, FOUND)


def nearest(vectors: DataFrame, k: int, query: F.Column) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row for which ``query`` holds."""
    kind = vectors.schema["embedding"].dataType
    cell = "float" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "double"
    fine = _usable(vectors, cell)
    first = fine.select(F.size("vec").alias("d")).first()
    classes, members = _classes(fine, k, query)
    classes, members = stored(classes, "classes"), stored(members, "members")
    # Classes and members are tables of their own now.
    delete(fine)
    d = first["d"] if first else 1
    projections, shifts = _directions(d)
    mean, spread, top, n, asks = _moments(classes, projections)
    if asks:
        curves, plan = fit(classes, Curves(projections, shifts, mean, spread, top), k, n, asks, d * (4 if cell == "float" else 8))
        found = _merged(search(index(classes, curves, plan, cell), plan, n, k + 1), k + 1)
    else:
        found = classes.sparkSession.createDataFrame([], FOUND)
    # The k + 1 smallest ids of a class, at most k + 1 classes of a query.
    small = members.where(F.col("place") <= k).groupBy("cid").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    lists = (
        found.select(F.col("cid").alias("asker"), F.explode(F.arrays_zip("back", "other")).alias("hit"))
        .select("asker", "hit.back", F.col("hit.other").alias("cid"))
        .join(small, "cid")
        .groupBy("asker")
        .agg(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct(F.col("back"), i.alias("vec_id"))))).alias("hits"))
        .select("asker", F.slice(F.array_sort("hits"), 1, k + 1).alias("hits"))
    )
    own = F.filter("hits", lambda h: h["vec_id"] != F.col("query_id"))
    return (
        members.where("asks")
        .select(F.col("cid").alias("asker"), F.col("vec_id").alias("query_id"))
        .join(lists, "asker")
        .select("query_id", F.posexplode(F.slice(own, 1, k)).alias("at", "hit"))
        .select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.back")).alias("score"))
    )


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every ``embeddings`` row whose id 20 divides."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, 20, F.col("vec_id") % 20 == 0)
