"""Vector codes: product quantisation whose nearest entries are looked up by memoised grid cells.

A component x becomes the integer floor(256 x), a vector is cut into PARTS equal parts, and every
part position has a codebook of ENTRIES entries. To find the entry nearest to a part, the part's
coarse grid cell is hashed. For a new cell the squared distances of every entry to the nearest and to the
farthest point of the cell's box are worked out; an entry whose nearest point is farther than some
other entry's farthest one is dominated, nowhere in the box can it be nearest. The others are kept
under the cell's key, and only they are evaluated exactly for every part of that cell. Dominance is
strict, so ties, which go to the lower index, stay whole. Cells change what is computed, never a result.

Codebooks start as the parts of the ENTRIES smallest ids. In each of ROUNDS rounds tasks sum their
own parts by entry, so what is shuffled, and what reaches the driver, is one row for each part, entry
and component whatever the number of vectors. Error totals by label are summed before they are joined
back; a label with more than a thousandth of all rows is joined by broadcast (there are under a
thousand of those), the rest by a shuffle without hot keys.

Defined cases: a vector that is null or holds null or non-finite components is left out; shorter
vectors count as followed by zeros up to the longest one's length, rounded up to a multiple of PARTS
(an empty vector is all zeros); components saturate at LARGEST, so that squared distances fit a long,
and sums of errors saturate at a long's end; repeated ids are coded row by row, and seed a codebook in
the order of their components; a null id is coded but seeds only where too few others are; with fewer than
ENTRIES vectors the codebook has as many entries; null labels are one label; an empty table gives no rows;
further columns are not carried over.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.shared import stored
from tallywright.llm.workers import held

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: The largest component: 16 parts of vectors of up to 2048 components add up to less than 2^63.
LARGEST = 1 << 24
#: Bytes of remembered cells in a worker, and rows that are coded at a time.
MEMO, ROWS = 48_000_000, 2048
#: A label with more than this share of all rows is joined by broadcast.
HOT = 0.001
LONGEST = 2**63 - 1


def integer_vectors(column: pa.Array, width: int) -> np.ndarray:
    """The vectors' integer components, ``width`` of them each; float arithmetic is exact up to the floor."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(column), width), dtype=np.int64)
    lengths = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(column)), lengths)
    at = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, at] = np.clip(np.floor(np.minimum(np.maximum(values, -LARGEST), LARGEST) * SCALE), -LARGEST, LARGEST).astype(np.int64)
    return out


def cell_bits(codebook: np.ndarray) -> int:
    """Bits of a cell's width: about half the median distance between neighbouring entries."""
    d = ((codebook[:, None, :] - codebook[None, :, :]) ** 2).sum(axis=2).astype(np.float64)
    np.fill_diagonal(d, np.inf)
    nearest = d.min(axis=1)
    nearest = nearest[np.isfinite(nearest) & (nearest > 0)]
    return max(0, round(float(np.log2(np.sqrt(np.median(nearest)) / 2)))) if len(nearest) else 0


def not_dominated(cells: np.ndarray, bits: int, codebook: np.ndarray) -> list[np.ndarray]:
    """For each cell the ascending indices of the entries that can be nearest somewhere in its box."""
    low = (cells << bits)[:, None, :]
    high = low + (1 << bits) - 1
    book = codebook[None, :, :]
    outside = np.maximum(np.maximum(low - book, book - high), 0)
    farthest = np.maximum(np.abs(book - low), np.abs(book - high))
    least, most = (outside**2).sum(axis=2), (farthest**2).sum(axis=2)
    return [np.flatnonzero(x) for x in least <= most.min(axis=1, keepdims=True)]


class Grid:
    """One codebook's cells: which entries to evaluate, remembered by cell."""

    def __init__(self, codebook: np.ndarray):
        self.codebook, self.bits = codebook, cell_bits(codebook)
        self.known: dict[bytes, np.ndarray] = {}
        self.bytes = self.evaluated = 0

    def nearest(self, parts: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of every part's nearest entry, ties to the lower index."""
        if not len(parts) or not parts.shape[1]:
            return np.zeros(len(parts), dtype=np.int64), np.zeros(len(parts), dtype=np.int64)
        cells, where = np.unique(parts >> self.bits, axis=0, return_inverse=True)
        where = where.reshape(-1)
        keys = [c.tobytes() for c in np.ascontiguousarray(cells)]
        if self.bytes > room:
            self.known.clear()
            self.bytes = 0
        if new := [i for i, k in enumerate(keys) if k not in self.known]:
            for i, found in zip(new, not_dominated(cells[new], self.bits, self.codebook), strict=True):
                self.known[keys[i]] = found
                self.bytes += 250 + found.nbytes
        open_to = [self.known[k] for k in keys]
        sizes = np.array([len(x) for x in open_to])
        starts, flat = np.cumsum(sizes) - sizes, np.concatenate(open_to)
        # One row for each part and entry of its cell, the parts' rows one after the other.
        per_part = sizes[where]
        first = np.cumsum(per_part) - per_part
        part = np.repeat(np.arange(len(parts)), per_part)
        entry = flat[np.repeat(starts[where], per_part) + np.arange(len(part)) - first[part]]
        self.evaluated += len(part)
        distance = ((parts[part] - self.codebook[entry]) ** 2).sum(axis=1)
        best = np.minimum.reduceat(distance, first)
        return np.minimum.reduceat(np.where(distance == best[part], entry, len(self.codebook)), first), best


@dataclass
class Coder:
    """The codebooks of all part positions: (parts, entries, components of a part)."""

    books: np.ndarray

    def __post_init__(self) -> None:
        self.grids = [Grid(b) for b in self.books]

    def code(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, parts) of entry indices and of squared distances."""
        codes, errors = np.zeros((len(vectors), len(self.books)), dtype=np.int64), np.zeros((len(vectors), len(self.books)), dtype=np.int64)
        for p, block in enumerate(np.split(vectors, len(self.books), axis=1)):
            codes[:, p], errors[:, p] = self.grids[p].nearest(block, MEMO // len(self.books))
        return codes, errors


def sha256_of(books: np.ndarray) -> str:
    """The digest of all entries' components, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def kept(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """``vec_id``, ``label`` and ``vec`` of the rows that take part."""
    vec = F.col(column).cast("array<double>")
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select("vec_id", "label", vec.alias("vec")).where(F.col("vec").isNotNull() & ~bad)


def _coding(spark: SparkSession, books: np.ndarray, take):
    """A ``mapInArrow`` function: ``take(ids and labels, codes, errors, vectors)`` of each batch, and of None at the end."""
    shared, token, width = spark.sparkContext.broadcast(books), uuid.uuid4().hex, books.shape[0] * books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = held(("vector codes", token), lambda: Coder(shared.value))
        state: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                vectors = integer_vectors(part.column("vec"), width)
                yield from take(state, part, *coder.code(vectors), vectors)
        yield from take(state, None, None, None, None)

    return run


def _sums(state: dict, batch, codes, errors, vectors) -> Iterator[pa.RecordBatch]:
    """Adds to a task's sums by part, entry and component (the last one counts); gives them at the end."""
    if batch is not None:
        wide = vectors.reshape(len(vectors), codes.shape[1], -1)
        sums = state.setdefault("sums", np.zeros((codes.shape[1], ENTRIES, wide.shape[2] + 1), dtype=object))
        for p in range(codes.shape[1]):
            one = np.zeros((ENTRIES, wide.shape[2] + 1), dtype=np.int64)
            np.add.at(one, codes[:, p], np.concatenate([wide[:, p], np.ones((len(wide), 1), dtype=np.int64)], axis=1))
            sums[p] += one
    elif state:
        p, e, j = np.nonzero(state["sums"])
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int32()) for x in (p, e, j)] + [pa.array([str(x) for x in state["sums"][p, e, j]])], names=["part", "entry", "component", "total"]
        )


def _coded(state: dict, batch, codes, errors, vectors) -> Iterator[pa.RecordBatch]:
    if batch is not None:
        digits = codes.astype(np.uint8)
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("label"), pa.array([x.tobytes().hex() for x in digits]), pa.array(errors.sum(axis=1))],
            names=["vec_id", "label", "code", "error"],
        )


def trained(rows: DataFrame, rounds: int = ROUNDS, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray | None:
    """The codebooks after ``rounds`` rounds over all of ``rows`` (see ``kept``); None of an empty table."""
    spark = rows.sparkSession
    if not 0 < entries <= ENTRIES:
        raise ValueError(f"a codebook has 1 to {ENTRIES} entries")
    longest = rows.agg(F.max(F.size("vec"))).first()[0]
    if longest is None:
        return None
    width = -(-longest // parts) * parts
    # At most ``entries`` rows.
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vec").select("vec").limit(entries).toArrow()
    books = np.stack(np.split(integer_vectors(seeds.column("vec"), width), parts, axis=1))
    for _ in range(rounds):
        sums = rows.mapInArrow(_coding(spark, books, _sums), "part int, entry int, component int, total string")
        found = sums.groupBy("part", "entry", "component").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
        total = {(r.part, r.entry, r.component): int(r.total) for r in found}
        d = books.shape[2]
        moved = books.copy()
        for p, e, j in np.ndindex(books.shape):
            if n := total.get((p, e, d)):
                moved[p, e, j] = total.get((p, e, j), 0) // n
        books = moved
    return books


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` (label, error, ...) with ``label_error``, the sum over equal labels."""
    totals = stored(coded.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("error").cast("decimal(38,0)")).alias("sum")), "labels")
    totals = totals.select(F.col("label").alias("_label"), "n", F.least("sum", F.lit(LONGEST).cast("decimal(38,0)")).cast("long").alias("_sum"))
    all_rows = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_hot = F.col("n") > HOT * all_rows
    # Fewer than 1 / HOT labels.
    hot = totals.where(is_hot).select("_label", F.col("_sum").alias("_hot"))
    rest = totals.where(~is_hot).select("_label", F.col("_sum").alias("_cold"))
    rows = coded.join(F.broadcast(hot), coded["label"].eqNullSafe(hot["_label"]), "left").drop("_label")
    # Rows of hot labels match nothing more; they are dealt out by their ids.
    salt = F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64("vec_id", "code"), F.lit(4096)))
    rows = rows.withColumn("_salt", salt)
    rest = rest.withColumn("_at", F.lit(0).cast("long"))
    joined = rows.join(rest, rows["label"].eqNullSafe(rest["_label"]) & (rows["_salt"] == rest["_at"]), "left")
    return joined.withColumn("label_error", F.coalesce("_hot", "_cold")).drop("_label", "_hot", "_cold", "_salt", "_at")


def compressed(vectors: DataFrame, column: str = "embedding", rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray | None]:
    """(vec_id, label, code, error) of ``vectors`` that take part, and the codebooks."""
    rows = kept(vectors, column)
    books = trained(rows, rounds)
    schema = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, label {vectors.schema['label'].dataType.simpleString()}, code string, error long"
    if books is None:
        return vectors.sparkSession.createDataFrame([], schema), None
    return rows.mapInArrow(_coding(vectors.sparkSession, books, _coded), schema), books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of every ``embeddings`` row, its error, its label's error and the codebooks' digest."""
    coded, books = compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    coded = coded if books is None else stored(coded, "codes")
    digest = sha256_of(books) if books is not None else ""
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _rounds_sql() -> str:
    """Assignment and update of each round, written out; all in integers."""
    text = []
    for r in range(ROUNDS + 1):
        text.append(f"""
a{r} AS (
  SELECT rid, part, arg_min(entry, distance * {ENTRIES} + entry) AS entry, min(distance) AS distance
  FROM (SELECT p.rid, p.part, b.entry,
               list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance
        FROM parts p JOIN b{r} b ON b.part = p.part)
  GROUP BY rid, part)""")
        if r < ROUNDS:
            text.append(f"""
m{r} AS (
  SELECT part, entry, list(c ORDER BY j) AS v
  FROM (SELECT a.part, a.entry, j, floor(sum(p.v[j])::DOUBLE / count(*))::BIGINT AS c
        FROM a{r} a JOIN parts p ON p.rid = a.rid AND p.part = a.part, range(1, len(p.v) + 1) AS t(j)
        GROUP BY a.part, a.entry, j)
  GROUP BY part, entry),
b{r + 1} AS (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN m{r} m ON m.part = b.part AND m.entry = b.entry)""")
    return ",".join(text)


#: All vectors of one length that PARTS divides, ids without nulls; every part against every entry.
OP11_SQL = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS rid, vec_id, label,
         list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (
  SELECT rid, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] AS v
  FROM kept, range({PARTS}) AS t(part)),
b0 AS (SELECT part, rid AS entry, v FROM parts WHERE rid < {ENTRIES}),{_rounds_sql()},
coded AS (
  SELECT rid, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, sum(distance)::BIGINT AS error
  FROM a{ROUNDS} GROUP BY rid),
digest AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (rid), digest
"""
