"""Document fingerprints by consistent weighted sampling.

Terms are lower-cased words, weighted 1 + ln(count). For each of SAMPLES hash functions a term has
gamma and uniform variates that depend on the term and the function alone; with weight S,

    t = floor(ln S / r + b),  y = exp(r (t - b)),  a = c / (y exp(r)),  r, c ~ Gamma(2, 1), b ~ U(0, 1)

and the term with the least ``a`` is the sample, together with its ``t``. Two texts agree in a
sample with a probability of their generalised Jaccard similarity, sum(min)/sum(max) of weights.
The least ``a`` itself identifies (term, t), so a fingerprint keeps 16 bits of it per sample.

Defined cases: a null text counts as empty; a text without words has a fingerprint of zeros, alike
(1.0) to another empty one only; the only row of a table is its own next document; rows with equal
ids follow each other by a hash of their text; null ids come first; extra columns do not matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.shared import bounded_batches
from tallywright.llm.workers import held, slices


#: Samples of a fingerprint; the deviation of a likeness is at most 0.5 / sqrt(SAMPLES).
SAMPLES = 128
#: Terms whose variates a Python worker keeps: CACHED x SAMPLES x 4 bytes. A full cache is emptied.
CACHED = 250_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Splitmix finaliser over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sampler:
    """The samples' values per (term, weight), kept between batches in a Python worker."""

    def __init__(self, samples: int = SAMPLES, cached: int = CACHED):
        self.samples, self.cached = samples, cached
        with np.errstate(over="ignore"):
            self.salts = _mixed(np.arange(1, samples * 5 + 1, dtype=np.uint64) * _STEP).reshape(5, samples)
        self.clear()

    def clear(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.more: dict[tuple[int, int], int] = {}
        self.hash_of: dict[int, int] = {}
        self.values = np.empty((4096, self.samples), dtype=np.float32)
        self.filled = 0

    def _values(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Per term (a 64-bit hash) and count the ``a`` of every sample."""
        with np.errstate(over="ignore"):
            u = [((_mixed(keys[:, None] ^ s[None, :]) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53 for s in self.salts]
        r, log_c = -np.log(u[0] * u[1]), np.log(-np.log(u[2] * u[3]))
        t = np.floor(np.log1p(np.log(counts))[:, None] / r + u[4])
        # ln a is as good as a: only the order and equality count.
        return (log_c - r * (t - u[4]) - r).astype(np.float32)

    def _append(self, keys: list[int], counts: list[int]) -> None:
        need = self.filled + len(keys)
        if need > len(self.values):
            grown = np.empty((max(need, 2 * len(self.values)), self.samples), dtype=np.float32)
            grown[: self.filled] = self.values[: self.filled]
            self.values = grown
        for i in range(0, len(keys), 2048):
            part = slice(i, i + 2048)
            got = self._values(np.array(keys[part], dtype=np.uint64), np.array(counts[part], dtype=np.float64))
            self.values[self.filled : self.filled + len(got)] = got
            self.filled += len(got)

    def fingerprints(self, texts: list[str]) -> np.ndarray:
        """uint16 [len(texts), samples]; zeros for texts without words."""
        if self.filled > self.cached:
            self.clear()
        words = [x.encode("utf-8", "surrogatepass").lower().split() for x in texts]
        new = set().union(*words).difference(self.rows) if words else ()
        if new:
            new = sorted(new)
            hashes = [xxhash.xxh3_64_intdigest(w) for w in new]
            # Rows of single terms and of (term, count) pairs share the table of values.
            self.rows.update(zip(new, range(self.filled, self.filled + len(new)), strict=True))
            self.hash_of.update(zip(range(self.filled, self.filled + len(new)), hashes, strict=True))
            self._append(hashes, [1] * len(new))
        out = np.zeros((len(texts), self.samples), dtype=np.uint16)
        plans, keys, counts = [], [], []
        for ws in words:
            rows, n = np.unique(np.fromiter(map(self.rows.__getitem__, ws), dtype=np.int64, count=len(ws)), return_counts=True)
            often = np.flatnonzero(n > 1)
            for k in often:
                pair = (int(rows[k]), int(n[k]))
                if (row := self.more.get(pair)) is None:
                    row = self.more[pair] = self.filled + len(keys)
                    keys.append(self.hash_of[pair[0]])
                    counts.append(pair[1])
                rows[k] = row
            plans.append(rows)
        if keys:
            self._append(keys, counts)
        for i, rows in enumerate(plans):
            if len(rows):
                bits = self.values[rows].min(axis=0).view(np.uint32)
                out[i] = (bits * np.uint32(0x9E3779B1)) >> np.uint32(16)
        return out


def sampler(samples: int = SAMPLES) -> Sampler:
    """The Python worker's own sampler."""
    return held(("samples", samples), lambda: Sampler(samples))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples; texts without words are like each other only."""
    none_a, none_b = not a.any(), not b.any()
    return float(none_a and none_b) if none_a or none_b else float((a == b).mean())


def fingerprint(docs: DataFrame, text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """``docs`` with a column ``fingerprint``: 4 hex digits per sample."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        got = sampler(samples).fingerprints([x or "" for x in texts])
        return pd.Series([x.astype(">u2").tobytes().hex() for x in got], dtype=object)

    return docs.withColumn("fingerprint", of(F.col(text)))


def with_next(docs: DataFrame, pieces: int) -> DataFrame:
    """(piece, halo, doc_id, text): runs of ids, each followed by the first row of the next run.

    The bounds of the runs are ids of the table (``percentile_approx`` returns values that occur),
    so the row after a run is known to be the one whose id is the next bound. Texts are shuffled
    once; only the first rows of the runs go to two of them.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    at = [k / pieces for k in range(1, pieces)]
    low, bounds = docs.agg(F.min(key), F.percentile_approx(key, at, 10_000)).first()
    bounds = sorted({b for b in bounds or [] if b > low})

    @F.pandas_udf("int")
    def piece(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), side="right").astype("int32"))

    last = len(bounds)
    rows = docs.select(key.alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("own", piece("key"))
    ends = [F.when(F.col("key") == low, F.lit(last)), F.when(F.col("key").isin(bounds), F.col("own") - 1)]
    return (
        rows.withColumn("to", F.explode(F.array_compact(F.array(F.col("own"), *[F.when(e.isNotNull(), -1 - e) for e in ends]))))
        .select(
            F.when(F.col("to") < 0, -1 - F.col("to")).otherwise(F.col("to")).alias("piece"),
            (F.col("to") < 0).alias("halo"),
            "key",
            F.xxhash64("text").alias("tie"),
            "doc_id",
            "text",
        )
        .repartition("piece")
        .sortWithinPartitions("piece", "halo", "key", "tie")
        .select("piece", "halo", "doc_id", "text")
    )


NEXT_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def compare_with_edits(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text, of its edited text, and how alike they and the next text's are.

    The edited text has its last floor(n / 4) characters replaced by the first as many of the next
    text. Rows stream through in order; a task holds one batch and one row.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_chars", pa.int64())]
        + [(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
        + [(c, pa.float64()) for c in ("near_edited", "near_next")]
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple | None = None  # the row whose next one has not come yet
        for batch in batches:
            for part in slices(batch, "text", 1_000_000, 256):
                ids, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
                halos, pieces = part.column("halo").to_pylist(), part.column("piece").to_pylist()
                prints = sampler(samples).fingerprints(texts)
                rows = [] if waiting is None else [waiting]
                rows += [(p, h, i, x, f) for p, h, i, x, f in zip(pieces, halos, ids, texts, prints, strict=True)]
                # A halo ends its piece; repeated ids may leave several, of which the first counts.
                todo = [(a, b) for a, b in zip(rows, rows[1:]) if not a[1] and a[0] == b[0]]
                waiting = rows[-1]
                out = []
                edits = []
                for a, b in todo:
                    cut = len(a[3]) // 4
                    edits.append(a[3][: len(a[3]) - cut] + b[3][:cut])
                for (a, b), edit, edited in zip(todo, edits, sampler(samples).fingerprints(edits), strict=True):
                    out.append(
                        (
                            a[2],
                            len(a[3]),
                            hashlib.sha256(edit.encode("utf-8", "surrogatepass")).hexdigest(),
                            a[4].astype(">u2").tobytes().hex(),
                            edited.astype(">u2").tobytes().hex(),
                            likeness(a[4], edited),
                            likeness(a[4], b[4]),
                        )
                    )
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    bounded_batches(docs.sparkSession)
    pieces = 4 * max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return with_next(docs, min(pieces, 4000)).mapInArrow(compare, NEXT_SCHEMA)


def generalised_jaccard(a: str, b: str) -> float:
    """The similarity that a likeness estimates, computed outright; for tests."""
    from collections import Counter

    x, y = (Counter(t.encode().lower().split()) for t in (a, b))
    weigh = lambda c, w: 1 + math.log(c[w]) if c[w] else 0.0
    terms = x.keys() | y.keys()
    return sum(min(weigh(x, w), weigh(y, w)) for w in terms) / sum(max(weigh(x, w), weigh(y, w)) for w in terms) if terms else 1.0


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ``documents`` text with its edited text and the next document."""
    return compare_with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
