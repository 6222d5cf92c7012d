"""Toxicity: a counterfactually regularised linear classifier over words and word beginnings.

Features are the distinct lower-cased words of a text and their beginnings of PREFIXES characters,
which carry over to forms that training has not seen. Training keeps the features that go along
with the label more often than chance explains (a z-score of MIN_Z), FEATURES at most, and fits a
ridge-penalised logistic regression on them.

Counterfactual regularisation: a labelled text that holds an identity term gets copies in which the
term is swapped for another of its group. The loss adds LAMBDA times the squared difference between
the scores (logits) of text and copy. A term that merely goes along with toxic texts then cannot
carry weight of its own, so neutral mentions of a group are not taken for abuse.

The model is fitted on a bounded sample of labelled rows, SAMPLE at most: of either label the
SAMPLE / 2 rows with the smallest hash of their id. Row weights undo the balance. Scores run over
all whole texts in Spark; what tasks get is bounded by FEATURES.

Defined cases: a null or empty text has the score of no words, the model's prior; with labels of one
kind only that kind's certainty is every score, and 0 without labels; equal texts score equally; an
id that occurs twice among the labels counts once, with the larger label; null labels do not count;
extra columns stay, but one named like the score's ``column`` is replaced by it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.shared import bounded_batches, stored
from tallywright.llm.workers import WordStore, held, slices

#: Characters of the word beginnings.
PREFIXES = (4, 5)
#: Labelled rows that training uses at most, half of them for either label.
SAMPLE = 24_000
#: Features of a model at most; how unlikely by chance and how frequent each must be.
FEATURES, MIN_Z, MIN_ROWS = 65_536, 5.0, 3
#: Weight of the counterfactual term and of the L2 term, passes over the sample.
LAMBDA, RIDGE, PASSES = 2.0, 1e-5, 80
THRESHOLD = 0.3
#: Groups of identity terms; a term is swapped for another one of its group.
IDENTITY_TERMS = [
    ["women", "men", "girls", "boys"],
    ["woman", "man", "girl", "boy"],
    ["female", "male", "nonbinary", "transgender"],
    ["gay", "straight", "lesbian", "bisexual", "queer"],
    ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist"],
    ["christians", "muslims", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "latino"],
    ["african", "european", "american", "mexican", "chinese", "indian"],
    ["immigrants", "refugees", "foreigners", "citizens"],
    ["disabled", "blind", "deaf", "elderly", "young"],
    ["frauen", "männer"],
    ["femmes", "hommes"],
    ["mujeres", "hombres"],
]
_STRIP = ".,;:!?\"'()[]{}*&%$#|-_<>/\\"


def word_features(raw: str) -> tuple[int, ...]:
    """Signed 64-bit hashes of a word and of its beginnings."""
    word = raw.strip(_STRIP)
    keys = [f"w:{word}", *(f"{n}:{word[:n]}" for n in PREFIXES if len(word) >= n)] if word else []
    return tuple(xxhash.xxh3_64_intdigest(k.encode("utf-8", "surrogatepass")) - 2**63 for k in keys)


def text_features(text: str) -> list[int]:
    """Sorted distinct features of a text."""
    return sorted({f for word in set(text.lower().split()) for f in word_features(word)})


def counterfactuals(text: str, groups: list[list[str]] = IDENTITY_TERMS) -> list[str]:
    """Copies of the text with its identity terms swapped, each by another term of its group.

    One copy per step around the largest group involved; no copy without a term.
    """
    place = {term: (g, i) for g, group in enumerate(groups) for i, term in enumerate(group)}
    words = text.lower().split()
    hits = [(k, t) for k, w in enumerate(words) if (t := w.strip(_STRIP)) in place]
    copies = []
    for step in range(1, max((len(groups[place[t][0]]) for _, t in hits), default=0)):
        swapped = list(words)
        for k, term in hits:
            g, i = place[term]
            swapped[k] = words[k].replace(term, groups[g][(i + step) % len(groups[g])])
        copies.append(" ".join(swapped))
    return copies


@dataclass
class Model:
    """Weights of features and a bias; the score is the logistic function of their sum."""

    weights: dict[int, float]
    bias: float


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit(rows: list[list[int]], labels: np.ndarray, weights: np.ndarray, pairs: list[tuple[int, list[int]]], lam: float = LAMBDA) -> Model:
    """Logistic regression by Adagrad steps over the whole sample.

    ``pairs`` are (row, features of a counterfactual); each adds lam (z - z')^2, whose gradient
    touches only the features in which the two differ.
    """
    rate = float(np.average(labels, weights=weights)) if len(labels) else 0.0
    if not 0 < rate < 1:
        return Model({}, 40.0 if rate else -40.0)
    flat = lambda many: (np.repeat(np.arange(len(many)), [len(r) for r in many]), np.array([f for r in many for f in r], dtype=np.int64))
    at, cols = flat(rows)
    c_at, c_cols = flat([p for _, p in pairs])
    used, all_cols = np.unique(np.concatenate([cols, c_cols]), return_inverse=True)
    cols, c_cols = all_cols[: len(cols)], all_cols[len(cols) :]
    origin = np.array([i for i, _ in pairs], dtype=np.int64)
    share = weights / weights.sum()
    w, bias = np.zeros(len(used)), float(np.log(rate / (1 - rate)))
    w_seen, bias_seen = np.full(len(used), 1e-8), 1e-8
    for _ in range(PASSES):
        z = np.bincount(at, w[cols], minlength=len(rows)) + bias
        error = (_logistic(z) - labels) * share
        grad = np.bincount(cols, error[at], minlength=len(used)) + RIDGE * w
        if pairs:
            gap = 2 * lam / len(pairs) * (z[origin] - np.bincount(c_at, w[c_cols], minlength=len(pairs)) - bias)
            pull = np.bincount(origin, gap, minlength=len(rows))
            grad += np.bincount(cols, pull[at], minlength=len(used)) - np.bincount(c_cols, gap[c_at], minlength=len(used))
        w_seen += grad * grad
        bias_seen += error.sum() ** 2
        w -= 0.5 * grad / np.sqrt(w_seen)
        bias -= 0.1 * error.sum() / np.sqrt(bias_seen)
    return Model(dict(zip(used.tolist(), w.tolist(), strict=True)), float(bias))


def _sampled(labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, label): of either label the sample / 2 rows with the smallest hash of their id."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").alias("label"))
    first = [known.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2) for v in (0, 1)]
    return first[0].union(first[1])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE, groups: list[list[str]] = IDENTITY_TERMS, lam: float = LAMBDA) -> Model:
    """A model from ``labels`` (doc_id, label 0 or 1) and the texts of ``docs``."""
    bounded_batches(docs.sparkSession)
    counts = {r["label"]: r["n"] for r in labels.where(F.col("label").isin(0, 1)).groupBy("label").agg(F.countDistinct("doc_id").alias("n")).collect()}

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4_000_000, 256):
                texts = [x or "" for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("label"),
                        pa.array([text_features(x) for x in texts], pa.list_(pa.int64())),
                        pa.array([[text_features(c) for c in counterfactuals(x, groups)] for x in texts], pa.list_(pa.list_(pa.int64()))),
                    ],
                    names=["label", "features", "swapped"],
                )

    # The sampled labels are at most ``sample`` rows.
    chosen = F.broadcast(_sampled(labels, sample))
    rows = stored(
        docs.select("doc_id", F.col(text).alias("text")).join(chosen, "doc_id").select("label", "text").mapInArrow(describe, "label int, features array<long>, swapped array<array<long>>"),
        "labelled",
    )
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < ones < n:
        return fit([[]] * n, np.full(n, float(ones > 0)), np.ones(n), [])
    rate = ones / n
    expected = F.col("rows") * rate
    z = (F.col("ones") - expected) / F.sqrt(expected * (1 - rate))
    telling = (
        rows.select("label", F.explode("features").alias("feature"))
        .groupBy("feature")
        .agg(F.count("*").alias("rows"), F.sum("label").alias("ones"))
        .withColumn("z", z)
        .where((F.col("rows") >= MIN_ROWS) & (F.col("z") >= MIN_Z))
        .orderBy(F.desc("z"), "feature")
        .limit(FEATURES)
    )
    kept = frozenset(r["feature"] for r in telling.select("feature").collect())

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = lambda many: [f for f in many if f in kept]
        for batch in batches:
            features = [only(x) for x in batch.column("features").to_pylist()]
            swapped = [[only(c) for c in copies] for copies in batch.column("swapped").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array(features, pa.list_(pa.int64())), pa.array(swapped, pa.list_(pa.list_(pa.int64())))],
                names=["label", "features", "swapped"],
            )

    # At most ``sample`` rows with the few telling features of each.
    small = rows.mapInArrow(reduce, rows.schema).collect()
    y = np.array([r["label"] for r in small], dtype=np.float64)
    undo = {v: counts.get(v, 0) / max(1, int((y == v).sum())) for v in (0, 1)}
    pairs = [(i, copy) for i, r in enumerate(small) for copy in r["swapped"]]
    return fit([r["features"] for r in small], y, np.where(y == 1, undo[1], undo[0]), pairs, lam)


class Scorer:
    """A model's weights with the telling features of the words that a worker has met."""

    def __init__(self, model: Model):
        self.weights, self.bias, self.memory = model.weights, model.bias, WordStore()

    def logit(self, text: str | None) -> float:
        known, weights = self.memory.words, self.weights
        self.memory.room()
        words = set((text or "").lower().split())
        # Nearly all words have no telling feature.
        if new := words.difference(known):
            self.memory.learn({w: tuple(f for f in word_features(w) if f in weights) for w in new})
        found = set().union(*filter(None, map(known.__getitem__, words)))
        return self.bias + sum(weights[f] for f in sorted(found))


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with the score of whole texts in ``column``, which replaces one of that name."""
    bounded_batches(docs.sparkSession)
    known_by, token = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        scorer = held(("toxicity", token), lambda: Scorer(known_by.value))
        return pd.Series(_logistic(np.array([scorer.logit(x) for x in texts], dtype=np.float64)))

    return docs.withColumn(column, of(F.col(text)))


def held_out(doc_id: F.Column) -> F.Column:
    """The rows whose labels training must not see."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def toxic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, label) of the ``labels`` rows that training may see."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.where(~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("label"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every ``documents`` text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, toxic_labels(spark, sf_dir))
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
