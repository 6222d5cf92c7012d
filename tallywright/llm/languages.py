"""Languages of a text as a mixture: proportions by expectation-maximisation, the set by penalised likelihood.

A language is a character model: the chance of a letter (or a word's end) after the up to ORDER - 1
before it, smoothed with shorter contexts. A text is a bag of words, each drawn from one of the
text's languages; a word's likelihood in a language is the product over its n-grams.
Expectation-maximisation finds the proportions that make the words likeliest. From all learned
languages the least used one is taken out again and again, as long as the log likelihood loses less
than the penalty for a language, GAIN + WEIGHT ln(words). The prediction is the language with the
largest share of what stays, the score that share.

The likelihood is concave in the proportions, so its slope bounds what a mixture can gain over the best
single language. Where that bound is below the penalty the single language is the answer, and no
iteration is needed; results are the same.

The models are fitted on a bounded sample: SAMPLE texts in all, dealt evenly to the languages by a
hash of the id (an expected number; a binomial deviation stays). A model holds CELLS counts at most,
of the commonest n-grams and the LANGUAGES commonest languages. Prediction covers whole texts; words
beyond LONGEST characters count as several.

Defined cases: ``und`` and a score of 0 for a text that is null or has no letter, and for all texts if nothing was
learned; one language learned: it is predicted for every text with a letter, with 1; equal texts get equal results;
ties go to the language first in order; rows of a null id can be learned from, repeated ones count
each time; further columns stay, but those named like a result are replaced by it.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.shared import bounded_batches, columns_of, private, stored
from tallywright.llm.workers import LIMIT, held, slices

#: Letters of an n-gram, weight of shorter contexts, characters of a word.
ORDER, SMOOTH, LONGEST = 4, 3.0, 40
#: Texts to learn from, languages and counts of a model, n-grams that a worker remembers.
SAMPLE, LANGUAGES, CELLS, GRAMS = 40_000, 256, 1_000_000, 200_000
#: The penalty for a language, and when iterations end.
GAIN, WEIGHT, ROUNDS, STILL = 4.0, 1.5, 60, 1e-4
UNKNOWN = "und"


def words_of(text: str | None) -> Counter:
    """The lower-cased words of a text that hold a letter, with their counts; long ones in pieces."""
    found = Counter((text or "").lower().split())
    for w in [w for w in found if len(w) > LONGEST]:
        n = found.pop(w)
        for i in range(0, len(w), LONGEST):
            found[w[i : i + LONGEST]] += n
    return found


def runs(word: str) -> list[str]:
    """The runs of letters in a word."""
    return [word] if word.isalpha() else "".join(c if c.isalpha() else " " for c in word).split()


def grams(word: str, order: int = ORDER) -> list[str]:
    """The longest n-gram that ends at each letter of the word's runs and at each run's end."""
    found = []
    for run in runs(word):
        p = f" {run} "
        found += [p[max(0, i - order + 1) : i + 1] for i in range(1, len(p))]
    return found


@dataclass
class Model:
    """Counts of n-grams of all orders by language: ``counts[gram]`` has one number for each of ``languages``."""

    languages: list[str]
    counts: dict[str, np.ndarray]

    def __post_init__(self) -> None:
        n = len(self.languages)
        self.after: dict[str, np.ndarray] = {}
        for g, c in self.counts.items():
            self.after[g[:-1]] = self.after.get(g[:-1], np.zeros(n)) + c
        self.letters = 1 + sum(len(g) == 1 for g in self.counts)
        self.nothing = np.zeros(n)


class Guesser:
    """A model with the n-grams and words a worker has met, both bounded."""

    def __init__(self, model: Model):
        self.model, self.n = model, len(model.languages)
        self.chances: dict[str, np.ndarray] = {}
        self.at: dict[int, int] = {}
        #: Words that are learned together, so that the n-grams of a step stay small.
        self.step = max(32, 2_000_000 // (LONGEST * max(1, self.n)))
        self.gram_logs = np.zeros((GRAMS + 1 + 3 * LONGEST * self.step, self.n))
        self.room = max(1000, LIMIT // (170 + 8 * self.n))
        self.known: dict[str, int] = {}
        self.logs = np.zeros((self.room, self.n))
        self.lettered = np.zeros(self.room, dtype=bool)
        self.solved = 0

    def chance(self, gram: str) -> np.ndarray:
        """The chance of the n-gram's last character after the others, by language."""
        if (found := self.chances.get(gram)) is None:
            m = self.model
            seen, after = m.counts.get(gram, m.nothing), m.after.get(gram[:-1], m.nothing)
            if len(gram) == 1:
                found = (seen + 0.5) / (after + 0.5 * m.letters)
            else:
                found = (seen + SMOOTH * self.chance(gram[1:])) / (after + SMOOTH)
            self.chances[gram] = found
        return found

    def learn(self, words: list[str]) -> None:
        """Log likelihoods of words not met before, many at a time: all their n-grams (see ``grams``) are found in one array."""
        for part in _parts(words, self.step):
            if max(len(self.at), len(self.chances) // 4) > GRAMS:
                self.chances.clear()
                self.at.clear()
            begin = len(self.known)
            self.known.update(zip(part, range(begin, begin + len(part)), strict=True))
            self.logs[begin : begin + len(part)] = 0.0
            c = np.frombuffer(f" {' '.join(part)} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
            owner = np.repeat(np.arange(len(part)), np.fromiter(map(len, part), dtype=np.int64, count=len(part)) + 1)
            signs, which = np.unique(c, return_inverse=True)
            letter = np.array([chr(x).isalpha() for x in signs.tolist()])[which]
            c = np.where(letter, c, 32).astype(np.uint64)
            # Letters and the ends of their runs, and where each one's run begins.
            ends = np.flatnonzero(letter[1:] | letter[:-1]) + 1
            if not len(ends):
                self.lettered[begin : begin + len(part)] = False
                continue
            before = np.maximum.accumulate(np.where(letter, 0, np.arange(len(c))))[ends - 1]
            sizes = np.minimum(ORDER, ends - before + 1)
            key = np.zeros(len(ends), dtype=np.uint64)
            for k in range(ORDER):
                key = key * np.uint64(0x9E3779B97F4A7C15) + np.where(k < sizes, c[np.maximum(ends - k, 0)] + np.uint64(1), np.uint64(0))
            found, first, place = np.unique(key, return_index=True, return_inverse=True)
            new = [k for k, x in enumerate(found.tolist()) if x not in self.at]
            if new:
                told = ["".join(map(chr, c[ends[i] - sizes[i] + 1 : ends[i] + 1].tolist())) for i in first[new].tolist()]
                at = len(self.at)
                self.gram_logs[at : at + len(new)] = np.log(np.stack([self.chance(g) for g in told]))
                self.at.update(zip(found[new].tolist(), range(at, at + len(new)), strict=True))
            rows = np.fromiter(map(self.at.__getitem__, found.tolist()), dtype=np.int64, count=len(found))[place]
            # A run's end belongs to its word: the space behind a word counts as the word's.
            of = owner[ends - 1]
            starts = np.flatnonzero(np.diff(of, prepend=-1))
            self.logs[begin + of[starts]] = np.add.reduceat(self.gram_logs[rows], starts)
            self.lettered[begin : begin + len(part)] = False
            self.lettered[begin + of[starts]] = True

    def know(self, words: set[str]) -> None:
        """Have all of ``words`` in the store, at most half of its room; a full store starts anew."""
        new = words.difference(self.known)
        if len(self.known) + len(new) > self.room:
            self.known.clear()
            new = words
        self.learn(list(new))

    def rows(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, log likelihoods, count) of the distinct lettered words of all texts."""
        at, logs, counts = [], [], []
        all_words = [words_of(text) for text in texts]
        distinct = set().union(*all_words)
        # Nearly always the words of all texts fit; else those of a text, or a part of them, are looked up at a time.
        if len(distinct) <= self.room // 2:
            self.know(distinct)
        for i, found in enumerate(all_words):
            for part in _parts(list(found), self.room // 2):
                if len(distinct) > self.room // 2:
                    self.know(set(part))
                where = np.fromiter(map(self.known.__getitem__, part), dtype=np.int64, count=len(part))
                use = self.lettered[where]
                logs.append(self.logs[where[use]])
                counts.append(np.fromiter(map(found.__getitem__, part), dtype=np.float64, count=len(part))[use])
                at.append(np.full(int(use.sum()), i))
        if not at:
            return np.zeros(0, dtype=np.int64), np.zeros((0, self.n)), np.zeros(0)
        return np.concatenate(at), np.concatenate(logs), np.concatenate(counts)

    def shares(self, texts: list[str | None]) -> np.ndarray:
        """(texts, languages): proportions of the selected languages; a row of zeros without a letter."""
        at, logs, counts = self.rows(texts)
        shares = np.zeros((len(texts), self.n))
        if not len(at):
            return shares
        owners, first = np.unique(at, return_index=True)
        words = np.add.reduceat(counts, first)
        single = np.add.reduceat(logs * counts[:, None], first)
        best = single.argmax(axis=1)
        shares[owners, best] = 1.0
        of = np.repeat(np.arange(len(owners)), np.diff(np.append(first, len(at))))
        # The slope from the best single language towards each other one.
        ratio = np.exp(np.minimum(logs - logs[np.arange(len(at)), best[of]][:, None], 500.0))
        slope = np.add.reduceat(ratio * counts[:, None], first) - words[:, None]
        open_to = np.flatnonzero(slope.max(axis=1) > penalty(words))
        if self.n > 1 and len(open_to):
            self.solved += len(open_to)
            mine = np.isin(of, open_to)
            shares[owners[open_to]] = selected(np.searchsorted(open_to, of[mine]), logs[mine], counts[mine])
        return shares


def _parts(values: list, most: int) -> Iterator[list]:
    for i in range(0, len(values), most):
        yield values[i : i + most]


def penalty(words: np.ndarray) -> np.ndarray:
    """What a further language must gain in a text of so many words."""
    return GAIN + WEIGHT * np.log(words)


def proportions(of: np.ndarray, likely: np.ndarray, counts: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation from ``start`` (texts, languages): shares, and the log likelihood less a constant.

    ``of`` numbers the texts of the words in ascending order. A text whose shares move no more is left alone.
    """
    shares = start.copy()
    first = np.flatnonzero(np.diff(of, prepend=-1))
    total = np.add.reduceat(counts, first)
    moving = np.ones(len(shares), dtype=bool)
    for _ in range(ROUNDS):
        use = moving[of]
        local, mine = np.flatnonzero(moving), of[use]
        part = likely[use] * shares[mine]
        part *= (counts[use] / part.sum(axis=1))[:, None]
        new = np.add.reduceat(part, np.flatnonzero(np.diff(mine, prepend=-1))) / total[local][:, None]
        still = np.abs(new - shares[local]).max(axis=1) < STILL
        shares[local] = new
        moving[local[still]] = False
        if not moving.any():
            break
    fit = np.add.reduceat(np.log((likely * shares[of]).sum(axis=1)) * counts, first)
    return shares, fit


def selected(of: np.ndarray, logs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Shares of the languages that stay when the least used ones are taken out while that costs less than the penalty.

    ``of`` holds all numbers from 0 on, in ascending order.
    """
    # A word that a language cannot have made keeps a chance of e^-600 there.
    likely = np.exp(np.maximum(logs - logs.max(axis=1, keepdims=True), -600.0))
    texts, n = int(of[-1]) + 1, logs.shape[1]
    words = np.bincount(of, counts)
    shares, fit = proportions(of, likely, counts, np.full((texts, n), 1.0 / n))
    todo = np.flatnonzero((shares > 0).sum(axis=1) > 1)
    while len(todo):
        fewer = shares[todo]
        fewer[np.arange(len(todo)), np.where(fewer > 0, fewer, 2.0).argmin(axis=1)] = 0.0
        fewer /= fewer.sum(axis=1, keepdims=True)
        use = np.isin(of, todo)
        tried, fit_tried = proportions(np.searchsorted(todo, of[use]), likely[use], counts[use], fewer)
        worth = fit[todo] - fit_tried < penalty(words[todo])
        done = todo[worth]
        shares[done], fit[done] = tried[worth], fit_tried[worth]
        todo = done[(shares[done] > 0).sum(axis=1) > 1]
    return shares


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from ``labelled`` (doc_id, lang, text), rows without a language left out."""
    bounded_batches(labelled.sparkSession)
    labelled = labelled.where(F.col("lang").isNotNull())
    # At most LANGUAGES rows.
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], {})
    each = sample / len(languages)
    scale = 1 << 30
    bound = F.create_map(*[x for name in languages for x in (F.lit(name), F.lit(math.ceil(min(1.0, each / sizes[name]) * scale)))])
    chosen = labelled.where(F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("languages")), F.lit(scale)) < bound[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_words: dict[str, Counter] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for lang, words in held_words.items():
                found: Counter = Counter()
                for w, n in words.items():
                    for g in grams(w):
                        for k in range(len(g)):
                            found[g[k:]] += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(found)), pa.array(list(found)), pa.array(list(found.values()), pa.int64())], names=["lang", "gram", "n"]
                )
            held_words.clear()

        for batch in batches:
            for part in slices(batch, "text", 4_000_000, 256):
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                    held_words.setdefault(lang, Counter()).update(words_of(text))
                if sum(map(len, held_words.values())) > 200_000:
                    yield from told()
        yield from told()

    counts = stored(
        chosen.select("lang", "text").mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams"
    )
    common = counts.groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(CELLS // len(languages)).select("gram")
    # At most CELLS rows.
    rows = counts.join(F.broadcast(common), "gram").toArrow()
    place = {name: i for i, name in enumerate(languages)}
    found: dict[str, np.ndarray] = {}
    for lang, gram, n in sorted(zip(rows["lang"].to_pylist(), rows["gram"].to_pylist(), rows["n"].to_pylist(), strict=True)):
        found.setdefault(gram, np.zeros(len(languages)))[place[lang]] = n
    return Model(languages, found)


def predicted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``languages``, the selected ones with their shares, largest first."""
    bounded_batches(docs.sparkSession)
    shared, token = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    @F.pandas_udf("lang_pred string, score double, languages array<struct<lang: string, share: double>>")
    def of(texts: pd.Series) -> pd.DataFrame:
        guesser = held(("languages", token), lambda: Guesser(shared.value))
        names, out = guesser.model.languages, []
        for part in _batches(texts, 2_000_000, 256):
            for row in guesser.shares(part) if names else [np.zeros(0)] * len(part):
                order = np.argsort(-row, kind="stable")
                found = [{"lang": names[k], "share": float(row[k])} for k in order if row[k] > 0]
                out.append((found[0]["lang"], min(1.0, found[0]["share"]), found) if found else (UNKNOWN, 0.0, []))
        return pd.DataFrame(out, columns=["lang_pred", "score", "languages"])

    kept = docs.drop("lang_pred", "score", "languages")
    name = private("guess")
    return kept.withColumn(name, of(F.col(text))).select(*columns_of(kept), f"{name}.*")


def _batches(texts: pd.Series, most: int, rows: int) -> Iterator[list[str | None]]:
    """``texts`` in lists of at most ``most`` characters (or one text) and ``rows`` texts."""
    held_texts: list[str | None] = []
    size = 0
    for t in texts:
        if held_texts and (size + len(t or "") > most or len(held_texts) >= rows):
            yield held_texts
            held_texts, size = [], 0
        held_texts.append(t)
        size += len(t or "")
    if held_texts:
        yield held_texts


def op12_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every ``documents`` text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = train(docs.where(~held_out))
    return predicted(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", F.transform("languages", lambda x: x["lang"]).alias("languages")
    )
