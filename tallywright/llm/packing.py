"""Best-fit packing of documents into sequences of a fixed number of tokens.

Documents become pieces: token ids with a closing 0, cut only beyond the capacity. The pieces are
range-sorted by length and numbered in Spark. Pieces of one length are alike, and so are gaps of
one size, so a round of the bulk-synchronous best fit works on classes: every length finds its
successor, the smallest gap that holds it; lengths that want the same gaps are served by rank,
longest first; gaps shrink; rounds repeat until nothing fits, and then the longest length left opens new
sequences. The classes are at most ``capacity`` lengths and ``capacity`` gap sizes whatever the
number of documents is, so the state of a round is a bounded table. Its outcome is a list of runs
(length, ranks, sequences, offset) that a join by length and rank gives back to the pieces.

Defined cases: a null or empty text is one piece with the single id 0; repeated rows are pieces of
their own; an empty table gives no pieces; extra columns do not matter.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywright.llm.shared import bounded_batches, numbered, private, stored
from tallywright.llm.workers import WordStore, held, slices

CAPACITY = 2048
#: Stretches of an order that are packed on their own, at most, and the pieces of one, at least.
PARTS, LEAST = 16, 8192
#: New words encoded as one text, and bytes of texts that are tokenized together.
TOGETHER, BATCH_BYTES = 4_000, 2_000_000
#: Bytes of words whose ids a worker remembers; to encode one again costs more than elsewhere.
STORE = 96_000_000
_CLOSE = np.zeros(1, dtype="<u4").tobytes()
#: Marks that may close a word; the tokenizer makes one piece of a run of them, apart from letters.
_MARKS = ".,;:!?%$#&*"


class WordIds:
    """Token ids of texts as little-endian uint32 bytes, remembering the ids of words.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its
    words in a row. New words go to the tokenizer itself, each once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        #: Whether a token closes a run of letters.
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known = WordStore(STORE)
        self.tails: dict[str, bytes] = {"": b""}

    def _encode(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in got]

    def _encode_plain(self, bodies: list[str]) -> list[bytes]:
        """Ids of words of Latin letters only. Each is one piece for the tokenizer, and one token of
        every piece closes it, so many words are encoded as one text and cut at these tokens."""
        out: list[bytes] = []
        for begin in range(0, len(bodies), TOGETHER):
            part = bodies[begin : begin + TOGETHER]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = ((np.flatnonzero(self.closes[ids]) + 1) * 4).tolist()
            blob = ids.tobytes()
            # Another kind of vocabulary has no closing tokens; its words are encoded one by one.
            out += [blob[a:b] for a, b in zip([0, *ends], ends, strict=False)] if len(ends) == len(part) else self._encode(part)
        return out

    def _learn(self, new: set[str]) -> None:
        """Put the ids of ``new`` words into the store."""
        plain, bodies, rest = [], [], []
        for w in new:
            body = w.rstrip(_MARKS)
            # The one Latin letter whose lower case is no letter alone is left to the tokenizer.
            if body.isalpha() and (body.isascii() or (max(body) <= "\u024f" and "\u0130" not in body)):
                plain.append(w)
                bodies.append(body)
            else:
                rest.append(w)
        tails = [w[len(body) :] for w, body in zip(plain, bodies, strict=True)]
        if strange := sorted(set(tails).difference(self.tails)):
            self.tails.update(zip(strange, self._encode(strange), strict=True))
        self.known.learn(dict(zip(rest, self._encode(rest), strict=True)))
        self.known.learn({w: ids + self.tails[t] if t else ids for w, ids, t in zip(plain, self._encode_plain(bodies), tails, strict=True)})

    def ids(self, texts: list[str]) -> list[bytes]:
        """Per text the ids and a closing 0."""
        if self.known.room():
            self.tails = {"": b""}
        # The tokenizer's white space has no file, group, record and unit separators; split() does.
        odd = {i for i, x in enumerate(texts) if any(c in x for c in "\x1c\x1d\x1e\x1f")}
        words = [[] if i in odd else x.split() for i, x in enumerate(texts)]
        known = self.known.words
        if new := set().union(*words).difference(known):
            self._learn(new)
        whole = dict(zip(sorted(odd), self._encode([texts[i] for i in sorted(odd)]), strict=True)) if odd else {}
        return [(whole[i] if i in odd else b"".join(map(known.__getitem__, ws))) + _CLOSE for i, ws in enumerate(words)]


def word_ids(path: str) -> WordIds:
    """The Python worker's own store for the tokenizer at ``path``."""
    return held(("ids", path), lambda: WordIds(path))


PIECES_SCHEMA = "doc_id long, piece int, start long, length int, ids_crc32 long"


def cut(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, place: str | None = None) -> DataFrame:
    """The pieces of every document: (doc_id, piece, start, length, ids_crc32) and the document's ``place``, if asked for."""
    bounded_batches(docs.sparkSession)
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if place:
        types, names = [*types, pa.int64()], [*names, "place"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                out: list[list] = [[] for _ in names]
                texts = [x or "" for x in part.column("text").to_pylist()]
                places = [[x] for x in part.column("place").to_pylist()] if place else [[]] * len(texts)
                for doc, at_place, ids in zip(part.column("doc_id").to_pylist(), places, word_ids(tokenizer).ids(texts), strict=True):
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        for c, v in zip(out, (doc, k, at // 4, len(own) // 4, zlib.crc32(own), *at_place), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    if place:
        return docs.select("doc_id", "text", F.col(place).cast("long").alias("place")).mapInArrow(pieces, f"{PIECES_SCHEMA}, place long")
    return docs.select("doc_id", "text").mapInArrow(pieces, PIECES_SCHEMA)


def best_fit_runs(lengths: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, last rank, first sequence, offset) for a histogram of lengths.

    Within a run, rank and sequence number go up together. Gap classes hold intervals of sequences.
    """
    left = {n: c for n, c in lengths.items() if c > 0}
    given: dict[int, int] = defaultdict(int)  # ranks of a length that have a place
    gaps: dict[int, list[list[int]]] = defaultdict(list)  # size: [first sequence, number]
    runs, opened = [], 0

    def place(n: int, count: int, first: int, gap: int) -> None:
        runs.append((n, given[n], given[n] + count - 1, first, capacity - gap))
        given[n] += count
        left[n] -= count
        if not left[n]:
            del left[n]
        if gap > n:
            gaps[gap - n].append([first, count])

    while left:
        while True:
            sizes = np.array(sorted(g for g, spans in gaps.items() if spans))
            waiting = np.array(sorted(left, reverse=True))
            at = np.searchsorted(sizes, waiting) if len(sizes) else np.zeros(0, dtype=int)
            wanted = [(int(n), int(sizes[k])) for n, k in zip(waiting, at) if k < len(sizes)]
            if not wanted:
                break
            # All lengths choose from the gaps as they were; conflicts go by rank, longest first.
            held = {g: gaps.pop(g) for g in {g for _, g in wanted}}
            for n, g in wanted:
                spans = held[g]
                while spans and n in left:
                    first, free = spans[-1]
                    take = min(free, left[n])
                    place(n, take, first, g)
                    if take == free:
                        spans.pop()
                    else:
                        spans[-1] = [first + take, free - take]
            for g, spans in held.items():
                gaps[g] = spans + gaps[g]
        if left:
            # The longest length opens as many sequences as it fills with equal numbers of its own.
            n = max(left)
            each = min(capacity // n, left[n])
            fresh = left[n] // each
            first, opened = opened, opened + fresh
            for k in range(each):
                runs.append((n, given[n], given[n] + fresh - 1, first, k * n))
                given[n] += fresh
            left[n] -= each * fresh
            if not left[n]:
                del left[n]
            if capacity > each * n:
                gaps[capacity - each * n].append([first, fresh])
    return runs


def _with_runs(pieces: DataFrame, runs: DataFrame, n_runs: int, n: int) -> DataFrame:
    """``pieces`` joined with the run that holds their ``pos``.

    Runs split the positions into intervals, up to some thousands for one length. Positions are dealt
    into as many equal buckets as there are runs, so the runs come in at most twice their number of
    rows, and a piece tests the runs of its bucket only.
    """
    width = max(1, -(-n // max(1, n_runs)))
    bucket = lambda c: F.floor(c / width)
    by_bucket = runs.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("first_pos")), bucket(F.col("last_pos")))))
    # Bounded by the number of runs: at most a few for every pair of a length and a gap size.
    return (
        pieces.withColumn("_bucket", bucket(F.col("pos")))
        .join(F.broadcast(by_bucket), "_bucket")
        .where(F.col("pos").between(F.col("first_pos"), F.col("last_pos")))
        .drop("_bucket")
    )


def _runs_table(spark: SparkSession, runs: list[tuple], names: list[str]) -> DataFrame:
    """The runs as a table of longs; an Arrow table goes to the JVM without Python workers."""
    columns = zip(*runs, strict=True) if runs else [[] for _ in names]
    return spark.createDataFrame(pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)}))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``."""
    spark = docs.sparkSession
    # Dealing by ranges reads its input twice; texts are tokenized once.
    pieces = numbered(stored(cut(docs, tokenizer, capacity), "cut"), ["length", "doc_id", "piece"], "pieces")
    # At most ``capacity`` rows, one per length.
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    before, rows = {}, 0
    for n in sorted(histogram):
        before[n], rows = rows, rows + histogram[n]
    runs = [(n, before[n] + a, before[n] + b, s, o) for n, a, b, s, o in best_fit_runs(histogram, capacity)]
    names = ["run_length", "first_pos", "last_pos", "first_sequence", "offset"]
    return _with_runs(pieces, _runs_table(spark, runs, names), len(runs), rows).select(
        "doc_id",
        "piece",
        "start",
        F.col("length").cast("long").alias("length"),
        "ids_crc32",
        (F.col("first_sequence") + F.col("pos") - F.col("first_pos")).alias("sequence_id"),
        "offset",
    )


def in_file_order(docs: DataFrame, place: str) -> DataFrame:
    """``docs`` with the 0-based ``place`` of each row in the files it is read from, in the order of their names.

    A table that is not read from files has its rows numbered by partition. A column of that name is replaced,
    all others stay whatever they are called.
    """
    if "_metadata" in docs.columns:  # a caller's own column hides the files
        return docs.withColumn(place, F.monotonically_increasing_id())
    file, row, of, n, offset = (private(x) for x in ("file", "row", "of", "n", "offset"))
    try:
        rows = docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
    except AnalysisException:
        return docs.withColumn(place, F.monotonically_increasing_id())
    ahead = Window.orderBy(of).rowsBetween(Window.unboundedPreceding, -1)
    # One row per file.
    counts = rows.groupBy(F.col(file).alias(of)).agg(F.count("*").alias(n))
    offsets = counts.select(of, F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(offset))
    return rows.join(F.broadcast(offsets), F.col(file) == F.col(of)).withColumn(place, F.col(offset) + F.col(row)).drop(file, of, row, offset)


def pack_in_order(docs: DataFrame, tokenizer: str, place: str, capacity: int = CAPACITY, parts: int = PARTS, least: int = LEAST) -> DataFrame:
    """As pack(), but the sequences keep the order of ``place``.

    At most ``parts`` stretches of the order, of ``least`` pieces at least, are packed one after the
    other, so a piece never leaves its stretch. Within one, pieces of equal lengths are taken by
    place, and sequences are numbered by the place of the piece that opens them.
    """
    spark = docs.sparkSession
    by_place = numbered(stored(cut(docs, tokenizer, capacity, place), "cut"), ["place", "doc_id", "piece"], "by-place", "rank")
    n = by_place.count()
    each = max(least, -(-n // parts))
    pieces = numbered(by_place.withColumn("part", F.floor(F.col("rank") / each)).drop("rank"), ["part", "length", "place", "doc_id", "piece"], "pieces")
    # At most ``parts`` x ``capacity`` rows.
    histogram = {(r["part"], r["length"]): r["n"] for r in pieces.groupBy("part", "length").agg(F.count("*").alias("n")).collect()}
    runs, rows, opened = [], 0, 0
    for part in sorted({p for p, _ in histogram}):
        lengths, before = {k: c for (p, k), c in sorted(histogram.items()) if p == part}, {}
        for k, c in lengths.items():
            before[k], rows = rows, rows + c
        own = best_fit_runs(lengths, capacity)
        runs += [(part, k, before[k] + a, before[k] + b, opened + s, o) for k, a, b, s, o in own]
        opened = max(opened + s + b - a + 1 for _, a, b, s, _ in own)
    names = ["run_part", "run_length", "first_pos", "last_pos", "first_sequence", "offset"]
    placed = stored(
        _with_runs(pieces, _runs_table(spark, runs, names), len(runs), rows).withColumn("_sequence", F.col("first_sequence") + F.col("pos") - F.col("first_pos")),
        "placed",
    )
    openings = placed.where(F.col("offset") == 0).select(F.col("_sequence").alias("_opened"), "place")
    order = numbered(openings, ["place", "_opened"], "sequences", "sequence_id").drop("place")
    return placed.join(order, F.col("_sequence") == F.col("_opened")).select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset"
    )


def tokenizer_path() -> str:
    """The registered query's tokenizer file; every machine has the package."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of 2048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
