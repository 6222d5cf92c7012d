"""Exact n-gram Jaccard join of shingle sets: prefix filtering first, then pivots and Voronoi regions.

The Jaccard distance 1 - |x n y| / |x u y| is a metric on all sets.

Level 0, over the whole table, is a prefix-filter join, chosen instead of document pivots: unrelated
documents are at a distance of nearly 1 from each other and from every document pivot, so a window
of twice the threshold would replicate every document to every region. Shingles have one order for
the whole table, those that many documents share last. A partner within distance e misses at most
floor(e n) of a document's n shingles, so two documents within e always share one of their first
floor(e n) + 1 shingles and meet there. (In terms of the metric: the pivots are the one-shingle sets,
which the triangle inequality alone would not tell apart.) Where documents meet, sizes and sketches,
each a lower bound of the distance, leave candidates; an overfull meeting place is cut into blocks
and joined by pairs of blocks.

Level 1 and on is the metric join by document pivots: candidates are connected into clusters, a
superset of the components. Inside a cluster distances are small and tell documents apart, so each
member joins the Voronoi region of its nearest pivot, and also every region whose pivot is not
farther than the nearest one by more than 2 e, which the triangle inequality demands; regions join
recursively, down to LEAF members, and end in exact counts of common shingles.

Only links that connect something new leave a task, so a group of copies costs its size in links and
not its square. Equal sets are one class from the start. Sets are longer than their texts, so they are not
stored: texts are shingled to count shingles, to describe the rows, and those of clusters once more.

Defined cases: null, empty and blank texts have no shingles, are linked with nothing and are their
own component; a text of fewer words than a shingle is one shingle; repeated rows are in one class;
rows that share an id are one document, linked by any of its texts, and each tells the size of its
own set; a null id has a null component and links nothing; extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywright.llm.components import components
from tallywright.llm.shared import bounded_batches, stored
from tallywright.llm.workers import WordStore, held, release, slices

#: Pivots that come last, at most: the shingles that most documents share.
COMMON = 65_536
#: Entries of one region, and shingles of one cluster, that a task joins as one block.
REGION_BLOCK, CLUSTER_BLOCK = 2_000, 1_500_000
#: Sets below PARITY_BELOW shingles have parities, those from COUNTS_FROM on counts; the two overlap,
#: so that sets of similar size have one in common.
PARITY_BELOW, COUNTS_FROM, BUCKETS = 400, 300, 256
#: Members of a cluster that are joined without further pivots, and pivots of a larger one.
LEAF, PIVOTS = 32, 8
#: Shingles that the counting pass gathers before it counts them, and bytes of texts or sets that are handled together.
GATHERED, BATCH_BYTES = 1_000_000, 2_000_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text.

    Words are what ASCII white space leaves, with A-Z lower-cased; ``bytes`` do exactly that.
    """
    store = held(("shingles",), WordStore)
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    store.room()
    known = store.words
    if fresh := set(words).difference(known):
        store.learn({w: xxhash.xxh3_64_intdigest(w) for w in fresh})
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(size, len(h))
    s = np.zeros(len(h) - size + 1, dtype=np.uint64)
    for i in range(size):
        s = _mixed(s * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - size + 1 + i])
    return np.unique(s)


def sketches(s: np.ndarray) -> tuple[bytes | None, bytes | None]:
    """Parities (BUCKETS bits) and counts (BUCKETS bytes) of shingles by hash.

    A shingle that only one of two sets has changes one parity and one count by one, so the number
    of differing parities, and the sum of differences of counts, are at most the symmetric difference.
    Parities are compact but fill up; counts keep telling large sets apart.
    """
    counts = np.bincount((s >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1), minlength=BUCKETS)
    parities = np.packbits((counts & 1).astype(np.uint8)).tobytes() if len(s) < PARITY_BELOW else None
    return parities, np.minimum(counts, 255).astype(np.uint8).tobytes() if len(s) >= COUNTS_FROM else None


def _sets(rows: DataFrame, size: int) -> DataFrame:
    """(id, cluster, shingles, set) per row (id, cluster, shingles, text): the sorted hashes of its shingles, as bytes."""

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                raw = [shingle_set(x.as_py(), size).tobytes() for x in part.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("id", "cluster", "shingles")), pa.array(raw, pa.binary())],
                    names=["id", "cluster", "shingles", "set"],
                )

    return rows.select("id", "cluster", "shingles", "text").mapInArrow(shingled, "id long, cluster long, shingles long, set binary")


def _common(docs: DataFrame, size: int, least: int = 16) -> np.ndarray:
    """The COMMON most shared shingles of the texts, the rarest of them first.

    Counts are exact but for shingles that occur once in a stretch of GATHERED; which shingles are
    here decides the order of pivots, and any order gives the same links.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(sets), return_counts=True)
            often = n > 1
            return pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(n[often])], names=["shingle", "n"])

        sets, total = [], 0
        for batch in batches:
            for x in batch.column(0):
                sets.append(shingle_set(x.as_py(), size))
                total += len(sets[-1])
                if total >= GATHERED:
                    yield counted(sets)
                    sets, total = [], 0
        if sets:
            yield counted(sets)

    counts = docs.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    # At most COMMON rows come back.
    top = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "shingle").limit(COMMON).collect()
    return np.array([r["shingle"] for r in reversed(top)], dtype=np.int64)


def _described(docs: DataFrame, size: int, share: tuple[int, int], common: np.ndarray) -> DataFrame:
    """(doc_id, text_key, n, digest, pivots, parities, counts) per row (doc_id, text_key, text)."""
    order = np.argsort(common.view(np.uint64), kind="stable")
    known = docs.sparkSession.sparkContext.broadcast((common.view(np.uint64)[order], order))
    num, den = share

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, rank = known.value
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                n, digests, pivots, kept = [], [], [], []
                for x in part.column("text"):
                    s = shingle_set(x.as_py(), size)
                    at = np.minimum(np.searchsorted(values, s), max(0, len(values) - 1))
                    shared = values[at] == s if len(values) else np.zeros(len(s), dtype=bool)
                    keep = len(s) - -(-num * len(s) // den) + 1 if len(s) else 0
                    rare = s[~shared][:keep]
                    if len(rare) < keep:
                        rare = np.concatenate([rare, s[shared][np.argsort(rank[at[shared]])][: keep - len(rare)]])
                    n.append(len(s))
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                    pivots.append(rare.view(np.int64))
                    kept.append(sketches(s))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(pivots, pa.list_(pa.int64())), *[pa.array([k[c] for k in kept], pa.binary()) for c in (0, 1)]],
                    names=["doc_id", "text_key", "n", "digest", "pivots", "parities", "counts"],
                )

    return docs.mapInArrow(describe, "doc_id long, text_key binary, n long, digest binary, pivots array<long>, parities binary, counts binary")


def _blocks(rows: DataFrame, key: str, count: str, block: int) -> DataFrame:
    """``rows`` with ``i`` and ``j``: groups of more than ``block`` rows become pairs of blocks."""
    parts = F.ceil(F.col(count) / block).cast("int")
    own = F.pmod(F.xxhash64("id"), parts).cast("int")
    others = F.sequence(F.lit(0), parts - 1)
    return (
        rows.withColumn("own", own)
        .withColumn("other", F.explode(others))
        .withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
        .drop("other", "own", count)
        .repartition(key, "i", "j")
        .sortWithinPartitions(key, "i", "j")
    )


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole (key, i, j) groups of sorted batches; the last group waits for the next batch."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        ends = _ends(table, key)
        if len(ends) > 1:
            yield table.slice(0, int(ends[-2]))
            table = table.slice(int(ends[-2]))
        held = table
    if held is not None and held.num_rows:
        yield held


def _ends(table: pa.Table, key: str) -> np.ndarray:
    """Ends of the (key, i, j) groups."""
    if not table.num_rows:
        return np.zeros(0, dtype=np.int64)
    columns = [table.column(c).to_numpy() for c in (key, "i", "j")]
    change = np.zeros(table.num_rows - 1, dtype=bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(change) + 1, table.num_rows)


class Forest:
    """Union-find over ids; ``join`` says whether it connected something new."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.parent.setdefault(x, x)
        while up != x:
            self.parent[x] = self.parent.setdefault(up, up)
            x, up = up, self.parent[up]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def _candidates(entries: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(a, b): links that connect all documents which sizes and sketches don't tell apart."""
    num, den = share

    def near(n: np.ndarray, parities: np.ndarray, counts: np.ndarray, i: int, js: np.ndarray) -> np.ndarray:
        """Of the rows js those that row i may be linked with."""
        js = js[den * np.minimum(n[i], n[js]) >= num * np.maximum(n[i], n[js])]
        # A similarity of num / den bounds the symmetric difference by this share of both sizes.
        most = (n[i] + n[js]) * (den - num) // (den + num)
        fits = np.ones(len(js), dtype=bool)
        if n[i] < PARITY_BELOW:
            both = n[js] < PARITY_BELOW
            fits[both] = np.bitwise_count(parities[js[both]] ^ parities[i]).sum(axis=1, dtype=np.int64) <= most[both]
        if n[i] >= COUNTS_FROM:
            both = fits & (n[js] >= COUNTS_FROM)
            fits[both] = np.abs(counts[js[both]] - counts[i]).sum(axis=1, dtype=np.int64) <= most[both]
        return js[fits]

    def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
        return np.frombuffer(b"".join(x or bytes(width) for x in column.to_pylist()), dtype=np.uint8).reshape(-1, width)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        forest = Forest()
        for table in _groups(batches, "pivot"):
            ids, n = table.column("id").to_numpy(), table.column("n").to_numpy()
            parities = matrix(table.column("parities"), BUCKETS // 8).view(np.uint64)
            counts = matrix(table.column("counts"), BUCKETS).astype(np.int16)
            out, begin = [], 0
            for end in _ends(table, "pivot").tolist():
                label = np.array([forest.root(int(x)) for x in ids[begin:end]])
                for i in range(begin, end - 1):
                    js = np.flatnonzero(label[i - begin + 1 :] != label[i - begin]) + i + 1
                    for j in near(n, parities, counts, i, js).tolist() if len(js) else ():
                        if forest.join(int(ids[i]), int(ids[j])):
                            out.append((int(ids[i]), int(ids[j])))
                            label[label == label[j - begin]] = label[i - begin]
                begin = end
            if out:
                a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return entries.mapInArrow(join, "a long, b long")


class Cluster:
    """Members of a candidate cluster with their sets, joined exactly by pivots."""

    def __init__(self, ids: np.ndarray, sets: list[np.ndarray], share: tuple[int, int], forest: Forest):
        self.ids, self.forest, self.share = ids, forest, share
        self.n = np.array([len(s) for s in sets], dtype=np.int64)
        # One sort gives the numbers of the shingles and who has each; what is large is let go at once.
        values = np.concatenate(sets)
        order = np.argsort(values, kind="stable")
        values = values[order]
        new = np.flatnonzero(values[1:] != values[:-1]) + 1
        del values
        self.starts = np.concatenate([[0], new, [len(order)]])
        flat = np.empty(len(order), dtype=np.int32)
        flat[order] = np.repeat(np.arange(len(self.starts) - 1, dtype=np.int32), np.diff(self.starts))
        self.postings = np.repeat(np.arange(len(sets), dtype=np.int32), self.n)[order]
        del order
        self.columns = np.split(flat, np.cumsum(self.n)[:-1])
        self.links: list[tuple[int, int]] = []
        self.margin = 2 * (1 - share[0] / share[1]) + 1e-9

    def common(self, i: int) -> np.ndarray:
        """Common shingles of member i with every member."""
        spans = [self.postings[self.starts[c] : self.starts[c + 1]] for c in self.columns[i].tolist()]
        return np.bincount(np.concatenate(spans), minlength=len(self.n))

    def distance(self, i: int, members: np.ndarray) -> np.ndarray:
        both = self.common(i)[members]
        return 1 - both / (self.n[i] + self.n[members] - both)

    def leaf(self, members: np.ndarray) -> None:
        num, den = self.share
        label = np.array([self.forest.root(int(x)) for x in self.ids[members]])
        for k, i in enumerate(members.tolist()):
            rest = np.flatnonzero(label[k + 1 :] != label[k]) + k + 1
            if not len(rest):
                continue
            both = self.common(i)[members[rest]]
            linked = den * both >= num * (self.n[i] + self.n[members[rest]] - both)
            for m in rest[linked].tolist():
                a, b = int(self.ids[i]), int(self.ids[members[m]])
                if self.forest.join(a, b):
                    self.links.append((a, b))
                    label[label == label[m]] = label[k]

    def join(self, members: np.ndarray) -> None:
        if len(members) <= LEAF:
            return self.leaf(members)
        # Each pivot is the member that is farthest from those before it.
        pivots, gaps = [int(members[0])], [self.distance(int(members[0]), members)]
        while len(pivots) < PIVOTS:
            pivots.append(int(members[np.argmax(np.min(gaps, axis=0))]))
            gaps.append(self.distance(pivots[-1], members))
        gap = np.array(gaps)
        near = gap.min(axis=0)
        home = gap.argmin(axis=0)
        regions = [members[(home == p) | (gap[p] <= near + self.margin)] for p in range(len(pivots)) if (home == p).any()]
        if sum(map(len, regions)) > 1.5 * len(members) or max(map(len, regions)) > 0.9 * len(members):
            return self.leaf(members)  # too close together for these pivots
        for region in regions:
            self.join(region)


def _links(members: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(a, b): exact links that connect the components of the clusters' members (id, cluster, shingles, set)."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for table in _groups(batches, "cluster"):
            begin, links = 0, []
            for end in _ends(table, "cluster").tolist():
                part = table.slice(begin, end - begin)
                begin = end
                if part.num_rows < 2:
                    continue
                sets = [np.frombuffer(x, dtype=np.uint64) for x in part.column("set").to_pylist()]
                cluster = Cluster(part.column("id").to_numpy(), sets, share, Forest())
                cluster.join(np.argsort(cluster.n, kind="stable"))
                links += cluster.links
            if links:
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return _blocks(members, "cluster", "shingles", CLUSTER_BLOCK).mapInArrow(join, "a long, b long")


def jaccard_join(docs: DataFrame, size: int = 5, share: tuple[int, int] = (80, 100), text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): ``component_id`` is the smallest id reachable by links.

    Two documents are linked when den * common >= num * united, ``share`` being (num, den).
    """
    bounded_batches(docs.sparkSession)
    # Joins of ids and digests are by merge, as they are on large tables anyway: no broadcast goes through the driver.
    # With the id, a digest of the text finds the text again when its set is needed.
    docs = docs.select("doc_id", F.unhex(F.sha2(F.col(text), 256)).alias("text_key"), F.col(text).alias("text"))
    # A stored row keeps its number, which also names the class that it stands for.
    rows = stored(_described(docs, size, share, _common(docs, size)).withColumn("row", F.monotonically_increasing_id()), "sets")
    known = rows.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    chosen = F.min(F.struct("row", "n", "doc_id", "text_key")).alias("chosen")
    classes = stored(known.groupBy("digest").agg(chosen).select("digest", "chosen.*"), "classes").withColumnRenamed("row", "id")
    described = rows.select(F.col("row").alias("id"), "pivots", "parities", "counts").join(classes.select("id", "n").hint("merge"), "id")
    per_pivot = Window.partitionBy("pivot")
    # Most pivots are met by one document only; sketches travel with those that are left.
    entries = (
        described.select("id", F.explode("pivots").alias("pivot"))
        .withColumn("met", F.count("*").over(per_pivot))
        .where("met > 1")
        .join(described.select("id", "n", "parities", "counts").hint("merge"), "id")
    )
    clusters = components(_candidates(_blocks(entries, "pivot", "met", REGION_BLOCK), share), "candidates")
    clusters = clusters.join(classes.select("id", "n", "doc_id", "text_key").hint("merge"), "id")
    sizes = clusters.groupBy("component_id").agg(F.sum("n").alias("shingles"))
    members = clusters.join(sizes.hint("merge"), "component_id").select("id", "doc_id", "text_key", F.col("component_id").alias("cluster"), "shingles")
    # Repeated rows share the key; one of them is enough.
    texts = docs.join(members, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"])
    links = _links(_sets(texts, size), share)
    named = stored(known.select("doc_id", "digest").distinct().join(classes.select("digest", F.col("id").alias("class")).hint("merge"), "digest").select("doc_id", "class"), "named")
    # An id with several texts ties their classes together.
    several = named.groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a < b").select("doc_id", "a")
    tied = named.join(several.hint("merge"), "doc_id").where("class <> a").select("a", F.col("class").alias("b"))
    found = components(links.unionByName(tied), "links")
    # Copies share a class, so all but the last join is one row per class.
    placed = named.groupBy("class").agg(F.min("doc_id").alias("first_id")).join(found.hint("merge"), F.col("class") == F.col("id"), "left").select("class", "first_id", F.coalesce("component_id", "class").alias("_component"))
    first = placed.groupBy("_component").agg(F.min("first_id").alias("component_id"))
    of_id = named.join(placed.join(first.hint("merge"), "_component").select("class", "component_id").hint("merge"), "class").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    # Ids without any shingle are linked with nothing, not even with one another.
    return rows.select("doc_id", "n").join(of_id.hint("merge"), "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of ``documents`` under 3-word shingles and a similarity of 0.9 or more."""
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, (90, 100))


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM d),
n AS (SELECT doc_id, len(g)::BIGINT AS n FROM s),
e AS (SELECT doc_id, hash(t) AS t FROM (SELECT doc_id, unnest(g) AS t FROM s)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r(id, reach) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.id, l.b FROM r JOIN l ON r.reach = l.a)
SELECT n.doc_id, n.n AS n_shingles, m.component_id
FROM n JOIN (SELECT id, min(reach) AS component_id FROM r GROUP BY id) m ON m.id = n.doc_id
"""
