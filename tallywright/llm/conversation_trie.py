"""A trie of conversation prefixes with subtree totals by time-forward processing.

Every distinct sequence of a conversation's first d turns is a node. A prefix is known by its depth and
two 64-bit sums (exclusive or) of hashes of its turns and their places, which are worked out by blocks of BLOCK
turns, so that no task walks a whole long conversation. What a node knows of itself - members, smallest
member, children - is plain grouping. Subtree totals travel upwards:

* A node with one member has one leaf below it and saves nothing; only shared nodes take part.
* A node's mass is the number of turns its members still have from there on. A subtree of at most ``shard``
  turns whose parent is heavier is a shard. Tasks read shards in reverse level order - Spark's sort, which
  spills - and every node sends its totals to its parent through a priority queue in that same order, which
  spills too. A node pops what was sent to it, adds itself and sends on.
* The heavier nodes, the trunk, get the sums of what shard roots send and go through the same process
  once more, in one task. ``shard`` is SHARD turns or a TRUNK-th of all turns, whichever is more, so the trunk
  has at most TRUNK nodes at a depth however large the table is.

A digest over members must see them one after the other; tasks write runs of ids side by side, and only
those runs meet, in order, in a task that holds one of them at a time.

Defined cases: turns without a conversation id are left out; a null role or text counts as empty; turns of one
number (nulls first) follow the SHA-256 of role and text, equal rows are turns of their own; an empty table has no
nodes, not even a root; further columns are not carried over.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywright.llm.shared import numbered, stored

#: Turns below a shard's root, nodes of the trunk at a depth, turns whose sums are worked out together.
SHARD, TRUNK, BLOCK = 50_000, 2000, 1024
#: Messages that a queue holds in memory, entries of a spilled chunk, ids of a run.
QUEUE, CHUNK, IDS = 100_000, 1000, 4096
#: Fixed values of the rebuilt conversations: ids of a group, the most turns taken from its first one.
GROUP, TAKEN = 5, 8
KEY = ["depth", "s1", "s2"]


class SpillingQueue:
    """A priority queue that keeps ``most`` messages in memory and writes sorted runs of the rest to unnamed files.

    The files are as a task's own spills: gone with the task, read by nobody else.
    """

    def __init__(self, most: int = QUEUE):
        self.most, self.heap, self.runs, self.files = most, [], [], []

    def push(self, key: tuple, value: tuple) -> None:
        heapq.heappush(self.heap, (key, value))
        if len(self.heap) > self.most:
            self.heap.sort()
            file = tempfile.TemporaryFile()
            for i in range(0, len(self.heap), CHUNK):
                pickle.dump(self.heap[i : i + CHUNK], file)
            file.seek(0)
            self.heap = []
            self.files.append(file)
            self._next(self._read(file), len(self.files))

    @staticmethod
    def _read(file) -> Iterator[tuple]:
        while True:
            try:
                yield from pickle.load(file)
            except EOFError:
                file.close()
                return

    def _next(self, run: Iterator[tuple], number: int) -> None:
        if (entry := next(run, None)) is not None:
            heapq.heappush(self.runs, (*entry, number, run))

    def pop(self, key: tuple) -> Iterator[tuple]:
        """The values sent to ``key``, which is no larger than any key in the queue."""
        while self.heap and self.heap[0][0] == key:
            yield heapq.heappop(self.heap)[1]
        while self.runs and self.runs[0][0] == key:
            _, value, number, run = heapq.heappop(self.runs)
            self._next(run, number)
            yield value

    def __bool__(self) -> bool:
        return bool(self.heap or self.runs)


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, i, n, digest, bytes): numbered turns with their conversation's number of turns."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
        F.monotonically_increasing_id().alias("row"),
    )
    placed = numbered(rows, ["conv_id", "turn", "digest", "row"], "turns").select("conv_id", "pos", "digest", "bytes")
    first = placed.groupBy("conv_id").agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    return placed.join(first, "conv_id").select("conv_id", (F.col("pos") - F.col("first") + 1).alias("i"), "n", "digest", "bytes")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, len, digest, bytes): the first turns of the group's first conversation, then the own ones.

    Every conversation has a row of depth 0, without a digest.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % (TAKEN + 1)
    convs = turns.where("i = 1").select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    ahead = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0).cast("long")))
    convs = convs.join(ahead, "base", "left").withColumn("taken", taken)
    convs = stored(convs.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "conversations")
    own = turns.select("conv_id", "i", "digest", "bytes").join(convs.drop("base"), "conv_id").where("i > h")
    # At most TAKEN turns of a conversation, for GROUP conversations at most.
    heads = turns.where(F.col("i") <= TAKEN).select(F.col("conv_id").alias("base"), "i", "digest", "bytes").join(convs, "base").where("i <= h")
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), "len", F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("bytes"))
    return (
        own.select("conv_id", (F.col("i") - F.col("h") + F.col("taken")).alias("depth"), "len", "digest", "bytes")
        .unionByName(heads.select("conv_id", F.col("i").alias("depth"), "len", "digest", "bytes"))
        .unionByName(root)
    )


def paths_of(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, len, s1, s2, p1, p2, bytes): each prefix's sums and those of the prefix one turn shorter.

    ``turns`` is as ``rebuilt`` gives it.
    """
    block = F.floor((F.col("depth") - 1) / BLOCK)
    root = F.col("depth") == 0
    zero = F.lit(0).cast("long")
    h1 = F.when(root, zero).otherwise(F.xxhash64("depth", "digest"))
    h2 = F.when(root, zero).otherwise(F.xxhash64("digest", "depth", F.lit("second")))
    rows = turns.select("conv_id", "depth", "len", "bytes", F.when(root, F.lit(-1).cast("long")).otherwise(block).alias("block"), h1.alias("h1"), h2.alias("h2"))
    rows = stored(rows, "rebuilt")
    inside = Window.partitionBy("conv_id", "block").orderBy("depth")
    so_far = rows.withColumns({s: F.bit_xor(h).over(inside.rowsBetween(Window.unboundedPreceding, 0)) for s, h in (("s1", "h1"), ("s2", "h2"))})
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # Only conversations of more than one block have rows here, one a block.
    long = rows.where(F.col("len") > BLOCK).where("block >= 0").groupBy("conv_id", "block").agg(F.bit_xor("h1").alias("b1"), F.bit_xor("h2").alias("b2"))
    carried = long.select("conv_id", "block", F.bit_xor("b1").over(before).alias("c1"), F.bit_xor("b2").over(before).alias("c2")).where("block > 0")
    s = {k: F.col(f"s{k}").bitwiseXOR(F.coalesce(F.col(f"c{k}"), zero)) for k in (1, 2)}
    return so_far.join(carried, ["conv_id", "block"], "left").select(
        "conv_id", "depth", "len", s[1].alias("s1"), s[2].alias("s2"), s[1].bitwiseXOR(F.col("h1")).alias("p1"), s[2].bitwiseXOR(F.col("h2")).alias("p2"), "bytes"
    )


NODE = "depth long, s1 long, s2 long, p1 long, p2 long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def forward(most: int = QUEUE):
    """A ``mapInArrow`` function over nodes sorted by shard and reverse level order; see the module's text.

    ``top_depth`` is the depth of the shard's root, which sends nothing; ``n_leaves`` and ``saved_tokens`` come in
    with the node's own share and go out as totals.
    """
    names = [c.split()[0] for c in NODE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, shard = SpillingQueue(most), None
        for batch in batches:
            got = {c: batch.column(c).to_pylist() for c in ("top_depth", "top_s1", "top_s2", *KEY, "p1", "p2", "n_leaves", "saved_tokens")}
            leaves, saved = got["n_leaves"], got["saved_tokens"]
            for i, (d, s1, s2) in enumerate(zip(got["depth"], got["s1"], got["s2"], strict=True)):
                if shard != (shard := (got["top_depth"][i], got["top_s1"][i], got["top_s2"][i])) and queue:
                    raise RuntimeError("a shard holds a node whose parent is not in it")
                for a, b in queue.pop((-d, s1, s2)):
                    leaves[i] += a
                    saved[i] += b
                if d > shard[0]:
                    queue.push((1 - d, got["p1"][i], got["p2"][i]), (leaves[i], saved[i]))
            done = {"n_leaves": pa.array(leaves, pa.int64()), "saved_tokens": pa.array(saved, pa.int64())}
            yield pa.RecordBatch.from_arrays([done[c] if c in done else batch.column(c) for c in names], names=names)

    return run


def digests(ends: DataFrame) -> DataFrame:
    """(depth, s1, s2, ends_sha256) of ``ends`` (depth, s1, s2, conv_id): of the ascending ids, joined by commas."""

    def grouped(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, list[Any]]]:
        """Neighbouring rows of one key, at most IDS together."""
        key, held = None, []
        for batch in batches:
            for *now, value in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if held and (now != key or len(held) >= IDS):
                    yield key, held
                    held = []
                key = now
                held.append(value)
        if held:
            yield key, held

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = []
        for key, ids in grouped(batches, [*KEY, "conv_id"]):
            waiting.append((*key, ids[0], ",".join(map(str, ids))))
            if len(waiting) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*waiting, strict=True)], names=[*KEY, "first", "ids"])
                waiting = []
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*waiting, strict=True)], names=[*KEY, "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, hashlib.sha256()
        out: list[tuple] = []
        for batch in batches:
            for *now, ids in zip(*(batch.column(c).to_pylist() for c in [*KEY, "ids"]), strict=True):
                if now != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = now, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=[*KEY, "ends_sha256"])
                out = []
        if key is not None:
            out.append((*key, state.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=[*KEY, "ends_sha256"])

    key = "depth long, s1 long, s2 long"
    sorted_ends = ends.select(*KEY, "conv_id").repartitionByRange("s1", "s2", "depth", "conv_id").sortWithinPartitions("s1", "s2", "depth", "conv_id")
    found = sorted_ends.mapInArrow(runs, f"{key}, first long, ids string").repartition(*KEY).sortWithinPartitions(*KEY, "first")
    return found.mapInArrow(hashed, f"{key}, ends_sha256 string")


def trie(paths: DataFrame, shard: int = SHARD, queue: int = QUEUE) -> DataFrame:
    """The nodes of ``paths`` (see ``paths_of``): NODE's columns, ``parent_conv_id`` and ``ends_sha256``."""
    mass = F.col("len") - F.col("depth") + 1
    nodes = stored(
        paths.groupBy(*KEY).agg(
            F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"), F.sum(mass).alias("mass")
        ),
        "nodes",
    )
    upwards = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("s1"), F.col("p2").alias("s2"))
    children = upwards.agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("single"))
    zero = F.lit(0).cast("long")
    own = nodes.join(children, KEY, "left").select(
        *KEY, "p1", "p2", "conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "mass",
        # A leaf counts itself; of single children each stands for one leaf.
        F.when(F.col("n_children").isNull() | (F.col("n_convs") == 1), F.lit(1).cast("long")).otherwise(F.col("single")).alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"),
    )
    own = stored(own, "nodes")
    total = nodes.agg(F.coalesce(F.sum("n_convs"), zero)).first()[0]
    limit = max(shard, -(-total // TRUNK))
    columns = [c.split()[0] for c in NODE.split(", ")]
    single, shared = own.where("n_convs = 1").select(columns), own.where("n_convs > 1")
    trunk, light = shared.where(F.col("mass") > limit), shared.where(F.col("mass") <= limit)
    # Heavy nodes are the beginning of a path; the node after them roots the shard.
    depth_of = paths.select("conv_id", *KEY).join(trunk.select(KEY), KEY, "left_semi").groupBy("conv_id").agg(F.max("depth").alias("trunk"))
    tops = paths.select("conv_id", *KEY).join(depth_of, "conv_id", "left").where(F.col("depth") == F.coalesce("trunk", F.lit(-1)) + 1)
    tops = tops.select("conv_id", F.col("depth").alias("top_depth"), F.col("s1").alias("top_s1"), F.col("s2").alias("top_s2"))
    top = ["top_depth", "top_s1", "top_s2"]
    sharded = light.join(tops, "conv_id").repartition(*top).sortWithinPartitions(*top, F.desc("depth"), "s1", "s2").select(*columns, *top)
    low = stored(sharded.mapInArrow(forward(queue), NODE), "shards")
    # What shard roots send: the rows whose parent is in the trunk.
    sent = low.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("s1"), F.col("p2").alias("s2"))
    sent = sent.agg(F.sum("n_leaves").alias("leaves_below"), F.sum("saved_tokens").alias("saved_below"))
    high = (
        trunk.join(sent, KEY, "left")
        .withColumn("n_leaves", F.col("n_leaves") + F.coalesce("leaves_below", zero))
        .withColumn("saved_tokens", F.col("saved_tokens") + F.coalesce("saved_below", zero))
        .select(*columns, *[zero.alias(c) for c in top])
        .repartition(1)
        .sortWithinPartitions(F.desc("depth"), "s1", "s2")
        .mapInArrow(forward(queue), NODE)
    )
    whole = single.unionByName(low).unionByName(high)
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("s1").alias("p1"), F.col("s2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    # The root's own sums are zero as are those before it; only its depth sets it apart.
    with_parent = whole.join(parents, ["depth", "p1", "p2"], "left")
    ends = digests(paths.where("depth = len"))
    nobody = F.lit(hashlib.sha256(b"").hexdigest())
    return with_parent.join(ends, KEY, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nobody))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the rebuilt ``conversations``."""
    turns = stored(turns_of(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "turns")
    paths = stored(paths_of(rebuilt(turns)), "paths")
    return trie(paths).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: CRC-32 bit by bit (fixed polynomial); a node's totals are summed over the paths of its descendants' members.
OP13_SQL = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id
                            ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % {GROUP} AS base,
         xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
           lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1)))) % {TAKEN + 1} AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, t.i, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.i <= c.h
  UNION ALL
  SELECT c.conv_id, 1, t.i, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.i > c.h),
hashed AS (
  SELECT conv_id, row_number() OVER w AS depth, octet_length(encode(text)) AS bytes,
         sha256(length(role) || ':' || role || text) AS digest
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, i)),
paths AS (
  SELECT conv_id, depth, bytes, sha256(string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS prefix FROM hashed
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM convs),
ended AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM paths),
nodes AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM ended GROUP BY prefix, depth),
-- each node's parent is the prefix one turn shorter of its smallest member
linked AS (
  SELECT n.*, p.prefix AS parent FROM nodes n LEFT JOIN paths p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
children AS (SELECT parent AS prefix, count(*) AS n_children FROM linked WHERE parent IS NOT NULL GROUP BY parent),
below AS (
  SELECT up.prefix, count(*) FILTER (WHERE k.prefix IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.bytes)::BIGINT AS saved_tokens
  FROM nodes n LEFT JOIN children k ON k.prefix = n.prefix
  JOIN paths up ON up.conv_id = n.conv_id AND up.depth <= n.depth
  GROUP BY up.prefix)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children,
       b.n_leaves, b.saved_tokens, n.ends_sha256
FROM linked n JOIN below b ON b.prefix = n.prefix LEFT JOIN children k ON k.prefix = n.prefix LEFT JOIN nodes p ON p.prefix = n.parent
"""
