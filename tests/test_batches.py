"""Merge keys, referee, consensus, corrections, expiring state and result files at their edges."""

import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from tallywright.operators import compare, matching, merge
from tallywright.sources import connectors, records
from tallywright.streaming import jobs

CAPTURE = "batch_id string, name string, file string, tokens array<string>, broker string, kind string, ok boolean, pos long, value double, qty double, cost double, pnl double"


def merged(spark, *rows):
    """(file, tokens, broker, kind, ok, value, qty) captured in this order, all of one name."""
    full = [("b", "x", f, t, b, k, ok, i, v, q, None, None) for i, (f, t, b, k, ok, v, q) in enumerate(rows)]
    got = merge.captures_merged(spark.createDataFrame(full, CAPTURE), ["batch_id", "name"], ["value", "qty", "cost", "pnl"]).orderBy("pos").collect()
    return [(r.file, r.value, r.qty, r.conflict, r.suspect, r.captures) for r in got]


N1, N2 = ["1234567-1"], ["7654321-2"]


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        # One number in common is enough; nulls are filled either way.
        ([("a", N1 + N2, None, "k", None, 10.0, None), ("b", N2, None, "k", None, 10.0, 3.0)], [("a", 10.0, 3.0, False, False, 2)]),
        # Other numbers, or the same file, are other things.
        ([("a", N1, None, "k", None, 10.0, None), ("b", N2, None, "k", None, 10.0, None)], [("a", 10.0, None, False, False, 1), ("b", 10.0, None, False, False, 1)]),
        ([("a", N1, None, "k", None, 10.0, None), ("a", N1, None, "k", None, 10.0, None)], [("a", 10.0, None, False, False, 1), ("a", 10.0, None, False, False, 1)]),
        # Half a per cent is equal, a little more is not.
        ([("a", N1, None, "k", None, 1000.0, 1.0), ("b", N1, None, "k", None, 1005.0, 1.0)], [("a", 1000.0, 1.0, False, False, 2)]),
        ([("a", N1, None, "k", None, 1000.0, 1.0), ("b", N1, None, "k", None, 1005.1, 1.0)], [("a", 1000.0, 1.0, True, False, 2)]),
        # The confirmed file's value, else the fuller row's; a refuted file is no better than an unknown one.
        ([("a", N1, None, "k", None, 10.0, 1.0), ("b", N1, None, "k", True, 20.0, None)], [("b", 20.0, 1.0, True, False, 2)]),
        ([("a", N1, None, "k", True, 10.0, None), ("b", N1, None, "k", None, 20.0, 1.0)], [("a", 10.0, 1.0, True, False, 2)]),
        ([("a", N1, None, "k", None, 10.0, None), ("b", N1, None, "k", None, 20.0, 1.0)], [("b", 20.0, 1.0, True, False, 2)]),
        # Weak: the same broker and type, values equal or not.
        ([("a", [], "s", "k", None, 10.0, None), ("b", [], "s", "k", None, 10.0, 2.0)], [("a", 10.0, 2.0, False, False, 2)]),
        ([("a", [], "s", "k", None, 10.0, None), ("b", [], "s", "k", None, 11.0, None), ("c", [], "s", "k", None, 10.0, None)],
         [("a", 10.0, None, False, False, 2), ("b", 11.0, None, False, True, 1)]),
        ([("a", [], "s", "k", None, 10.0, None), ("b", [], "t", "k", None, 10.0, None)], [("a", 10.0, None, False, False, 1), ("b", 10.0, None, False, False, 1)]),
        # Anonymous: exactly equal and nothing against it; else both stay, and the later one is what a third is held against.
        ([("a", None, None, "k", None, 10.0, None), ("b", None, None, "k", None, 10.0, 2.0)], [("a", 10.0, 2.0, False, False, 2)]),
        ([("a", [], None, "k", None, 10.0, 1.0), ("b", [], None, "k", None, 10.0, 2.0), ("c", [], None, "k", None, 10.0, 2.0)],
         [("a", 10.0, 1.0, False, False, 1), ("b", 10.0, 2.0, False, True, 2)]),
        ([("a", [], None, "k", None, None, None), ("b", [], None, "k", None, None, None)], [("a", None, None, False, False, 2)]),
    ],
)
def test_merge_keys(spark, rows, want):
    assert merged(spark, *rows) == want


def test_merge_leaves_rows_without_a_name(spark):
    rows = [("b", n, f, N1, None, "k", None, i, 1.0, None, None, None) for i, (n, f) in enumerate([(None, "a"), ("", "b"), (None, "c"), ("x", "a"), ("x", "b")])]
    got = merge.captures_merged(spark.createDataFrame(rows, CAPTURE), ["batch_id", "name"], ["value", "qty", "cost", "pnl"])
    assert sorted((r.name or "-", r.captures) for r in got.collect()) == [("-", 1), ("-", 1), ("-", 1), ("x", 2)]
    assert merge.captures_merged(spark.createDataFrame([], CAPTURE), ["batch_id", "name"], ["value"]).count() == 0


@pytest.mark.parametrize(
    ("mine", "theirs", "taken"),
    [(0.0, 100.0, True), (111.0, 100.0, True), (89.0, 102.0, True), (110.0, 100.0, False), (90.0, 100.0, False), (50.0, 102.5, False), (None, 98.0, True)],
)
def test_referee_thresholds(spark, mine, theirs, taken):
    """More than 10 % off against 2 % at most."""
    rows = spark.createDataFrame([("g", "a", mine, 7.0), ("g", "b", 0.0, 8.0), ("g", "b", 0.0, 9.0)], "g string, name string, value double, qty double")
    other = spark.createDataFrame([("g", "a", theirs, None), ("g", "b", 0.0, 1.0), ("g", "b", 0.0, 2.0)], "g string, name string, value double, qty double")
    totals = spark.createDataFrame([("g", 100.0), ("h", 0.0)], "g string, total double")
    got = matching.refereed(rows, other, totals, ["g"], "name", "value", ["value", "qty"], F.lit(True)).orderBy("qty").collect()
    # Of a name that occurs twice nothing is taken; what is taken is whole, nulls too.
    assert sorted((r.name, r.value, r.qty) for r in got if r.name == "b") == [("b", 0.0, 8.0), ("b", 0.0, 9.0)]
    assert [(r.value, r.qty) for r in got if r.name == "a"] == [(theirs, None) if taken else (mine, 7.0)]


def test_consensus(spark):
    rows = [(1, "S", "screen"), (1, None, None), (1, "x", "filename"), (1, "y", "brand"), (2, "S", "screen"), (2, "T", "screen"), (2, None, None), (3, "y", "brand"), (3, None, None), (None, "S", "screen"), (None, None, None)]
    df = spark.createDataFrame(rows, "g int, v string, src string")
    got = matching.consensus_filled(df, ["g"], "v", "src", F.col("src") == "screen", F.col("src") == "brand", "filename").collect()
    assert sorted(map(str, got)) == sorted(str(r) for r in spark.createDataFrame(
        [(1, "S", "screen"), (1, "S", "filename"), (1, "S", "filename"), (1, "y", "brand"), (2, "S", "screen"), (2, "T", "screen"), (2, None, None), (3, "y", "brand"), (3, "y", "filename"), (None, "S", "screen"), (None, None, None)],
        "g int, v string, src string").collect())


def test_nested_objects(spark):
    texts = ['[{"a": {"b": {"c": "} \\" {"}}, "n": 1}, {bad}, {"n": 2}]', '[{"n": 1, "x": [{"y": 1}, {"z": {}}]}, {"n": ]', "[" + '{"a": ' * 9 + "1" + "}" * 9 + ", bad]", '["' + "{" * 20_000 + '"]', None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: [(o.get("n"), len(o)) for o in r.o] for r in df.select("i", records.objects(F.col("t")).alias("o")).collect()}
    # Deeper than DEPTH levels only the inner ones are left.
    assert got == {0: [("1", 2), ("2", 1)], 1: [("1", 2)], 2: [(None, 1)], 3: [], 4: [], 5: []}


def test_versions_and_replay(spark, tmp_path):
    folder, feed = f"{tmp_path}/table", f"{tmp_path}/in"
    stream = lambda: spark.readStream.schema("k int, at int, v string").parquet(feed)
    told = lambda n: sorted((r.k, r.v) for r in jobs.version(spark, folder, n).collect())
    spark.createDataFrame([(1, 1, "a"), (2, 5, "b"), (2, 3, "old")], "k int, at int, v string").write.parquet(feed)
    jobs.corrected(stream(), ["k"], "at", folder)
    spark.createDataFrame([(1, 2, "A"), (2, 4, "stale"), (3, 1, "c")], "k int, at int, v string").write.mode("append").parquet(feed)
    jobs.corrected(stream(), ["k"], "at", folder)
    assert told(0) == [(1, "a"), (2, "b")] and told(1) == [(1, "A"), (2, "b"), (3, "c")]
    # The commit of the second batch is lost, so it runs again; the table is as before.
    for name in ("1", ".1.crc"):
        if os.path.exists(f"{folder}/checkpoint/commits/{name}"):
            os.remove(f"{folder}/checkpoint/commits/{name}")
    shutil.rmtree(jobs.version_path(folder, 1))
    jobs.corrected(stream(), ["k"], "at", folder)
    assert told(0) == [(1, "a"), (2, "b")] and told(1) == [(1, "A"), (2, "b"), (3, "c")]


def test_state_expires_between_batches(spark, tmp_path):
    """The second batch finds one key's state alive and the other's gone."""
    feed, seconds = f"{tmp_path}/in", 60
    write = lambda rows: spark.createDataFrame([(k, t) for k, t in rows], "k int, t long").select("k", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.mode("append").parquet(feed)

    def run():
        stream = spark.readStream.schema("k int, ts timestamp").parquet(feed)
        seen = []
        keep = lambda b, n: seen.extend(b.collect())
        jobs.expiring(stream, "k", "ts", seconds).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return sorted((r.k, r.n, r.expired, r.started // 1_000_000) for r in seen)

    write([(1, 1000), (1, 1030), (2, 1000), (3, 900), (3, 1040)])
    assert run() == [(1, 2, 0, 1000), (2, 1, 0, 1000), (3, 1, 1, 1040)]
    write([(1, 1090), (2, 1061)])
    assert run() == [(1, 3, 0, 1000), (2, 1, 1, 1061)]


def test_result_files(spark, tmp_path):
    for folder, name, raw in (("a", "2.json", "[2]"), ("a", "10.json", "[10]"), ("b", "2.json", None)):
        os.makedirs(tmp_path / folder, exist_ok=True)
        (tmp_path / folder / name).write_text(json.dumps({"image": "x", "raw": raw}, indent=2))
    (tmp_path / "b" / "3.json").write_text("no json")
    (tmp_path / "b" / "4.txt").write_text("{}")
    got = [(r.file.split("/")[-2:], r.screen_no, r.raw) for r in connectors.result_files(spark, str(tmp_path)).orderBy("file").collect()]
    assert got == [(["a", "10.json"], 0, "[10]"), (["a", "2.json"], 1, "[2]"), (["b", "2.json"], 0, None), (["b", "3.json"], 1, None)]


def test_invariants(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, -1.0), (4, -2.0)], "k int, v double")
    got = {r.rule: (r.checked, r.broken, r["first"]) for r in compare.invariants(df, {"positive": F.col("v") > 0, "known": F.col("v").isNotNull()}, "k").collect()}
    assert got == {"positive": (3, 2, 3), "known": (4, 1, 2)}
