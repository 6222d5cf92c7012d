"""Progress, expiry and keep-latest over event streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def progress(events: DataFrame, key: str, done: Column) -> DataFrame:
    """(key, n, done): rows and finished rows so far; for the update or complete mode."""
    return events.groupBy(key).agg(F.count("*").alias("n"), F.count_if(done).alias("done"))


def latest(events: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """(key, ts, value) of the newest event of a key: state of one row per key."""
    return events.groupBy(key).agg(F.max(ts).alias(ts), F.max_by(value, ts).alias(value))


def windows(events: DataFrame, ts: str, key: str, width: str, late: str) -> DataFrame:
    """Counts per window and key under a watermark (not in the reference; for event streams)."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n")).select("window.start", key, "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    """Jobs as sessions that end after ``gap`` without an event: the state of older ones is evicted."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n")).select("session_window.start", "session_window.end", key, "n")


def run_to_table(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Run a stream over what there is now and give its result, kept as Parquet below ``folder``.

    A batch that is tried again overwrites its own files. In complete mode the last batch is the
    whole result; else all batches are. Nothing comes to the driver.
    """
    seen: list[str] = []

    def keep(batch: DataFrame, number: int) -> None:
        path = f"{folder}/table/batch-{number}"
        batch.write.mode("overwrite").parquet(path)
        if path not in seen:
            seen.append(path)

    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(*(seen[-1:] if mode == "complete" else seen)) if seen else spark.createDataFrame([], stream.schema)


def version_path(folder: str, number: int) -> str:
    return f"{folder}/version-{number:09d}"


def corrected(stream: DataFrame, keys: list[str], order: str, folder: str) -> None:
    """Run a stream over what there is now, each batch making a new version of a table below ``folder``.

    A version is the one before with the rows of the batch in it: of a key the row with the largest ``order``, so late
    corrections count and stale ones do not. Earlier versions stay readable. A batch that is tried again overwrites its own version, made
    from the one before, so a replay changes nothing.
    """

    def keep(batch: DataFrame, number: int) -> None:
        rows = batch if number == 0 else batch.unionByName(version(batch.sparkSession, folder, number - 1))
        others = [c for c in rows.columns if c not in keys]
        newest = F.max_by(F.struct(*others), F.struct(order, F.xxhash64(*others))).alias("_r")
        rows.groupBy(*keys).agg(newest).select(*keys, "_r.*").write.mode("overwrite").parquet(version_path(folder, number))

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def version(spark: SparkSession, folder: str, number: int) -> DataFrame:
    """The table as of a version."""
    return spark.read.parquet(version_path(folder, number))


def expiring(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """(key, started, last, n, expired) after every batch: a key's state lives ``seconds`` after its last event.

    An event that comes later finds the state gone and starts anew; ``expired`` counts how often. State is one row per
    key, kept by Spark between batches; where no event comes for a key, its timer drops the state once the watermark
    has passed. Events of a batch are taken in the order of ``ts``, a slice of a key at a time.
    """
    kind = dict(events.dtypes)[key]

    def update(now: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        started, last, n, expired = state.get if state.exists else (None, None, 0, 0)
        moments = sorted(t for part in parts for t in part["_at"].tolist())
        for t in moments:
            if last is not None and t - last > seconds * 1_000_000:
                started, n, expired = None, 0, expired + 1
            started, last, n = t if started is None else started, t if last is None else max(last, t), n + 1
        state.update((started, last, n, expired))
        state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [now[0]], "started": [started], "last": [last], "n": [n], "expired": [expired]})

    moment = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = events.select(key, F.col(ts).cast("timestamp").alias("_ts"), moment.alias("_at")).withWatermark("_ts", f"{seconds} seconds")
    schema = f"{key} {kind}, started long, last long, n long, expired long"
    return rows.groupBy(key).applyInPandasWithState(update, schema, "started long, last long, n long, expired long", "update", GroupStateTimeout.EventTimeTimeout)
