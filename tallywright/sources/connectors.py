"""Readers and writers: text boxes, bars, quotes, watch lists and snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BOX = "struct<text:string,x:int,y:int,w:int,h:int,conf:double>"


def boxes_from_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(file, text, x, y, w, h, conf) of tab-separated recognition output with twelve columns."""
    names = ["level", "page", "block", "par", "line", "word", "left", "top", "width", "height", "conf", "text"]
    raw = spark.read.csv(path, sep="\t", header=True, quote="", schema=", ".join(f"{n} string" for n in names))
    number = lambda c: F.col(c).try_cast("double")
    return raw.where((number("conf") >= 0) & (F.trim("text") != "")).select(
        F.input_file_name().alias("file"),
        F.trim("text").alias("text"),
        *[number(a).cast("int").alias(b) for a, b in (("left", "x"), ("top", "y"), ("width", "w"), ("height", "h"))],
        (number("conf") / 100).alias("conf"),
    )


def boxes_from_json(json: Column) -> Column:
    """Array of boxes of a JSON array; those without text go, and a missing confidence is 1."""
    return F.transform(
        F.filter(F.from_json(json, f"array<{BOX}>"), lambda b: F.trim(b["text"]) != ""),
        lambda b: F.struct(b["text"], b["x"], b["y"], b["w"], b["h"], F.coalesce(b["conf"], F.lit(1.0)).alias("conf")),
    )


def rectangle(polygon: Column) -> Column:
    """(x, y, w, h) around an array of (x, y) points."""
    side = lambda f, n: f(F.transform(polygon, lambda p: p[n]))
    whole = lambda c: F.bround(c, 0).cast("int")
    x, y = side(F.array_min, "x"), side(F.array_min, "y")
    return F.struct(whole(x).alias("x"), whole(y).alias("y"), whole(side(F.array_max, "x") - x).alias("w"), whole(side(F.array_max, "y") - y).alias("h"))


def bars_long(charts: DataFrame) -> DataFrame:
    """(symbol, rng, itv, ts, close) of parallel arrays (timestamp, close); null closes stay null."""
    return charts.select("symbol", "rng", "itv", F.inline(F.arrays_zip("timestamp", "close"))).select("symbol", "rng", "itv", F.timestamp_seconds("timestamp").alias("ts"), "close")


def watchlist(json: Column) -> Column:
    """Array of (symbol, name) of a JSON array of symbols and objects."""
    items = F.from_json(json, "array<string>")
    return F.filter(
        F.transform(
            items,
            lambda i: F.struct(
                F.when(F.startswith(i, F.lit("{")), F.get_json_object(i, "$.symbol")).otherwise(i).alias("symbol"),
                F.when(F.startswith(i, F.lit("{")), F.get_json_object(i, "$.name")).alias("name"),
            ),
        ),
        lambda s: s["symbol"].isNotNull(),
    )


def capture_time(requested: Column, stored: Column, day: Column, now: Column, zone: str = "Asia/Seoul") -> Column:
    """Time of a capture: as requested, as stored with the image, half past three of the day, or now."""
    return F.coalesce(F.try_to_timestamp(requested), stored, F.to_utc_timestamp(F.try_to_timestamp(F.concat(day, F.lit(" 15:30:00"))), zone), now)


def capture_source(requested: Column, stored: Column) -> Column:
    return F.when(F.try_to_timestamp(requested).isNotNull(), "manual").when(stored.isNotNull(), "exif").otherwise("fallback")


def file_time(name: Column) -> Column:
    """Time in a file name such as shot_20260709-160155.png."""
    shape = r"(20\d{6})[_-]?(\d{6})"
    return F.try_to_timestamp(F.concat(F.regexp_extract(name, shape, 1), F.regexp_extract(name, shape, 2)), F.lit("yyyyMMddHHmmss"))


def snapshot(quotes: DataFrame, as_of: str, source: str, fx: Column) -> DataFrame:
    """One row (asOf, source, fx, prices, errors) of quotes (symbol, price, currency, name, marketTime, stale, error).

    The maps hold a watch list, which is bounded by what its owner has entered.
    """
    price = F.struct("price", "currency", "name", "marketTime", "stale")
    return quotes.agg(
        F.lit(as_of).alias("asOf"),
        F.lit(source).alias("source"),
        F.max(fx).alias("fx"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("error").isNull(), F.struct("symbol", price))))).alias("prices"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("symbol", "error"))))).alias("errors"),
    )


def publish(df: DataFrame, path: str) -> bool:
    """Replace the snapshot at ``path``; an empty one is not published.

    The new snapshot is written aside and renamed, so a failed write leaves the old one as it was.
    """
    if df.isEmpty():
        return False
    spark, mark = df.sparkSession, uuid.uuid4().hex
    fresh, old = f"{path.rstrip('/')}.new-{mark}", f"{path.rstrip('/')}.old-{mark}"
    df.write.json(fresh)
    jvm = spark.sparkContext._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    files = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = files.exists(at(path)) and files.rename(at(path), at(old))
    if not files.rename(at(fresh), at(path)):
        if had:
            files.rename(at(old), at(path))
        raise OSError(f"the snapshot could not be moved to {path}")
    if had:
        files.delete(at(old), True)
    return True


def result_files(spark: SparkSession, folder: str) -> DataFrame:
    """(batch_id, file, screen_no, raw, image): the JSON files below ``folder``, one result each, in the order of their names.

    A file's folder is its batch. ``file`` is the whole path, so evidence that is kept by name cannot be taken for that
    of a file of the same name elsewhere. Files that are no JSON have a null ``raw``.
    """
    read = spark.read.schema("image string, raw string").json(folder, multiLine=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    path = F.col("_metadata.file_path")
    rows = read.select(F.regexp_replace(path, "/[^/]*$", "").alias("batch_id"), path.alias("file"), "image", "raw")
    place = F.row_number().over(Window.partitionBy("batch_id").orderBy("file")) - 1
    return rows.withColumn("screen_no", place).select("batch_id", "file", "screen_no", "raw", "image")
