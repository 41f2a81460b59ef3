"""Structured Streaming forms of the timeline and store operators; each has a batch twin that tests hold it against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators.merge import upsert_items
from inkwell.streaming.late import Windows, with_columns


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def dedupe_snapshots(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Each (content_hash, board, observed_at) once, within the watermark."""
    return stream.where("rank is not null").withWatermark("observed_at", late).dropDuplicatesWithinWatermark(["content_hash", "board", "observed_at"])


def rising_windows(hours: int = 6, slide_minutes: int = 30) -> Windows:
    """(delta) for each item of a board: the first place less the best one."""
    delta = F.min_by("rank", F.struct("observed_at", "rank")) - F.min("rank")
    return Windows("observed_at", ("board", "content_hash"), f"{hours} hours", f"{slide_minutes} minutes", (delta.alias("delta"),))


def health_windows(hours: int = 24, slide_hours: int = 1) -> Windows:
    """(runs, ok_runs, new_items) for each collector."""
    values = (F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "ok").alias("ok_runs"), F.sum(F.coalesce("new_count", F.lit(0))).alias("new_items"))
    return Windows("started_at", ("collector",), f"{hours} hours", f"{slide_hours} hours", values)


def rising(stream: DataFrame, hours: int = 6, slide_minutes: int = 30, late: str = "1 hour") -> DataFrame:
    """(window_end, board, content_hash, delta) of sliding windows: the first place less the best one.

    Run in update mode: a window's row is written again whenever it changes, until the watermark passes its end and its state is
    dropped; rows that come later than ``late`` don't count (``late.keep_late`` keeps them).  Which deltas are large enough is asked
    of the last rows."""
    return rising_windows(hours, slide_minutes).reckon(stream.withWatermark("observed_at", late))


def rising_panes(stream: DataFrame, hours: int = 6, slide_minutes: int = 30, late: str = "1 hour") -> DataFrame:
    """(pane_end, board, content_hash, first, best) of panes as long as the slide of ``rising``, for ``rising_of``; for update mode.

    State has one row for what ``rising`` keeps in each of a row's windows.  A pane stays open until ``late`` after the last window
    that holds it, so every row that counts in one of the windows of ``rising`` counts here."""
    if hours * 60 % slide_minutes:
        raise ValueError("panes make up windows whose length is a multiple of the slide")
    spark = stream.sparkSession
    seconds = spark.range(1).select(F.expr(f"unix_micros(timestamp '1970-01-01 00:00:00' + INTERVAL {late}) - unix_micros(timestamp '1970-01-01 00:00:00')").alias("us")).first().us // 1_000_000
    values = (F.min(F.struct("observed_at", "rank")).alias("first"), F.min("rank").alias("best"))
    panes = Windows("observed_at", ("board", "content_hash"), f"{slide_minutes} minutes", f"{slide_minutes} minutes", values)
    return panes.reckon(stream.withWatermark("observed_at", f"{seconds + hours * 3600} seconds")).withColumnRenamed("window_end", "pane_end")


def rising_of(panes: DataFrame, hours: int = 6, slide_minutes: int = 30) -> DataFrame:
    """What ``rising`` has, out of a table of ``rising_panes``: each pane stands in all windows that hold it.

    Panes are dealt by item before they are repeated, so only panes are shuffled."""
    ends = F.transform(F.sequence(F.lit(0), F.lit(hours * 60 // slide_minutes - 1)), lambda k: F.col("pane_end") + F.make_dt_interval(mins=k * slide_minutes))
    rows = panes.repartition("board", "content_hash").select(F.explode(ends).alias("window_end"), "board", "content_hash", "first", "best")
    out = rows.groupBy("board", "content_hash", "window_end").agg((F.min("first")["rank"] - F.min("best")).alias("delta"))
    return out.select("window_end", "board", "content_hash", "delta")


def rolling_health(stream: DataFrame, hours: int = 24, slide_hours: int = 1, late: str = "1 hour") -> DataFrame:
    """(window_end, collector, runs, ok_runs, new_items) of rolling windows; for update mode, as ``rising``."""
    return health_windows(hours, slide_hours).reckon(stream.withWatermark("started_at", late))


def edition_slots(rows: DataFrame, time: str = "observed_at") -> DataFrame:
    """(slot, n): twelve-hour editions that close at 07:00 and 19:00 of UTC+8."""
    return rows.groupBy(F.window(time, "12 hours", "12 hours", "11 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("slot"), F.when(F.hour("w.end") == 23, "am").otherwise("pm").alias("edition"), "n")


def ingest(stream: DataFrame, table: str, checkpoint: str, seq: str = "seq", key: str = "content_hash", buckets: int = 64):
    """Merges every micro-batch into the table below ``table``; read it with ``read_items``.

    Rows are kept in ``buckets`` by hash of their key.  A batch reads and writes only the buckets that it touches, under its own
    version, and then a manifest that says which version of each bucket counts (one row a bucket, so it's small).  A batch that is
    run again after a failure starts from the same manifest and writes the same version; versions that no manifest of the last
    batches names can be removed at any time."""

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("bucket", _bucket(key, buckets))
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most ``buckets``
        held = _manifest(spark, table, epoch - 1) if epoch else {}
        old = [held[b] for b in touched if b in held]
        now = _read_parts(spark, old, batch.drop(seq).schema)
        merged = upsert_items(now, batch).drop("is_new", "duplicates").withColumn("bucket", _bucket(key, buckets))
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/data/v{epoch}")
        held |= {b: f"{table}/data/v{epoch}/bucket={b}" for b in touched}
        spark.createDataFrame(sorted(held.items()), "bucket int, path string").coalesce(1).write.mode("overwrite").parquet(f"{table}/manifest/v{epoch}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _manifest(spark: SparkSession, table: str, version: int) -> dict[int, str]:
    return {r["bucket"]: r["path"] for r in spark.read.parquet(f"{table}/manifest/v{version}").collect()}


def _read_parts(spark: SparkSession, paths: list[str], schema) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_items(spark: SparkSession, table: str, version: int, schema) -> DataFrame:
    """The table as it was after a batch."""
    return _read_parts(spark, list(_manifest(spark, table, version).values()), schema)


def drain(stream: DataFrame, folder: str, mode: str = "append", keys: tuple[str, ...] = ()) -> DataFrame:
    """Runs a stream over all that has landed and reads back what it wrote below ``folder``.

    In complete mode that is the last state; in update mode the last row of each of ``keys``, or all rows that changed without them."""
    spark = stream.sparkSession
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    else:

        def land(batch: DataFrame, n: int) -> None:
            place = f"{folder}/out/batch={n}" if mode == "update" else f"{folder}/out/batch=0"
            batch.write.mode("overwrite").parquet(place)

        query = stream.writeStream.foreachBatch(land).option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(f"{folder}/out")
    out = spark.read.schema(with_columns(stream.schema, batch="long")).option("basePath", f"{folder}/out").parquet(f"{folder}/out/batch=*")
    if not keys:
        return out.drop("batch")
    rest = [c for c in stream.columns if c not in keys]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*").select(*stream.columns)
