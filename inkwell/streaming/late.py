"""Late rows: what a watermark drops is kept in a side table, and only the windows that it touches are computed anew."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Windows:
    """Sliding windows over ``time`` for each of ``keys``: their lengths, and what is reckoned in them."""

    time: str
    keys: tuple[str, ...]
    length: str
    slide: str
    values: tuple[Column, ...]

    def of(self, rows: DataFrame) -> DataFrame:
        """``rows`` once for each window that holds them, with its end in ``window_end``."""
        return rows.withColumn("window_end", F.window(self.time, self.length, self.slide)).withColumn("window_end", F.col("window_end.end"))

    def reckon(self, rows: DataFrame) -> DataFrame:
        """(window_end, keys, values) of a table, or of a stream with a watermark."""
        own = rows.groupBy(F.window(self.time, self.length, self.slide).alias("w"), *self.keys).agg(*self.values)
        return own.select(F.col("w.end").alias("window_end"), *[c for c in own.columns if c != "w"])


def keep_late(stream: DataFrame, windows: Windows, folder: str, late: str = "1 hour"):
    """Keeps every row below ``folder``/history, by day, and beside that in ``folder``/late those that come after one of their windows has closed.

    A window has closed for a batch where its end is not above the greatest time of all earlier batches less ``late``.  That is what
    a watermark of ``late`` lets a stream drop, or more, so no dropped row is missed.  The greatest time is kept by batch in
    ``folder``/high: a batch that is run again after a failure sees the same past and overwrites what it wrote.  Rows without a time
    belong to no window and are left out."""

    def land(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.where(F.col(windows.time).isNotNull())
        high = _high(spark, folder, number - 1) if number else None
        dated = rows.withColumn("day", F.to_date(windows.time)).withColumn("batch", F.lit(number))
        dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{folder}/history")
        if high is None:
            behind = rows.limit(0)
        else:
            # of a row's windows the one that begins first ends first
            closed = F.lit(high).cast("timestamp") - F.expr(f"INTERVAL {late}")
            behind = rows.where(_first_end(windows) <= closed)
        behind.write.mode("overwrite").parquet(f"{folder}/late/batch={number}")
        now = rows.agg(F.max(windows.time).alias("high")).select(F.greatest("high", F.lit(high).cast("timestamp")).alias("high"))
        now.write.mode("overwrite").parquet(f"{folder}/high/batch={number}")

    return stream.writeStream.foreachBatch(land).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()


def _first_end(windows: Windows) -> Column:
    """The end of the earliest window that holds a row."""
    slide = F.unix_micros(F.lit("1970-01-01 00:00:00").cast("timestamp") + F.expr(f"INTERVAL {windows.slide}"))
    length = F.unix_micros(F.lit("1970-01-01 00:00:00").cast("timestamp") + F.expr(f"INTERVAL {windows.length}"))
    at = F.unix_micros(windows.time)
    last_start = at - F.pmod(at, slide)
    steps = F.floor((last_start - at + length - 1) / slide)
    return F.timestamp_micros(last_start - steps * slide + length)


def with_columns(schema: StructType, **columns: str) -> StructType:
    out = StructType(list(schema.fields))
    for name, kind in columns.items():
        out = out.add(name, kind)
    return out


def _high(spark: SparkSession, folder: str, batch: int):
    return spark.read.schema("high timestamp").parquet(f"{folder}/high/batch={batch}").first().high


def read_late(spark: SparkSession, folder: str, schema, after: int = -1) -> DataFrame:
    """The late rows of batches above ``after``."""
    return spark.read.schema(with_columns(schema, batch="integer")).option("basePath", f"{folder}/late").parquet(f"{folder}/late/batch=*").where(F.col("batch") > after).drop("batch")


def touched(late: DataFrame, windows: Windows) -> DataFrame:
    """(window_end, keys): the windows that late rows are in."""
    return windows.of(late).select("window_end", *windows.keys).distinct()


def recompute(spark: SparkSession, folder: str, schema, late: DataFrame, windows: Windows) -> DataFrame:
    """(window_end, keys, values) of the windows that ``late`` touches, from the history.

    Only the days that those windows reach over are read, and only their rows are gathered."""
    ends = touched(late, windows)
    reach = ends.select(F.explode(F.sequence(F.to_date(F.col("window_end") - F.expr(f"INTERVAL {windows.length}")), F.to_date("window_end"))).alias("day")).distinct()
    days = [r.day for r in reach.collect()]  # of the calendar, so few
    history = spark.read.schema(with_columns(schema, day="date", batch="integer")).parquet(f"{folder}/history").where(F.col("day").isin(days)) if days else spark.createDataFrame([], schema)
    same = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in ("window_end", *windows.keys)]
    rows = windows.of(history).alias("x").join(ends.alias("y").hint("merge"), same, "left_semi")
    return rows.groupBy("window_end", *windows.keys).agg(*windows.values)


def repair(written: DataFrame, again: DataFrame, windows: Windows) -> DataFrame:
    """What a stream has written, with windows computed anew in the place of old ones and beside them."""
    same = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in ("window_end", *windows.keys)]
    kept = written.alias("x").join(again.alias("y").hint("merge"), same, "left_anti")
    return kept.unionByName(again)
