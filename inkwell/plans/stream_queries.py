"""Streaming queries, run over all that has landed, with batch SQL to hold them against."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import text as X
from inkwell.operators.folding import simhash
from inkwell.operators.graph import shared_folder
from inkwell.operators.near_index import NearIndex, link_stream
from inkwell.plans.tables import RUNS_SQL, SNAPSHOTS_SQL, clock
from inkwell.plans.text_queries import PAIRS_SQL
from inkwell.streaming import late, state, streams

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


#: A drop of more rows is landed as several files, so that no task writes or reads more than a few times so many.
DROP_ROWS = 20_000
LATE = "40 days"  # no row of the table is later, so batch SQL sees what the streams see


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _drops(spark: SparkSession, sf_dir: str, name: str, order: str, parts: int = 4, held: str | None = None) -> list[DataFrame]:
    """The table as it would land: ``parts`` drops in order of a column.

    Rows of which ``held`` is true are held back and all land in a further drop after the others."""
    rows, out = spark.read.parquet(f"{sf_dir}/{name}.parquet"), []
    low, high = rows.agg(F.min(order), F.max(order)).first()
    step = (high - low) / parts
    for k in range(parts):
        own = rows if k == parts - 1 else rows.where(F.col(order) < F.lit(low + step * (k + 1)))
        own = own.where(F.col(order) >= F.lit(low + step * k)) if k else own
        out.append(own.where(f"not ({held})") if held else own)
    return out + [rows.where(held)] if held else out


def _files(drops: list[DataFrame], most: int = DROP_ROWS) -> int:
    """How many files each drop is landed as: as many for all, so that a trigger of that many takes a drop."""
    return sum(d.count() for d in drops) // (most * len(drops)) + 1


def _stream(spark: SparkSession, folder: str, schema, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/*")


def _landing(spark: SparkSession, sf_dir: str, name: str, order: str, parts: int = 4, held: str | None = None) -> DataFrame:
    """A stream of all ``_drops``, one micro-batch each."""
    drops, folder = _drops(spark, sf_dir, name, order, parts, held), f"{_folder(spark)}/{name}"
    files = _files(drops)
    for k, own in enumerate(drops):
        own.repartition(files).write.parquet(f"{folder}/{k}")
    return _stream(spark, folder, drops[0].schema, files)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _landing(spark, sf_dir, "events", "ts")


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_snapshots(_events(spark, sf_dir))


def _as_snapshots(e: DataFrame) -> DataFrame:
    return e.select(F.col("event_type").alias("board"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("content_hash"), F.col("ts").cast("timestamp").alias("observed_at"), (F.floor("value").cast("int") % 50 + 1).alias("rank"), F.col("value").alias("heat"))


def _runs(spark: SparkSession, sf_dir: str, held: str | None = None) -> DataFrame:
    bad = F.col("event_type") == "error"
    e = _landing(spark, sf_dir, "events", "ts", held=held)
    return e.select(F.concat(F.lit("c"), (F.col("user_id") % 20).cast("string")).alias("collector"), F.col("ts").cast("timestamp").alias("started_at"), F.when(bad, "failed").otherwise("ok").alias("status"), F.get_json_object("props", "$.k").cast("long").alias("new_count"))


@query(f"WITH {SNAPSHOTS_SQL} SELECT board, count(DISTINCT (content_hash, observed_at)) AS n FROM snapshots GROUP BY board")
def t2_stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.drain(streams.dedupe_snapshots(_snapshots(spark, sf_dir), LATE), _folder(spark))
    return out.groupBy("board").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SNAPSHOTS_SQL} SELECT board, content_hash, strftime(min(observed_at), '%Y-%m-%d %H:%M:%S') AS first_seen FROM snapshots GROUP BY ALL")
def t3_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream stops after two drops and starts again from its checkpoint for the other two."""
    folder, drops = _folder(spark), _drops(spark, sf_dir, "events", "ts")
    files = _files(drops)
    for k, own in enumerate(drops):
        own.repartition(files).write.parquet(f"{folder}/in/{k}")
        if k % 2:
            out = streams.drain(state.first_seen(_as_snapshots(_stream(spark, f"{folder}/in", own.schema, files))), folder)
    return out.select("board", "content_hash", clock("first_seen"))


@query(f"""WITH {SNAPSHOTS_SQL}, w AS (SELECT *, unnest(range(0, 12)) AS k FROM snapshots), x AS (SELECT board, content_hash, rank, observed_at, time_bucket(INTERVAL 30 MINUTE, observed_at) + INTERVAL 30 MINUTE + to_minutes(30 * k) AS e FROM w)
  SELECT strftime(e, '%Y-%m-%d %H:%M:%S') AS window_end, board, content_hash, arg_min(rank, (observed_at, rank)) - min(rank) AS delta FROM x GROUP BY e, board, content_hash HAVING arg_min(rank, (observed_at, rank)) - min(rank) >= 15""")
def t4_rising(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream keeps panes of half an hour; windows of six hours are put together out of the panes that it wrote."""
    panes = streams.drain(streams.rising_panes(_snapshots(spark, sf_dir), late=LATE), _folder(spark), "update", ("pane_end", "board", "content_hash"))
    return streams.rising_of(panes).where("delta >= 15").select(clock("window_end"), "board", "content_hash", "delta")


HEALTH_SQL = f"""WITH {RUNS_SQL}, w AS (SELECT *, unnest(range(0, 24)) AS k FROM runs), x AS (SELECT *, time_bucket(INTERVAL 1 HOUR, started_at) + INTERVAL 1 HOUR + to_hours(k) AS e FROM w)
  SELECT strftime(e, '%Y-%m-%d %H:%M:%S') AS window_end, collector, count(*) AS runs, count(*) FILTER (WHERE status = 'ok') AS ok_runs, sum(coalesce(new_count, 0))::BIGINT AS new_items FROM x GROUP BY e, collector"""


@query(HEALTH_SQL)
def t5_rolling_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.drain(streams.rolling_health(_runs(spark, sf_dir), late=LATE), _folder(spark), "update", ("window_end", "collector"))
    return out.select(clock("window_end"), "collector", "runs", "ok_runs", "new_items")


@query(f"WITH {SNAPSHOTS_SQL} SELECT strftime(b, '%Y-%m-%d %H:%M:%S') AS slot, CASE WHEN hour(b) = 11 THEN 'am' ELSE 'pm' END AS edition, count(*) AS n FROM (SELECT time_bucket(INTERVAL 12 HOUR, observed_at, TIMESTAMP '2024-01-01 11:00:00') AS b FROM snapshots) GROUP BY b")
def t6_edition_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.drain(streams.edition_slots(_snapshots(spark, sf_dir)), _folder(spark), "complete")
    return out.select(clock("slot"), "edition", "n")


@query("SELECT conv_id::VARCHAR AS queue_id, max(turn) AS pos FROM conversations GROUP BY conv_id")
def t7_drip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _landing(spark, sf_dir, "conversations", "turn").select(F.col("conv_id").cast("string").alias("queue_id"), F.concat_ws("-", "conv_id", "turn").alias("unit_id"), F.col("turn").alias("pos"))
    out = streams.drain(state.drip(rows), _folder(spark), "update")
    return out.groupBy("queue_id").agg(F.max("pos").alias("pos"))


@query("""WITH q AS (SELECT 'u' || user_id AS queue_id, max(event_id) AS pos, max(ts) AS last FROM events GROUP BY user_id)
  SELECT queue_id, pos, last + INTERVAL 12 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR AS due FROM q""")
def t7_due_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queues whose last print is twelve hours behind the watermark when all has landed; a timer for each tells."""
    rows = _events(spark, sf_dir).select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("queue_id"), F.col("event_id").cast("string").alias("unit_id"), F.col("event_id").alias("pos"), F.col("ts").cast("timestamp").alias("printed_at"))
    out = streams.drain(state.drip(rows, due_hours=12), _folder(spark), "update", ("queue_id",))
    return out.select("queue_id", "pos", (F.col("state") == "due").alias("due"))


@query("SELECT (doc_id % 300)::VARCHAR AS content_hash, count(*) > 0 AS stored, length(arg_min(text, doc_id)) AS content_n, arg_max(doc_id % 50 + 1, doc_id) AS rank FROM documents GROUP BY doc_id % 300")
def t1_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _landing(spark, sf_dir, "documents", "doc_id").select((F.col("doc_id") % 300).cast("string").alias("content_hash"), "source", (F.col("doc_id") % 50 + 1).alias("rank"), F.lit(None).cast("double").alias("heat"), F.col("text").alias("content"), F.col("doc_id").alias("seq"))
    folder = _folder(spark)
    job = streams.ingest(rows, f"{folder}/items", f"{folder}/state")
    job.awaitTermination()
    last = max(p["batchId"] for p in job.recentProgress)
    out = streams.read_items(spark, f"{folder}/items", last, rows.drop("seq").schema)
    return out.select("content_hash", F.lit(True).alias("stored"), F.char_length("content").cast("long").alias("content_n"), "rank")


@query(f"WITH {PAIRS_SQL} SELECT * FROM pairs")
def j6_index_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents land in four drops; each is linked to the index of those before it and then added."""
    folder = _folder(spark)
    rows = _landing(spark, sf_dir, "documents", "doc_id").select(F.col("doc_id").alias("id"), X.tokenize("text").alias("tokens"))
    link_stream(simhash(rows), NearIndex(spark, f"{folder}/index", buckets=8), folder).awaitTermination()
    return spark.read.schema("a long, b long").parquet(f"{folder}/pairs/*")


@query(HEALTH_SQL)
def t8_late_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the runs lands after all others, most of it far behind the watermark; the windows that it touches are repaired."""
    folder, windows = _folder(spark), streams.health_windows()
    rows = _runs(spark, sf_dir, held="event_id % 10 = 7")
    written = streams.drain(streams.rolling_health(rows), f"{folder}/stream", "update", ("window_end", "collector"))
    late.keep_late(rows, windows, f"{folder}/kept").awaitTermination()
    again = late.recompute(spark, f"{folder}/kept", rows.schema, late.read_late(spark, f"{folder}/kept", rows.schema), windows)
    out = late.repair(written, again, windows)
    return out.select(clock("window_end"), "collector", "runs", "ok_runs", "new_items")
