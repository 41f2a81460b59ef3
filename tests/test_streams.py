"""Streams over several micro-batches, with late and repeated rows, against their batch twins."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from inkwell.operators import merge
from inkwell.streaming import late, state, streams

T0 = datetime(2024, 1, 1, 12)
RUN = "collector string, started_at timestamp, status string, new_count long"


def land(spark, folder, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def test_late_rows_are_dropped_after_the_watermark(spark, tmp_path):
    """A row within the watermark changes a window that was written before; one beyond it doesn't."""
    at = lambda h: T0 + timedelta(hours=h)
    batches = [[("c", at(0), "ok", 1), ("c", at(30), "ok", 1)], [("c", at(29.5), "failed", 0), ("c", at(60), "ok", 2)], [("c", at(1), "ok", 100), ("c", at(59.5), "ok", 4)]]
    stream = streams.rolling_health(land(spark, str(tmp_path), batches, RUN), 24, 24, "1 hour")
    got = {r.window_end: (r.runs, r.ok_runs, r.new_items) for r in streams.drain(stream, f"{tmp_path}/w", "update", ("window_end", "collector")).collect()}
    day = lambda d: datetime(2024, 1, d)
    assert got == {day(2): (1, 1, 1), day(3): (2, 1, 1), day(4): (1, 1, 4), day(5): (1, 1, 2)}


def test_repeated_rows_and_returning_items(spark, tmp_path):
    s = "board string, content_hash string, observed_at timestamp, rank int, heat double"
    row = lambda k, h: ("b", k, T0 + timedelta(hours=h), 1, 1.0)
    batches = [[row("x", 0), row("x", 0)], [row("x", 0), row("y", 1)], [row("x", 2)]]
    once = streams.drain(streams.dedupe_snapshots(land(spark, f"{tmp_path}/a", batches, s), "2 days"), f"{tmp_path}/a/w")
    assert sorted((r.content_hash, r.observed_at.hour) for r in once.collect()) == [("x", 12), ("x", 14), ("y", 13)]
    first = streams.drain(state.first_seen(land(spark, f"{tmp_path}/b", batches, s)), f"{tmp_path}/b/w")
    assert sorted((r.content_hash, r.first_seen.hour) for r in first.collect()) == [("x", 12), ("y", 13)]


def test_ingest_over_batches_is_the_batch_merge(spark, tmp_path):
    s = "content_hash string, source string, rank int, heat double, content string, seq long"
    batches = [[(f"k{i % 7}", "a", i, None, None if i % 3 else f"t{i}", b * 100 + i) for i in range(b, 20)] for b in range(3)]
    stream = land(spark, str(tmp_path), batches, s)
    job = streams.ingest(stream, f"{tmp_path}/t", f"{tmp_path}/c", buckets=4)
    job.awaitTermination()
    shape = stream.drop("seq").schema
    got = {r.content_hash: (r.source, r["rank"], r.content) for r in streams.read_items(spark, f"{tmp_path}/t", 2, shape).collect()}
    everything = spark.createDataFrame([r for b in batches for r in b], s)
    want = {r.content_hash: (r.source, r["rank"], r.content) for r in merge.upsert_items(spark.createDataFrame([], shape), everything).collect()}
    assert got == want and len(got) == 7
    # a key that no later batch touches stays in its old version
    paths = {r.path.split("/data/")[1].split("/")[0] for r in spark.read.parquet(f"{tmp_path}/t/manifest/v2").collect()}
    assert paths <= {"v0", "v1", "v2"} and "v2" in paths
    assert spark.read.parquet(f"{tmp_path}/t/data/v0").where(F.col("bucket") >= 0).count() == 7


def test_late_rows_are_kept_and_their_windows_repaired(spark, tmp_path):
    """Every window is as a batch over all rows has it; only those that late rows touch were computed anew, repeats of a batch change nothing."""
    at = lambda h: T0 + timedelta(hours=h)
    batches = [
        [("c", at(0), "ok", 1), ("c", at(30), "ok", 1), (None, at(2), "ok", 7), ("d", None, "ok", 9)],
        [("c", at(29.5), "failed", 0), ("c", at(60), "ok", 2), ("d", at(58), "ok", 1)],
        [("c", at(1), "ok", 100), ("c", at(59.5), "ok", 4), ("e", at(-40), "ok", None), (None, at(3), "failed", 1)],
    ]
    windows, source = streams.health_windows(24, 12), land(spark, str(tmp_path), batches, RUN)
    written = streams.drain(streams.rolling_health(source, 24, 12, "1 hour"), f"{tmp_path}/w", "update", ("window_end", "collector"))
    late.keep_late(source, windows, f"{tmp_path}/k", "1 hour").awaitTermination()
    kept = late.read_late(spark, f"{tmp_path}/k", source.schema)
    assert sorted((str(r.collector), r.started_at) for r in kept.collect()) == [("None", at(3)), ("c", at(1)), ("e", at(-40))]
    assert late.read_late(spark, f"{tmp_path}/k", source.schema, after=2).count() == 0
    again = late.recompute(spark, f"{tmp_path}/k", source.schema, kept, windows)
    ends = {(r.window_end, r.collector) for r in again.collect()}
    day = lambda d, h=0: datetime(2024, 1, d, h)
    assert ends == {(day(2), "c"), (day(2, 12), "c"), (day(2), None), (day(2, 12), None), (datetime(2023, 12, 31), "e"), (datetime(2023, 12, 31, 12), "e")}
    out = late.repair(written, again, windows)
    everything = spark.createDataFrame([r for b in batches for r in b], RUN).where("started_at is not null")
    plain = lambda df: sorted(map(str, df.select("window_end", "collector", "runs", "ok_runs", "new_items").collect()))
    assert plain(out) == plain(windows.reckon(everything))
    assert late.recompute(spark, f"{tmp_path}/k", source.schema, kept.limit(0), windows).count() == 0


def test_first_window_of_a_row(spark):
    """Late is told by the window that ends first, for lengths that the slide divides and for others."""
    rows = spark.createDataFrame([("c", T0 + timedelta(minutes=m), "ok", 1) for m in range(0, 400, 7)], RUN)
    for length, slide in (("6 hours", "30 minutes"), ("24 hours", "1 hour"), ("50 minutes", "20 minutes"), ("1 hour", "1 hour")):
        windows = late.Windows("started_at", ("collector",), length, slide, (F.count(F.lit(1)).alias("n"),))
        first = {r.started_at: r.e for r in windows.of(rows).groupBy("started_at").agg(F.min("window_end").alias("e")).collect()}
        assert {r.started_at: r.e for r in rows.select("started_at", late._first_end(windows).alias("e")).collect()} == first


def test_state_goes_on_after_a_stop(spark, tmp_path):
    """A stream that stops between drops and starts again from its checkpoint says what one that runs on says."""
    s = "board string, content_hash string, observed_at timestamp"
    row = lambda k, h: ("b", k, T0 + timedelta(hours=h))
    drops = [[row("x", 0), row("x", -1)], [row("y", 1), ("b", "z", None)], [row("x", 2), row("z", 3)], [row("y", -5), row("w", 4)]]
    for k, rows in enumerate(drops):
        spark.createDataFrame(rows, s).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        out = streams.drain(state.first_seen(stream), f"{tmp_path}/w")
    assert sorted((r.content_hash, r.first_seen) for r in out.collect()) == [("w", T0 + timedelta(hours=4)), ("x", T0 - timedelta(hours=1)), ("y", T0 + timedelta(hours=1)), ("z", T0 + timedelta(hours=3))]


def test_cursor_counts_and_timers(spark, tmp_path):
    """A cursor never goes back, units printed again are counted, and a queue is due when the watermark is past its last print by enough."""
    s = "queue_id string, unit_id string, pos long, printed_at timestamp"
    row = lambda q, u, p, h: (q, u, p, T0 + timedelta(hours=h))
    batches = [
        [row("q", "a", 0, 0), row("q", "b", 1, 1), row("r", "a", 0, 0), (None, "n", 5, T0), ("q", None, 9, T0)],
        [row("q", "a", 0, 2), row("q", "a", 0, 3)],
        [row("s", "k", 3, 30)],
        [row("r", "c", 2, 31)],
    ]
    out = streams.drain(state.drip(land(spark, f"{tmp_path}/a", batches, s)), f"{tmp_path}/a/w", "update")
    assert sorted((str(r.queue_id), r.unit_id, r.pos, r.again) for r in out.collect()) == [("None", "n", 5, 0), ("q", "b", 1, 0), ("q", "b", 1, 2), ("r", "a", 0, 0), ("r", "c", 2, 0), ("s", "k", 3, 0)]
    out = streams.drain(state.drip(land(spark, f"{tmp_path}/b", batches, s), due_hours=10), f"{tmp_path}/b/w", "update", ("queue_id",))
    assert sorted((str(r.queue_id), r.pos, r.state) for r in out.collect()) == [("None", 5, "due"), ("q", 1, "due"), ("r", 2, "printed"), ("s", 3, "printed")]


def test_windows_put_together_out_of_panes_are_those_of_rising(spark, tmp_path):
    """State has one row for each item and half hour, not one for each of the twelve windows that hold it."""
    s = "board string, content_hash string, observed_at timestamp, rank int"
    row = lambda k, m, rank: ("b", k, T0 + timedelta(minutes=m), rank)
    batches = [[row("x", 0, 40), row("x", 29, 9), row("y", 30, None)], [row("x", 100, 3), row("y", 200, 7), row(None, 0, 1)], [row("x", 10, 50), row("y", 420, 2), row("x", 359, 1)]]
    rows = land(spark, str(tmp_path), batches, s)
    panes = streams.drain(streams.rising_panes(rows, late="2 days"), f"{tmp_path}/p", "update", ("pane_end", "board", "content_hash"))
    keys = ("window_end", "board", "content_hash")
    want = streams.drain(streams.rising(rows, late="2 days"), f"{tmp_path}/w", "update", keys)
    assert panes.count() == 7 and want.count() > 40
    assert sorted(map(str, streams.rising_of(panes).collect())) == sorted(map(str, want.collect()))
