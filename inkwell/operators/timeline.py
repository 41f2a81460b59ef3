"""Operators over rank observations and run ledgers; every one takes an explicit ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _since(as_of: str, hours: int) -> Column:
    return F.lit(as_of).cast("timestamp") - F.expr(f"interval {hours} hours")


def newly_entered(snapshots: DataFrame, as_of: str, hours: int = 6) -> DataFrame:
    """(board, content_hash, first_seen): seen on the board within the window and never before it.  One grouped pass, no anti join."""
    seen = snapshots.groupBy("board", "content_hash").agg(F.min("observed_at").alias("first_seen"))
    return seen.where(F.col("first_seen") >= _since(as_of, hours))


def fast_rising(snapshots: DataFrame, as_of: str, hours: int = 6, min_delta: int = 15) -> DataFrame:
    """(board, content_hash, delta): first place in the window less the best one, where that is ``min_delta`` or more."""
    own = snapshots.where(F.col("observed_at") >= _since(as_of, hours)).groupBy("board", "content_hash")
    ranked = own.agg(F.min_by("rank", F.struct("observed_at", "rank")).alias("first"), F.min("rank").alias("best"))
    return ranked.select("board", "content_hash", (F.col("first") - F.col("best")).alias("delta")).where(F.col("delta") >= min_delta)


def new_entry_items(entered: DataFrame, items: DataFrame, limit: int = 20) -> DataFrame:
    """Items of new entries on any board, each once, by heat, then place (none: 999), then key."""
    keys = entered.select("content_hash").distinct()
    order = [F.coalesce("heat", F.lit(0.0)).desc(), F.coalesce("rank", F.lit(999)), F.col("content_hash")]
    return items.join(keys, "content_hash", "left_semi").orderBy(*order).limit(limit)


def collector_health(runs: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Runs, results, new items and last error of each collector within the window."""
    own = runs.where((F.col("started_at") >= _since(as_of, hours)) & (F.col("started_at") <= F.lit(as_of).cast("timestamp")))
    failed = F.col("error").isNotNull()
    return own.groupBy("collector").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "ok").alias("ok_runs"), F.count_if(F.col("status") == "failed").alias("failed_runs"),
        F.sum(F.coalesce("new_count", F.lit(0))).alias("new_items"), F.max("started_at").alias("last_run"), F.max(F.when(F.col("status") == "ok", F.col("started_at"))).alias("last_ok"),
        F.max_by(F.when(failed, F.col("error")), F.when(failed, F.col("id"))).alias("last_error"),
    )


def latest_runs(runs: DataFrame) -> DataFrame:
    """The run of largest id of each collector, without a self join."""
    return runs.groupBy("collector").agg(F.max_by(F.struct("id", "status", "started_at", "new_count", "error"), "id").alias("r")).select("collector", "r.*")


def diagnose(expected: DataFrame, runs: DataFrame, as_of: str, drop_ratio: float = 0.2, least_mean: float = 3.0) -> DataFrame:
    """State of every expected collector: idle, else never_ok, else volume_drop, else ok; runs of others don't count."""
    day, week = collector_health(runs, as_of, 24), collector_health(runs, as_of, 168)
    out = expected.join(day, "collector", "left").join(week.select("collector", F.col("new_items").alias("new_7d"), F.col("last_run").alias("last_run_7d")), "collector", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    mean = zero("new_7d") / 7.0
    state = F.when(zero("runs") == 0, "idle").when(zero("ok_runs") == 0, "never_ok").when((mean >= least_mean) & (zero("new_items") < drop_ratio * mean), "volume_drop").otherwise("ok")
    severity = F.when(F.col("state") == "never_ok", "fail").when(F.col("state") == "ok", "ok").otherwise("warn")
    facts = [zero(c).alias(a) for c, a in (("runs", "runs"), ("ok_runs", "ok_runs"), ("failed_runs", "failed_runs"), ("new_items", "new_24h"), ("new_7d", "new_7d"))]
    out = out.select("collector", *facts, F.coalesce("last_run", "last_run_7d").alias("last_run"), "last_error", state.alias("state"))
    return out.withColumn("severity", severity).withColumn("alert", _alert(drop_ratio)).drop("last_error")


def _alert(drop_ratio: float) -> Column:
    mean = F.col("new_7d") / 7.0
    failed = F.concat(F.col("collector"), F.lit(" 过去 24h 全失败"), F.coalesce(F.concat(F.lit(" · "), "last_error"), F.lit("")))
    return F.when(F.col("state") == "never_ok", failed).when(F.col("state") == "volume_drop", F.concat(F.col("collector"), F.lit(" 产出骤降:24h="), F.col("new_24h"), F.lit(f" < {drop_ratio:.0%} × 7日日均 "), F.format_number(mean, 1)))


def alerts(diagnosed: DataFrame, left: DataFrame, hours: float = 72.0, least: int = 5) -> DataFrame:
    """(pos, alert): what failed or dropped by collector, how many collectors weren't run, and readable items that pile up.

    ``diagnosed`` is the bounded catalog of collectors with their state, ``left`` a backlog (what, n, hours)."""
    own = diagnosed.where(F.col("alert").isNotNull()).select(F.row_number().over(Window.orderBy("collector")).alias("pos"), "alert")
    idle = diagnosed.agg(F.count_if(F.col("state") == "idle").alias("n")).where("n > 0").select(F.lit(1_000_000).alias("pos"), F.concat(F.col("n").cast("string"), F.lit(" 张网 24h 未调度")).alias("alert"))
    old = left.where((F.col("what") == "readable") & (F.col("hours") >= hours) & (F.col("n") >= least))
    pile = old.select(F.lit(1_000_001).alias("pos"), F.format_string("%d 篇有正文的未读已积压 %.0fh,该出报了", F.col("n"), F.bround("hours")).alias("alert"))
    return own.unionByName(idle).unionByName(pile)


def item_stats(items: DataFrame) -> DataFrame:
    """Items of each source and in all (source null): how many, unused, with content."""
    return items.rollup("source").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("used_in").isNull()).alias("unused"), F.count("content").alias("with_content"))


def backlog(items: DataFrame, as_of: str) -> DataFrame:
    """(what, n, hours): unused items and unused readable ones, with the age of the oldest."""
    readable = F.col("kind").isin("article", "post") & F.col("content").isNotNull() & (F.trim("content") != "")
    age = lambda t: (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(t)) / 3600.0
    free = items.where(F.col("used_in").isNull()).agg(F.count(F.lit(1)).alias("n"), F.min("fetched_at").alias("t"), F.count_if(readable).alias("rn"), F.min(F.when(readable, F.col("fetched_at"))).alias("rt"))
    return free.select(F.explode(F.array(F.struct(F.lit("unused").alias("what"), F.col("n"), age("t").alias("hours")), F.struct(F.lit("readable").alias("what"), F.col("rn").alias("n"), age("rt").alias("hours")))).alias("x")).select("x.*")


def batch_coverage(runs: DataFrame, minutes: int = 30, least: int = 5) -> DataFrame:
    """Rounds of ``minutes`` in which at least ``least`` collectors ended well, or not."""
    done = F.count_distinct(F.when(F.col("status") == "ok", F.col("collector")))
    return runs.groupBy(F.window("started_at", f"{minutes} minutes")["start"].alias("round")).agg(done.alias("ok_collectors")).withColumn("covered", F.col("ok_collectors") >= least)
