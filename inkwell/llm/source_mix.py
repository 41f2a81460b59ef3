"""Mixing sources to target weights by entropy balancing (operator 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.llm.common import cut, fresh, partitions, skew_join

#: Phases of the systematic rounding that are tried for each source.
PHASES = 32
WORD = r"[^\x20\x09-\x0D]+"


def _placed(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` with their place (from 0) in order of a column without repeats: a range partitioning, and one sum over its partitions."""
    ranged = rows.repartitionByRange(partitions(rows.sparkSession), by).sortWithinPartitions(by)
    ranged = cut(ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")))
    counts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row for each partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(F.broadcast(counts.select("part", before.alias("before"))), "part").withColumn("place", F.col("at") + F.col("before")).drop("part", "at", "before")


def source_targets(totals: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """Adds ``target`` to one row per source (skey, source_size): shares of all tokens by weight, at most ``cap`` times a source.

    Sources take the weights in order of ``skey``, repeating.  What a source can't take is shared out among the others by
    weight until none is above its cap; each round brings two sums to the driver."""
    turn = F.col("place") % len(weights)
    totals = _placed(totals, "skey").withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")).cast("double"))
    totals = cut(totals.drop("place").withColumn("most", F.col("source_size") * F.lit(float(cap))))
    share = 0.0
    while True:
        full = F.col("weight") * F.lit(share) > F.col("most")
        left, open_weight = totals.agg(F.sum("source_size") - F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0.0)), F.sum(F.when(full, F.lit(0.0)).otherwise(F.col("weight")))).first()
        now = left / open_weight if open_weight else share
        if now <= share:
            return totals.withColumn("target", F.least("most", F.col("weight") * F.lit(share)))
        share = now


def balance_rates(totals: DataFrame, tolerance: float = 1e-13, rounds: int = 60) -> DataFrame:
    """Adds ``rate``, the exponential tilt exp(lambda) that meets each source's token constraint.

    Entropy balancing: of all document rates whose tokens sum to the targets, those with the least token-weighted divergence
    from 1 are exp(lambda[source]); lambda minimises the convex dual sum(size * exp(lambda)) - target * lambda.  Each Newton
    round is a DataFrame step over the gradient and the (diagonal) Hessian; the driver sees only the largest error."""
    at = totals.withColumn("lam", F.lit(0.0))
    for _ in range(rounds):
        tilted = F.col("source_size") * F.exp("lam")
        at = cut(at.withColumn("lam", F.when((F.col("source_size") > 0) & (F.col("target") > 0), F.col("lam") - (tilted - F.col("target")) / tilted).otherwise(F.col("lam"))))
        worst = at.where("source_size > 0 and target > 0").agg(F.max(F.abs(tilted / F.col("target") - 1))).first()[0]
        if worst is None or worst < tolerance:
            break
    return at.withColumn("rate", F.round(F.exp("lam"), 9)).drop("lam")


def mix_sources(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(key, source, size, source_size, target, rate, copies, taken) for every row of ``docs``.

    size: words of the text (null or empty: 0).  A null source is a source of its own, last in order.  ``copies`` rounds the
    rate systematically along the documents of a source in order of (size, key): the k-th running total of copies is the
    running total of rates, rounded at one of 32 phases, whichever brings the source's words nearest to its target.  The order comes from a
    range partitioning on (source, size, key) with one prefix sum over partitions, so a source of any size is spread over many
    tasks.  Repeated rows count each time; equal rows may swap places.  Other columns are not looked at, so
    their names can't clash.  An empty table gives an empty result."""
    spark = docs.sparkSession
    sized = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = sized.withColumn("skey", F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "source")))
    sized = cut(sized)  # words are counted once; sampling for the ranges reads the counts alone
    ranged = sized.repartitionByRange(partitions(spark), "skey", "size", "key").sortWithinPartitions("skey", "size", "key")
    ranged = cut(ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")))
    runs = ranged.groupBy("skey", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("start"), F.sum("size").alias("words"))
    totals = runs.groupBy("skey").agg(F.sum("words").alias("source_size"))
    rates = balance_rates(source_targets(totals, weights, cap)).select("skey", "source_size", "target", "rate")
    before = F.sum("n").over(Window.partitionBy("skey").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("skey", "part", "n", (F.coalesce(before, F.lit(0)) - F.col("start")).alias("shift")).join(rates.hint("shuffle_hash"), "skey")
    runs = cut(runs.withColumn("run", F.struct("skey", "part")).drop("part"))
    ranged = ranged.withColumn("run", F.struct("skey", "part")).drop("skey", "part")
    i, whole = F.col("at") + F.col("shift"), F.floor("rate")

    def copies(phase):
        part = F.col("rate") - whole
        return (whole + F.floor((i + 1) * part + phase) - F.floor(i * part + phase)).cast("long")

    tried = skew_join(ranged, runs, "run", "n").groupBy("skey").agg(F.first("target").alias("target"), *[F.sum(copies(F.lit(p / PHASES)) * F.col("size")).alias(f"p{p}") for p in range(PHASES)])
    errors = F.array(*[F.abs(F.col(f"p{p}") - F.col("target")) for p in range(PHASES)])
    phases = tried.select("skey", ((F.array_position(errors, F.array_min(errors)) - 1) / PHASES).alias("phase"))
    out = skew_join(ranged, cut(runs.join(phases.hint("shuffle_hash"), "skey")), "run", "n").withColumn("copies", copies(F.col("phase")))
    return out.select(F.col("key").alias(key), "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs``, each as often as its number of copies, numbered in ``copy`` from 1; rows of 0 copies go.

    ``copy`` is called ``copy_2`` where ``docs`` has a column of that name, and so on.  Rows of one key, and those of a null key,
    are taken alike, as often as the one taken most.  An empty table stays empty."""
    own, times = fresh(docs, "key_of_mix"), fresh(docs, "times")
    plan = mix_sources(docs, key=key, **how).select(F.col(key).alias(own), "copies").groupBy(own).agg(F.max("copies").alias(times)).where(F.col(times) > 0)
    joined = docs.join(plan.hint("shuffle_hash"), docs[key].eqNullSafe(F.col(own)))
    return joined.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))).alias(fresh(docs, "copy")))
