"""Merge semantics of the item store: idempotent upserts, sparse updates, queues and catalog overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions.fixed import KINDS, SOURCES
from inkwell.functions.text import is_blank, is_stub, payload_text, strip


def first_wins(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key, the first in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert_items(existing: DataFrame, incoming: DataFrame, key: str = "content_hash", seq: str = "seq") -> DataFrame:
    """The table after the incoming rows, in order of ``seq``, are stored.

    The first row of a key stays, but rank and heat follow the last one, even to null, and content, summary and images take
    the first value that isn't null.  ``is_new`` marks keys that weren't there, ``duplicates`` counts the incoming rows that met
    one.  One grouped aggregate; rows of a key are combined before the shuffle."""
    both = existing.withColumn(seq, F.lit(-1).cast("long")).withColumn("__old", F.lit(1)).unionByName(incoming.withColumn(seq, F.col(seq).cast("long")).withColumn("__old", F.lit(0)))
    late, fill = ["rank", "heat"], ["content", "summary", "images"]
    rest = [c for c in existing.columns if c not in (key, *late, *fill)]
    aggs = [F.min_by(F.struct(*rest), seq).alias("__first"), F.max_by(F.struct(*late), seq).alias("__last"), F.max("__old").alias("__old"), F.count(F.lit(1)).alias("__n")]
    aggs += [F.min_by(F.struct(c), F.when(F.col(c).isNotNull(), F.col(seq))).alias(f"__{c}") for c in fill if c in existing.columns]
    out = both.groupBy(key).agg(*aggs)
    picked = [F.col(f"__{c}.{c}").alias(c) for c in fill if c in existing.columns]
    return out.select(key, *[F.col(f"__first.{c}") for c in rest], *[F.col(f"__last.{c}") for c in late], *picked, (F.col("__old") == 0).alias("is_new"), (F.col("__n") - 1).alias("duplicates")).select(*existing.columns, "is_new", "duplicates")


def ledger(merged: DataFrame, incoming: DataFrame, least: int = 1) -> DataFrame:
    """(collector, total, new, dup, status) of a batch; fewer than ``least`` rows is a failure."""
    fresh = merged.where("is_new").select("content_hash")
    marked = incoming.join(fresh.withColumn("fresh", F.lit(1)), "content_hash", "left")
    w = Window.partitionBy("content_hash").orderBy("seq")
    marked = marked.withColumn("new", F.col("fresh").isNotNull() & (F.row_number().over(w) == 1))
    out = marked.groupBy("collector").agg(F.count(F.lit(1)).alias("total"), F.count_if("new").alias("new"), F.count_if(~F.col("new")).alias("dup"))
    return out.withColumn("status", F.when(F.col("total") < least, "failed").otherwise("ok"))


def append_snapshots(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rank observations with those of ``incoming`` that are ranked and new by (content_hash, board, observed_at)."""
    keys = ["content_hash", "board", "observed_at"]
    fresh = first_wins(incoming.where(F.col("rank").isNotNull()), keys, ["rank", "heat"])
    return existing.unionByName(fresh.join(existing.select(*keys), keys, "left_anti"))


def mark_used(items: DataFrame, used: DataFrame) -> DataFrame:
    """``used`` (content_hash, edition): sets used_in where it isn't set."""
    one = used.groupBy("content_hash").agg(F.min("edition").alias("__edition"))
    return items.join(one, "content_hash", "left").withColumn("used_in", F.coalesce("used_in", "__edition")).drop("__edition").select(*items.columns)


def sparse_update(items: DataFrame, changes: DataFrame, columns: list[str], skip_blank: tuple[str, ...] = ("content",)) -> DataFrame:
    """Sets those columns that a change has; blank text counts as none for ``skip_blank``."""
    new = changes.select("content_hash", *[(F.when(~is_blank(c), F.trim(c)) if c in skip_blank else F.col(c)).alias(f"__{c}") for c in columns])
    out = items.join(new, "content_hash", "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"__{c}", c))
    return out.select(*items.columns)


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key, the last in ``order``: feedback, embeddings."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("r")).select(*keys, "r.*")


def valid_feedback(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose label is 1 or -1, and the others."""
    good = F.coalesce(F.col("label").isin(1, -1), F.lit(False))
    return df.where(good), df.where(~good)


def quarantine(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a known source and kind, and the others with the reason."""
    bad_source, bad_kind = ~F.coalesce(F.col("source").isin(*SOURCES), F.lit(False)), ~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False))
    return items.where(~bad_source & ~bad_kind), items.where(bad_source | bad_kind).withColumn("reason", F.when(bad_source, "source").otherwise("kind"))


def work_queue(missing_content: DataFrame, missing_images: DataFrame, limit: int) -> DataFrame:
    """Items without content, then those without images, each once, no videos, at most twice ``limit``."""
    both = missing_content.withColumn("queue", F.lit(0)).unionByName(missing_images.withColumn("queue", F.lit(1))).where(F.col("kind") != "video")
    return first_wins(both, ["content_hash"], ["queue"]).orderBy("queue", F.desc("fetched_at"), "content_hash").limit(2 * limit)


def longer(old: Column, new: Column) -> Column:
    """``new`` where its text is longer than ``old``, else ``old``."""
    size = lambda c: F.char_length(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(size(new) > size(old), F.trim(new)).otherwise(old)


def restore_bodies(items: DataFrame, payloads: DataFrame, stub: int = 500) -> DataFrame:
    """Content that is a stub (the summary, a beginning of it, or exactly ``stub`` characters) gives way to the longest plain text of
    its landed payload, where that is longer.  ``restored`` marks such rows.

    ``payloads`` (content_hash, payload), JSON of feed entries.  Only payloads of stubs are joined and read; of several payloads of
    a key the longest text counts, by a partial aggregate."""
    items = items.withColumn("__stub", is_stub("content", "summary", stub))
    stubs = items.where("__stub").select("content_hash").distinct()
    best = payloads.join(stubs, "content_hash", "left_semi").select("content_hash", payload_text("payload").alias("t"))
    best = best.groupBy("content_hash").agg(F.max_by("t", F.struct(F.char_length("t"), "t")).alias("__best"))
    out = items.join(best, "content_hash", "left")
    better = F.col("__stub") & (F.char_length(strip(F.coalesce("__best", F.lit("")))) > F.char_length(strip("content")))
    out = out.withColumn("restored", F.coalesce(better, F.lit(False)))
    return out.withColumn("content", F.when(F.col("restored"), F.col("__best")).otherwise(F.col("content"))).drop("__best", "__stub")


def split_lists(articles: DataFrame, entries: str = "entries") -> DataFrame:
    """An article with two or more entries becomes one row for each: derived id, falling priority."""
    out = articles.where(F.size(entries) >= 2).select("*", F.posexplode(entries).alias("__i", "__e"))
    many = out.withColumn("id", F.concat("id", F.lit("-"), F.lpad((F.col("__i") + 1).cast("string"), 2, "0"))).withColumn("priority", F.round(F.col("priority") - (F.col("__i") + 1) * 0.001, 4)).withColumn("title", F.col("__e")).drop("__i", "__e", entries)
    return many.unionByName(articles.where(F.coalesce(F.size(entries), F.lit(0)) < 2).drop(entries))


def overlay(catalog: DataFrame, changes: DataFrame, extra: DataFrame, key: str = "name") -> DataFrame:
    """A catalog with an overlay: disabled rows go, fields that a change has replace the catalog's, new rows and ``extra`` follow, first name wins.

    ``changes`` has the catalog's columns and ``disabled``."""
    fields = [c for c in catalog.columns if c != key]
    off = changes.where("disabled").select(key)
    on = changes.where("not disabled")
    merged = catalog.join(off, key, "left_anti").join(on.select(key, *[F.col(c).alias(f"__{c}") for c in fields]), key, "left")
    merged = merged.select(key, *[F.coalesce(f"__{c}", c).alias(c) for c in fields]).withColumn("__o", F.lit(0))
    added = on.join(catalog.select(key), key, "left_anti").select(*catalog.columns).withColumn("__o", F.lit(1))
    out = merged.unionByName(added).unionByName(extra.select(*catalog.columns).withColumn("__o", F.lit(2)))
    return first_wins(out, [key], ["__o"]).drop("__o")


def append_unseen(existing: DataFrame, incoming: DataFrame, key: str, order: list) -> DataFrame:
    """``existing`` and the first incoming row of every key that it lacks."""
    return existing.unionByName(first_wins(incoming, [key], order).join(existing.select(key), key, "left_anti"))


def drop_used(items: DataFrame, used: DataFrame) -> DataFrame:
    return items.join(used.select("content_hash"), "content_hash", "left_anti")
