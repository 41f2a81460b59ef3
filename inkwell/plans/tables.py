"""The engine's logical tables, bound to the given Parquet tables; the same bindings as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF_ITEMS, AS_OF_BOARD, AS_OF_RUNS = "2024-01-31 00:00:00", "2024-01-03 00:00:00", "2024-01-31 00:00:00"
ITEM_SOURCES = ("weibo", "zhihu", "bilibili", "wechat_mp", "toutiao", "rss", "xiaohongshu", "news")
ITEM_KINDS = ("article", "post", "video", "hotlist", "article")
LINKS = ("https://mp.weixin.qq.com/s/", "http://m.zhihu.com/p/", "https://Example.com/a/", "http://m.weibo.cn/status/", "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple, by: str):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(by) % len(values) + 1).cast("int"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    hours = F.make_interval(hours=(F.col("doc_id") % 720).cast("int"))
    n, link = F.col("doc_id"), _pick(LINKS, "doc_id")
    return d.select(
        "doc_id", F.substring(F.sha2(F.concat(F.col("source"), F.lit(":doc:"), n.cast("string")), 256), 1, 32).alias("content_hash"), _pick(ITEM_SOURCES, "doc_id").alias("source"), _pick(ITEM_KINDS, "doc_id").alias("kind"),
        F.substring_index("text", "\n", 1).alias("title"), F.when(link == "", "").otherwise(F.concat(link, n.cast("string"))).alias("url"), F.when(n % 11 == 0, None).otherwise(F.substring("text", 1, 500)).alias("summary"), F.when(n % 7 == 0, None).otherwise(F.col("text")).alias("content"),
        F.concat(F.lit("a"), (n % 30).cast("string")).alias("author"), F.when(n % 9 == 0, None).otherwise(start + hours).alias("published_at"), (start + hours + F.make_interval(mins=(n % 5 * 30).cast("int"))).alias("fetched_at"),
        F.when(n % 3 == 0, None).otherwise(n % 50 + 1).cast("int").alias("rank"), F.when(n % 4 == 0, None).otherwise((n * 37 % 100000).cast("double")).alias("heat"), F.col("source").alias("collector"), (n * 7919 % 1000 / 1000.0).cast("double").alias("score"),
        F.when(n % 10 == 0, F.concat(F.lit("2024-01-0"), (n % 3 + 1).cast("string"), F.lit("-am"))).alias("used_in"), F.when(n % 6 == 0, F.array().cast("array<string>")).alias("images"),
    )


ITEMS_SQL = """
items AS (
  SELECT doc_id, left(sha256(source || ':doc:' || doc_id), 32) AS content_hash,
    ['weibo','zhihu','bilibili','wechat_mp','toutiao','rss','xiaohongshu','news'][doc_id % 8 + 1] AS source,
    ['article','post','video','hotlist','article'][doc_id % 5 + 1] AS kind,
    split_part(text, chr(10), 1) AS title,
    CASE WHEN doc_id % 5 = 4 THEN '' ELSE ['https://mp.weixin.qq.com/s/','http://m.zhihu.com/p/','https://Example.com/a/','http://m.weibo.cn/status/',''][doc_id % 5 + 1] || doc_id END AS url,
    CASE WHEN doc_id % 11 = 0 THEN NULL ELSE left(text, 500) END AS summary,
    CASE WHEN doc_id % 7 = 0 THEN NULL ELSE text END AS content,
    'a' || doc_id % 30 AS author,
    CASE WHEN doc_id % 9 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01' + to_hours(doc_id % 720) END AS published_at,
    TIMESTAMP '2024-01-01' + to_hours(doc_id % 720) + to_minutes(doc_id % 5 * 30) AS fetched_at,
    CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 50 + 1 END AS rank,
    CASE WHEN doc_id % 4 = 0 THEN NULL ELSE (doc_id * 37 % 100000)::DOUBLE END AS heat,
    source AS collector, (doc_id * 7919 % 1000) / 1000.0::DOUBLE AS score,
    CASE WHEN doc_id % 10 = 0 THEN '2024-01-0' || (doc_id % 3 + 1) || '-am' END AS used_in,
    CASE WHEN doc_id % 6 = 0 THEN 1 END AS images
  FROM documents)"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("board"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("content_hash"), F.col("ts").cast("timestamp").alias("observed_at"), (F.floor("value").cast("int") % 50 + 1).alias("rank"), F.col("value").alias("heat"))


SNAPSHOTS_SQL = """
snapshots AS (SELECT event_type AS board, 'u' || user_id AS content_hash, ts AS observed_at, floor(value)::INT % 50 + 1 AS rank, value AS heat FROM events)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    bad = F.col("event_type") == "error"
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("c"), (F.col("user_id") % 20).cast("string")).alias("collector"), F.col("ts").cast("timestamp").alias("started_at"), F.when(bad, "failed").otherwise("ok").alias("status"), F.get_json_object("props", "$.k").cast("long").alias("new_count"), F.when(bad, F.concat(F.lit("E"), F.floor("value").cast("string"))).alias("error"))


RUNS_SQL = """
runs AS (SELECT event_id AS id, 'c' || user_id % 20 AS collector, ts AS started_at, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status,
  (props->>'$.k')::BIGINT AS new_count, CASE WHEN event_type = 'error' THEN 'E' || floor(value)::BIGINT END AS error FROM events)"""


def clock(name: str):
    """Times as text, the same in every engine."""
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)
