"""Dumps written from the given tables as they would land, and read back as items by the ``landed_dumps`` source."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators.graph import shared_folder
from inkwell.plans.tables import clock, table
from inkwell.sources import dumps
from inkwell.sources.landed import register
from inkwell.streaming import streams

QUERIES, ORACLE = {}, {}
#: Entries of a dump, so that one file stays small however many documents there are.
ENTRIES = 500


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return keep


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/dumps-{uuid.uuid4().hex}"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the number of their dump and their text as words of Latin letters."""
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]+", " "))
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.floor(F.col("doc_id") / ENTRIES).alias("dump"), words.alias("words"))


DOCUMENTS_SQL = f"d AS (SELECT doc_id, text, doc_id // {ENTRIES} AS dump, trim(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ', 'g')) AS words FROM documents)"


def _land(entries: DataFrame, folder: str, entry: Column, file: Column) -> str:
    """One text file for each dump: ``entry`` of all its rows in order of doc_id, made into a file's text by ``file`` (from array ``e``)."""
    own = entries.select("dump", F.struct("doc_id", entry.alias("e")).alias("x")).groupBy("dump").agg(F.array_sort(F.collect_list("x"))["e"].alias("e"))
    own.select("dump", file.alias("value")).write.mode("append").partitionBy("dump").text(folder)
    return folder


def _read(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    return register(spark).read.format("landed_dumps").option("path", folder).option("dump", kind).load()


def _dump_name() -> Column:
    return F.regexp_extract("path", "dump=([0-9]+)", 1)


def _board_entry(title: Column) -> Column:
    n, k = F.col("doc_id").cast("string"), F.col("doc_id") % 5
    hot = F.when(k == 1, F.concat((F.col("doc_id") % 100).cast("string"), F.lit(".5万"))).when(k == 2, n).when(k == 3, F.concat(F.lit("1,"), F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0"))).when(k == 4, "n/a")
    url, mobile = F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("https://e/"), n)), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("https://m/"), n))
    return F.struct(title.alias("title"), url.alias("url"), mobile.alias("mobileUrl"), F.left(F.md5("text"), F.lit(8)).alias("desc"), hot.alias("hot"), F.when(F.col("doc_id") % 2 == 0, 1700000000 + F.col("doc_id")).otherwise(1700000000000 + F.col("doc_id") * 1000).alias("timestamp"))


def _board_file() -> Column:
    return F.to_json(F.struct(F.col("e").alias("data")))


HEAT_SQL = "CASE doc_id % 5 WHEN 1 THEN (doc_id % 100 + 0.5) * 1e4 WHEN 2 THEN doc_id WHEN 3 THEN 1000 + doc_id % 1000 END::DOUBLE"


@query(f"""WITH {DOCUMENTS_SQL}
SELECT dump::VARCHAR AS board, 'T' || doc_id AS title,
  CASE WHEN doc_id % 4 <> 0 THEN 'https://e/' || doc_id WHEN doc_id % 3 <> 0 THEN 'https://m/' || doc_id ELSE '' END AS url,
  left(md5(text), 8) AS summary, row_number() OVER (PARTITION BY dump ORDER BY doc_id) AS rank, {HEAT_SQL} AS heat,
  strftime(TIMESTAMP '2023-11-14 22:13:20' + to_seconds(doc_id), '%Y-%m-%d %H:%M:%S') AS published_at
FROM d QUALIFY doc_id % 9 <> 0""")
def s1_board_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(F.col("doc_id") % 9 == 0, "  ").otherwise(F.concat(F.lit(" T"), F.col("doc_id").cast("string"), F.lit(" ")))
    folder = _land(_documents(spark, sf_dir), _folder(spark), _board_entry(title), _board_file())
    rows = dumps.entries(_read(spark, folder, "board"), "board")
    return dumps.board_items(rows, _dump_name()).select("board", "title", "url", "summary", "rank", "heat", clock("published_at"))


@query(f"""WITH {DOCUMENTS_SQL},
x AS (SELECT *, CASE WHEN doc_id % 9 = 0 THEN '' ELSE 'T & ' || doc_id END AS t, CASE WHEN doc_id % 7 = 0 OR doc_id % 9 = 0 AND doc_id % 2 = 0 THEN '' ELSE 'https://e/' || doc_id END AS l,
  trim(left(words, (30 + doc_id % 120)::INT)) AS short, CASE WHEN doc_id % 3 = 0 THEN trim(left(words, 900)) ELSE '' END AS long FROM d)
SELECT coalesce(nullif(t, ''), l) AS title, CASE WHEN l <> '' THEN l ELSE 'urn:rss:feeds:' || t END AS url, nullif(short, '') AS summary,
  CASE WHEN length(long) > 80 THEN long WHEN length(short) >= 80 THEN short END AS content, CASE WHEN doc_id % 2 = 0 THEN 'a' || doc_id % 30 ELSE 'feeds' END AS author,
  strftime(TIMESTAMP '2024-01-01' + to_minutes(doc_id), '%Y-%m-%d %H:%M:%S') AS published_at, CASE WHEN doc_id % 5 = 0 THEN 'x|y' || doc_id ELSE '' END AS tags
FROM x WHERE t <> '' OR l <> ''""")
def s2_feed_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("doc_id").cast("string"), F.col("doc_id")
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    time = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(mins=k.cast("int"))
    entry = F.concat(
        F.lit("<item>"),
        tag("title", F.when(k % 9 == 0, "").otherwise(F.concat(F.lit("T &amp; "), n))),
        tag("link", F.when((k % 7 == 0) | (k % 9 == 0) & (k % 2 == 0), "").otherwise(F.concat(F.lit("https://e/"), n))),
        tag("description", F.substr("words", F.lit(1), (30 + k % 120).cast("int"))),
        F.when(k % 3 == 0, tag("content:encoded", F.concat(F.lit("<![CDATA[<p>"), F.left("words", F.lit(900)), F.lit("</p>]]>")))).otherwise(""),
        F.when(k % 2 == 0, tag("author", F.concat(F.lit("a"), (k % 30).cast("string")))).otherwise(""),
        tag("pubDate", F.concat(F.lit("Mon, "), F.date_format(time, "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))),
        F.when(k % 5 == 0, F.concat(tag("category", F.lit("x")), tag("category", F.concat(F.lit("y"), n)))).otherwise(""),
        F.lit("</item>"),
    )
    file = F.concat(F.lit('<rss xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel>'), F.array_join("e", ""), F.lit("</channel></rss>"))
    folder = _land(_documents(spark, sf_dir), _folder(spark), entry, file)
    items = dumps.feed_items(dumps.entries(_read(spark, folder, "feed"), "feed").select("r.*"), "feeds")
    return items.select("title", "url", "summary", "content", "author", clock("published_at"), F.array_join("tags", "|").alias("tags"))


@query(f"""WITH {DOCUMENTS_SQL}
SELECT CASE WHEN doc_id % 6 = 0 AND words <> '' THEN words WHEN doc_id % 12 = 0 THEN 'https://e/' || doc_id WHEN doc_id % 6 = 0 THEN 'https://www.xiaohongshu.com/explore/n' || doc_id ELSE 'T' || doc_id END AS title,
  CASE WHEN doc_id % 4 = 0 THEN 'https://e/' || doc_id ELSE 'https://www.xiaohongshu.com/explore/n' || doc_id END AS url, nullif(left(words, 500), '') AS summary,
  'a' || doc_id % 30 AS author, 'u' || doc_id % 30 AS author_id, strftime(TIMESTAMP '2023-11-14 22:13:20' + to_seconds(doc_id), '%Y-%m-%d %H:%M:%S') AS published_at,
  CASE WHEN doc_id % 5 < 4 THEN (1000 + doc_id)::DOUBLE END AS heat, CASE WHEN doc_id % 3 = 0 THEN 'a|b' WHEN doc_id % 3 = 1 THEN 'c|d e' ELSE '' END AS tags FROM d""")
def s3_note_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat notes and nested ones, as lines; tags as text, as a list, or none."""
    n, k = F.col("doc_id").cast("string"), F.col("doc_id")
    flat = k % 2 == 0
    name, user = F.concat(F.lit("a"), (k % 30).cast("string")), F.concat(F.lit("u"), (k % 30).cast("string"))
    liked = F.when(k % 5 < 4, F.format_string("%,d", 1000 + k)).otherwise("many")
    entry = F.to_json(
        F.struct(
            F.concat(F.lit("n"), n).alias("note_id"), F.when(k % 6 == 0, "").otherwise(F.concat(F.lit("T"), n)).alias("title"), F.col("words").alias("desc"), (1700000000000 + k * 1000).alias("time"),
            F.when(k % 4 == 0, F.concat(F.lit("https://e/"), n)).alias("note_url"), F.when(flat, name).alias("nickname"), F.when(flat, user).alias("user_id"), F.when(flat, liked).alias("liked_count"),
            F.when(~flat, F.struct(name.alias("nickname"), user.alias("user_id"))).alias("user"), F.when(~flat, F.struct(liked.alias("liked_count"))).alias("interact_info"),
            F.when(k % 3 == 0, "a, b").alias("tag_list"), F.when(k % 3 == 1, F.array(F.lit(" c"), F.lit("d e"), F.lit(""))).alias("tags"),
        )
    )
    folder = _land(_documents(spark, sf_dir), _folder(spark), entry, F.array_join("e", "\n"))
    items = dumps.creator_items(dumps.entries(_read(spark, folder, "notes"), "notes").select("r.*"), "notes")
    return items.select("title", "url", "summary", "author", "author_id", clock("published_at"), "heat", F.array_join(F.coalesce("tags", F.array().cast("array<string>")), "|").alias("tags"))


@query(f"""WITH {DOCUMENTS_SQL}
SELECT CASE WHEN doc_id % 7 <> 0 THEN 'T' || doc_id END AS title, CASE doc_id % 3 WHEN 0 THEN CASE WHEN words <> '' THEN words || chr(10) || chr(10) ELSE '' END || 'end' WHEN 1 THEN words ELSE '' END AS text FROM d WHERE doc_id % 4 <> 3""")
def s13_article_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of four codes, of which three are a success; fields under data or at the root, markup or text."""
    k = F.col("doc_id")
    fields = F.struct(
        F.when(k % 7 == 0, " ").otherwise(F.concat(F.lit(" T"), k.cast("string"))).alias("title"),
        F.when(k % 3 == 0, F.concat(F.lit("<p>"), "words", F.lit("</p><p>end</p>"))).when(k % 2 == 0, "").alias("content"),
        F.when(k % 3 == 1, F.concat(F.lit("  "), "words", F.lit(" \n"))).alias("content_text"),
    )
    code = F.when(k % 4 == 0, 20000).when(k % 4 == 1, 200).when(k % 4 == 3, 500)
    entry = F.when(k % 2 == 0, F.to_json(F.struct(code.alias("code"), fields.alias("data")))).otherwise(F.to_json(F.struct(code.alias("code"), fields["title"].alias("title"), fields["content"].alias("content"), fields["content_text"].alias("content_text"))))
    folder = _land(_documents(spark, sf_dir), _folder(spark), entry, F.array_join("e", "\n"))
    return dumps.article_items(dumps.entries(_read(spark, folder, "article"), "article").select("r.*"))


@query(f"""WITH {DOCUMENTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id % 2, dump ORDER BY doc_id) AS rank, 'T' || doc_id % 300 AS content_hash, (doc_id % 2, doc_id) AS seq FROM d)
SELECT content_hash, arg_max(rank, seq)::INT AS rank, max_by(struct_pack(h := {HEAT_SQL}), seq).h AS heat, arg_min(left(md5(text), 8), seq) AS content FROM r GROUP BY content_hash""")
def t1_dump_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Board dumps land in two rounds; after each the stream goes on from its offset and merges what is new into the items."""
    folder, d = _folder(spark), _documents(spark, sf_dir)
    for k in (0, 1):
        title = F.concat(F.lit("T"), (F.col("doc_id") % 300).cast("string"))
        _land(d.where(F.col("doc_id") % 2 == k), f"{folder}/landed/round={k}", _board_entry(title), _board_file())
        stream = register(spark).readStream.format("landed_dumps").option("path", f"{folder}/landed").load()
        place = F.concat(F.regexp_extract("path", "round=([0-9]+)", 1), F.lpad(_dump_name(), 12, "0"))
        items = dumps.board_items(dumps.entries(stream, "board"), place)
        rows = items.select(F.col("title").alias("content_hash"), F.lit("board").alias("source"), "rank", "heat", F.col("summary").alias("content"), F.concat("board", F.lpad(F.col("rank").cast("string"), 4, "0")).cast("long").alias("seq"))
        job = streams.ingest(rows, f"{folder}/items", f"{folder}/state")
        job.awaitTermination()
        last = max(p["batchId"] for p in job.recentProgress)
    return streams.read_items(spark, f"{folder}/items", last, rows.drop("seq").schema).select("content_hash", "rank", "heat", "content")
