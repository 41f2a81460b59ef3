"""Readers of landed dumps: each gives items; an empty dump is an error where asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions.text import html_to_text, is_activity, normalize_paragraphs, one_line, parse_epoch, parse_heat, split_tags, strip, strip_footer

_BOARD_ENTRY = "struct<title:string,url:string,mobileUrl:string,desc:string,hot:string,timestamp:string>"
BOARD = f"data array<{_BOARD_ENTRY}>"


class EmptyDump(RuntimeError):
    """A source that gave nothing has failed."""


def require_rows(items: DataFrame, name: str) -> DataFrame:
    if items.isEmpty():
        raise EmptyDump(name)
    return items


def entries(dumps: DataFrame, kind: str) -> DataFrame:
    """Rows (path, pos, raw) of ``landed_dumps`` of a kind with their entry in ``r``; rows of dumps without entries, or entries that aren't objects, go."""
    return dumps.withColumn("r", F.from_json("raw", ENTRY[kind])).where(F.col("raw").startswith("{"))


def board_items(rows: DataFrame, board: str | Column) -> DataFrame:
    """Items of a board's entries (pos, r): the rank is the place in the list, blank titles counted; the mobile link where there is no other."""
    blank = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    board = F.lit(board) if isinstance(board, str) else board
    return rows.where(blank(F.col("r.title")).isNotNull()).select(board.alias("board"), F.trim("r.title").alias("title"), F.coalesce(blank(F.col("r.url")), blank(F.col("r.mobileUrl")), F.lit("")).alias("url"), blank(F.col("r.desc")).alias("summary"), (F.col("pos") + 1).alias("rank"), parse_heat("r.hot").alias("heat"), parse_epoch("r.timestamp").alias("published_at"), F.lit("hotlist").alias("kind"))


def read_board(spark: SparkSession, path: str, board: str) -> DataFrame:
    """Items of a board's JSON (``board_items``)."""
    return board_items(spark.read.schema(BOARD).option("multiLine", True).json(path).select(F.posexplode("data").alias("pos", "r")), board)


def parse_feed_date(raw: Column) -> Column:
    """Dates of feeds, without their day of the week."""
    return F.coalesce(F.try_to_timestamp(F.regexp_replace(raw, r"^[A-Za-z]{3},\s*", ""), F.lit("dd MMM yyyy HH:mm:ss z")), F.try_to_timestamp(F.regexp_replace(raw, r"^[A-Za-z]{3},\s*", ""), F.lit("dd MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(raw))


FEED = "title string, link string, description string, author string, pubDate string, category array<string>, `content:encoded` string"
_LINK = "struct<_href:string,_rel:string>"
ATOM = f"title string, link array<{_LINK}>, id string, summary string, content string, author struct<name:string>, published string, updated string, category array<struct<_term:string>>"


def _rss(r: DataFrame) -> DataFrame:
    return r.select("title", "link", F.col("description").alias("full"), F.col("content:encoded").alias("encoded"), "author", parse_feed_date(F.col("pubDate")).alias("published_at"), F.col("category").alias("tags"))


def _atom(r: DataFrame) -> DataFrame:
    """Entries of an Atom feed: the alternate link, or else the first; content as markup or text; the author's name."""
    other = F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    link = F.coalesce(F.get(other, F.lit(0))["_href"], F.get("link", F.lit(0))["_href"])
    time = F.coalesce(F.try_to_timestamp("published"), F.try_to_timestamp("updated"))
    return r.select("title", link.alias("link"), F.coalesce("summary", F.lit("")).alias("full"), F.col("content").alias("encoded"), F.col("author.name").alias("author"), time.alias("published_at"), F.transform("category", lambda c: c["_term"]).alias("tags"))


def read_feed(spark: SparkSession, path: str, name: str, source: str = "rss", include: str | None = None, exclude: str | None = None, atom: bool = False) -> DataFrame:
    """Items of a feed's XML (RSS, or Atom); see ``feed_items``."""
    rows = spark.read.schema(ATOM if atom else FEED).format("xml").option("rowTag", "entry" if atom else "item").load(path)
    return feed_items(rows, name, source, include, exclude, atom)


def feed_items(rows: DataFrame, name: str, source: str = "rss", include: str | None = None, exclude: str | None = None, atom: bool = False) -> DataFrame:
    """Items of a feed's entries; title patterns keep or drop entries; content is the long text, or a description of 80 characters or more."""
    entries = _atom(rows) if atom else _rss(rows)
    full, encoded = html_to_text("full"), html_to_text("encoded")
    if source == "zhihu":
        full, encoded = strip_footer(full), strip_footer(encoded)
    out = entries.select(one_line(html_to_text("title")).alias("title"), F.trim(F.coalesce("link", F.lit(""))).alias("url"), full.alias("full"), encoded.alias("encoded"), "author", "published_at", "tags")
    out = out.where((F.col("title") != "") | (F.col("url") != "")).where(~is_activity(F.lit(source), "title", F.lit(name)))
    if exclude:
        out = out.where(~F.col("title").rlike(exclude))
    if include:
        out = out.where(F.concat_ws("\n", "title", "full").rlike(include))
    content = F.when(F.char_length("encoded") > 80, F.col("encoded")).when(F.char_length("full") >= 80, F.col("full"))
    return out.select(
        F.lit(source).alias("source"), F.lit("article").alias("kind"), F.coalesce(F.nullif("title", F.lit("")), "url").alias("title"), F.coalesce(F.nullif("url", F.lit("")), F.concat(F.lit(f"urn:rss:{name}:"), "title")).alias("url"),
        F.nullif(F.left("full", F.lit(500)), F.lit("")).alias("summary"), content.alias("content"), F.coalesce("author", F.lit(name)).alias("author"), "published_at", F.lit(name).alias("collector"), "tags",
    )


NOTE = (
    "note_id string, id string, title string, desc string, summary string, time string, last_update_time string, nickname string, author string, user_id string, creator_hash string, "
    "liked_count string, heat string, note_url string, url string, tag_list string, tags string, user struct<nickname:string,user_id:string>, interact_info struct<liked_count:string>"
)


def read_creator(spark: SparkSession, path: str, name: str, multiline: bool = False) -> DataFrame:
    """Items of a creator's notes, as JSON lines or (``multiline``) an array."""
    return creator_items(spark.read.schema(NOTE).option("multiLine", multiline).json(path), name)


def creator_items(r: DataFrame, name: str) -> DataFrame:
    """Items of notes, flat or nested: of each field the first that isn't empty; a note without title and link is none."""
    first = lambda *cols: strip(F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cols], F.lit("")))
    some = lambda c: F.nullif(c, F.lit(""))
    note, link = first("note_id", "id"), first("note_url", "url")
    out = r.withColumn("t", first("title", "desc")).withColumn("l", F.when((link == "") & (note != ""), F.concat(F.lit("https://www.xiaohongshu.com/explore/"), note)).otherwise(link))
    liked = F.replace(first("liked_count", "interact_info.liked_count", "heat"), F.lit(","), F.lit(""))
    tags = F.coalesce(some(F.col("tag_list")), some(F.col("tags")))
    listed = F.filter(F.transform(F.from_json(tags, "array<string>"), strip), lambda t: t != "")
    return out.where("t <> '' or l <> ''").select(
        F.lit("xiaohongshu").alias("source"), F.lit("post").alias("kind"), F.coalesce(some(F.col("t")), "l").alias("title"), F.coalesce(some(F.col("l")), F.concat(F.lit(f"urn:xhs:{name}:"), "t")).alias("url"),
        some(F.left(first("desc", "summary"), F.lit(500))).alias("summary"), some(first("nickname", "user.nickname", "author")).alias("author"), some(first("user_id", "creator_hash", "user.user_id")).alias("author_id"),
        parse_epoch(first("time", "last_update_time"), 1e11).alias("published_at"), F.when(liked.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), liked.try_cast("double")).alias("heat"),
        F.when(tags.startswith("["), listed).otherwise(split_tags(tags)).alias("tags"), F.lit(name).alias("collector"),
    )


ARTICLE = "code int, data struct<title:string,content:string,content_text:string>, title string, content string, content_text string"
#: What one entry of a dump is, by kind of dump.
ENTRY = {"board": _BOARD_ENTRY, "feed": FEED, "atom": ATOM, "notes": NOTE, "article": ARTICLE}


def read_article_api(spark: SparkSession, path: str) -> DataFrame:
    return article_items(spark.read.schema(ARTICLE).option("multiLine", True).json(path))


def article_items(r: DataFrame) -> DataFrame:
    """Articles of API answers whose code is a success; fields stand under data or at the root."""
    r = r.where(F.col("code").isNull() | F.col("code").isin(20000, 200))
    of = lambda f: F.when(F.col("data").isNotNull(), F.col(f"data.{f}")).otherwise(F.col(f))
    body = F.coalesce(F.nullif(of("content"), F.lit("")), of("content_text"), F.lit(""))
    return r.select(F.nullif(strip(of("title")), F.lit("")).alias("title"), F.when(body.contains("<"), html_to_text(body)).otherwise(normalize_paragraphs(body)).alias("text"))


def video_items(catalog: DataFrame) -> DataFrame:
    """Video items of a catalog (pos, bvid, title, cover, tags), each bvid once, in order."""
    first = catalog.withColumn("k", F.row_number().over(Window.partitionBy("bvid").orderBy("pos"))).where("k = 1")
    image = F.array(F.struct(F.col("cover").alias("url"), F.lit("").alias("alt"), F.lit("cover").alias("role")))
    return first.select("pos", F.lit("bilibili").alias("source"), F.lit("video").alias("kind"), "title", F.concat(F.lit("https://www.bilibili.com/video/"), "bvid").alias("url"), F.when(F.coalesce("cover", F.lit("")) != "", image).otherwise(F.array().cast("array<struct<url:string,alt:string,role:string>>")).alias("images"), split_tags("tags").alias("tags"))


def find_videos(items: DataFrame, tokens: DataFrame) -> DataFrame:
    """Videos whose link holds one of ``tokens`` (token), matched on the token cut out of the link."""
    own = items.where(F.col("kind") == "video").withColumn("token", F.regexp_extract("url", r"(BV[0-9A-Za-z]+)", 1))
    return own.join(tokens.distinct(), "token", "left_semi").drop("token")
