"""Operators over landed pages: snapshots, quality tiers, image candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions.fixed import DECORATION, DECORATION_CLASS, NAVIGATION, PHOTO_HOSTS
from inkwell.functions.text import col, html_to_text, is_photo_host, is_printable, longer_text, normalize_paragraphs

PHOTO_SIDE, MOST_IMAGES = 160, 8


def fresh_snapshots(pages: DataFrame, as_of: str, ttl_hours: int = 24) -> DataFrame:
    """The newest html of each url, by the hash of the url, if it's no older than ``ttl_hours``."""
    own = pages.where(F.col("fetched_at") >= F.lit(as_of).cast("timestamp") - F.expr(f"interval {ttl_hours} hours"))
    return own.groupBy(F.sha2("url", 256).alias("cache_key")).agg(F.max_by("html", F.struct("fetched_at", "html")).alias("html"), F.max("fetched_at").alias("fetched_at"))


def quality_score(text: Column | str, navigation: str = NAVIGATION) -> Column:
    """0 to 1: length, less the density of navigation words, less the share of short lines."""
    body = F.trim(F.coalesce(col(text), F.lit("")))
    n = F.char_length(body)
    lines = F.filter(F.transform(F.split(body, "\n"), F.trim), lambda s: s != "")
    short = F.size(F.filter(lines, lambda s: F.char_length(s) < 8)) / F.greatest(F.size(lines), F.lit(1))
    density = F.regexp_count(body, F.lit(navigation)) / F.greatest(n / 80.0, F.lit(1.0))
    s = F.least(n / 400.0, F.lit(1.0)) - F.least(density * 0.45, F.lit(0.55)) - short * 0.25
    return F.when(n == 0, 0.0).when(n < 80, 0.05).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)))


def tier(length: Column, score: Column, least: int = 200, accept_short: Column | None = None) -> Column:
    short = accept_short if accept_short is not None else F.lit(False)
    return F.when((length >= least) & (score >= 0.35), "full").when((length >= 150) & (score >= 0.25), "partial").when(short & (length >= 80) & (score >= 0.2), "partial").otherwise("meta_only")


def extract(pages: DataFrame, fallback: str | None = None, summary: str | None = None, least: int = 200) -> DataFrame:
    """``pages`` with text, score, tier and outcome.

    Where the page's text isn't enough, the longer of the ``fallback`` and ``summary`` columns takes its place if it has 80
    characters.  outcome: error where a column ``error`` is set, blocked where ``status`` is 401, 403 or 451, ok where the text is
    full or partial, else degraded; ``cached`` marks pages with a column ``from_cache`` that says so."""
    out = pages.withColumn("text", html_to_text("html")).withColumn("score", quality_score("text")).withColumn("tier", tier(F.char_length("text"), F.col("score"), least))
    if fallback or summary:
        own = normalize_paragraphs(longer_text(fallback or F.lit(None).cast("string"), summary or F.lit(None).cast("string")))
        use = (F.col("tier") == "meta_only") & (F.char_length(own) >= 80)
        out = out.withColumn("text", F.when(use, own).otherwise(F.col("text"))).withColumn("score", quality_score("text")).withColumn("tier", tier(F.char_length("text"), F.col("score"), least))
    failed = F.col("error").isNotNull() if "error" in pages.columns else F.lit(False)
    barred = F.coalesce(F.col("status").isin(401, 403, 451), F.lit(False)) if "status" in pages.columns else F.lit(False)
    outcome = F.when(failed, "error").when(barred, "blocked").when(F.col("tier").isin("full", "partial"), "ok").otherwise("degraded")
    cached = F.coalesce(F.col("from_cache"), F.lit(False)) if "from_cache" in pages.columns else F.lit(False)
    return out.withColumn("outcome", outcome).withColumn("cached", cached)


def tier_counts(extracted: DataFrame) -> DataFrame:
    return extracted.groupBy("tier").agg(F.count(F.lit(1)).alias("pages"), F.round(F.avg("score"), 6).alias("mean_score"))


def outcome_counts(extracted: DataFrame, restored: DataFrame | None = None) -> DataFrame:
    """One row: how many pages were ok, degraded, blocked, error and cached, and how many bodies of ``restored`` were restored."""
    one = lambda c: F.count_if(F.col("outcome") == c).alias(c)
    out = extracted.agg(*map(one, ("ok", "degraded", "blocked", "error")), F.count_if("cached").alias("cached"))
    if restored is None:
        return out.withColumn("restored", F.lit(0).cast("long"))
    return out.join(F.broadcast(restored.agg(F.count_if("restored").alias("restored"))))


def _attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*["']([^"']+)["']""", 1)


def prune_images(found: DataFrame, most: int = MOST_IMAGES) -> DataFrame:
    """(page_id, pos, url, role) of ``found`` (page_id, page, at, src, role, tag, w, h): absolute links, no decoration, no small ones,
    each once whatever its size parameters, in order, ``most`` of a page."""
    base = F.regexp_extract("page", r"^(https?://[^/?#]+)", 1)
    url = F.when(F.col("src").startswith("//"), F.concat(F.lit("https:"), "src")).when(F.col("src").startswith("/"), F.concat(base, "src")).otherwise(F.col("src"))
    rows = found.withColumn("url", url).where(F.col("url").startswith("http") & ~F.concat_ws(" ", "url", "tag").rlike(DECORATION))
    rows = rows.where(~_attribute(F.col("tag"), "class").rlike(DECORATION_CLASS))
    sized = F.col("w").try_cast("int").isNotNull() & F.col("h").try_cast("int").isNotNull()
    rows = rows.where(~sized | is_printable("w", "h", PHOTO_SIDE))
    plain = F.regexp_replace(F.regexp_replace("url", r"[?&](w|h|width|height|size|quality|q)=[^&#]*", ""), "#.*$", "")
    first = rows.withColumn("canon", plain).withColumn("k", F.row_number().over(Window.partitionBy("page_id", "canon").orderBy("at"))).where("k = 1")
    return first.withColumn("pos", F.row_number().over(Window.partitionBy("page_id").orderBy("at"))).where(F.col("pos") <= most).select("page_id", "pos", "url", "role")


def _tags(html: Column) -> Column:
    """Structs (src, role, w, h, tag) of a page's og:image metas, then of its images (lazy sources before src)."""
    def of(tag: Column, src: Column, role: str) -> Column:
        return F.struct(src.alias("src"), F.lit(role).alias("role"), _attribute(tag, "width").alias("w"), _attribute(tag, "height").alias("h"), tag.alias("tag"))

    lazy = lambda t: F.coalesce(F.nullif(_attribute(t, "data-src"), F.lit("")), F.nullif(_attribute(t, "data-original"), F.lit("")), _attribute(t, "src"))
    cover = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)(<meta[^>]*og:image[^>]*>)"), 1), lambda t: of(t, _attribute(t, "content"), "cover"))
    body = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)(<img\b[^>]*>)"), 1), lambda t: of(t, lazy(t), "body"))
    return F.concat(cover, body)


def image_candidates(pages: DataFrame, most: int = MOST_IMAGES) -> DataFrame:
    """(page_id, pos, url, role): og:image first, then img sources (lazy ones before src), pruned."""
    rows = pages.select("page_id", F.col("url").alias("page"), F.posexplode(_tags(F.col("html"))).alias("at", "i")).select("page_id", "page", "at", "i.*")
    return prune_images(rows, most)


def payload_images(payloads: DataFrame, most: int = MOST_IMAGES) -> DataFrame:
    """The same of article APIs' JSON ``payloads`` (page_id, url, payload): the cover, the list of images, then images of its HTML.

    Fields stand under data or at the root; entries of the list are links or objects with one."""
    fields = "image:string,image_uri:string,uri:string,cover:string,images:array<string>,content:string,content_text:string"
    p = F.from_json("payload", f"data struct<{fields}>, {fields.replace(':string', ' string').replace('images:array', 'images array')}")
    get = lambda c: F.when(p["data"].isNotNull(), p["data"][c]).otherwise(p[c])
    web = lambda v: F.when(v.startswith("http"), v)
    link = lambda v: F.when(v.startswith("{"), F.coalesce(*[web(F.get_json_object(v, f"$.{k}")) for k in ("uri", "url", "src", "image")])).otherwise(web(v))
    of = lambda src, role: F.struct(src.alias("src"), F.lit(role).alias("role"), F.lit("").alias("w"), F.lit("").alias("h"), F.lit("").alias("tag"))
    cover = F.filter(F.transform(F.array(*[get(c) for c in ("image", "image_uri", "uri", "cover")]), link), lambda v: v.isNotNull())
    listed = F.coalesce(F.transform(get("images"), lambda v: of(link(v), "body")), F.array().cast("array<struct<src:string,role:string,w:string,h:string,tag:string>>"))
    html = F.coalesce(F.nullif(get("content"), F.lit("")), get("content_text"), F.lit(""))
    found = F.concat(F.transform(F.slice(cover, 1, 1), lambda v: of(v, "cover")), listed, F.filter(_tags(html), lambda t: t["role"] == "body"))
    rows = payloads.select("page_id", F.col("url").alias("page"), F.posexplode(found).alias("at", "i")).select("page_id", "page", "at", "i.*")
    return prune_images(rows, most)


def feed_images(entries: DataFrame, most: int = MOST_IMAGES) -> DataFrame:
    """The same of feed entries ``entries`` (page_id, url, html), for hosts whose articles come with photos."""
    return image_candidates(entries.where(is_photo_host("url", PHOTO_HOSTS)), most)


def pick_images(candidates: DataFrame, most: int = 3) -> DataFrame:
    """Covers first, three in all, or two where there's no cover."""
    w = Window.partitionBy("page_id")
    cover = F.max((F.col("role") == "cover").cast("int")).over(w)
    n = F.row_number().over(w.orderBy((F.col("role") == "cover").desc(), "pos"))
    return candidates.withColumn("cover", cover).withColumn("n", n).where(F.col("n") <= F.when(F.col("cover") == 1, most).otherwise(most - 1)).select("page_id", "n", "url", "role")


def choose_images(candidates: DataFrame, articles: DataFrame, scorer: Callable[[pd.DataFrame], list] | None = None, most: int = 3, rows: int = 64) -> DataFrame:
    """(page_id, n, url, role, caption): the photos that ``scorer`` keeps of each page's candidates (page_id, pos, url, role), else those of ``pick_images``.

    The scorer gets frames of at most ``rows`` pages (page_id, title, body, photos: a list of (url, role)) and answers for each with
    ``{"keep": [places from 0], "captions": [texts]}``.  Places that don't exist are skipped, an empty list keeps nothing, captions are
    cut at 24 characters; an answer without a list falls back.  Where a call fails its pages are asked one by one, and only those
    that fail again fall back.  ``articles`` (page_id, title, body) are the pages' texts; page ids are distinct, a page without candidates has no photo."""
    photos = candidates.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "url", "role"))).alias("p")).select("page_id", F.transform("p", lambda x: F.struct(x["url"].alias("url"), x["role"].alias("role"))).alias("photos"))
    own = photos.join(articles.select("page_id", "title", "body").hint("merge"), "page_id", "left").select("page_id", "title", "body", "photos")
    kind = f"page_id {dict(own.dtypes)['page_id']}, photos {dict(own.dtypes)['photos']}, keep array<int>, captions array<string>"

    def ask(frame: pd.DataFrame) -> list:
        try:
            out = list(scorer(frame))
            if len(out) != len(frame):
                raise ValueError("an answer for each page is needed")
            return out
        except Exception:
            return [None] if len(frame) == 1 else [ask(frame.iloc[i : i + 1])[0] for i in range(len(frame))]

    def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), rows):
                part = frame.iloc[at : at + rows]
                checked = [_kept(a, len(p), most) for a, p in zip(ask(part), part["photos"], strict=True)]
                yield pd.DataFrame({"page_id": part["page_id"].to_numpy(), "photos": part["photos"].to_numpy(), "keep": [c and c[0] for c in checked], "captions": [c and c[1] for c in checked]})

    asked = own.mapInPandas(answer, kind) if scorer else own.withColumn("keep", F.lit(None).cast("array<int>")).withColumn("captions", F.lit(None).cast("array<string>"))
    cover = lambda p: p["role"] == "cover"
    of = lambda p, caption: F.struct(p["url"].alias("url"), p["role"].alias("role"), caption.alias("caption"))
    plain = F.concat(F.filter("photos", cover), F.filter("photos", lambda p: ~cover(p)))
    plain = F.transform(F.slice(plain, 1, F.when(F.exists("photos", cover), most).otherwise(most - 1)), lambda p: of(p, F.lit(None).cast("string")))
    chosen = F.transform("keep", lambda k, i: of(F.get("photos", k), F.get("captions", i)))
    return asked.select("page_id", F.posexplode(F.coalesce(chosen, plain)).alias("n", "p")).select("page_id", (F.col("n") + 1).alias("n"), "p.*")


def _kept(answer, photos: int, most: int) -> tuple[list[int], list[str | None]] | None:
    """(places, captions) of an answer, or None where it has no list."""
    keep = answer.get("keep") if isinstance(answer, dict) else None
    if not isinstance(keep, list):
        return None
    said = answer.get("captions") if isinstance(answer.get("captions"), list) else []
    places, captions = [], []
    for j, k in enumerate(keep):
        try:
            k = int(k)
        except (TypeError, ValueError):
            continue
        if 0 <= k < photos and len(places) < most:
            places.append(k)
            captions.append(str(said[j])[:24] if j < len(said) and said[j] else None)
    return places, captions
