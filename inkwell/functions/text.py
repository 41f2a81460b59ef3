"""Scalar functions over text, URLs, titles, times and numbers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.fixed import (
    BLANK, BOILERPLATE_BEGINS, BOILERPLATE_HAS, CATEGORIES, DAILY_BACKGROUND, DAILY_COLLECTOR, DAILY_END, DAILY_ENTRY, DAILY_NAME, DAILY_TITLE,
    ESSENTIAL_PARAMS, HOSTS, SOURCE_GUESSES, SOURCES, TITLE_NOISE, TRACKING_EXACT, TRACKING_PREFIXES, WECHAT_FEED,
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mapping(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once for a row, also where ``use`` names it within a lambda.

    Columns that ``use`` needs go in with the value, as a struct: a column's name within a lambda may mean an alias of the same select."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(c: Column | str) -> Column:
    """Without white space of any script at both ends."""
    return let(col(c), lambda t: F.when(F.concat(F.left(t, F.lit(1)), F.right(t, F.lit(1))).rlike(r"(?U)\s"), F.regexp_replace(t, r"(?U)^\s+|\s+$", "")).otherwise(t))


def _decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def _encode(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def normalize_url(url: Column | str) -> Column:
    """One form for all variants of a link: https, known host, no tracking parameters, sorted query, no fragment or port."""
    u = strip(F.coalesce(col(url), F.lit("")))
    u = F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).otherwise(u)
    rest = F.regexp_replace(u, r"(?i)^https?://", "")
    named = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"^.*@", ""), r":\d*$", ""))
    host = F.coalesce(mapping(HOSTS)[named], named)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    path = F.when(F.char_length(path) > 1, F.regexp_replace(path, "/+$", "")).otherwise(F.lit("/"))
    pairs = F.transform(F.filter(F.split(F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: p.rlike("^[^=]*=.")), lambda p: F.struct(_decode(F.substring_index(p, "=", 1)).alias("k"), _decode(F.regexp_replace(p, "^[^=]*=", "")).alias("v")))
    essential = F.create_map(*[x for h, ps in ESSENTIAL_PARAMS.items() for x in (F.lit(h), F.array(*map(F.lit, ps)).cast("array<string>"))])[host]

    def keep(p: Column) -> Column:
        name = F.lower(p["k"])
        noise = name.isin(*TRACKING_EXACT) | name.rlike("^(" + "|".join(TRACKING_PREFIXES) + ")")
        return F.when(essential.isNotNull(), F.array_contains(essential, name)).otherwise(~noise)

    kept = F.transform(F.array_sort(F.filter(pairs, keep)), lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"])))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(F.coalesce(col(url), F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit("https://"), host, path, query))


def normalize_title(title: Column | str) -> Column:
    """Only the characters that carry content, in lower case and without a leading place number."""
    t = F.lower(strip(F.coalesce(col(title), F.lit(""))))
    t = F.regexp_replace(F.regexp_replace(t, r"^\d+[.、]\s*", ""), "[​-‏﻿]", "")
    return F.regexp_replace(t, TITLE_NOISE, "")


def content_hash(source: Column | str, url: Column | str, title: Column | str) -> Column:
    """The identity of an item: 32 hex digits of its source and normalised link, or title where there is no link."""
    link = normalize_url(url)
    basis = F.when(link != "", F.concat_ws("|", col(source), F.lit("url"), link)).otherwise(F.concat_ws("|", col(source), F.lit("title"), normalize_title(title)))
    return F.substring(F.sha2(basis, 256), 1, 32)


def to_utc(published: Column | str, zone: str = "Asia/Shanghai") -> Column:
    """A time without a zone is local time of the publisher."""
    return F.to_utc_timestamp(col(published), zone)


def event_time(published: Column | str, fetched: Column | str) -> Column:
    return F.coalesce(col(published), col(fetched))


def local_day(t: Column | str, zone: str = "Asia/Shanghai") -> Column:
    return F.to_date(F.from_utc_timestamp(col(t), zone))


def dateline(t: Column | str, as_of: Column, zone: str = "Asia/Shanghai") -> Column:
    """Today and yesterday to the minute, earlier days as a date."""
    local = F.from_utc_timestamp(col(t), zone)
    days = F.datediff(local_day(as_of, zone), F.to_date(local))
    return F.when(col(t).isNull(), "").when(days == 0, F.concat(F.lit("今天 "), F.date_format(local, "HH:mm"))).when(days == 1, F.concat(F.lit("昨天 "), F.date_format(local, "HH:mm"))).otherwise(F.concat(F.year(local), F.lit("年"), F.month(local), F.lit("月"), F.dayofmonth(local), F.lit("日")))


def parse_heat(raw: Column | str) -> Column:
    """Numbers with thousands separators and the units 万 (1e4) and 亿 (1e8); null for anything else."""
    s = F.replace(strip(col(raw).cast("string")), F.lit(","), F.lit(""))
    number = F.regexp_extract(s, r"^([\d.]+)\s*([万亿])?$", 1).try_cast("double")
    unit = F.regexp_extract(s, r"^([\d.]+)\s*([万亿])?$", 2)
    return F.coalesce(number * F.when(unit == "万", 1e4).when(unit == "亿", 1e8).otherwise(1.0), F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("double")))


def format_heat(heat: Column | str) -> Column:
    h = col(heat)
    return F.when(h.isNull(), "-").when(h >= 1e8, F.format_string("%.1f亿", h / 1e8)).when(h >= 1e4, F.format_string("%.1f万", h / 1e4)).otherwise(F.format_string("%.0f", h))


def parse_epoch(raw: Column | str, milliseconds_from: float = 1e12) -> Column:
    """Seconds, milliseconds or microseconds since 1970, or an ISO time, as UTC; null outside 1970 to 2100."""
    s = strip(col(raw).cast("string"))
    n = F.when(s.rlike(r"^\d+(\.\d+)?$"), s.try_cast("double"))
    seconds = F.when(n > 1e14, n / 1e6).when(n > milliseconds_from, n / 1e3).otherwise(n)
    by_number = F.when(seconds.between(0, 4102444800), F.timestamp_micros(F.round(seconds * 1e6).cast("long")))
    by_text = F.try_to_timestamp(F.regexp_replace(s, "Z$", "+00:00"))
    return F.when(n.isNotNull(), by_number).otherwise(F.when(F.year(by_text).between(1970, 2100), by_text))


def split_tags(raw: Column | str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(col(raw), F.lit("")), r"[,，、;；#\s]+"), strip), lambda t: t != "")


def slugify(name: Column | str) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(strip(col(name))), r"(?U)[\s/\\]+", "_"), r"(?U)[^\w一-鿿\-]+", "")
    return F.when(s == "", "unnamed").otherwise(s)


def normalize_paragraphs(text: Column | str) -> Column:
    """Runs of blanks become one, lines are trimmed, one empty line at most parts paragraphs."""
    t = F.replace(F.replace(F.coalesce(col(text), F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    t = F.regexp_replace(t, r"(?U)[^\S\n](?:[^\S\n]+|(?<! ))", " ")  # single spaces stay, so most texts are read only
    t = F.replace(F.replace(t, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return strip(t)


def html_to_text(html: Column | str) -> Column:
    """Plain text of markup; block elements end a paragraph."""
    t = F.coalesce(col(html), F.lit(""))
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.regexp_replace(t, r"(?is)<\s*br\s*/?\s*>|<\s*/\s*(?:p|div|h[1-6]|li|tr|blockquote|section|article|ul|ol|table)\s*>", "\n\n")
    return normalize_paragraphs(F.regexp_replace(t, "<[^>]+>", ""))


def one_line(text: Column | str) -> Column:
    return strip(F.regexp_replace(col(text), r"(?U)\s+", " "))


def strip_footer(text: Column | str) -> Column:
    """Without the recommendations at the end: from the last 1500 characters' ``author`` that related articles follow."""

    def of(t: Column, window: Column) -> Column:
        found = F.regexp_instr(window, F.lit(r"(?is)author\s*[:：]?.{0,160}相关文章"))
        return let(found, lambda at: F.when(at > 0, F.regexp_replace(F.left(t, F.char_length(t) - F.char_length(window) + at - 1), r"(?U)\s+$", "")).otherwise(strip(t)))

    return let(F.coalesce(col(text), F.lit("")), lambda t: let(F.right(t, F.lit(1500)), lambda window: of(t, window)))


def char_count(text: Column | str) -> Column:
    """Characters that are not white space."""
    return F.char_length(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"(?U)\s+", ""))


def readable_body(kind, content, summary, source) -> Column:
    """What is printed and scored: content, or else the summary; sources with a footer lose it; a video needs a transcript."""
    raw = F.coalesce(F.nullif(col(content), F.lit("")), col(summary), F.lit(""))
    body = normalize_paragraphs(raw)
    return F.when(col(source) == "zhihu", strip_footer(body)).otherwise(body)


def text_for_embedding(title, content, summary) -> Column:
    return F.concat(F.coalesce(col(title), F.lit("")), F.lit("\n"), F.substring(F.coalesce(F.nullif(col(content), F.lit("")), col(summary), F.lit("")), 1, 2000))


def item_length(content, summary, title) -> Column:
    return F.char_length(F.coalesce(F.nullif(col(content), F.lit("")), F.nullif(col(summary), F.lit("")), col(title), F.lit("")))


def _runs(chars: Column, k: int) -> Column:
    """All runs of k neighbours in an array of characters."""
    last = F.greatest(F.size(chars) - k + 1, F.lit(1))
    return F.transform(F.sequence(F.lit(1), last), lambda i: F.concat(*[F.element_at(chars, i + j) for j in range(k)]))


def tokenize(text: Column | str) -> Column:
    """ASCII words whole, Chinese characters in pairs; segments of other letters give no token."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), r"(?U)[^\w一-鿿]+", " "))

    def of(segment: Column) -> Column:
        pairs = let(F.filter(F.split(segment, ""), lambda c: c.rlike("^[一-鿿]$")), lambda chars: F.when(F.size(chars) > 1, _runs(chars, 2)).otherwise(F.array().cast("array<string>")))
        return F.when(segment.rlike("^[a-z0-9]+$"), F.array(segment)).when(segment.rlike("[一-鿿]"), pairs).otherwise(F.array().cast("array<string>"))

    each = lambda s: F.flatten(F.transform(F.filter(F.split(s, " "), lambda p: p != ""), of))
    return let(plain, lambda s: F.when(s.rlike("[一-鿿]"), each(s)).otherwise(F.regexp_extract_all(s, F.lit(r"(?:^| )([a-z0-9]++)(?= |\z)"), 1)))


def char_ngrams(text: Column | str, sizes: tuple[int, ...] = (2, 3)) -> Column:
    """Character n-grams of the text without white space; a text shorter than n is its own n-gram, an empty one ``_empty_``."""
    s = F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), r"(?U)\s+", "")
    whole = lambda s, k: F.when(F.char_length(s) < k, F.array(s)).otherwise(F.regexp_extract_all(s, F.lit(f"(?s)(?=({'.' * k}))."), 1))
    return let(s, lambda s: F.when(s == "", F.array(F.lit("_empty_"))).otherwise(F.concat(*[whole(s, k) for k in sizes])))


def reading_minutes(markdown: Column | str, per_minute: int = 400) -> Column:
    return F.greatest(F.lit(1), F.bround(F.char_length(F.replace(F.coalesce(col(markdown), F.lit("")), F.lit(" "), F.lit(""))) / per_minute).cast("int"))


def summary_of(markdown: Column | str, limit: int = 120) -> Column:
    t = one_line(F.regexp_replace(F.coalesce(col(markdown), F.lit("")), "[#>*`]", ""))
    return F.when(F.char_length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(F.left(t, F.lit(limit - 1)), r"(?U)\s+$", ""), F.lit("…")))


def first_sentence(text: Column | str, limit: int = 72) -> Column:
    """Up to the first full stop of any kind, in order of kinds, that ends between 8 and ``limit`` characters; else a comma; else cut."""
    t = one_line(F.coalesce(col(text), F.lit("")))
    out = F.when(t == "", "")
    for mark in ("。", "！", "？", ".", "!", "?"):
        at = F.instr(t, mark) - 1
        out = out.when(at.between(8, limit), F.left(t, at + 1))
    for mark in ("，", "、", ",", "；", ";"):
        at = F.instr(t, mark) - 1
        out = out.when(at.between(16, limit), F.concat(F.left(t, at), F.lit("。")))
    return out.otherwise(F.concat(F.regexp_replace(F.left(t, F.lit(limit)), "[…。 ]+$", ""), F.lit("。")))


def article_kind(section, role, markdown) -> Column:
    n = F.char_length(F.coalesce(col(markdown), F.lit("")))
    out = F.when(col(section) == "health", "system_report").when((col(section) == "lede") | (col(role) == "index"), "brief")
    return out.when((col(section) == "critical") & (n >= 2500), "report").when(n < 400, "brief").when(n >= 2500, "long").otherwise("normal")


def source_of(url: Column | str) -> Column:
    """A guess of the source from what a link holds; rss where nothing tells."""
    u, out = F.coalesce(col(url), F.lit("")), F.when(F.lit(False), "")
    for name, parts in SOURCE_GUESSES:
        known = F.lit(False)
        for part in parts:
            known |= F.lower(u).contains(part)
        out = out.when(known | u.contains(WECHAT_FEED) if name == "wechat_mp" else known, name)
    return out.otherwise("rss")


def kind_of(url: Column | str) -> Column:
    return F.when(source_of(url) == "bilibili", "video").otherwise("article")


def category_of(source: Column | str) -> Column:
    return F.coalesce(mapping(CATEGORIES)[col(source)], F.lit("other"))


def format_bytes(n: Column | str) -> Column:
    b = col(n).cast("double")
    return F.when(b < 1024, F.format_string("%.0f B", b)).when(b < 1024**2, F.format_string("%.1f KB", b / 1024)).when(b < 1024**3, F.format_string("%.1f MB", b / 1024**2)).otherwise(F.format_string("%.1f GB", b / 1024**3))


def byline(line: Column | str, sources: tuple[str, ...] = SOURCES) -> Column:
    """(published_label, source_type, source_name) of parts that dots part: the first date, the first source, and all that is left."""
    parts = F.filter(F.transform(F.split(F.coalesce(col(line), F.lit("")), "·"), strip), lambda p: p != "")
    dated = lambda p: p.rlike(r"^(今天|昨天|\d{4}年)")
    label = F.coalesce(F.get(F.filter(parts, dated), F.lit(0)), F.lit(""))
    kind = F.coalesce(F.get(F.filter(parts, lambda p: F.lower(p).isin(*sources) & ~dated(p)), F.lit(0)), F.lit(""))
    own = lambda p, i: (i + 1 == F.array_position(parts, label)) | (i + 1 == F.array_position(parts, kind))
    names = F.filter(parts, lambda p, i: ~own(p, i) & (p != "总分") & ~p.startswith("sim ") & ~p.contains("挑战了"))
    return F.struct(label.alias("published_label"), F.lower(kind).alias("source_type"), F.array_join(names, " ").alias("source_name"))


def is_activity(source, title, collector) -> Column:
    """Entries of a timeline that only say somebody approved or followed something."""
    return (col(source) == "zhihu") & (F.coalesce(col(title), F.lit("")).rlike("赞同了(回答|想法|文章)?|关注了|喜欢了") | F.coalesce(col(collector), F.lit("")).endswith("_动态"))


def is_daily(source, title, collector) -> Column:
    """The daily digest of an institution, not a text of one author."""
    own = (col(source) == "zhihu") & one_line(html_to_text(title)).contains(DAILY_TITLE)
    return F.coalesce(col(collector), F.lit("")).contains(DAILY_COLLECTOR) | F.coalesce(own, F.lit(False))


def display_title(source, title, collector) -> Column:
    """The title in print: one line of plain text; the daily digest has a name of its own."""
    return F.when(is_daily(source, title, collector), DAILY_NAME).otherwise(one_line(html_to_text(title)))


def expand_daily_title(title, body) -> Column:
    """The questions that a digest answers, eight at most, from its body; its own title where there are fewer than two."""
    region = F.substring_index(F.coalesce(col(body), F.lit("")), DAILY_END, 1)
    found = F.transform(F.regexp_extract_all(region, F.lit(DAILY_ENTRY), 1), strip)
    found = F.filter(found, lambda h: ~h.contains(DAILY_END) & ~h.startswith(DAILY_BACKGROUND))
    heads = F.filter(F.transform(found, lambda h: strip(F.regexp_extract(h, rf"(?s)^(.*?)(?:\s*{DAILY_BACKGROUND}|$)", 1))), lambda h: F.char_length(h) >= 8)
    own = F.struct(heads.alias("heads"), col(title).alias("title"))
    return let(own, lambda v: F.when(F.size(v["heads"]) >= 2, F.array_join(F.slice(v["heads"], 1, 8), "；")).otherwise(v["title"]))


def newspaper_body(kind, content, summary, source, title, collector) -> Column:
    """The body in print: a daily digest's begins with its catalog."""
    own = F.struct(readable_body(kind, content, summary, source).alias("body"), is_daily(source, title, collector).alias("daily"), one_line(html_to_text(title)).alias("title"))
    return let(own, lambda v: F.when(v["daily"], with_catalog(expand_daily_title(v["title"], v["body"]), v["body"])).otherwise(v["body"]))


def with_catalog(catalog: Column | str, body: Column | str) -> Column:
    """A daily digest in print: its catalog, if there is one, and its body."""
    lead = lambda v: F.concat(F.lit("**"), v["catalog"], F.lit("**"))
    of = lambda v: F.when(v["catalog"] == "", v["body"]).when(v["body"] == "", lead(v)).otherwise(F.concat(lead(v), F.lit("\n\n"), v["body"]))
    return let(F.struct(col(catalog).alias("catalog"), col(body).alias("body")), of)


def title_longer_than_body(source, title, collector, body) -> Column:
    """Advertisements have all of their text in the title, as it's printed."""
    return char_count(display_title(source, title, collector)) > char_count(body)


def trim_boilerplate(markdown: Column | str) -> Column:
    """All lines before the first that is a disclaimer or an offer."""
    lines = F.split(F.regexp_replace(F.coalesce(col(markdown), F.lit("")), r"\r\n?", "\n"), "\n")
    plain = F.transform(lines, strip)
    ends = F.transform(plain, lambda s: s.startswith(BOILERPLATE_BEGINS[0]) | s.startswith(BOILERPLATE_BEGINS[1]) | s.contains(BOILERPLATE_HAS))
    at = F.array_position(ends, True)
    return strip(F.array_join(F.when(at > 0, F.slice(lines, F.lit(1), at.cast("int") - 1)).otherwise(lines), "\n"))


def first_paragraph(markdown: Column | str, limit: int = 140) -> Column:
    """The first lines of plain text up to a blank line or ``limit`` characters, as one line; headings, quotes and images are passed over."""
    lines = F.transform(F.split(F.regexp_replace(F.coalesce(col(markdown), F.lit("")), r"\r\n?", "\n"), "\n"), strip)
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"), F.lit(False).alias("over"))

    def step(s: Column, line: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(line, r"\[([^\]]+)\]\([^)]+\)", "$1"), r"\*", "")
        skipped = s["over"] | line.startswith("#") | line.startswith(">") | line.startswith("![")
        added = F.struct(F.concat(s["text"], F.lit(" "), bare).alias("text"), (s["n"] + F.char_length(bare)).alias("n"), (s["n"] + F.char_length(bare) >= limit).alias("over"))
        blank = F.struct(s["text"].alias("text"), s["n"].alias("n"), (s["over"] | (s["text"] != "")).alias("over"))
        return F.when(line == "", blank).when(skipped, s).otherwise(added)

    text = one_line(F.aggregate(lines, start, step, lambda s: s["text"]))
    return F.when(F.char_length(text) > limit, F.concat(F.left(text, F.lit(limit - 1)), F.lit("…"))).otherwise(text)


def item_slug(title: Column | str, content_hash: Column | str, n: Column | None = None) -> Column:
    """A file name for an item: word characters and hyphens of its title's beginning, or its key's, after its number."""
    raw = F.left(F.coalesce(F.nullif(col(title), F.lit("")), col(content_hash)), F.lit(40))
    own = F.regexp_replace(F.replace(raw, F.lit(" "), F.lit("-")), r"(?U)[^\w一-鿿\-]+", "")
    slug = F.when(own == "", F.left(col(content_hash), F.lit(8))).otherwise(own)
    return slug if n is None else F.concat(F.lpad(n.cast("string"), 2, "0"), F.lit("-"), slug)


def is_stub(content: Column | str, summary: Column | str, most: int = 500) -> Column:
    """Content that is its summary or a beginning of it, or was cut at ``most`` characters."""
    c, s = strip(F.coalesce(col(content), F.lit(""))), strip(F.coalesce(col(summary), F.lit("")))
    of = lambda v: v["n"].between(1, most) & (((v["s"] != "") & v["s"].startswith(v["c"])) | (v["n"] == most))
    return let(let(F.struct(c.alias("c"), s.alias("s")), lambda v: F.struct(F.char_length(v["c"]).alias("n"), v["c"].alias("c"), v["s"].alias("s"))), of)


def longer_text(content: Column | str, summary: Column | str) -> Column:
    """The longer of two bodies, content where they are as long; null where both are blank."""
    c, s = strip(F.coalesce(col(content), F.lit(""))), strip(F.coalesce(col(summary), F.lit("")))
    of = lambda v: F.when((F.char_length(v["c"]) >= F.char_length(v["s"])) & (v["c"] != ""), v["c"]).otherwise(v["s"])
    return F.nullif(let(F.struct(c.alias("c"), s.alias("s")), of), F.lit(""))


def payload_text(payload: Column | str) -> Column:
    """The longest plain text, without a footer, that a landed feed entry (JSON) holds; of equal ones the first."""
    entry = F.from_json(col(payload), "content array<string>, content_encoded string, summary string, description string")
    blobs = let(entry, lambda p: F.concat(F.coalesce(p["content"], F.array().cast("array<string>")), F.array(p["content_encoded"], p["summary"], p["description"])))
    bare = F.transform(F.array_compact(blobs), lambda b: F.when(b.startswith("{"), F.coalesce(F.get_json_object(b, "$.value"), F.lit(""))).otherwise(b))
    texts = F.transform(bare, lambda b, i: let(strip_footer(html_to_text(b)), lambda t: F.struct(F.char_length(t).alias("n"), (-i).alias("i"), t.alias("t"))))
    return F.coalesce(F.array_max(texts)["t"], F.lit(""))


def is_photo_host(url: Column | str, hosts: str) -> Column:
    return F.coalesce(col(url), F.lit("")).rlike(hosts)


def is_printable(width, height, side: int) -> Column:
    """Photos whose shorter side is long enough for print; a size that isn't a number is none."""
    w, h = col(width).try_cast("int"), col(height).try_cast("int")
    return F.coalesce((w >= side) & (h >= side), F.lit(False))


def is_blank(c: Column | str) -> Column:
    return col(c).isNull() | col(c).rlike(BLANK)
