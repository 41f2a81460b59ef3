"""Assembly of editions: roll-ups, title joins, client rows and section texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions.fixed import (
    DIGEST_FAILED, DIGEST_GAPS, DIGEST_ISSUE, DIGEST_MADE, DIGEST_PARTS, DIGEST_TITLE, EDITION_NAMES, HEALTH_BAD, HEALTH_GOOD, ITEM_LINK, ITEM_NO_BODY, ITEM_NO_DATE, ITEM_VIDEO, LEDE_EMPTY, LEDE_LABELS, LEDE_MORE, ORAL_INTRO, PRINT_LINK,
    PRINT_NO_BODY, PRINT_RELATED, PRINT_VIDEO, SECTION_EMPTY, SECTION_INTROS, SECTION_ORDER, SECTION_PRIORITY, SECTION_TITLES,
)
from inkwell.functions.text import article_kind, display_title, first_sentence, format_heat, is_blank, mapping, newspaper_body, reading_minutes, summary_of
from inkwell.operators.titles import match_titles


def roll_up(sections: DataFrame) -> DataFrame:
    """(edition_id, status): sections (edition_id, has_content, error): nothing printed is failed, any error partial, else ok."""
    out = sections.groupBy("edition_id").agg(F.bool_or("has_content").alias("__any"), F.count_if(F.col("error").isNotNull()).alias("errors"))
    return out.select("edition_id", "errors", F.when(~F.col("__any"), "failed").when(F.col("errors") > 0, "partial").otherwise("ok").alias("status"))


def used_hashes(rows: DataFrame) -> DataFrame:
    """(edition_id, content_hash, seq): each hash once, where it comes first."""
    return rows.groupBy("edition_id", "content_hash").agg(F.min("seq").alias("seq"))


def latest_edition(editions: DataFrame) -> DataFrame:
    """The greatest edition id; ids that begin with an underscore are drafts."""
    return editions.where(~F.col("edition_id").startswith("_")).agg(F.max("edition_id").alias("latest"))


def feedback_by_number(feedback: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feedback (edition_id, n, label) as (content_hash, edition_id, label), and what no manifest row answers."""
    keys = ["edition_id", "n"]
    known = manifest.select(*keys, "content_hash").hint("merge")
    return feedback.join(known, keys).select("content_hash", "edition_id", "label"), feedback.join(known.select(*keys), keys, "left_anti")


def union_images(first: DataFrame, second: DataFrame, most: int = 8) -> DataFrame:
    """(content_hash, urls): images of two tables (content_hash, images array<string>), each once, in order."""
    rows = first.select("content_hash", F.lit(0).alias("o"), F.posexplode("images").alias("p", "url")).unionByName(second.select("content_hash", F.lit(1).alias("o"), F.posexplode("images").alias("p", "url")))
    once = rows.groupBy("content_hash", "url").agg(F.min(F.struct("o", "p")).alias("at"))
    return once.withColumn("k", F.row_number().over(Window.partitionBy("content_hash").orderBy("at"))).where(F.col("k") <= most).groupBy("content_hash").agg(F.array_sort(F.collect_list(F.struct("k", "url"))).alias("x")).select("content_hash", F.col("x.url").alias("urls"))


def client_articles(articles: DataFrame) -> DataFrame:
    """Rows for readers: kind, summary and reading time beside each article."""
    return articles.select("edition_id", "id", "title", "section", article_kind("section", "role", "markdown").alias("kind"), summary_of("markdown").alias("summary"), reading_minutes("markdown").alias("reading_minutes"), "priority")


def client_editions(rows: DataFrame) -> DataFrame:
    """One row for each edition with its articles in order of priority, and whether it's the latest.

    An edition holds what ``cap_stories`` lets in, so its array is bounded."""
    cards = F.array_sort(F.collect_list(F.struct((-F.col("priority")).alias("__o"), "id", "title", "section", "kind", "summary", "reading_minutes")))
    out = rows.groupBy("edition_id").agg(cards.alias("a"))
    newest = latest_edition(out.select("edition_id"))
    return out.join(F.broadcast(newest)).select("edition_id", F.transform("a", lambda x: x.dropFields("__o")).alias("articles"), (F.col("edition_id") == F.col("latest")).alias("latest"))


def edition_index(editions: DataFrame) -> DataFrame:
    """(edition_id, latest) of all editions but drafts."""
    own = editions.where(~F.col("edition_id").startswith("_")).select("edition_id").distinct()
    newest = own.agg(F.max("edition_id").alias("latest"))
    return own.join(F.broadcast(newest)).select("edition_id", (F.col("edition_id") == F.col("latest")).alias("latest"))


def print_articles(articles: DataFrame, ranking: DataFrame | None = None) -> DataFrame:
    """The print contract: (edition_id, id, title, markdown, images, priority, kind, metadata) of every article of an edition.

    ``articles`` (edition_id, id, section, role, title, markdown, images, source, pos, pages): ids are the edition's kind (its last two
    letters, pm or else am) and the place over the edition, which falls in order of sections, then pos, then id.  The score is that of
    the ranked title that matches (``match_titles``), else 0.2."""
    order = mapping({s: i for i, s in enumerate(SECTION_PRIORITY)})[F.col("section")]
    seq = F.row_number().over(Window.partitionBy("edition_id").orderBy(F.coalesce(order, F.lit(90)), "pos", "id"))
    out = articles.withColumn("seq", seq)
    if ranking is not None:
        out = out.join(match_titles(articles.select("id", "title"), ranking).select("id", F.col("score").alias("ranking_score")).hint("merge"), "id")
    else:
        out = out.withColumn("ranking_score", F.lit(0.2))
    base = F.coalesce(mapping(SECTION_PRIORITY)[F.col("section")], F.lit(0.5))
    kind = F.when(F.col("edition_id").endswith("pm"), "pm").otherwise("am")
    body = F.regexp_replace(F.coalesce("markdown", F.lit("")), r"(?U)^\s+|\s+$", "")
    return out.select(
        "edition_id", F.concat(kind, F.lpad(F.col("seq").cast("string"), 2, "0")).alias("id"), "title", body.alias("markdown"), "images", F.round(base - F.col("seq") * 0.001, 4).alias("priority"),
        article_kind("section", "role", body).alias("kind"), F.struct("section", "source", "ranking_score").alias("metadata"),
    )


def item_text(level: int = 2, already: str | None = None, images: str | None = None) -> Column:
    """One item as a text to be read offline; columns: kind, title, source, author, collector, content, summary, url, dateline.

    ``already`` names a column that says where the item is printed in full; ``images`` one with its image lines."""
    body = newspaper_body("kind", "content", "summary", "source", "title", "collector")
    byline = F.concat_ws(" · ", F.coalesce(F.nullif("dateline", F.lit("")), F.lit(ITEM_NO_DATE)), F.nullif("source", F.lit("")), F.nullif("author", F.lit("")))
    link = F.when(F.col("url").startswith("http"), F.concat(F.lit(f"{ITEM_LINK}: `"), "url", F.lit("`\n")))
    block = F.concat(F.nullif(images, F.lit("")), F.lit("\n")) if images else F.lit(None).cast("string")
    full = F.when(body != "", F.concat_ws("\n", block, F.concat(body, F.lit("\n")))).when(F.col("kind") == "video", F.lit(f"{ITEM_VIDEO}\n")).otherwise(F.concat_ws("\n", block, F.lit(f"{ITEM_NO_BODY}\n")))
    if already:
        full = F.when(F.col(already).isNotNull(), F.concat(F.lit("_"), already, F.lit("，此处不重复全文。_\n"))).otherwise(full)
    head = F.concat(F.lit("#" * level + " "), display_title("source", "title", "collector"), F.lit("\n\n> "), byline, F.lit("\n"))
    return F.concat_ws("\n", head, full, link)


def ranked_text(edition: str = "edition_id") -> Column:
    """One ranked item as it's printed: number, title, scores, body, folded reports, link, and how to give feedback.

    Columns: n, total, sim, kind, title, source, collector, content, summary, url, dateline, angle, reason, related array<string>."""
    body = newspaper_body("kind", "content", "summary", "source", "title", "collector")
    scores = F.concat(F.lit("> "), F.format_string("总分 %.3f · sim %.2f", F.col("total"), F.col("sim")))
    angle = F.when(F.coalesce("angle", F.lit("")) != "", F.concat(F.lit("> 挑战了: "), "angle", F.lit(" — "), F.coalesce("reason", F.lit(""))))
    date = F.when(F.coalesce("dateline", F.lit("")) != "", F.concat(F.lit("> "), "dateline"))
    names = F.array_join(F.transform(F.slice("related", 1, 5), lambda t: F.left(t, F.lit(40))), "；")
    hint = F.when(F.col(edition).startswith("ab-"), F.lit("这是 A/B 对照稿,不要打点。")).otherwise(F.format_string("读完再打点: --edition %s --n %d --label 1 有用, --label -1 无用。没读不要标。", F.col(edition), F.col("n")))
    parts = [
        F.concat(F.format_string("## F%02d · ", F.col("n")), display_title("source", "title", "collector"), F.lit("\n")),
        F.concat(F.concat_ws("\n", scores, angle, date), F.lit("\n")),
        F.when(F.col("kind") == "video", F.lit(f"{PRINT_VIDEO}\n")),
        F.concat(F.when(body != "", body).otherwise(F.lit(PRINT_NO_BODY)), F.lit("\n")),
        F.when(F.coalesce(F.size("related"), F.lit(0)) > 0, F.concat(F.lit(PRINT_RELATED), names, F.lit("\n"))),
        F.when(F.col("url").startswith("http"), F.concat(F.lit(f"{PRINT_LINK}: `"), "url", F.lit("`\n"))),
        F.concat(hint, F.lit("\n")),
    ]
    return F.concat_ws("\n", *parts, F.lit("---\n"))


def hot_text() -> Column:
    """One line of the hot list (pos, title, source, dateline, heat), with the platform's own summary under it."""
    date = F.when(F.coalesce("dateline", F.lit("")) != "", F.concat(F.lit(" · "), "dateline")).otherwise(F.lit(""))
    line = F.concat(F.col("pos").cast("string"), F.lit(". **"), "title", F.lit("** · "), "source", date, F.lit(" · 热度 "), format_heat("heat"))
    blurb = F.trim(F.coalesce("summary", F.lit("")))
    return F.concat(F.when(blurb != "", F.concat(line, F.lit("\n   "), blurb)).otherwise(line), F.lit("\n"))


def section_pages(rows: DataFrame, section: str, generated: str, text: Column, notes: tuple[str, ...] = ()) -> DataFrame:
    """(edition_id, text): ``rows`` (edition_id, pos, …) of one section under its heading, in order of pos.

    ``generated`` is the time that the heading names.  Rows of an edition are a bounded list (``cap_stories``, a top-k)."""
    intro = SECTION_INTROS.get(section)
    head = "\n".join(["# " + SECTION_TITLES[section], "", *(f"> {x}" for x in ((intro,) if intro else ()) + notes), f"> 生成于 {generated}", "", ""])
    own = rows.select("edition_id", "pos", text.alias("t")).groupBy("edition_id").agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("a"))
    return own.select("edition_id", F.concat(F.lit(head), F.array_join(F.col("a.t"), "\n")).alias("text"))


def subscription_pages(rows: DataFrame, feeds: DataFrame, generated: str, hours: int = 48) -> DataFrame:
    """(edition_id, text) of the subscription section: counts, the list of feeds, a table of contents, then every item's text.

    ``rows`` (edition_id, pos, already, and what ``item_text`` reads); ``feeds`` (collector, source, kind, weight), the catalog."""
    catalog = feeds.select(F.concat(F.lit("- **"), "collector", F.lit("** · `"), "source", F.lit("` / `"), F.coalesce("kind", F.lit("article")), F.lit("` · weight="), F.coalesce(F.col("weight").cast("string"), F.lit("-"))).alias("line"), "collector")
    listed = catalog.agg(F.array_join(F.array_sort(F.collect_list(F.struct("collector", "line")))["line"], "\n").alias("feeds"), F.count(F.lit(1)).alias("n_feeds"))
    body = newspaper_body("kind", "content", "summary", "source", "title", "collector")
    flag = F.coalesce("already", F.when(body != "", "有正文").otherwise("无正文"))
    line = F.concat(F.col("pos").cast("string"), F.lit(". "), display_title("source", "title", "collector"), F.lit(" · "), "source", F.lit(" · "), flag)
    own = rows.select("edition_id", "pos", line.alias("line"), item_text(already="already").alias("t"), (F.col("already").isNull() & (body != "")).alias("full"))
    own = own.groupBy("edition_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line", "t"))).alias("a"), F.count(F.lit(1)).alias("n"), F.count_if("full").alias("full"))
    head = F.concat(F.lit(f"# {SECTION_TITLES['subscribe']}\n\n> 统计窗口:过去 {hours} 小时(按刊出时间) · 生成于 {generated}\n"), F.format_string("> 订阅源 %d · 本页 %d 条 · 其中 %d 条有正文\n", F.col("n_feeds"), F.col("n"), F.col("full")))
    parts = [head, F.concat(F.lit("## 订阅清单\n\n"), "feeds", F.lit("\n")), F.concat(F.lit("## 目录\n\n"), F.array_join(F.col("a.line"), "\n"), F.lit("\n\n---\n")), F.array_join(F.transform("a", lambda x: F.concat(x["t"], F.lit("\n---\n"))), "\n")]
    return own.join(F.broadcast(listed)).select("edition_id", F.concat_ws("\n", *parts).alias("text"))


def health_page(diagnosed: DataFrame, alerts: DataFrame, backlog: DataFrame, generated: str) -> DataFrame:
    """(text) of the health section: alerts, then failed, idle and dropped collectors, the backlog, and a table of all.

    ``diagnosed`` is the catalog of collectors with their state, ``alerts`` (pos, alert), ``backlog`` (what, n, hours)."""
    rows = diagnosed.select("collector", "state", F.format_string("| `%s` | %d | %d | %d | %d |", "collector", "runs", "ok_runs", "failed_runs", "new_24h").alias("row"))
    one = lambda state, line: F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.when(F.col("state") == state, F.col("collector")))), line))
    bullet = lambda c: F.concat(F.lit("- `"), c, F.lit("`"))
    table = rows.agg(F.concat_ws("\n", F.array_sort(F.collect_list(F.struct("collector", "row")))["row"]).alias("table"), *[one(s, bullet).alias(s) for s in ("never_ok", "idle", "volume_drop")])
    said = alerts.agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("pos", "alert"))), lambda x: F.concat(F.lit("- "), x["alert"]))).alias("alerts"), F.count(F.lit(1)).alias("n"))
    left = backlog.agg(F.concat_ws("\n", F.array_sort(F.collect_list(F.format_string("- %s: %d · %.1fh", F.col("what"), F.col("n"), F.coalesce("hours", F.lit(0.0)))))).alias("left"))
    good = F.when(F.col("n") == 0, HEALTH_GOOD).otherwise(F.concat(F.lit(HEALTH_BAD[0]), F.col("n").cast("string"), F.lit(HEALTH_BAD[1] + "\n\n"), "alerts"))
    part = lambda title, c: F.when(F.col(c) != "", F.concat(F.lit(f"## {title}\n\n"), F.col(c), F.lit("\n")))
    whole = [F.lit(f"# {SECTION_TITLES['health']}\n\n> 生成于 {generated}\n"), F.concat(good, F.lit("\n")), part("采集失败(24h 跑过但全挂)", "never_ok"), part("调度未跑(24h 0 次)", "idle"), part("产出骤降(低于 7 日均值 20%)", "volume_drop"), part("容量", "left"), F.concat(F.lit("## 各网 24h\n\n| collector | runs | ok | fail | new |\n|---|---:|---:|---:|---:|\n"), "table", F.lit("\n"))]
    return table.join(F.broadcast(said)).join(F.broadcast(left)).select(F.concat_ws("\n", *whole).alias("text"))


def oral_pages(rows: DataFrame, editions: DataFrame, generated: str, notes: tuple[str, ...] = ()) -> DataFrame:
    """(edition_id, text) of the oral section for each of ``editions`` (edition_id): every item's text, or that there is none today.

    ``rows`` (edition_id, pos, images, and what ``item_text`` reads), where ``images`` holds the item's image lines, are what
    ``cap_stories`` lets in."""
    head = "\n".join([f"# {SECTION_TITLES['oral']}", "", f"> {ORAL_INTRO} · {generated}", "", *(f"> {x}" for x in notes), *([""] if notes else []), ""])
    own = rows.select("edition_id", "pos", rstrip(item_text(images="images")).alias("t")).groupBy("edition_id").agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("a"))
    body = F.array_join(F.transform("a", lambda x: F.concat(x["t"], F.lit("\n\n---"))), "\n\n")
    out = editions.select("edition_id").distinct().join(own, "edition_id", "left")
    return out.select("edition_id", F.concat(F.lit(head), F.coalesce(body, F.lit(SECTION_EMPTY["oral"])), F.lit("\n")).alias("text"))


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+$", "")


def digest(sections: DataFrame, failures: DataFrame | None = None, generated: str | None = None) -> DataFrame:
    """(edition_id, text): section texts (edition_id, section, text) one after another, in the order of sections.

    With ``generated``, the time that is printed, an edition begins with its name and counts, and with what failed:
    ``failures`` (edition_id, section, error), in the order of sections; parts are ruled off.  Ids that end in am are morning editions."""
    order = mapping({s: i for i, s in enumerate(SECTION_ORDER)})[F.col("section")]
    placed = F.coalesce(order, F.lit(99)).alias("o")
    own = sections.groupBy("edition_id").agg(F.array_sort(F.collect_list(F.struct(placed, "section", "text"))).alias("a"))
    if generated is None:
        return own.select("edition_id", F.array_join(F.col("a.text"), "\n\n").alias("text"))
    if failures is None:
        failures = sections.select("edition_id", "section", F.lit("").alias("error")).limit(0)
    lost = failures.groupBy("edition_id").agg(F.array_sort(F.collect_list(F.struct(placed, "section", F.coalesce("error", F.lit("")).alias("error")))).alias("f"))
    out = own.join(lost, "edition_id", "full").withColumn("f", F.coalesce("f", F.array().cast("array<struct<o:int,section:string,error:string>>")))
    name = F.when(F.col("edition_id").endswith("am"), EDITION_NAMES["am"]).otherwise(EDITION_NAMES["pm"])
    head = F.concat(
        F.lit(f"# {DIGEST_TITLE} · "), name, F.lit(" · "), "edition_id", F.lit(f"\n\n> {DIGEST_ISSUE} `"), "edition_id", F.lit(f"` · {DIGEST_MADE} {generated}\n> {DIGEST_PARTS} "),
        F.when(F.col("a").isNull(), "0").otherwise(F.size("a").cast("string")), F.lit(f" · {DIGEST_FAILED} "), F.size("f").cast("string"),
    )
    failed = F.when(F.size("f") > 0, F.concat(F.lit(f"{DIGEST_GAPS}\n\n"), F.array_join(F.transform("f", lambda x: F.concat(F.lit("- `"), x["section"], F.lit("`: "), x["error"])), "\n"), F.when(F.col("a").isNotNull(), "\n\n---").otherwise("")))
    parts = F.array_join(F.transform("a", lambda x: rstrip(x["text"])), "\n\n---\n\n")
    return out.select("edition_id", F.concat(rstrip(F.concat_ws("\n\n", head, failed, parts)), F.lit("\n")).alias("text"))


def lede(articles: DataFrame, kind: str = "pm", editions: DataFrame | None = None) -> DataFrame:
    """(edition_id, lede): first sentences of three headlines, then three more titles, at most 180 characters.

    ``articles`` (edition_id, id, section, role, seq, title, body); those without a body or a title don't count.  The further titles
    come from the first twenty stories of any section but health that aren't those headlines.  ``editions`` (edition_id) are told
    that they have too little where nothing counts."""
    rows = articles.where(~is_blank("body") & ~is_blank("title"))
    head, pool = F.col("section") == "headline", (F.col("role") == "story") & (F.col("section") != "health")
    nth = lambda flag: F.sum(flag.cast("int")).over(Window.partitionBy("edition_id").orderBy("seq", "id"))
    rows = rows.where(head | pool).withColumn("h", F.when(head, nth(head))).withColumn("p", F.when(pool, nth(pool)))
    rows = rows.withColumn("lead", F.coalesce(F.col("h") <= 3, F.lit(False)))
    rows = rows.withColumn("more", ~F.col("lead") & F.coalesce(F.col("p") <= 20, F.lit(False))).where("lead or more")
    sent = first_sentence("body", 56)
    ended = F.when(sent.rlike("[。！？.!?]$"), sent).otherwise(F.concat(sent, F.lit("。")))
    bit = F.when(sent != "", ended).otherwise(F.concat(F.regexp_replace(F.left("title", F.lit(22)), "。+$", ""), F.lit("。")))
    own = rows.groupBy("edition_id").agg(F.array_sort(F.collect_list(F.when(F.col("lead"), F.struct("seq", "id", bit.alias("t"))))).alias("a"), F.array_sort(F.collect_list(F.when(F.col("more"), F.struct("seq", "id", F.left("title", F.lit(14)).alias("t"))))).alias("b"))
    lead, extra = F.array_join(F.col("a.t"), ""), F.array_join(F.slice(F.col("b.t"), 1, 3), "、")
    full = F.when((F.size("b") > 0) & (F.char_length(lead) < 140), F.concat(F.regexp_replace(lead, "。+$", ""), F.lit(f"。{LEDE_MORE}"), extra, F.lit("。"))).otherwise(lead)
    out = own.select("edition_id", F.left(F.trim(F.concat(F.lit(f"{LEDE_LABELS[kind]}："), full)), F.lit(180)).alias("lede"))
    if editions is None:
        return out
    none = f"{LEDE_EMPTY[0]}{EDITION_NAMES[kind]}{LEDE_EMPTY[1]}"
    return editions.select("edition_id").distinct().join(out, "edition_id", "left").withColumn("lede", F.coalesce("lede", F.lit(none)))


def write_edition(rows: DataFrame, folder: str) -> None:
    """One JSON folder for each edition, written anew where it was there."""
    rows.repartition("edition_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("edition_id").json(folder)
