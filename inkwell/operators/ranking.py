"""Filters, keyword rules, orders, sections and diversification."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions.fixed import BOARD_SOURCES, PHOTO_HOSTS, RANK_KINDS, SECTION_LIMITS, SECTION_ORDER, SECTION_PRIORITY
from inkwell.functions.text import char_count, display_title, event_time, is_activity, is_blank, is_daily, let, mapping, readable_body, title_longer_than_body


def body_of() -> Column:
    return readable_body("kind", "content", "summary", "source")


def top_k(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each group, with their ``place``; a limit in each task comes before the shuffle."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)


def query_items(items: DataFrame, since: str | None = None, kinds=None, sources=None, unused_only: bool = True, limit: int = 5000) -> DataFrame:
    """The newest items under conjunctive filters."""
    if since:
        items = items.where(F.col("fetched_at") >= F.lit(since).cast("timestamp"))
    if kinds:
        items = items.where(F.col("kind").isin(*kinds))
    if sources:
        items = items.where(F.col("source").isin(*sources))
    if unused_only:
        items = items.where(F.col("used_in").isNull())
    return items.orderBy(F.desc("fetched_at"), "content_hash").limit(limit)


def missing_content(items: DataFrame, limit: int = 50) -> DataFrame:
    return items.where(F.col("url").startswith("http") & is_blank("content")).orderBy(F.desc("fetched_at"), "content_hash").limit(limit)


def missing_images(items: DataFrame, limit: int = 50) -> DataFrame:
    """Items of photo hosts whose images were never looked for (null; an empty list was)."""
    return items.where(F.col("url").startswith("http") & F.col("images").isNull() & F.col("url").rlike(PHOTO_HOSTS)).orderBy(F.desc("fetched_at"), "content_hash").limit(limit)


def within_window(items: DataFrame, as_of: str, hours: int) -> DataFrame:
    """Two clocks: fetched within the longer of ``hours`` and 72, published (or else fetched) within ``hours``."""
    now = F.lit(as_of).cast("timestamp")
    return items.where(F.col("fetched_at") >= now - F.expr(f"interval {max(hours, 72)} hours")).where(event_time("published_at", "fetched_at") >= now - F.expr(f"interval {hours} hours"))


def rank_candidates(items: DataFrame, excludes: DataFrame | None = None, least_body: int = 80) -> DataFrame:
    """Articles and posts to be ranked: no boards, no activity entries, no excluded titles, no advertisements, enough body."""
    ok = F.col("kind").isin(*RANK_KINDS) & ~F.col("source").isin(*BOARD_SOURCES) & ~is_activity("source", "title", "collector")
    parts = F.struct(body_of().alias("body"), char_count(display_title("source", "title", "collector")).alias("n"))
    ok &= let(parts, lambda v: (F.char_length(v["body"]) >= least_body) & (v["n"] <= char_count(v["body"])))
    return title_excludes(items.where(ok), excludes) if excludes is not None else items.where(ok)


def viable(ranked: DataFrame, excludes: DataFrame | None = None, score: str = "total", least: float = 0.12) -> DataFrame:
    """Ranked items that reach the absolute score and are still candidates: a weak day has a thin edition."""
    return rank_candidates(ranked.where(F.col(score) >= least), excludes)


def subscription_items(items: DataFrame, feeds: DataFrame, as_of: str, hours: int = 48, excludes: DataFrame | None = None) -> DataFrame:
    """Items of the catalog's ``feeds`` (collector) within both clocks: no videos, no activity entries, no excluded titles, no advertisements."""
    own = within_window(items, as_of, hours).join(feeds.select("collector").distinct(), "collector", "left_semi")
    own = own.where((F.col("kind") != "video") & ~is_activity("source", "title", "collector") & ~title_longer_than_body("source", "title", "collector", body_of()))
    return title_excludes(own, excludes) if excludes is not None else own


def title_excludes(items: DataFrame, excludes: DataFrame) -> DataFrame:
    """Drops items whose title matches their collector's own pattern; ``excludes`` (collector, pattern) is a small catalog."""
    out = items.join(excludes.select("collector", F.col("pattern").alias("__p")), "collector", "left")
    return out.where(F.coalesce(~F.expr("title rlike __p"), F.lit(True))).drop("__p")


def title_includes(items: DataFrame, includes: DataFrame) -> DataFrame:
    """Keeps, for collectors with a pattern, items whose title or summary matches it."""
    out = items.join(includes.select("collector", F.col("pattern").alias("__p")), "collector", "left").withColumn("__t", F.concat_ws("\n", "title", "summary"))
    return out.where(F.coalesce(F.expr("__t rlike __p"), F.lit(True))).drop("__p", "__t")


def round_robin(items: DataFrame, weights: DataFrame, per_collector: int = 5, limit: int = 40) -> DataFrame:
    """Collectors take turns, heavier ones first in each round; each gives those with a body first, newest first."""
    order = [(body_of() != "").desc(), event_time("published_at", "fetched_at").desc(), F.col("content_hash")]
    own = top_k(items, ["collector"], order, per_collector).join(weights, "collector", "left")
    return own.orderBy("place", F.coalesce("weight", F.lit(1.0)).desc(), "collector").limit(limit)


def newest_per_creator(items: DataFrame, as_of: str, hours: int = 48) -> DataFrame:
    order = [(body_of() != "").desc(), event_time("published_at", "fetched_at").desc(), F.col("content_hash")]
    return top_k(within_window(items, as_of, hours), ["collector"], order, 1).drop("place")


def _word(variants: list[str], text: Column) -> Column:
    """The first variant that a text in lower case holds: ASCII ones as whole words, others anywhere."""

    def holds(v: str) -> Column:
        own = v.lower()
        inside = F.contains(text, F.lit(own))  # most texts need no pattern, and the pattern looks for the word's letters first
        return inside & text.rlike(f"{re.escape(own)}(?<![a-z0-9]{re.escape(own)})(?![a-z0-9])") if v.isascii() else inside

    return F.coalesce(*[F.when(holds(v), F.lit(v)) for v in variants if v], F.lit(None).cast("string"))


def keyword_matches(items: DataFrame, groups: list[dict], title: str = "title", body: Column | None = None) -> DataFrame:
    """Adds ``matches`` (group, weight, in_title), heaviest first, and ``keyword`` = total / (total + 2).

    A group (name, must, any, exclude, weight, aliases) matches when no excluded word is there, all of ``must`` are, and, where
    ``must`` is empty, one of ``any``; a hit in the title counts half as much again.  Each text is lowered once and each word looked up once."""
    head = F.lower(F.coalesce(F.col(title), F.lit("")))
    full = F.lower(F.concat(F.coalesce(F.col(title), F.lit("")), F.lit("\n"), F.coalesce(body if body is not None else F.concat_ws(" ", "summary", "content"), F.lit(""))))
    expanded = [{role: [[w, *g.get("aliases", {}).get(w, [])] for w in g.get(role, [])] for role in ("must", "any", "exclude")} for g in groups]
    sought = sorted({tuple(v) for g in expanded for vs in g.values() for v in vs})
    titled = sorted({w for g in expanded for v in [*g["must"], *g["any"]] for w in v})

    def hit(name: str, weight: float):
        return lambda t: F.struct((F.lit(weight) * F.when(t, 1.5).otherwise(1.0)).alias("w"), F.lit(name).alias("group"), t.alias("in_title"))

    def match(f: Column) -> Column:
        word, found = lambda v: f["found"][f"w{sought.index(tuple(v))}"], []
        for g, own in zip(groups, expanded, strict=True):
            must, some = [word(v) for v in own["must"]], [word(v) for v in own["any"]]
            out = F.lit(bool(must or some))
            for v in own["exclude"]:
                out &= word(v).isNull()
            for m in must:
                out &= m.isNotNull()
            if not must and some:
                out &= F.coalesce(*some).isNotNull()
            in_title = F.lit(False)
            for w in [w for v in [*own["must"], *own["any"]] for w in v]:
                used = F.lit(False)
                for h in [*must, *some]:
                    used |= F.coalesce(h == w, F.lit(False))
                in_title |= used & f["titled"][f"w{titled.index(w)}"]
            found.append(F.when(out, let(in_title, hit(g["name"], -float(g.get("weight", 1.0))))))
        return F.array_sort(F.array_compact(F.array(*found)))

    def look_up(v: Column) -> Column:
        none = F.lit(None).cast("string").alias("none")
        found = F.struct(none, *[_word(list(w), v["full"]).alias(f"w{i}") for i, w in enumerate(sought)])
        return F.struct(found.alias("found"), F.struct(none, *[_word([w], v["head"]).isNotNull().alias(f"w{i}") for i, w in enumerate(titled)]).alias("titled"))

    hits = let(let(F.struct(head.alias("head"), full.alias("full")), look_up), match) if groups else F.array().cast("array<struct<w: double, group: string, in_title: boolean>>")
    total = F.aggregate("__m", F.lit(0.0), lambda s, m: s - m["w"])
    out = items.withColumn("__m", hits)
    return out.withColumn("keyword", F.when(F.size("__m") > 0, total / (total + 2.0)).otherwise(0.0)).withColumn("matches", F.transform("__m", lambda m: F.struct(m["group"].alias("group"), (-m["w"]).alias("weight"), m["in_title"].alias("in_title")))).drop("__m")


def heat_order(items: DataFrame, limit: int) -> DataFrame:
    """The order by heat alone."""
    return items.orderBy(F.coalesce("heat", F.lit(0.0)).desc(), F.coalesce("rank", F.lit(999)), F.desc("fetched_at"), "content_hash").limit(limit)


def compare_orders(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two ranked frames (place, content_hash) side by side."""
    return a.select("place", F.col("content_hash").alias("a")).join(b.select("place", F.col("content_hash").alias("b")), "place", "full")


def explore(ranked: DataFrame, slots: int, ratio: float = 0.15, seed: int = 7, group: str = "edition") -> DataFrame:
    """``ranked`` (group, place, content_hash, sim, llm) with some slots given to good items unlike the reader's taste.

    The last max(1, slots * ratio), at most half, of the slots go to items from the tail with sim < 0.55 and llm >= 0.7, in an
    order by seeded hash; what they can't fill the tail fills in order."""
    n = min(max(1, int(slots * ratio)), slots // 2)
    main = ranked.where(F.col("place") <= slots - n).withColumn("via", F.lit("main")).withColumn("__o", F.col("place").cast("string"))
    tail = ranked.where(F.col("place") > slots - n)
    strange = (F.col("sim") < 0.55) & (F.col("llm") >= 0.7)
    chance = F.md5(F.concat(F.col("content_hash"), F.lit(f":{seed}")))
    w = Window.partitionBy(group).orderBy(strange.desc(), F.when(strange, chance), "place")
    picked = tail.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).withColumn("via", F.when(strange, "explore").otherwise("fill"))
    out = main.withColumn("__n", F.lit(0)).unionByName(picked.withColumn("__o", F.lit("")), allowMissingColumns=True)
    w = Window.partitionBy(group).orderBy("__n", "place")
    return out.withColumn("slot", F.row_number().over(w)).select(group, "slot", "content_hash", "via")


def diversify(ranked: DataFrame, slots: int, lam: float = 0.7, group: str = "edition", coarse: int = 150, ties: str | None = None) -> DataFrame:
    """(group, slot, content_hash): picks one after another the item of greatest lam * score - (1 - lam) * closest cosine to those picked.

    Only the best ``coarse`` items of a group come in, so a group's task is small; groups run side by side.  Of equal values the
    first in order of score, then of the column ``ties``, then of key is picked."""
    bounded = top_k(ranked, [group], [F.desc("score"), *([ties] if ties else []), "content_hash"], coarse)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        v = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
        v /= np.linalg.norm(v, axis=1, keepdims=True) + 1e-9
        s, near = pdf["score"].to_numpy(), np.full(len(pdf), -np.inf)
        chosen: list[int] = []
        while len(chosen) < min(slots, len(pdf)):
            value = np.round(lam * s - (1 - lam) * near, 9) if chosen else s.astype(float).copy()
            value[chosen] = -np.inf
            i = int(np.argmax(value))
            chosen.append(i)
            near = np.maximum(near, v @ v[i])
        return pd.DataFrame({group: pdf[group].iloc[chosen].to_numpy(), "slot": range(1, len(chosen) + 1), "content_hash": pdf["content_hash"].iloc[chosen].to_numpy()})

    kind = dict(ranked.dtypes)[group]
    return bounded.groupBy(group).applyInPandas(pick, f"{group} {kind}, slot int, content_hash string")


def split_sections(ranked: DataFrame, group: str = "edition", headline: int = 3, deep: int = 8, critical: int = 3, deep_length: int = 200) -> DataFrame:
    """Headline, deep-read (articles and posts of ``deep_length`` characters) and critical (by critic), each item once.

    ``ranked`` (group, slot, content_hash, kind, length, critic)."""
    w = Window.partitionBy(group)
    rows = ranked.withColumn("__h", F.row_number().over(w.orderBy("slot")) <= headline)
    fits = ~F.col("__h") & F.col("kind").isin(*RANK_KINDS) & (F.col("length") >= deep_length)
    rows = rows.withColumn("__fits", fits).withColumn("__d", F.col("__fits") & (F.sum(F.col("__fits").cast("int")).over(w.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)) <= deep))
    left = ~F.col("__h") & ~F.col("__d")
    rows = rows.withColumn("__left", left).withColumn("__c", F.row_number().over(w.orderBy(F.col("__left").desc(), F.desc("critic"), "slot")) <= critical)
    section = F.when(F.col("__h"), "headline").when(F.col("__d"), "deepread").when(F.col("__left") & F.col("__c"), "critical")
    pos = F.when(F.col("__h") | F.col("__d"), F.col("slot")).otherwise(F.row_number().over(w.orderBy(F.col("__left").desc(), F.desc("critic"), "slot")))
    out = rows.withColumn("section", section).withColumn("pos", pos).where("section is not null")
    return out.withColumn("pos", F.row_number().over(Window.partitionBy(group, "section").orderBy("pos"))).select(group, "section", "pos", "content_hash")


def pin_daily(sections: DataFrame, items: DataFrame, as_of: str, group: str = "edition", deep: int = 8) -> DataFrame:
    """The newest digest of the local day leads the deep-read section of an edition that hasn't placed it; the last one falls out."""
    day = lambda t: F.to_date(F.from_utc_timestamp(t, "Asia/Shanghai"))
    now = F.lit(as_of).cast("timestamp")
    t = event_time("published_at", "fetched_at")
    digest = is_daily("source", "title", "collector")
    pick = items.where(digest & (day(t) == day(now)) & (F.char_length(body_of()) >= 80)).agg(F.max_by("content_hash", F.struct(t, "content_hash")).alias("pin")).where("pin is not null")
    editions = sections.select(group).distinct().join(F.broadcast(pick))
    free = editions.join(sections.select(group, F.col("content_hash").alias("pin")), [group, "pin"], "left_anti")
    added = free.select(group, F.lit("deepread").alias("section"), F.lit(0).alias("pos"), F.col("pin").alias("content_hash"))
    both = sections.unionByName(added)
    both = both.withColumn("pos", F.row_number().over(Window.partitionBy(group, "section").orderBy("pos")))
    return both.where((F.col("section") != "deepread") | (F.col("pos") <= deep))


def cap_stories(articles: DataFrame, group: str = "edition") -> DataFrame:
    """The first stories of each section up to its limit, in order of sections; untitled ones and unknown sections go."""
    limit, order = mapping(SECTION_LIMITS)[F.col("section")], mapping({s: i for i, s in enumerate(SECTION_ORDER)})[F.col("section")]
    own = articles.where(~is_blank("title") & (F.coalesce(limit, F.lit(0)) > 0))
    own = own.withColumn("place", F.row_number().over(Window.partitionBy(group, "section").orderBy("pos"))).where(F.col("place") <= limit)
    return own.withColumn("n", F.row_number().over(Window.partitionBy(group).orderBy(order, "place")))


def manifest(sections: DataFrame, group: str = "edition") -> DataFrame:
    """Numbers from 1 across headline, deep-read and critical."""
    order = mapping({"headline": 0, "deepread": 1, "critical": 2})[F.col("section")]
    return sections.withColumn("n", F.row_number().over(Window.partitionBy(group).orderBy(order, "pos")))


def article_priority(articles: DataFrame, group: str = "edition") -> DataFrame:
    """Order over an edition and a priority that falls with it from its section's base."""
    order = mapping({s: i for i, s in enumerate(SECTION_PRIORITY)})[F.col("section")]
    out = articles.withColumn("seq", F.row_number().over(Window.partitionBy(group).orderBy(F.coalesce(order, F.lit(99)), "pos")))
    return out.withColumn("priority", F.round(F.coalesce(mapping(SECTION_PRIORITY)[F.col("section")], F.lit(0.5)) - F.col("seq") * 0.001, 4))
