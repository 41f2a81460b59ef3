"""The whole ranking of one edition as one plan: candidates, scores, folding, diversity, sections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import scoring
from inkwell.functions.text import display_title, event_time, text_for_embedding, tokenize
from inkwell.operators import folding, ranking, rules
from inkwell.operators.graph import cut
from inkwell.operators.taste import TasteModel


def judged(top: DataFrame, scorer: Callable[[Column, Column], Column] | None = None, cache: str = "llm_summary") -> DataFrame:
    """``top`` with ``critic`` (score, reason, source): what is cached, else what ``scorer`` says of (title, body), else the heuristic.

    ``scorer`` may be a costly pandas UDF that gives a struct (score 0 to 1, reason string), null where it fails; ``top`` is
    limited and checkpointed before, so it's asked once for each of a bounded number of rows."""
    body = ranking.body_of()
    blob = F.col(cache) if cache in top.columns else F.lit(None).cast("string")
    own = scoring.cached_critic(blob, F.col("title"), body)
    if scorer is None:
        return top.withColumn("critic", own)
    asked = F.when(own["source"] == "cached", F.lit(None)).otherwise(scorer(F.col("title"), body))
    said = F.struct(asked["score"].alias("score"), asked["reason"].alias("reason"), F.lit("scorer").alias("source"))
    return top.withColumn("critic", F.when(asked.isNotNull(), said).otherwise(own))


def rank_edition(
    items: DataFrame,
    vectors: DataFrame,
    taste: TasteModel,
    groups: list[dict] | DataFrame,
    as_of: str,
    edition: str = "am",
    excludes: DataFrame | None = None,
    scorer: Callable[[Column, Column], Column] | None = None,
    coarse: int = 150,
    slots: int = 20,
    least: float = 0.12,
    near: float = 0.82,
) -> DataFrame:
    """(n, section, content_hash, title, score, related, reason): headline, deep-read and critical articles of an edition, numbered from 1,
    with the titles of the reports that were folded into each (at most twenty, in order of score) and what the critic said.

    ``items`` with a column length; ``vectors`` (content_hash, vector); ``groups`` of keywords as a list or, where there are many, a table of rules.  Candidates are scored with a neutral critic; the best
    ``coarse`` of them are judged, scored again, and folded into events; what reaches ``least`` is diversified into ``slots``, some of
    them open to good items unlike the reader's taste, and dealt to sections; the day's digest is pinned.  All that follows
    the first limit is a small table."""
    own = ranking.rank_candidates(items, excludes).join(vectors.hint("merge"), "content_hash")
    own = taste.transform(own)
    own = rules.match_rules(own, groups, body=ranking.body_of()) if isinstance(groups, DataFrame) else ranking.keyword_matches(own, groups, body=ranking.body_of())
    now = F.unix_timestamp(F.lit(as_of).cast("timestamp"))
    age = F.greatest(F.lit(0.0), (now - F.unix_timestamp(event_time("published_at", "fetched_at"))) / 3600.0)
    hot = scoring.item_hot("source", "kind", "heat", "rank")
    score = lambda critic: scoring.final_score("sim", "len_score", critic, hot, "keyword", age, edition)["total"]
    top = own.withColumn("total", F.round(score(F.lit(0.5)), 9)).orderBy(F.desc("total"), "content_hash").limit(coarse)
    top = cut(judged(cut(top.withColumn("id", F.xxhash64("content_hash"))), scorer).withColumn("total", F.round(score(F.col("critic.score")), 9)))

    hashed = cut(folding.simhash(top.select("id", tokenize(text_for_embedding("title", "content", "summary")).alias("tokens"))))
    events = folding.fold_few(top.select("id", F.col("total").alias("score")), hashed, top.select("id", "vector"), near)
    events = cut(events)
    folded = events.where("id <> primary").join(top.select("id", "total", display_title("source", "title", "collector").alias("t")).hint("merge"), "id")
    folded = folded.groupBy(F.col("primary").alias("id")).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("total")).alias("o"), "id", "t")))["t"], 1, 20).alias("related"))  # of the best ``coarse``
    leads = cut(top.join(events.select(F.col("primary").alias("id")).distinct().hint("merge"), "id", "left_semi"))
    good = cut(ranking.viable(leads, excludes, least=least).withColumn("edition", F.lit(edition)))
    n = min(slots, good.count())
    placed = ranking.top_k(good, ["edition"], [F.desc("total"), F.col("content_hash")], coarse)
    explored = ranking.explore(placed.select("edition", "place", "content_hash", "sim", F.col("critic.score").alias("llm")), n)
    tied = good.join(explored.select("content_hash", F.col("slot").alias("tie")).hint("merge"), "content_hash", "left").withColumn("tie", F.coalesce("tie", F.lit(999)))
    chosen = cut(ranking.diversify(tied.select("edition", "content_hash", F.col("total").alias("score"), "vector", "tie"), n, ties="tie"))
    ranked = chosen.join(good.select("content_hash", "kind", "length", F.col("critic.score").alias("critic")).hint("merge"), "content_hash")
    sections = ranking.manifest(ranking.pin_daily(ranking.split_sections(ranked), items, as_of))
    title = items.select("content_hash", display_title("source", "title", "collector").alias("title"))
    out = sections.join(title.hint("merge"), "content_hash").join(good.join(folded.hint("merge"), "id", "left").select("content_hash", F.col("total").alias("score"), "related", F.col("critic.reason").alias("reason")).hint("merge"), "content_hash", "left")
    return out.select("n", "section", "content_hash", "title", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("related", F.array().cast("array<string>")).alias("related"), "reason")
