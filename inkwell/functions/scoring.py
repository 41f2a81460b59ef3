"""Scores of items as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.fixed import BOARD_SOURCES, CRITIC_ANGLES, CRITIC_DATA, CRITIC_HIGH, CRITIC_LOW, CRITIC_NEWS, CRITIC_SAYS, WEIGHTS
from inkwell.functions.text import col, let


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v) -> Column:
    """Of unit length; the length is computed once, not for each place."""
    own = F.struct(col(v).alias("v"), (F.sqrt(dot(v, v)) + 1e-9).alias("norm"))
    return let(own, lambda o: F.transform(o["v"], lambda x: x.cast("double") / o["norm"]))


def cosine(a, b) -> Column:
    return dot(a, b) / ((F.sqrt(dot(a, a)) + 1e-9) * (F.sqrt(dot(b, b)) + 1e-9))


def hamming(a, b) -> Column:
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def decay(age, half_life: float) -> Column:
    return F.pow(F.lit(0.5), col(age) / half_life)


def age_weight(age_days, half_life: float = 180.0) -> Column:
    return decay(F.greatest(col(age_days), F.lit(0.0)), half_life)


def hot_score(heat, rank, reference: float = 1e6) -> Column:
    """Heat on a log scale; without heat the place on a board; without either 0.3.  Zero counts as none."""
    h, r = col(heat), col(rank)
    return F.when(h.isNotNull() & (h != 0), F.least(F.lit(1.0), F.log1p(h) / math.log1p(reference))).when(r.isNotNull() & (r != 0), F.greatest(F.lit(0.0), 1 - F.log1p(r.cast("double")) / math.log1p(50))).otherwise(0.3)


def item_hot(source, kind, heat, rank) -> Column:
    """Long texts count 15 % of their heat, some sources none."""
    quiet = col(source).isin("wechat_mp", "xiaohongshu") | (col(kind) == "hotlist") | col(source).isin(*[s for s in BOARD_SOURCES if s != "bilibili"])
    h = hot_score(heat, rank)
    return F.when(quiet, 0.0).when(col(kind).isin("article", "post", "video"), h * 0.15).otherwise(h)


def length_score(length, mu, sigma) -> Column:
    z = F.ln(F.greatest(col(length).cast("double"), F.lit(50.0))) - col(mu)
    return F.exp(-(z * z) / (2 * col(sigma) * col(sigma)))


def taste_similarity(vector, centroids, sizes) -> Column:
    """Best cosine with a centroid, small clusters counting down to 70 %."""
    own = F.struct(unit(vector).alias("u"), col(centroids).alias("c"), col(sizes).alias("n"), F.aggregate(col(sizes), F.lit(0.0), lambda s, x: s + x).alias("total"), F.array_max(col(sizes)).alias("most"))

    def best(o: Column) -> Column:
        largest = F.sqrt(o["most"] / o["total"])
        return F.array_max(F.zip_with(o["c"], o["n"], lambda c, n: dot(o["u"], c) * (0.7 + 0.3 * F.sqrt(n / o["total"]) / largest)))

    return let(own, best)


def final_score(sim, length, critic, hot, keyword, age_hours, edition: str = "default", duplicates=0) -> Column:
    """The total and its parts: a weighted sum less a penalty for reprints, times freshness."""
    w = WEIGHTS[edition]
    many = F.lit(duplicates) if isinstance(duplicates, int) else col(duplicates)
    base = w["sim"] * col(sim) + w["len"] * col(length) + w["llm"] * col(critic) + w["hot"] * col(hot) + w["kw"] * col(keyword)
    penalty = w["dup"] * F.log1p(F.greatest(many, F.lit(0)).cast("double")) / math.log(5)
    fresh = decay(age_hours, w["half_life"])
    return F.struct((F.greatest(F.lit(0.0), base - penalty) * fresh).alias("total"), col(sim).alias("sim"), col(length).alias("len"), col(critic).alias("llm"), col(hot).alias("hot"), col(keyword).alias("kw"), penalty.alias("dup_penalty"), fresh.alias("fresh"))


def critic(title, body) -> Column:
    """(raw 0-10, reason, angle) by the features of a rubric: counter-arguments and data raise it, marketing and bare news lower it."""
    text = F.concat(F.coalesce(col(title), F.lit("")), F.lit("\n"), F.coalesce(col(body), F.lit("")))
    hits = lambda words: F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
    high, low, news = hits(CRITIC_HIGH), hits(CRITIC_LOW), hits(CRITIC_NEWS)
    n = F.char_length(F.coalesce(col(body), F.lit("")))
    s = 4.0 + F.least(F.lit(2.5), 0.45 * F.size(high)) + F.when(text.rlike(CRITIC_DATA), 1.2).otherwise(0.0) - F.least(F.lit(3.0), 1.2 * F.size(low))
    s = s - F.when((F.size(news) > 0) & (F.size(high) == 0), 1.0).otherwise(0.0) - F.when(n < 80, 1.5).when(n > 8000, 0.4).otherwise(0.0)
    raw = F.greatest(F.lit(0.0), F.least(F.lit(10.0), s))
    some, bad = F.size(high) > 0, F.size(low) > 0
    reason = F.when(some, CRITIC_SAYS[0]).when(bad, CRITIC_SAYS[1]).otherwise(CRITIC_SAYS[2])
    angle = F.when(some, F.concat(F.lit(CRITIC_ANGLES[0]), F.get(high, F.lit(0)))).when(bad, CRITIC_ANGLES[1]).otherwise(CRITIC_ANGLES[2])
    return F.struct(raw.alias("raw"), (raw / 10).alias("score"), reason.alias("reason"), angle.alias("angle"))


def cached_critic(blob, title, body) -> Column:
    """A verdict that was stored as JSON, clamped to 0..1, or else the heuristic one; ``source`` says which."""
    held = F.from_json(F.coalesce(col(blob), F.lit("")), "score double, reason string, angle string")
    own = critic(title, body)
    has = held["score"].isNotNull()
    return F.struct(F.when(has, F.greatest(F.lit(0.0), F.least(F.lit(1.0), held["score"] / 10))).otherwise(own["score"]).alias("score"), F.when(has, F.coalesce(held["reason"], F.lit(""))).otherwise(own["reason"]).alias("reason"), F.when(has, F.lit("cached")).otherwise("heuristic").alias("source"))
