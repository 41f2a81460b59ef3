"""URL rules by a cascade of Bloom filters (operator 13), in DataFrame functions alone.

The first filter encodes the listed keys, the second those keys of the corpus that the first lets pass wrongly, the third the
listed keys that the second holds wrongly, and so on until no key is wrong.  Over the keys of the corpus, which all take part in
the building, membership is exact; a row is judged where it is, by constants of the plan, without a join."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import cut, fresh

#: The most bits of one filter (16 MB): it becomes a constant of the plan, so its size is reckoned from counts before it is made.
MAX_BITS = 1 << 27
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its bits as comma-joined 64-bit words, their number, and how many of them a key sets."""

    words: str
    bits: int
    hashes: int
    seed: int


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def holds(self, key: Column) -> Column:
        """Whether a key of the corpus is listed: the first level that it fails tells by its side."""
        out = None
        for at, level in enumerate(self.levels):
            failed, side = ~_passes(level, key), F.lit(at % 2 == 1)
            out = F.when(failed, side) if out is None else out.when(failed, side)
        return F.lit(False) if out is None else out.otherwise(F.lit(len(self.levels) % 2 == 1))


def _places(key: Column, bits: int, seed: int, i: Column) -> Column:
    """The i-th bit of a key, by double hashing; sums of halves of one hash stay within a long."""
    h = F.xxhash64(key, F.lit(seed))
    step = F.call_function("shiftrightunsigned", h, F.lit(32)).bitwiseOR(F.lit(1))
    return (h.bitwiseAND(F.lit(0x7FFFFFFF)) + i.cast("long") * step) % F.lit(bits)


def _passes(level: Level, key: Column) -> Column:
    words = F.split(F.lit(level.words), ",").cast("array<bigint>")  # folded into one constant by the optimizer
    one = lambda i: F.call_function("bit_get", F.get(words, (_places(key, level.bits, level.seed, i) / 64).cast("int")), (_places(key, level.bits, level.seed, i) % 64).cast("int")) == 1
    return F.forall(F.sequence(F.lit(0), F.lit(level.hashes - 1)), one)


def _level(keys: DataFrame, count: int, rate: float, seed: int) -> Level:
    """The filter of ``count`` keys (column ``key``) that lets about ``rate`` of all others pass."""
    bits, hashes = 64 * max(1, math.ceil(count * math.log2(1 / rate) / math.log(2) / 64)), max(1, round(math.log2(1 / rate)))
    if bits > MAX_BITS:
        raise ValueError(f"a filter of {count} keys takes {bits} bits, {MAX_BITS} are allowed")
    places = keys.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: _places(F.col("key"), bits, seed, i))).alias("p"))
    words = places.select(F.floor(F.col("p") / 64).alias("w"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("b"))
    words = words.unionByName(keys.sparkSession.range(bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b"))).groupBy("w").agg(F.bit_or("b").alias("b"))
    text = words.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]), ",")).first()[0]
    return Level(text, bits, hashes, seed)


def build_cascade(universe: DataFrame, listed: DataFrame) -> Cascade:
    """The cascade of ``listed`` (column ``key``) that is exact for every key of ``universe`` (column ``key``, repeats allowed).

    Only keys that pass the first level wrongly are shuffled and kept; its rate of r / (sqrt(2) s), for r listed keys among s
    others, makes them fewer than the listed ones, and every later level halves what is left.  Null keys are no keys; an empty list holds nothing."""
    listed = cut(listed.select("key").where("key is not null").distinct())
    count = listed.count()
    if not count:
        return Cascade(())
    universe = universe.select("key").where("key is not null")
    others = max(1, universe.agg(F.approx_count_distinct("key")).first()[0])
    levels = [_level(listed, count, min(0.5, count / (math.sqrt(2) * others)), 0)]
    wrong = cut(universe.where(_passes(levels[0], F.col("key"))).distinct().join(listed.hint("shuffle_hash"), "key", "left_anti"))
    inside, outside = listed, wrong  # what the last level encodes, and what of the other side passed it
    while n := outside.count():
        levels.append(_level(outside, n, 0.5, len(levels)))
        inside, outside = outside, cut(inside.where(_passes(levels[-1], F.col("key"))))
    return Cascade(tuple(levels))


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://`` and for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def candidate_keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Every key that a rule fitting this host and path may have: so many last labels, and the path's beginning of so many code points.

    A rule's labels and path length are its shape; a url has one candidate for each shape that it is long enough for."""
    labels, length = F.size(F.split(host, r"\.")), F.char_length(path)
    return F.filter(F.array(*[F.when((labels >= n) & (length >= p), F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, p))) for n, p in shapes]), lambda k: k.isNotNull())


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict (or names after these, where taken) for each row.

    ``rules`` has host, path and verdict (allow or block).  A rule fits its host and the subdomains of it where the url's path
    starts with the rule's; of those that fit, the one with the longest text (host and path, in code points) decides, of two
    equally long ones the greater text.  A url that no rule fits, a null one or one without ``://`` gets ``otherwise``.
    A rule listed both ways blocks; rules with a null or empty host or a null path fit nothing; without rules all get ``otherwise``.
    Repeated rows are judged alike, an empty table stays empty, and urls are taken whole whatever their length."""
    rules = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict").where("host <> '' and path is not null")
    rules = rules.select(F.concat("host", "path").alias("key"), F.size(F.split("host", r"\.")).alias("labels"), F.char_length("path").alias("chars"), (F.col("verdict") == "block").alias("blocks"))
    shapes = sorted((r.labels, r.chars) for r in rules.select("labels", "chars").distinct().collect())
    host, path, rule, verdict = (fresh(pages, c) for c in ("host", "path", "rule", "verdict"))
    out = pages.withColumn(host, host_of(F.col(url))).withColumn(path, path_of(F.col(url)))
    if not shapes:
        return out.withColumn(rule, F.lit(None).cast("string")).withColumn(verdict, F.lit(otherwise))
    keys = candidate_keys(F.col(host), F.col(path), shapes)
    any_rule = build_cascade(out.where(F.col(host) != "").select(F.explode(keys).alias("key")), rules)
    blocks = build_cascade(rules, rules.where("blocks"))
    fitting = F.when(F.col(host) == "", F.array().cast("array<string>")).otherwise(F.filter(keys, any_rule.holds))
    longest = F.array_max(F.transform(fitting, lambda k: F.struct(F.char_length(k).alias("n"), k.alias("key"))))["key"]
    out = out.withColumn(rule, longest)
    return out.withColumn(verdict, F.when(F.col(rule).isNull(), otherwise).when(blocks.holds(F.col(rule)), "block").otherwise("allow"))
