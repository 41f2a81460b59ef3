"""Titles matched against a ranking by automata: each title is read once, however many titles the ranking has."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.operators.graph import cut

#: Bytes of ranked titles that go out at once.
BLOCK_BYTES = 8_000_000
_FOUND = {"equal_pos": pa.int64(), "equal_score": pa.float64(), "near_pos": pa.int64(), "near_score": pa.float64()}


class RankedTitles:
    """A block of the ranking: (pos, title, score) in order of pos, and an automaton of its titles."""

    def __init__(self, rows: list[tuple[int, str, float | None]]):
        self.rows = sorted(rows, key=lambda r: r[0])
        self.first: dict[str, int] = {}
        for at, (_, title, _) in enumerate(self.rows):
            self.first.setdefault(title, at)
        self.automaton = _automaton({t: at for t, at in self.first.items() if t})

    def inside(self, title: str) -> int | None:
        """The first ranked title that stands in ``title``."""
        return min((at for _, at in self.automaton.iter(title)), default=None) if len(self.automaton) else None

    def around(self, titles: list[str], automaton) -> dict[str, int]:
        """For each of ``titles`` the first ranked title that it stands in: one automaton of theirs (or more) reads the ranking once.

        A title that is found is left in the automaton, but read on past only until all are found."""
        found: dict[str, int] = {}
        wanted = set(titles)
        for at, (_, ranked, _) in enumerate(self.rows):
            if ranked and len(automaton):
                for _, title in automaton.iter(ranked):
                    if title in wanted:
                        found.setdefault(title, at)
            if ranked and "" in wanted:
                found.setdefault("", at)
            if len(found) == len(wanted):
                break
        return found


def _automaton(words: dict):
    out = ahocorasick.Automaton()
    for word, value in words.items():
        out.add_word(word, value)
    if len(out):
        out.make_automaton()
    return out


def _match(batches: Iterator[pa.RecordBatch], blocks: list[RankedTitles]) -> Iterator[pa.RecordBatch]:
    """What distinct titles find in each block that holds any of them, or is held."""
    for batch in batches:
        titles = batch.column(0).to_pylist()
        automaton = _automaton({t: t for t in titles if t})
        for ranked in blocks:
            equal = {t: ranked.first[t] for t in titles if t in ranked.first}
            around = ranked.around([t for t in titles if t not in equal], automaton)
            near = {}
            for t in titles:
                places = [x for x in (ranked.inside(t), around.get(t)) if x is not None] if t not in equal else []
                if places:
                    near[t] = min(places)
            found = [t for t in titles if t in equal or t in near]
            columns = [pa.array(found, pa.string())]
            for of in (equal, near):
                rows = [ranked.rows[of[t]] if t in of else (None, None, None) for t in found]
                columns += [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["title", *_FOUND])


def match_titles(articles: DataFrame, ranking: DataFrame, default: float = 0.2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``articles`` (id, title, …) with the score of the ranked title (pos, title, score) that is equal, else of the first that holds it or is held by it.

    Equal titles are matched once, and of equal ranked ones only the first can count, so both are made distinct.  What is left of the
    ranking is measured and goes out in blocks of about ``block_bytes`` of titles, as many at once as BLOCK_BYTES hold; each title meets
    each block where it is, in both directions by Aho-Corasick automata.  An empty title stands in every ranked one that isn't empty; an
    empty ranked title stands in none, but is equal to an empty one.  Null titles, and ranked titles without a place, match nothing;
    of ranked titles on one place the lesser text counts."""
    ranked = ranking.select(F.col("pos").cast("long").alias("pos"), "title", F.col("score").cast("double").alias("score")).where("pos is not null and title is not null")
    # of equal titles the first counts, whatever it is matched with
    place = F.struct("pos", F.col("score").isNull().alias("none"), "score")
    ranked = cut(ranked.groupBy("title").agg(F.min(place).alias("r")).select("r.pos", "title", "r.score"))
    own = cut(articles.select("title").where("title is not null").distinct())
    blocks = max(1, -(-(ranked.agg(F.sum(F.octet_length("title"))).first()[0] or 0) // block_bytes))
    numbered, found, sc = ranked.withColumn("b", F.pmod(F.xxhash64("pos"), F.lit(blocks))), None, articles.sparkSession.sparkContext
    together = max(1, BLOCK_BYTES // block_bytes)  # blocks that go out in one broadcast
    for first in range(0, blocks, together):
        held: list[list[tuple]] = [[] for _ in range(min(together, blocks - first))]
        for b, *row in numbered.where(F.col("b").between(first, first + len(held) - 1)).select("b", "pos", "title", "score").toLocalIterator():
            held[b - first].append(tuple(row))
        sent = sc.broadcast(held)
        part = own.mapInArrow(lambda batches, sent=sent: _match(batches, [RankedTitles(rows) for rows in sent.value]), "title string, equal_pos long, equal_score double, near_pos long, near_score double")
        found = part if found is None else found.unionByName(part)
    best = [F.min_by(F.struct(f"{k}_pos", f"{k}_score"), F.struct(F.col(f"{k}_pos").isNull().alias("n"), f"{k}_pos")).alias(k) for k in ("equal", "near")]
    found = cut(found.groupBy("title").agg(*best))
    score = F.when(F.col("equal.equal_pos").isNotNull(), F.col("equal.equal_score")).when(F.col("near.near_pos").isNotNull(), F.col("near.near_score"))
    scored = found.select("title", score.alias("__score"))
    return articles.join(scored.hint("merge"), "title", "left").withColumn("score", F.coalesce("__score", F.lit(default))).select(*articles.columns, *([] if "score" in articles.columns else ["score"]))
