"""Near-duplicate folding of items: SimHash votes, band join, greedy fold, event clusters."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions.text import col
from inkwell.operators.graph import components, cut, greedy_fold
from inkwell.operators.vectors import CELLS, _dense, _unit

#: Blocks of a table that all cores have work with, and how far a block may grow from there on.
BLOCKS, LARGE = 16, 16
#: Tokens whose distinct ones are held as rows of bits at once.
TOKENS = 500_000


def simhash(rows: DataFrame) -> DataFrame:
    """(id, h) of ``rows`` (id, tokens): 64-bit SimHash, each token weighted by its count; no token gives 0.

    Votes are sums of bit rows over the distinct tokens of some rows of a batch, about ``TOKENS`` tokens; each of these is hashed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).value_lengths().fill_null(0).to_numpy().astype(np.int64)
            ends = np.cumsum(sizes)
            out, at = np.zeros(len(sizes), np.int64), 0
            while at < len(sizes):
                begin = ends[at] - sizes[at]
                to = max(at + 1, int(np.searchsorted(ends, begin + TOKENS, "right")))
                flat = batch.column(1).slice(at, to - at).flatten().dictionary_encode()
                raw = b"".join(hashlib.md5(w.as_py().encode()).digest()[:8] for w in flat.dictionary)
                bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).view(np.int8)
                bits *= 2
                bits -= 1
                codes = flat.indices.to_numpy()
                for k in at + np.flatnonzero(sizes[at:to]):
                    votes = bits[codes[ends[k] - sizes[k] - begin : ends[k] - begin]].sum(axis=0, dtype=np.int64)
                    out[k] = int.from_bytes(np.packbits(votes > 0).tobytes(), "big", signed=True)
                at = to
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["id", "h"])

    return rows.select(F.col("id").cast("long").alias("id"), "tokens").mapInArrow(run, "id long, h long")


def block_keys(h: str, most: int = 3) -> Column:
    """The ten keys of a hash: each pair of its five blocks, about 26 bits, under the pair's number."""
    if most > 3:
        raise ValueError("five blocks find hashes up to three bits apart")
    blocks = [(0, 13), (13, 26), (26, 39), (39, 52), (52, 64)]
    part = lambda lo, hi: F.call_function("shiftrightunsigned", F.col(h), F.lit(lo)).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
    keys = [F.lit(n << 26).bitwiseOR(F.call_function("shiftleft", part(*x), F.lit(13))).bitwiseOR(part(*y)) for n, (x, y) in enumerate(combinations(blocks, 2))]
    return F.array(*keys)


def near_hashes(hashed: DataFrame, most: int = 3) -> DataFrame:
    """(h, g), h < g: the distinct hashes of ``hashed`` (h) that differ in at most ``most`` of 64 bits, three at most.

    Hashes that differ in three bits agree on two of five blocks, so each is met under ten keys of about 26 bits; equal hashes are
    one from the start."""
    rows = cut(hashed.select("h").distinct()).select("h", F.explode(block_keys("h", most)).alias("k"))
    left, right = rows.alias("x"), rows.alias("y")
    near = F.bit_count(F.col("x.h").bitwiseXOR(F.col("y.h"))) <= most
    return cut(left.join(right.hint("merge"), (F.col("x.k") == F.col("y.k")) & (F.col("x.h") < F.col("y.h")) & near).select("x.h", F.col("y.h").alias("g")).distinct())


def near_pairs(hashed: DataFrame, most: int = 3) -> DataFrame:
    """(a, b), a < b, of ``hashed`` (id, h) whose hashes differ in at most ``most`` of 64 bits, those of equal hashes too.

    This lists all pairs, as an index of near items does; to fold items use ``fold_simhash``, which lists none."""
    keyed = hashed.select("id", "h")
    near = near_hashes(hashed, most)
    link = near.union(keyed.groupBy("h").count().where("count > 1").select("h", F.col("h").alias("g")))
    met = link.join(keyed.select("h", F.col("id").alias("i")).hint("merge"), "h").join(keyed.select(F.col("h").alias("g"), F.col("id").alias("j")).hint("merge"), "g")
    # under one hash each pair comes once in either order
    return met.where("i <> j and (h <> g or i < j)").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))


def fold_simhash(items: DataFrame, hashed: DataFrame, score: str | Column = "score", key: str | Column = "id", most: int = 3) -> DataFrame:
    """(id, leader): a greedy pass by score, best first (ties by id); every near copy of a kept item folds into it.

    ``items`` has one row for each id of ``hashed`` (id, h).  Items of one hash fold alike, so the pass goes over distinct hashes, each
    in the place of its best item, and a group of copies of any size is one node."""
    place = items.select(col(key).alias("id"), F.struct((-F.coalesce(col(score), F.lit(0.0))).alias("s"), col(key).alias("k")).alias("place"))
    own = cut(hashed.select("id", "h").join(place.hint("merge"), "id"))
    best = cut(own.groupBy("h").agg(F.min("place").alias("place")))
    edges = near_hashes(best, most).select(F.col("h").alias("a"), F.col("g").alias("b"))
    folded = greedy_fold(best.select(F.col("h").alias("id"), "place"), edges).withColumnRenamed("id", "h")
    lead = folded.join(best.select(F.col("h").alias("leader"), F.col("place.k").alias("first")).hint("merge"), "leader").select("h", F.col("first").alias("leader"))
    return own.select("id", "h").join(lead.hint("merge"), "h").select("id", "leader")


def _products(dealt: DataFrame, least: float) -> DataFrame:
    """(a, b, cosine) of pairs at ``least`` or above within the tasks (bucket, i, j) of ``dealt``, a matrix product for some rows at a time."""

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        (a, x), (b, y) = ((side.column("id").to_numpy(), _unit(_dense(side.column("vector")))) for side in (rows.filter(rows.column(c)) for c in ("left", "right")))
        own = len(a) == len(b) == rows.num_rows  # a block with itself: each pair would come in either order
        step = max(1, CELLS // max(1, len(b)))
        for at in range(0, len(a) if len(b) else 0, step):
            s = x[at : at + step] @ y.T
            i, j = np.nonzero(s >= least)
            c, i, j = s[i, j], a[i + at], b[j]
            met = i < j if own else i != j
            columns = [np.minimum(i, j)[met], np.maximum(i, j)[met], c[met]]
            for lo in range(0, len(columns[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(z[lo : lo + 100_000]) for z in columns], ["a", "b", "cosine"])

    return dealt.withColumn("id", F.col("id").cast("long")).groupBy("bucket", "i", "j").applyInArrow(product, "a long, b long, cosine double")


def _in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Rows (bucket, id, vector, size) dealt to pairs of blocks of about ``block`` within their bucket.

    A vector is sent to as many tasks as there are blocks, so from ``BLOCKS`` on blocks grow, up to ``LARGE`` times ``block``."""
    few = F.least(F.lit(BLOCKS), F.ceil(F.col("size") / block))  # enough for all cores
    blocks = F.greatest(F.lit(1), few, F.ceil(F.col("size") / (LARGE * block))).cast("int")
    own = rows.withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return own.select("bucket", "id", "vector", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), (F.col("own") <= F.col("k")).alias("left"), (F.col("own") >= F.col("k")).alias("right"))


def cosine_pairs(vectors: DataFrame, least: float = 0.82, block: int = 512, tables: int | None = None, bits: int = 12) -> DataFrame:
    """(a, b, cosine) of pairs of ``vectors`` (id, vector), each id once, at ``least`` or above.

    Without ``tables`` all pairs are found: vectors are dealt into blocks of ``block`` and more, each pair of blocks is one task's matrix
    product, some rows at a time, and the work grows with the square of the table.  With ``tables`` a pair is met only under one of so many signatures of
    ``bits`` signs of random projections (equal vectors always are); what is met is compared exactly.  A pair of cosine c is missed
    with a chance of (1 - (1 - acos(c) / pi) ** bits) ** tables: 32 tables of 12 bits find 92 % of pairs at 0.82, 99 % at 0.9."""
    if tables is None:
        rows = vectors.select("id", "vector", F.lit(0).cast("long").alias("bucket"))
        n = rows.count()
        return _products(_in_blocks(rows.withColumn("size", F.lit(n)), block), least)

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            m = np.stack(frame["vector"].to_numpy()).astype(np.float64)
            planes = np.random.default_rng(20240103).standard_normal((m.shape[1], tables * bits))
            signs = (m @ planes > 0).reshape(len(m), tables, bits) @ (1 << np.arange(bits))
            for t in range(tables):
                yield pd.DataFrame({"bucket": (t << 32) + signs[:, t], "id": frame["id"].to_numpy()})

    buckets = cut(vectors.select("id", "vector").mapInPandas(sign, "bucket long, id long"))
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    rows = buckets.join(sizes.hint("merge"), "bucket").join(vectors.select("id", "vector").hint("merge"), "id")
    return _products(_in_blocks(rows, block), least).groupBy("a", "b").agg(F.max("cosine").alias("cosine"))


def fold_events(items: DataFrame, hashed: DataFrame, vectors: DataFrame, least: float = 0.82, score: str | Column = "score", tables: int | None = None) -> DataFrame:
    """(id, primary): near copies fold first; what is left is clustered by cosine, the best score of a cluster leads it."""
    folded = cut(fold_simhash(items, hashed, score))
    kept = folded.where("id = leader").select("id")
    edges = cosine_pairs(vectors.join(kept.hint("merge"), "id", "left_semi"), least, tables=tables).select("a", "b")
    label = components(kept, edges)
    ranked = label.join(items.select("id", F.coalesce(col(score), F.lit(0.0)).alias("s")).hint("merge"), "id")
    lead = ranked.groupBy("label").agg(F.max_by("id", F.struct("s", (-F.col("id")).alias("k"))).alias("primary"))
    of = ranked.join(lead.hint("merge"), "label").select(F.col("id").alias("leader"), "primary")
    return folded.join(of.hint("merge"), "leader").select("id", "primary")


def fold_few(items: DataFrame, hashed: DataFrame, vectors: DataFrame, least: float = 0.82, most: int = 3, score: str | Column = "score", limit: int = 5_000) -> DataFrame:
    """(id, primary) as ``fold_events`` has it, for a list that a limit has bounded: all pairs in one task, in two matrix products.

    For tables of over ``limit`` rows, which are counted, ``fold_events`` is used."""
    own = items.select("id", F.coalesce(col(score), F.lit(0.0)).alias("s")).join(hashed.select("id", "h").hint("merge"), "id").join(vectors.select("id", "vector").hint("merge"), "id")
    own = cut(own)
    if own.count() > limit:
        return fold_events(items, hashed, vectors, least, score)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["s", "id"], ascending=[False, True]).reset_index(drop=True)
        bits = np.unpackbits(rows["h"].to_numpy().astype(np.int64).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)
        ones = bits.sum(axis=1)
        near = ones[:, None] + ones[None, :] - 2 * (bits @ bits.T) <= most
        kept, leader = np.zeros(len(rows), bool), np.arange(len(rows))
        for i in range(len(rows)):
            before = np.flatnonzero(near[i, :i] & kept[:i])
            leader[i], kept[i] = (before[0], False) if len(before) else (i, True)
        lead = np.flatnonzero(kept)
        m = np.stack(rows["vector"].to_numpy()[lead]).astype(np.float64)
        m /= np.linalg.norm(m, axis=1, keepdims=True) + 1e-9
        alike = m @ m.T >= least
        first = np.arange(len(lead))  # rows are in order of score, so the least number of a component leads it
        while True:
            now = np.array([first[alike[k]].min() if alike[k].any() else first[k] for k in range(len(lead))])
            now = np.minimum(now, first)
            if (now == first).all():
                break
            first = now
        primary = dict(zip(lead.tolist(), lead[first].tolist(), strict=True))
        return pd.DataFrame({"id": rows["id"], "primary": rows["id"].to_numpy()[[primary[k] for k in leader.tolist()]]})

    return own.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(fold, "id long, primary long")


def related(folded: DataFrame, items: DataFrame, most: int = 20) -> DataFrame:
    """(primary, related, n): of what was folded into each primary the first ``most`` titles in order of id, and how many there are."""
    own = folded.where("id <> primary").join(items.select("id", "title").hint("merge"), "id")
    count = own.groupBy("primary").agg(F.count(F.lit(1)).alias("n"))
    first = own.withColumn("k", F.row_number().over(Window.partitionBy("primary").orderBy("id"))).where(F.col("k") <= most)
    listed = first.groupBy("primary").agg(F.array_sort(F.collect_list(F.struct("id", "title"))).alias("r"))
    return listed.join(count.hint("merge"), "primary").select("primary", F.col("r.title").alias("related"), "n")
