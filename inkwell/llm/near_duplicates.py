"""Near-duplicate documents by a chosen-path similarity join on shingle sets (operator 4)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import binary_rows, connected_components, cut, fixed_binary, likely_in, lower_ascii, mix, partitions, released, shingles, skew_join, text_blocks, whole_groups, without, word_hashes, word_spans, written

#: Minwise tokens of each document, and those of them that paths are chosen by; trees; largest node that is compared exhaustively.
TOKENS, PATHS, TREES, LEAF = 128, 48, 12, 256
#: Levels of branching, two fresh tokens each.  Below MAYBE a node's size falls by half a level, so no node comes that far.
LEVELS = PATHS // 2
#: Candidates by sketch (seven deviations below 0.75 by one byte a token), and what is compared with a pivot on whole sets (five below).
MAYBE, LIKELY = 0.49, 0.56
#: Documents that are compared on whole sets in one place; documents of a pivot's task.
BLOCK, STAR = 512, 256
#: Most members of a node with labels, and most pairs of members with different labels, that are compared exhaustively.
WIDE, ACROSS = 8_192, 2_000_000
#: A cluster of more than BLOCK documents is compared part by part if that moves a set at most so often; else leaf by leaf.
COPIES = 16


def shingle_sets(column: pa.Array, size: int = 5) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, distinct shingle hashes sorted within rows, first of each row and one more)."""
    for at, to, data, offs in text_blocks(column):
        data = lower_ascii(data)
        starts, ends, first = word_spans(data, offs)
        hashed, row = shingles(word_hashes(data, starts, ends), first, size)
        order = np.lexsort((hashed, row))
        hashed, row = hashed[order], row[order]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (hashed[1:] != hashed[:-1]) | (row[1:] != row[:-1])
        hashed, row = hashed[new], row[new]
        yield at, to, hashed, np.searchsorted(row, np.arange(to - at + 1))


def minwise(hashed: np.ndarray, first: np.ndarray, tokens: int = TOKENS) -> np.ndarray:
    """For each non-empty row the least value of its set under each of ``tokens`` hash functions."""
    full = np.flatnonzero(np.diff(first) > 0)
    out = np.zeros((len(full), tokens), np.uint32)
    if len(full):
        rng = np.random.default_rng(20240101)
        starts = first[full]
        for t in range(tokens):
            a, b = (np.uint64(int(x) | 1) for x in rng.integers(1, 2**63, 2))
            value = hashed * a
            value ^= value >> np.uint64(31)
            out[:, t] = np.minimum.reduceat((value * b) >> np.uint64(32), starts)
    return out


def sketch(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(id, n, digest, tokens, low): set size, a digest of the whole set, its minwise tokens for paths and one byte of each for comparisons."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, hashed, first in shingle_sets(batch.column(1), size):
                n = np.diff(first)
                total, other = np.concatenate([[np.uint64(0)], np.cumsum(hashed, dtype=np.uint64)]), np.concatenate([[np.uint64(0)], np.cumsum(mix(hashed + np.uint64(77)), dtype=np.uint64)])
                digest = np.stack([n.astype(np.uint64), total[first[1:]] - total[first[:-1]], other[first[1:]] - other[first[:-1]]], axis=1)
                low = np.zeros((to - at, TOKENS), np.uint32)
                low[n > 0] = minwise(hashed, first)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(n, pa.int64()), binary_rows(digest), binary_rows(low[:, :PATHS]), binary_rows(low.astype(np.uint8))], ["id", "n", "digest", "tokens", "low"])

    return docs.select(F.col(key).cast("long").alias("id"), text).mapInArrow(released(run), "id long, n long, digest binary, tokens binary, low binary")


_PLACES = np.array([np.random.default_rng([20240102, t]).permutation(PATHS) for t in range(256)])  # for each tree, in which order tokens are used


def _children(node: np.ndarray, tree: np.ndarray, level: int, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the row, child node): a node picks one minwise token that its path hasn't used, and with chance 1/3 a second
    one, so that at a similarity of 3/4 one child on the mean has both documents."""
    one, two = _PLACES[tree, 2 * level], _PLACES[tree, 2 * level + 1]
    rows = np.arange(len(node))
    more = np.flatnonzero((mix(node + np.uint64(0x51ED27)) >> np.uint64(40)) % np.uint64(3) == 0)
    at, which = np.concatenate([rows, more]), np.concatenate([one, two[more]])
    return at, mix(node[at] ^ mix(tokens[at, which].astype(np.uint64) + (which.astype(np.uint64) << np.uint64(32))))


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of sketches of one byte a token, less what chance makes equal."""
    return ((a == b).mean(axis=-1) - 1 / 256) / (1 - 1 / 256)


def _join(parent: list[int], i: int, j: int) -> bool:
    """Union of two members' sets; whether they were apart."""
    while parent[i] != i:
        parent[i] = i = parent[parent[i]]
    while parent[j] != j:
        parent[j] = j = parent[parent[j]]
    if i == j:
        return False
    parent[max(i, j)] = min(i, j)
    return True


def _labelled(labels: np.ndarray) -> list[int]:
    """A union-find over members in which equal labels are together from the start."""
    seen: dict[int, int] = {}
    return [seen.setdefault(x, i) for i, x in enumerate(labels.tolist())]


def compare_leaf(ids: np.ndarray, low: np.ndarray, labels: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Candidate pairs of a node, compared exhaustively, and which members are in any.

    Members with one label are linked already, so their pairs are none, and those of the most frequent label meet only the
    others.  Of pairs that close a circle of pairs none is listed."""
    names, own, sizes = np.unique(labels, return_inverse=True, return_counts=True)
    most = int(sizes.argmax())
    rows = np.flatnonzero(own != most) if sizes[most] > 1 else np.arange(len(ids))
    met, root = np.zeros(len(ids), dtype=bool), np.arange(len(ids))
    out: list[tuple[int, int]] = []
    for part in np.array_split(rows, max(1, len(rows) * len(ids) // 250_000)):
        near = (_alike(low[part, None, :], low[None, :, :]) >= MAYBE) & (own[part, None] != own[None, :])
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            a, others = part[i], np.flatnonzero(near[i])
            met[a] = met[others] = True
            roots, at = np.unique(root[others], return_index=True)
            apart = roots != root[a]
            if apart.any():
                out += [(ids[a], ids[b]) for b in others[at[apart]].tolist()]
                root[np.isin(root, roots)] = root[a]
    return out, met


def _compare(rows: DataFrame) -> DataFrame:
    """For the nodes in ``rows`` (node, id, label, low) the candidate pairs (node null, a, b), and every member that is in one by
    its node (node, a: the id, b: its label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "node"):
            node, ids, labels = (table.column(c).to_numpy() for c in ("node", "id", "label"))
            low = fixed_binary(table.column("low"), TOKENS)
            cut_at = np.concatenate([[0], np.flatnonzero(node[1:] != node[:-1]) + 1, [len(node)]])
            sizes = np.diff(cut_at)
            pairs = cut_at[:-1][sizes == 2]
            pairs = pairs[labels[pairs] != labels[pairs + 1]]
            pairs = pairs[_alike(low[pairs], low[pairs + 1]) >= MAYBE]
            found = [np.stack([ids[pairs], ids[pairs + 1]], axis=1)]
            members = [pairs, pairs + 1]
            for a, b in zip(cut_at[:-1][sizes > 2], cut_at[1:][sizes > 2], strict=True):
                own, met = compare_leaf(ids[a:b], low[a:b], labels[a:b])
                if own:
                    found.append(np.array(own, np.int64))
                    members.append(a + np.flatnonzero(met))
            out, at = np.concatenate(found), np.concatenate(members)
            none = pa.nulls(len(out), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(out.min(axis=1, initial=2**62)), pa.array(out.max(axis=1, initial=-(2**62)))], ["node", "a", "b"])
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(ids[at]), pa.array(labels[at])], ["node", "a", "b"])

    parts = partitions(rows.sparkSession)
    return rows.repartition(parts, "node").sortWithinPartitions("node").mapInArrow(released(run), "node long, a long, b long")


def _sized(rows: DataFrame, settle: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """Nodes with members of more than one label, with their size; ``settle`` ends the plan."""
    sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1")
    return settle(skew_join(rows, cut(sizes.select("node", "size", F.col("size").alias("w"))), "node", "w"))


class Texts:
    """Where whole sets come from: the documents' texts, which stay where they are until a Bloom filter picks them."""

    def __init__(self, docs: DataFrame, key: str, text: str, size: int, percent: int):
        self.rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null")
        self.size, self.percent = size, percent

    def sets(self, ids: DataFrame) -> DataFrame:
        """(id, items): the whole sets of the documents in ``ids`` (id); others that the filter lets through fall out in joins."""
        size = self.size

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, to, hashed, first in shingle_sets(batch.column(1), size):
                    raw = [hashed[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(raw, pa.binary())], ["id", "items"])

        return cut(self.rows.where(likely_in(ids, F.col("id"))).mapInArrow(released(make), "id long, items binary"), 2_000)


def _with_sets(sets: DataFrame, uses: DataFrame, hot_rows: int = 20_000, most_hot: int = 2_000) -> DataFrame:
    """(block, id, label, items): the set of each document for every block in ``uses`` (id, block, label).

    Sets of documents that a great many blocks need, such as a pivot's, go to all tasks (at most ``most_hot``); others meet their
    uses in a shuffle."""
    uses = cut(uses)
    counts = uses.groupBy("id").agg(F.count(F.lit(1)).alias("w"))
    total, most = counts.agg(F.sum("w"), F.max("w")).first()
    least = max(hot_rows, (total or 0) // most_hot)
    items = sets.groupBy("id").agg(F.min("items").alias("items")).hint("merge")
    if (most or 0) < least:
        out = uses.join(items, "id")
    else:
        hot = F.broadcast(cut(counts.where(F.col("w") >= least).select("id")))
        out = uses.join(hot, "id", "left_anti").join(items, "id").unionByName(uses.join(F.broadcast(sets.join(hot, "id", "left_semi").dropDuplicates(["id"])), "id"))
    return out.select("block", "id", "label", "items")


def _meets(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets without repeats."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def link_block(ids: list[int], labels: np.ndarray, items: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs of a block whose whole sets meet 100 * intersection >= percent * union.

    Equal labels are linked already; of links that close a circle none is listed.  All intersections of a member come from one
    count over the members that hold its items."""
    if len(ids) == 2:
        return [(ids[0], ids[1])] if labels[0] != labels[1] and _meets(items[0], items[1], percent) else []
    sizes = np.array([len(x) for x in items])
    which, code = np.unique(np.concatenate(items), return_inverse=True)
    owner = np.repeat(np.arange(len(ids)), sizes)
    by_item = owner[np.argsort(code, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(which)))])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    names, own, many = np.unique(labels, return_inverse=True, return_counts=True)
    most = int(many.argmax())
    parent, out = _labelled(labels), []
    for a in np.flatnonzero(own != most).tolist() if many[most] > 1 else range(len(ids)):
        c = code[begin[a] : begin[a + 1]]
        n = first[c + 1] - first[c]
        at = np.repeat(first[c] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        common = np.bincount(by_item[at], minlength=len(ids))
        for b in np.flatnonzero((100 * common >= percent * (sizes[a] + sizes - common)) & (own != own[a])).tolist():
            if _join(parent, a, b):
                out.append((ids[a], ids[b]))
    return out


def _link(blocks: DataFrame, percent: int, star: bool = False) -> DataFrame:
    """Links (a, b) of all blocks (block, id, label, items); of stars only those of the member of label -1 with each other one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> pa.RecordBatch:
            ids, labels, items = [h[0] for h in held], np.array([h[1] for h in held]), [h[2] for h in held]
            if star:
                found = [(ids[0], i) for i, x in zip(ids[1:], items[1:], strict=True) if _meets(items[0], x, percent)] if labels[0] == -1 else []
            else:
                found = link_block(ids, labels, items, percent) if len(held) > 1 else []
            found = np.array(found, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

        at, held = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                block, i, label = (batch.column(c)[k].as_py() for c in range(3))
                if held and block != at:
                    yield close()
                    held = []
                at = block
                if not held or held[-1][0] != i:
                    held.append((i, label, np.frombuffer(batch.column(3)[k].as_py(), np.uint64)))
        if held:
            yield close()

    order = ("block", "label", "id") if star else ("block", "id")
    return blocks.repartition(partitions(blocks.sparkSession), "block").sortWithinPartitions(*order).mapInArrow(released(run), "a long, b long")


def _relabel(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with the component of its links as every document's label."""
    parts = cut(connected_components(links).withColumnRenamed("component", "now"))
    return rows.join(parts.hint("merge"), "id", "left").withColumn("label", F.coalesce("now", "label")).drop("now")


def linked_pairs(sketches: DataFrame, texts: Texts, trees: int = TREES, leaf: int = LEAF, levels: int = LEVELS, block: int = BLOCK) -> DataFrame:
    """Links (a, b), confirmed on whole sets, that connect whatever some tree brings together and whose sets are similar enough.

    ``sketches`` (id, tokens, low) holds one row for each distinct set.  In every tree a document goes to the children that its
    node's selected minwise tokens name.  A node of up to ``leaf`` members is compared exhaustively.  In a larger one the member
    that stands in most large nodes is the pivot: all others that their sketches call likely are compared with it on whole sets,
    and what is linked gets one label.  A node with few pairs of different labels left is compared exhaustively too, one without
    any ends; the others branch, without their pivot.

    Leaves give candidates by sketch.  Candidates make clusters: one of up to ``block`` documents is compared in one place on whole
    sets; in a larger one the leaves are, which moves a set once for each tree at most.  Pairs that were never brought together by a
    tree are the only ones missed."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tokens = batch.column(0).to_numpy(), fixed_binary(batch.column(1), 4 * PATHS).view(np.uint32)
            for tree in range(trees):
                root = np.full(len(ids), mix(np.array([tree + 1], np.uint64))[0], np.uint64)
                at, child = _children(root, np.full(len(ids), tree), 0, tokens)
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(np.full(len(at), tree, np.int16)), pa.array(ids[at])], ["node", "tree", "id"])

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _alike(*(fixed_binary(batch.column(k), TOKENS) for k in (2, 3)))
            near = np.flatnonzero(s >= LIKELY)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(near)) for k in (0, 1, 4)], ["pivot", "id", "parts"])

    def branch(level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                node, tree = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
                at, child = _children(node, tree, level, fixed_binary(batch.column(4), 4 * PATHS).view(np.uint32))
                at_ = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), *(batch.column(k).take(at_) for k in (1, 2, 3))], ["node", "tree", "id", "label"])

        return run

    rows = sketches.select("id", "tokens").mapInArrow(released(grow), "node long, tree short, id long").withColumn("label", F.col("id"))
    rows = _sized(rows)
    leaves, links = [rows.where(F.col("size") <= leaf).select("node", "id", "label")], []
    large = rows.where(F.col("size") > leaf)
    tested = None
    for level in range(1, levels):
        if large.isEmpty():
            break
        seen = large.groupBy("id").agg(F.count(F.lit(1)).alias("seen"))
        pivots = large.join(seen.hint("merge"), "id").groupBy("node").agg(F.max_by("id", F.struct("seen", -F.col("id"))).alias("pivot"), F.max_by("label", F.struct("seen", -F.col("id"))).alias("own"), F.count(F.lit(1)).alias("w"))
        large = cut(skew_join(large, cut(pivots), "node", "w"))
        asked = large.where("label <> own").select("pivot", "id").distinct()
        if tested is not None:
            asked = asked.join(tested.hint("merge"), ["pivot", "id"], "left_anti")
        asked = cut(asked)
        tested = asked if tested is None else cut(tested.unionByName(asked))
        low = sketches.select("id", "low")
        weights = cut(asked.groupBy("pivot").agg(F.count(F.lit(1)).alias("w"), F.ceil(F.count(F.lit(1)) / STAR).alias("parts")))
        owns = weights.join(low.select(F.col("id").alias("pivot"), F.col("low").alias("own_low")).hint("merge"), "pivot")
        near = skew_join(asked.join(low.hint("merge"), "id"), cut(owns), "pivot", "w").select("pivot", "id", "low", "own_low", "parts").mapInArrow(released(likely), "pivot long, id long, parts long")
        near = cut(near.select("pivot", "id", F.xxhash64("pivot", F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block")))
        if not near.isEmpty():
            uses = near.select("id", "block", F.lit(0).cast("long").alias("label")).unionByName(near.select(F.col("pivot").alias("id"), "block", F.lit(-1).cast("long").alias("label")).distinct())
            links.append(cut(_link(_with_sets(texts.sets(uses.select("id").distinct()), uses), texts.percent, star=True)))
            large = _relabel(large, _all(links))
        near_done = large.where("id <> pivot").groupBy("node", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("node")
        done = near_done.agg(F.sum("n").alias("w"), ((F.pow(F.sum("n"), 2) - F.sum(F.pow("n", 2))) / 2).alias("across"))
        large = cut(skew_join(large.drop("size", "own"), cut(done.withColumn("size", F.col("w"))), "node", "w"))
        fits = (F.col("size") <= WIDE) & (F.col("across") <= ACROSS)
        leaves.append(large.where(fits & (F.col("id") != F.col("pivot")) & (F.col("across") > 0)).select("node", "id", "label"))
        large = large.where(~fits)
        rest = large.where("id <> pivot").select("node", "tree", "id", "label").join(sketches.select("id", "tokens").hint("merge"), "id").select("node", "tree", "id", "label", "tokens")
        if large.isEmpty():
            break
        rows = _sized(rest.mapInArrow(released(branch(level)), "node long, tree short, id long, label long"), written)
        leaves.append(rows.where(F.col("size") <= leaf).select("node", "id", "label"))
        large = rows.where(F.col("size") > leaf)
    small = _all(leaves)
    if not large.isEmpty():  # what no token tells apart is compared all the same, in blocks of pairs of parts
        parts = F.ceil(F.col("size") / (leaf // 2)).cast("int")
        dealt = large.withColumn("own", F.pmod(F.xxhash64("id"), parts).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), parts - 1)))
        small = small.unionByName(dealt.select(F.xxhash64("node", F.least("own", "k"), F.greatest("own", "k")).alias("node"), "id", "label"))
    if links:
        small = _relabel(small, _all(links))
    found = cut(_compare(small.join(sketches.select("id", "low").hint("merge"), "id").select("node", "id", "label", "low")))
    pairs, members = found.where("node is null").select("a", "b").distinct(), found.where("node is not null").select("node", F.col("a").alias("id"), F.col("b").alias("label"))
    clusters = cut(connected_components(pairs))
    sizes = clusters.groupBy("component").agg(F.count(F.lit(1)).alias("w"))
    sized = cut(skew_join(clusters, cut(sizes.withColumn("members", F.col("w"))), "component", "w"))
    labels = members.groupBy("id").agg(F.min("label").alias("label"))
    sets = texts.sets(sized.select("id"))
    sized = cut(sized.join(labels.hint("merge"), "id"))
    uses = sized.where(F.col("members") <= block).select("id", F.xxhash64("component").alias("block"), "label")
    wide = sized.where(F.col("members") > block)
    if not wide.isEmpty():
        uses = uses.unionByName(_wide_blocks(wide, members, block // 2))
    links.append(_link(_with_sets(sets, uses), texts.percent))
    return _all(links)


def _wide_blocks(wide: DataFrame, members: DataFrame, part: int) -> DataFrame:
    """(id, block, label): where documents of large clusters ``wide`` (id, component, members, label) meet on whole sets.

    Those of a cluster's most frequent label are linked, so the rest meets all, in pairs of parts of about ``part`` documents.
    Where that would move sets more than COPIES times, the documents meet in the leaves that made them candidates."""
    counts = wide.groupBy("component", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("component")
    main = counts.agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("w"))
    main = main.withColumn("down", F.ceil((F.col("w") - F.when(F.col("most") > 1, F.col("most")).otherwise(0)) / part).cast("int")).withColumn("across", F.ceil(F.col("w") / part).cast("int"))
    wide = cut(skew_join(wide, cut(main), "component", "w"))
    few, many = wide.where(F.col("down") <= COPIES), wide.where(F.col("down") > COPIES)
    r, c = F.pmod(F.xxhash64("id"), F.col("down")).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("across")).cast("int")
    rows = few.where((F.col("label") != F.col("main")) | (F.col("most") == 1)).withColumn("r", r).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("across") - 1)))
    columns = few.where(F.col("down") > 0).withColumn("c", c).withColumn("r", F.explode(F.sequence(F.lit(0), F.col("down") - 1)))
    parts = rows.select("id", F.xxhash64("component", "r", "c").alias("block"), "label").unionByName(columns.select("id", F.xxhash64("component", "r", "c").alias("block"), "label")).distinct()
    return parts.unionByName(members.join(many.select("id").hint("merge"), "id", "left_semi").select("id", F.col("node").alias("block"), "label"))


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 75, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row of ``docs``; component_id is the least key that links reach.

    Words are what blanks part, with A-Z lower-cased; a document's set are its distinct runs of ``size`` words, a shorter text's
    whole sequence; links join sets with 100 * intersection >= percent * union.  Documents with equal sets are one from the
    start, so groups of copies of any size cost one row.  Null and blank texts have an empty set and no link.  Rows with a null
    key have no link and a null component_id; repeated rows have the same result.  Texts are taken
    whole, a block at a time; other columns are not looked at.  An empty table gives an empty result."""
    rows = cut(sketch(docs, key, text, size))
    keyed = rows.where("id is not null")
    sets = cut(keyed.where("n > 0").groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("w")))
    first = sets.select(F.col("least").alias("id"), F.col("digest").alias("d"))
    distinct = keyed.join(first.hint("shuffle_hash"), "id").where("digest = d").dropDuplicates(["id"]).select("id", "tokens", "low")
    links = linked_pairs(cut(distinct), Texts(docs, key, text, size, percent), leaf=leaf, block=block)
    parts = connected_components(links).withColumnRenamed("id", "least")
    where = cut(sets.join(parts.hint("shuffle_hash"), "least", "left").select("digest", F.coalesce("component", "least").alias("component"), "w"))
    linked = skew_join(rows.select("id", "n", "digest"), where, "digest", "w", how="left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    return linked.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id").isNull() | (F.col("id") == component)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """One row of each group stays: ``docs`` without the rows whose component has a smaller key; columns stay as they are."""
    return without(docs, near_duplicates(docs, key, **how).where("not kept").select(F.col(key).alias("id")), key)
