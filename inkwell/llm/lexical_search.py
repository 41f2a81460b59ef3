"""Ranked lexical search over posting lists with range-maximum tables (operator 11).

The index keeps, for each block of documents, the postings of the queries' terms.  A segment of it has one posting list for each
term, in order of documents, and a sparse table of range maxima over all lists.  An item is searched best first: the interval of
documents with the largest bound (the sum of its terms' range maxima) is split at the document where its largest term peaks."""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import ensure_checkpoints, released
from inkwell.llm.decontaminate import ranges, words_of

#: Text of the items that one pass takes, text behind a row of the index, postings of a segment, postings of an interval that are read out whole, intervals split at once.
ITEM_BYTES, BLOCK_TEXT, SEGMENT, LEAF, AT_ONCE = 4_000_000, 4_000_000, 1_000_000, 512, 64
INDEX = "docs binary, sizes binary, doc binary, term binary, tf binary"
#: rows of the statistics that aren't terms
_DOCS, _WORDS = -1, -2


def index_blocks(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of the index: ids and sizes of the documents that have a term, and (document, term, occurrences) of the vocabulary's terms."""
    for batch in batches:
        keys, text = batch.column(0).cast(pa.int64()), batch.column(1)
        for at, to, hashes, first in words_of(text, BLOCK_TEXT):
            own = keys.slice(at, to - at)
            sizes = np.diff(first)
            there = np.flatnonzero((sizes > 0) & ~np.asarray(own.is_null()))
            if not len(there):
                continue
            number = np.full(to - at, -1)
            number[there] = np.arange(len(there))
            doc = np.repeat(number, sizes)
            term = np.minimum(np.searchsorted(vocabulary, hashes), max(len(vocabulary) - 1, 0))
            hit = (doc >= 0) & (vocabulary[term] == hashes) if len(vocabulary) else np.zeros(len(hashes), bool)
            pairs, tf = np.unique(doc[hit] * max(len(vocabulary), 1) + term[hit], return_counts=True)
            doc, term = np.divmod(pairs, max(len(vocabulary), 1))
            columns = (own.take(pa.array(there)).to_numpy(), sizes[there].astype(np.int32), doc.astype(np.int32), term.astype(np.int32), tf.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], ["docs", "sizes", "doc", "term", "tf"])


def _counts(batches: Iterator[pa.RecordBatch], terms: int) -> Iterator[pa.RecordBatch]:
    """(term, documents) of a partition of the index, and under negative numbers how many documents and words it has."""
    df, docs, words = np.zeros(terms, np.int64), 0, 0
    for batch in batches:
        for sizes, term in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            df += np.bincount(np.frombuffer(term, np.int32), minlength=terms)
            n = np.frombuffer(sizes, np.int32)
            docs, words = docs + len(n), words + int(n.sum(dtype=np.int64))
    held = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(held, [_DOCS, _WORDS])), pa.array(np.append(df[held], [docs, words]))], ["term", "n"])


class Segment:
    """Posting lists of some documents, sorted by term and document, with a sparse table of the places of range maxima."""

    def __init__(self, rows: list[dict], weights: np.ndarray, n_docs: int, n_words: int):
        read = lambda c, kind: [np.frombuffer(r[c], kind) for r in rows]
        docs, sizes, base = read("docs", np.int64), np.concatenate(read("sizes", np.int32)).astype(np.int64), np.cumsum([0, *(len(r["docs"]) // 8 for r in rows)])
        order = np.argsort(np.concatenate(docs), kind="stable")
        self.ids = np.concatenate(docs)[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        doc = place[np.concatenate([d + b for d, b in zip(read("doc", np.int32), base, strict=False)])]
        term, tf = np.concatenate(read("term", np.int32)).astype(np.int64), np.concatenate(read("tf", np.int32)).astype(np.int64)
        by = np.argsort(term * len(order) + doc)
        self.doc, self.term = doc[by], term[by]
        #: where a term's posting for a document is or would be, by binary search
        self.keys = self.term * len(order) + self.doc
        small = 75 * int(sizes.max(initial=0)) * n_docs < 2**63
        m = 25 + ((75 * sizes * n_docs) // n_words if small else np.array([75 * n * n_docs // n_words for n in sizes.tolist()], np.int64))
        self.impact = weights[self.term] * ((1_000_000_000 * tf[by]) // (1000 * tf[by] + 8 * m[order][self.doc]))
        self.bounds = np.searchsorted(self.term, np.arange(len(weights) + 1))
        self.table = [np.arange(len(self.doc), dtype=np.int32)]
        longest = int(np.diff(self.bounds).max(initial=0))
        while 2 << (len(self.table) - 1) <= longest:
            last, half = self.table[-1], 1 << (len(self.table) - 1)
            a, b = last[: len(last) - half], last[half:]
            self.table.append(np.where(self.impact[a] >= self.impact[b], a, b))
        self.lengths = np.array([len(t) for t in self.table])
        self.table = np.concatenate(self.table)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.sums = np.zeros(len(self.ids), np.int64)

    def peaks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(largest impact, its place) of the postings in each range; an empty range has none."""
        some = b > a
        n = np.where(some, b - a, 1)
        level = np.frexp(n)[1] - 1
        low = np.where(some, a, 0)
        left, right = self.table[self.starts[level] + low], self.table[self.starts[level] + np.where(some, b - (1 << level), 0)]
        best = np.where(self.impact[left] >= self.impact[right], left, right)
        return np.where(some, self.impact[best], 0), best


class Best:
    """An item's best documents so far: scores, ids; ``floor`` is what a further one must beat, or equal with an id below ``last``."""

    def __init__(self, top: int):
        self.top, self.floor, self.last = top, 0, None
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def may_enter(self, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return (scores > self.floor) if self.last is None else (scores > self.floor) | ((scores == self.floor) & (ids < self.last))

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = self.may_enter(scores, ids)
        if not good.any():
            return
        scores, ids = np.concatenate([self.scores, scores[good]]), np.concatenate([self.ids, ids[good]])
        order = np.lexsort((ids, -scores))[: self.top]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.top:
            self.floor, self.last = int(self.scores[-1]), int(self.ids[-1])


def search_segment(segment: Segment, terms: np.ndarray, times: np.ndarray, best: Best) -> None:
    """Bring ``best`` up to date with a segment's documents for an item of these terms, each so many times."""
    there = segment.bounds[terms + 1] > segment.bounds[terms]
    terms, times = terms[there], times[there]
    if not len(terms):
        return
    docs, count = len(segment.ids), 0
    heap: list[tuple] = []

    def put(a: np.ndarray, b: np.ndarray, low: np.ndarray) -> None:
        nonlocal count
        top, place = segment.peaks(a, b)
        top = top * times
        bound = top.sum(axis=1)
        for i in np.flatnonzero((bound > 0) & best.may_enter(bound, segment.ids[np.minimum(low, docs - 1)])).tolist():
            heapq.heappush(heap, (-int(bound[i]), int(low[i]), count, a[i], b[i], int(place[i, top[i].argmax()])))
            count += 1

    put(segment.bounds[terms][None, :], segment.bounds[terms + 1][None, :], np.zeros(1, np.int64))
    take = 1
    while heap:
        popped = []
        while heap and len(popped) < take:
            bound, low, _, a, b, peak = heapq.heappop(heap)
            if not best.may_enter(np.int64(-bound), segment.ids[low]):
                if -bound < best.floor:  # all others are bounded by less
                    heap.clear()
                continue
            popped.append((low, a, b, peak))
        if not popped:
            break
        take = min(2 * take, AT_ONCE)
        low, peak = np.array([p[0] for p in popped]), np.array([p[3] for p in popped])
        a, b = np.stack([p[1] for p in popped]), np.stack([p[2] for p in popped])
        leaf = (b - a).sum(axis=1) <= LEAF
        if leaf.any():
            which, at = ranges(a[leaf].ravel(), b[leaf].ravel())
            doc = segment.doc[at]
            np.add.at(segment.sums, doc, segment.impact[at] * np.tile(times, int(leaf.sum()))[which])
            score = segment.sums[doc]
            good = np.unique(doc[best.may_enter(score, segment.ids[doc])])
            best.offer(segment.sums[good], segment.ids[good])
            segment.sums[doc] = 0
        if not leaf.all():
            a, b, low, at_doc = a[~leaf], b[~leaf], low[~leaf], segment.doc[peak[~leaf]]
            wanted = terms[None, :] * docs + at_doc[:, None]
            place = np.searchsorted(segment.keys, wanted)
            held = segment.keys[np.minimum(place, len(segment.keys) - 1)] == wanted
            best.offer(np.where(held, segment.impact[np.minimum(place, len(segment.keys) - 1)] * times, 0).sum(axis=1), segment.ids[at_doc])
            put(a, place, low)
            put(place + held, b, at_doc + 1)


def _segments(batches: Iterator[pa.RecordBatch], *how) -> Iterator[Segment]:
    held, postings = [], 0
    for batch in batches:
        for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
            more = len(row["doc"]) // 4
            if held and postings + more > SEGMENT:
                yield Segment(held, *how)
                held, postings = [], 0
            held.append(row)
            postings += more
    if held:
        yield Segment(held, *how)


def _search(batches: Iterator[pa.RecordBatch], items: list[tuple[np.ndarray, np.ndarray]], top: int, how: tuple) -> Iterator[pa.RecordBatch]:
    """(item number, document, score): a partition's best documents of each item; what one segment finds bars the next one's intervals."""
    best = [Best(top) for _ in items]
    for segment in _segments(batches, *how):
        for found, (terms, times) in zip(best, items, strict=True):
            search_segment(segment, terms, times, found)
    sizes = [len(b.ids) for b in best]
    if sum(sizes):
        number = np.repeat(np.arange(len(items)), sizes)
        yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(np.concatenate([b.ids for b in best])), pa.array(np.concatenate([b.scores for b in best]))], ["number", "doc_id", "score"])


def _search_block(docs: DataFrame, items: list[tuple[int, str]], top: int) -> DataFrame:
    spark = docs.sparkSession
    sc = spark.sparkContext
    hashed = [next(words_of(pa.array([t or ""])), (0, 0, np.zeros(0, np.uint64), None))[2] for _, t in items]
    vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashed]))
    held = sc.broadcast(vocabulary)
    folder = f"{ensure_checkpoints(spark)}/index-{uuid.uuid4().hex}"
    docs.mapInArrow(released(lambda batches: index_blocks(batches, held.value)), INDEX).write.parquet(folder)
    index = spark.read.schema(INDEX).parquet(folder)
    terms = len(vocabulary)
    counted = index.select("sizes", "term").mapInArrow(released(lambda batches: _counts(batches, terms)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    count = dict(zip(counted.column("term").to_pylist(), counted.column("n").to_pylist(), strict=True))
    n_docs, n_words = count.pop(_DOCS, 0), count.pop(_WORDS, 0)
    weights = np.zeros(terms, np.int64)
    for term, df in count.items():
        weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    wanted = []
    for own in hashed:
        unique, times = np.unique(own, return_counts=True)
        at = np.searchsorted(vocabulary, unique)
        good = weights[at] > 0
        wanted.append((at[good], times[good]))
    sent = sc.broadcast((wanted, weights, n_docs, n_words))
    found = index.mapInArrow(released(lambda batches: _search(batches, sent.value[0], top, sent.value[1:])), "number long, doc_id long, score long")
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(items)], "number long, item_id long")
    order = Window.partitionBy("number").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(names), "number").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = 10, key: str = "doc_id", item: str = "item_id", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item, rank, key, score): for each row of ``items`` the ``top`` documents of highest score above 0, equal scores by ascending key.

    Terms are the runs of digits, letters A to Z (in lower case) and code points beyond ASCII.  A term in df of N documents weighs
    floor(1000 ln((2N+2)/(2df+1))); a document of n terms, of L in all, has m = 25 + 75nN div L and gets, for each term of the item,
    repeats included, weight * (10^9 tf div (1000 tf + 8m)).  All counts are over all documents, integers throughout.

    The items, the stated query set, are measured and go out in blocks of about ``item_bytes`` of text, one pass over the documents
    for each.  The index (postings of a block's terms) stands in the checkpoint folder; nothing of the documents is shuffled but
    each partition's best ones, and only counts by term come to the driver.  Terms are compared by 64-bit hashes.

    Null and empty texts have no terms; rows with a null key are no documents; rows that repeat a key are documents each, items that
    repeat an id are searched each.  Texts are taken whole.  Without documents, items or common terms the result is empty; other
    columns are not looked at."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), "text")
    asked = items.select(F.col(item).cast("long").alias("item_id"), "text").where("text is not null")
    blocks = max(1, -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // item_bytes))
    out = None
    for b in range(blocks):
        own = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b)
        found = _search_block(rows, sorted(map(tuple, own.collect()), key=str), top)
        out = found if out is None else out.unionByName(found)
    return out.withColumnsRenamed({"item_id": item, "doc_id": key})
