"""Benchmark decontamination with suffix arrays over shards of the training text (operator 8)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import lower_ascii, released, text_blocks, without, word_hashes, word_spans

#: What parts words: every ASCII character but letters and digits (after lower-casing also A-Z can't occur).
_PARTS = np.zeros(256, dtype=bool)
_PARTS[:128] = True
_PARTS[48:58] = False
_PARTS[97:123] = False
WINDOW, SHARD_BYTES, BENCHMARK_BYTES = 13, 8_000_000, 4_000_000
MATCH = "array<struct<item_id:long,item_word:int,doc_word:int,words:int>>"
RESULT = f"doc_id long, n_words long, hit_words array<int>, items array<long>, matches {MATCH}"


def words_of(column: pa.Array, size: int = SHARD_BYTES):
    """(first row, row after the last, word hashes, first word of each row and one more) of runs of rows of about ``size`` bytes.

    Words are hashed a small block at a time, so that a shard costs little more than its hashes."""
    held: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    begin, taken = 0, 0
    for _, to, data, offs in text_blocks(column):
        data = lower_ascii(data)
        starts, ends, first = word_spans(data, offs, _PARTS)
        held.append(word_hashes(data, starts, ends))
        counts.append(np.diff(first))
        taken += len(data)
        if taken >= size or to == len(column):
            yield begin, to, np.concatenate(held), np.concatenate([[0], np.cumsum(np.concatenate(counts))])
            held, counts, begin, taken = [], [], to, 0


class TestSuffixes:
    """The benchmark's side: a vocabulary, and the windows of all items as packed keys, each distinct one once, with its owners."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW):
        hashed = [(i, next(words_of(pa.array([t or ""])), (0, 0, np.zeros(0, np.uint64), None))[2]) for i, t in items if i is not None]
        hashed = [(i, h) for i, h in hashed if len(h)]
        self.window = window
        self.vocabulary = np.unique(np.concatenate([h for _, h in hashed])) if hashed else np.zeros(0, np.uint64)
        self.items = np.array([i for i, _ in hashed], np.int64)
        self.bits = max(1, int(len(self.vocabulary)).bit_length())
        self.shortest = min([min(window, len(h)) for _, h in hashed], default=0)
        #: for each width of windows: (width, their keys, first owner of each and one more, owners' items, owners' offsets)
        self.windows: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        sizes = np.array([len(h) for _, h in hashed], np.int64)
        widths = np.minimum(sizes, window)
        flat = np.concatenate([self.encode(h) for _, h in hashed]) if hashed else np.zeros(0, np.int64)
        begin = np.cumsum(sizes) - sizes
        for width in np.unique(widths).tolist():
            which = np.flatnonzero(widths == width)
            count = sizes[which] - width + 1
            item = np.repeat(which, count)
            offset = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            keys = self.pack(np.append(flat, 0), begin[item] + offset, width)
            order = np.lexsort(keys.T[::-1])
            new = np.flatnonzero(np.append(True, (keys[order][1:] != keys[order][:-1]).any(axis=1)))
            self.windows.append((width, keys[order[new]], np.append(new, len(order)), item[order], offset[order]))

    def encode(self, hashes: np.ndarray) -> np.ndarray:
        """Word ids from 1; 0 for a word that no item holds."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def pack(self, ids: np.ndarray, places: np.ndarray, width: int, pad: int = 0) -> np.ndarray:
        """The first ``width`` words from each place as rows of numbers that compare as the words do; ``pad`` fills a window."""
        per = 64 // self.bits
        out = np.zeros((len(places), -(-self.window // per)), np.uint64)
        for k in range(self.window):
            word = ids[np.minimum(places + k, len(ids) - 1)].astype(np.uint64) if k < width else np.uint64(pad)
            out[:, k // per] |= word << np.uint64(self.bits * (per - 1 - k % per))
        return out

    def last(self, keys: np.ndarray, width: int) -> np.ndarray:
        """The largest key of a window that begins with the ``width`` words of each."""
        return keys | self.pack(np.zeros(1, np.int64), np.zeros(1, np.int64), width, (1 << self.bits) - 1)


def suffix_array(ids: np.ndarray, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
    """(places of the shard's suffixes in order, their keys).

    ``ids`` has a 0 after every document and for words that no item holds, so no match runs past either.  Suffixes are compared by
    as many words as a window has; those that meet a 0 before the shortest window's end can't hold one and are left out."""
    if not tests.shortest:
        return np.zeros(0, np.int64), np.zeros((0, 1), np.uint64)
    stops = np.append(np.flatnonzero(ids == 0), len(ids))
    places = np.flatnonzero(ids > 0)
    places = places[stops[np.searchsorted(stops, places)] - places >= tests.shortest]
    keys = tests.pack(np.append(ids, 0), places, tests.window)
    order = np.lexsort(keys.T[::-1])
    return places[order], keys[order]


def search(keys: np.ndarray, wanted: np.ndarray, after: bool) -> np.ndarray:
    """For each wanted key the number of sorted keys before it (or, with ``after``, not behind it): binary searches, all at once."""
    lo, hi = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(keys))
    while (lo < hi).any():
        mid = np.minimum((lo + hi) >> 1, max(len(keys) - 1, 0))
        less, same = np.zeros(len(wanted), bool), np.ones(len(wanted), bool)
        for c in range(wanted.shape[1]):
            have = keys[mid, c]
            less |= same & (have < wanted[:, c])
            same &= have == wanted[:, c]
        go = (less | (same & after)) & (lo < hi)
        lo, hi = np.where(go, mid + 1, lo), np.where(go | (lo >= hi), hi, mid)
    return lo


def ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, number in it) of all numbers in consecutive ranges."""
    n = end - begin
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + begin[which]


def search_shard(ids: np.ndarray, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
    """(whether each word of the shard is in an occurrence of a window, the longest matches: place, words, item number, offset)."""
    places, keys = suffix_array(ids, tests)
    cover = np.zeros(len(ids) + 1, np.int32)
    found = [np.zeros((0, 4), np.int64)]
    for width, wanted, first, item, offset in tests.windows if len(places) else []:
        lo, hi = search(keys, wanted, False), search(keys, tests.last(wanted, width), True)
        window, at = ranges(lo, hi)
        place = places[at]
        np.add.at(cover, place, 1)
        np.add.at(cover, place + width, -1)
        k, owner = ranges(first[window], first[window + 1])
        found.append(np.stack([place[k], np.full(len(k), width), item[owner], offset[owner]], axis=1))
    hits = np.concatenate(found)
    # windows that follow one another on one diagonal of an item are one longest match
    hits = hits[np.lexsort((hits[:, 0], hits[:, 0] - hits[:, 3], hits[:, 2]))]
    follows = (hits[1:, 2] == hits[:-1, 2]) & (hits[1:, 0] == hits[:-1, 0] + 1) & (hits[1:, 3] == hits[:-1, 3] + 1)
    begins = np.flatnonzero(np.append(True, ~follows)) if len(hits) else np.zeros(0, np.int64)
    ends = np.append(begins[1:], len(hits))[: len(begins)] - 1
    matches = hits[begins]
    matches[:, 1] = hits[ends, 0] + hits[ends, 1] - matches[:, 0]
    return np.cumsum(cover[:-1]) > 0, matches


def scan(batches: Iterator[pa.RecordBatch], blocks: list[TestSuffixes]) -> Iterator[pa.RecordBatch]:
    """For each row what any block of the benchmark finds in it."""
    for batch in batches:
        keys_of = batch.column(0)
        for at, to, hashes, first in words_of(batch.column(1)):
            rows = to - at
            row = np.repeat(np.arange(rows), np.diff(first))
            spot = np.arange(len(row)) + row  # a 0 follows every row's words
            hit = np.zeros(len(row) + rows, dtype=bool)
            found = [np.zeros((0, 4), np.int64)]
            for tests in blocks:
                ids = np.zeros(len(row) + rows, np.int64)
                ids[spot] = tests.encode(hashes)
                own, matches = search_shard(ids, tests)
                hit |= own
                matches[:, 2] = tests.items[matches[:, 2]]
                found.append(matches)
            all_matches = np.concatenate(found)
            begin = first[:-1] + np.arange(rows)
            owner = np.searchsorted(begin, all_matches[:, 0], side="right") - 1
            order = np.lexsort((all_matches[:, 3], all_matches[:, 0], all_matches[:, 2], owner))
            all_matches, owner = all_matches[order], owner[order]
            at_row = np.searchsorted(owner, np.arange(rows + 1))
            words = np.flatnonzero(hit[spot])
            word_row = row[words]
            hit_words = pa.ListArray.from_arrays(pa.array(np.searchsorted(word_row, np.arange(rows + 1)).astype(np.int32)), pa.array((words - first[word_row]).astype(np.int32)))
            items = [np.unique(all_matches[a:b, 2]).tolist() if b > a else [] for a, b in zip(at_row[:-1].tolist(), at_row[1:].tolist(), strict=True)]
            pieces = pa.StructArray.from_arrays([pa.array(all_matches[:, 2]), pa.array(all_matches[:, 3].astype(np.int32)), pa.array((all_matches[:, 0] - begin[owner]).astype(np.int32)), pa.array(all_matches[:, 1].astype(np.int32))], ["item_id", "item_word", "doc_word", "words"])
            listed = pa.ListArray.from_arrays(pa.array(at_row.astype(np.int32)), pieces)
            yield pa.RecordBatch.from_arrays([keys_of.slice(at, rows).cast(pa.int64()), pa.array(np.diff(first), pa.int64()), hit_words, pa.array(items, pa.list_(pa.int64())), listed], ["doc_id", "n_words", "hit_words", "items", "matches"])


def find_contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", window: int = WINDOW, block_bytes: int = BENCHMARK_BYTES) -> DataFrame:
    """(key, n_words, hit_words, items, matches, n_hit, contaminated) for every row of ``docs``.

    Every task builds a suffix array over each shard of about 8 MB of its documents and binary-searches all test windows in it;
    windows in a row make up the longest verbatim matches (item, place in the item, place in the document, words).  Nothing of
    the documents is shuffled.  The benchmark is the stated query set: it's measured first and sent out in blocks of at most
    about ``block_bytes``; each row meets all blocks where it is.

    Null text has no words.  Items without words or without an id match nothing; items of one id count once.  Without items
    no document is contaminated.  Null keys and repeated rows have results like any other; an empty table gives an empty result;
    other columns are not looked at."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), "text")
    sc, held = docs.sparkSession.sparkContext, []
    for b in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        held.append(sc.broadcast(TestSuffixes([tuple(r) for r in own.collect()], window)))
    out = rows.mapInArrow(released(lambda batches: scan(batches, [h.value for h in held])), RESULT)
    out = out.withColumn("n_hit", F.size("hit_words").cast("long"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).withColumnRenamed("doc_id", key)


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """``docs`` without the rows that are contaminated; columns stay as they are.

    Rows with a null key stay; rows that share a key with a contaminated one go with it; an empty table stays empty."""
    return without(docs, find_contamination(docs, benchmark, key, **how).where("contaminated").select(F.col(key).alias("id")), key)


def items_digest(ids: list[int]) -> str:
    """What the digest column holds, for tests: ids sorted as strings and joined by commas."""
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
