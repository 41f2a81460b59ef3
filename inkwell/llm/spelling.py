"""Spelling variants by Bloom-guided neighbourhoods (operator 12).

Every vocabulary word's edits are generated and probed against blocked Bloom filters, one for each word length; only those that
a filter lets pass are shuffled to a join with the vocabulary, which removes the filters' false positives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import cut, mix, powers, released

#: Bits of a filter for each word, the most bytes of all filters together (they only let more pass where that is too little), and probes taken at once.
BITS_PER_WORD, FILTER_BYTES, PROBES = 16, 32_000_000, 1_000_000
_BLOCK = 8  # 64-bit words of a block; a key sets one bit in each


def count_words(words: DataFrame, word: str = "word", min_chars: int = 1, min_count: int = 1) -> DataFrame:
    """(word, n): distinct words of at least ``min_chars`` code points with at least ``min_count`` rows; null words are none."""
    counted = words.where(F.char_length(word) >= min_chars).groupBy(F.col(word).alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= min_count)


class LengthFilters:
    """Blocked Bloom filters in one array, a range of blocks for each word length."""

    def __init__(self, counts: dict[int, int], bits_per_word: int = BITS_PER_WORD, most_bytes: int = FILTER_BYTES):
        total = sum(counts.values()) * bits_per_word / 8
        share = min(1.0, most_bytes / max(total, 1))
        self.blocks = {length: max(1, int(n * bits_per_word * share) // (64 * _BLOCK)) for length, n in sorted(counts.items())}
        starts = np.cumsum([0, *self.blocks.values()])
        self.first = dict(zip(self.blocks, starts[:-1].tolist(), strict=True))
        self.size = int(starts[-1]) * _BLOCK
        self.words = np.zeros(0, np.uint64)

    def slots(self, hashed: np.ndarray, length: int) -> np.ndarray:
        """The first word of each key's block."""
        block = ((hashed >> np.uint64(32)) * np.uint64(self.blocks[length])) >> np.uint64(32)
        return (block.astype(np.int64) + self.first[length]) * _BLOCK

    @staticmethod
    def bits(hashed: np.ndarray, k: int) -> np.ndarray:
        return (hashed * np.uint64(2 * (0x9E3779B1 + 0x61C88647 * k) + 1)) >> np.uint64(58)

    def passes(self, hashed: np.ndarray, length: int) -> np.ndarray:
        """Numbers of the keys that may be words of this length; most others leave after one or two of the eight tests."""
        if length not in self.blocks:
            return np.zeros(0, np.int64)
        left, slots = np.arange(len(hashed)), self.slots(hashed, length)
        for k in range(_BLOCK):
            keep = np.flatnonzero((self.words[slots + k] >> self.bits(hashed, k)) & np.uint64(1))
            left, slots, hashed = left[keep], slots[keep], hashed[keep]
        return left


def _by_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of code points) of the words of one length, for each length."""
    texts = np.array(words.to_pylist(), dtype=object)
    sizes = np.array([len(t) for t in texts], np.int64)
    for length in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == length)
        step = max(1, PROBES // length)
        for at in range(0, len(rows), step):
            own = rows[at : at + step]
            yield own, np.frombuffer("".join(texts[own]).encode("utf-32-le"), np.uint32).reshape(len(own), length)


def _prefixes(points: np.ndarray) -> np.ndarray:
    """Prefix sums of each word's polynomial hash."""
    out = np.zeros((len(points), points.shape[1] + 1), np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * powers(points.shape[1]), axis=1, out=out[:, 1:], dtype=np.uint64)
    return out


def _fill(batches: Iterator[pa.RecordBatch], filters: LengthFilters) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, points in _by_length(batch.column(0)):
            hashed = mix(_prefixes(points)[:, -1])
            slots = filters.slots(hashed, points.shape[1])
            at = np.concatenate([slots + k for k in range(_BLOCK)])
            bits = np.concatenate([np.uint64(1) << filters.bits(hashed, k) for k in range(_BLOCK)])
            order = np.argsort(at, kind="stable")
            at, first = np.unique(at[order], return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.bitwise_or.reduceat(bits[order], first).view(np.int64))], ["slot", "bits"])


def build_filters(vocabulary: DataFrame, bits_per_word: int = BITS_PER_WORD, most_bytes: int = FILTER_BYTES) -> LengthFilters:
    """The filters of all words: bits are gathered where the words are, joined by ``bit_or``, and no more than ``most_bytes`` come back."""
    counts = {r.length: r.n for r in vocabulary.groupBy(F.char_length("word").alias("length")).agg(F.count(F.lit(1)).alias("n")).collect()}
    filters = LengthFilters(counts, bits_per_word, most_bytes)
    filled = vocabulary.select("word").mapInArrow(released(lambda batches: _fill(batches, filters)), "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    filters.words = np.zeros(filters.size, np.uint64)
    filters.words[filled.column("slot").to_numpy()] = filled.column("bits").to_numpy().view(np.uint64)
    return filters


def _texts(points: np.ndarray) -> list[str]:
    """The rows of a matrix of code points as strings."""
    width = points.shape[1]
    joined = np.ascontiguousarray(points.astype(np.uint32)).tobytes().decode("utf-32-le")
    return [joined[i * width : (i + 1) * width] for i in range(len(points))]


def _edits(points: np.ndarray, alphabet: np.ndarray, filters: LengthFilters) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(row, edited word) of every deletion, and every replacement by a larger code point, that a filter lets pass.

    An insertion is the other word's deletion and a replacement by a smaller code point the other's by a larger one, so each
    near pair is met, and met from one side."""
    rows, length = points.shape
    prefix = _prefixes(points)
    whole, power = prefix[:, -1:], powers(length)
    if length - 1 in filters.blocks:
        inverse = powers(2, inverse=True)[1]
        # of neighbours that are equal the first is dropped alone, for each gives the same word
        first = np.ones(points.shape, bool)
        first[:, 1:] = points[:, 1:] != points[:, :-1]
        row, at = np.nonzero(first)
        hashed = mix(prefix[row, at] + (whole[row, 0] - prefix[row, at + 1]) * inverse)
        good = filters.passes(hashed, length - 1)
        if len(good):
            row, at = row[good], at[good]
            keep = np.arange(length)[None, :] != at[:, None]
            yield row, _texts(points[row][keep].reshape(len(row), length - 1))
    step = max(1, PROBES // (rows * len(alphabet)))
    for begin in range(0, length, step):
        own = points[:, begin : begin + step].astype(np.int64)
        row, at, letter = np.nonzero(alphabet[None, None, :] > own[:, :, None])
        change = (alphabet[letter] - own[row, at]).astype(np.uint64)
        hashed = mix(whole[row, 0] + change * power[begin + at])
        good = filters.passes(hashed, length)
        if len(good):
            changed = points[row[good]].copy()
            changed[np.arange(len(good)), begin + at[good]] = alphabet[letter[good]]
            yield row[good], _texts(changed)


def _probe(batches: Iterator[pa.RecordBatch], alphabet: np.ndarray, filters: LengthFilters) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, counts = batch.column(0), batch.column(1)
        for rows, points in _by_length(words):
            step = max(1, PROBES // (points.shape[1] * len(alphabet)))
            for at in range(0, len(rows), step):
                for row, texts in _edits(points[at : at + step], alphabet, filters):
                    own = pa.array(rows[at : at + step][row])
                    yield pa.RecordBatch.from_arrays([words.take(own), counts.take(own), pa.array(texts, pa.string())], ["word", "n", "near"])


def near_words(vocabulary: DataFrame, bits_per_word: int = BITS_PER_WORD, most_bytes: int = FILTER_BYTES) -> DataFrame:
    """(word, n, near, near_n): each pair of vocabulary words (word, n) that differ by one inserted, deleted or replaced code point, once.

    The filters, of at most ``most_bytes`` whatever the vocabulary, are sent to all tasks; the code points in use are, too."""
    points = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct().collect()
    alphabet = np.array(sorted(ord(r.c) for r in points), np.int64)
    sc = vocabulary.sparkSession.sparkContext
    held = sc.broadcast((alphabet, build_filters(vocabulary, bits_per_word, most_bytes)))
    probed = vocabulary.select("word", "n").mapInArrow(released(lambda batches: _probe(batches, *held.value)), "word string, n long, near string")
    return probed.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")).hint("merge"), "near").select("word", "n", "near", "near_n")


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) for rows (word, form) that lead to no cycle: forms are followed to their end, twice as far in each round."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = cut(now.join(on.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("went_on")))
        now = moved.select("word", "root")
        if moved.where("went_on").isEmpty():
            return now


def spelling_variants(vocabulary: DataFrame, ratio: int = 5, bits_per_word: int = BITS_PER_WORD, most_bytes: int = FILTER_BYTES) -> DataFrame:
    """(word, n, form, form_n, root, n_near) for every vocabulary row (word, n).

    A word's form is the near word with the largest n, of equal ones the smallest in code-point order, where that n is at least
    ``ratio`` (2 or more) times the word's own; root is where forms end.  A word without a form is its own root.

    Words must be distinct, as ``count_words`` gives them; null and empty words have no near words; other columns are not looked at;
    words of any length are taken whole, a block of edits at a time; an empty vocabulary gives an empty result."""
    vocabulary = cut(vocabulary.select("word", F.col("n").cast("long").alias("n")))
    links = near_words(vocabulary.where("word <> ''"), bits_per_word, most_bytes)
    both = F.array(F.struct("word", "near", F.col("near_n").alias("m")), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("m")))
    sides = links.select(F.explode(both).alias("e")).select("e.*")
    best = sides.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    fits = -F.col("best.m") >= ratio * F.col("n")
    out = vocabulary.join(best.hint("merge"), "word", "left").select("word", "n", F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.m")).alias("form_n"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))
    out = cut(out)
    roots = last_forms(out.where("form is not null"))
    return out.join(roots.hint("merge"), "word", "left").select("word", "n", "form", "form_n", F.coalesce("root", "word").alias("root"), "n_near")
