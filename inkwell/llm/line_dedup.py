"""Fuzzy line removal with SimHash, pigeonhole blocks of its bits and pigeonhole choices of words (operator 3)."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import binary_rows, by_bucket, connected_components, cut, ensure_checkpoints, fresh, in_slices, likely_in, lower_ascii, mix, pack, packed_schema, partitions, powers, released, skew_join, text_blocks, unpack, whole_groups, word_hashes, word_spans

MIN_WORDS, HAMMING, SIMILARITY = 5, 3, 0.8
_PARTS = np.zeros(256, dtype=bool)
_PARTS[:128] = True
_PARTS[48:58] = False
_PARTS[97:123] = False
_DIGIT = np.arange(256, dtype=np.uint8)
_DIGIT[48:58] = 48
#: Five blocks of the 64 bits; two signatures at most three bits apart agree on at least two of them.
BLOCKS = ((0, 13), (13, 26), (26, 39), (39, 52), (52, 64))
#: Of a line's LEAST_WORDS least words in one order for all lines, every CHOICE of them is a key: two lines that differ in at
#: most two words (replaced, put in or left out) always share one, since at least three of either's five are the other's too.
LEAST_WORDS, CHOICE, COUNT_BITS = 5, 3, 16
#: Edits that are tried for first.
NARROW = 30
#: Groups of candidates up to this size are compared pair by pair; larger ones with a few leaders first.
PAIRWISE = 8
#: Members of large groups that one task compares with as many others, and classes of characters that are counted before.
BLOCK, BINS = 1_000, 61


def lines_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, number in its text, start, end) of every line of a block of texts, blank ones too; \\n parts lines."""
    begin = np.concatenate([offs[:-1], np.flatnonzero(data == 10) + 1])
    row = np.concatenate([np.arange(len(offs) - 1), np.searchsorted(offs, begin[len(offs) - 1 :] - 1, side="right") - 1])
    order = np.lexsort((begin, row))
    begin, row = begin[order], row[order]
    last = np.append(row[1:] != row[:-1], True)
    end = np.where(last, offs[row + 1], np.append(begin[1:], 0) - 1)
    first = np.searchsorted(row, np.arange(len(offs) - 1))
    return row, np.arange(len(row)) - first[row], begin, end


def simhash(features: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64-bit SimHash of consecutive groups of features (none empty): bit b is set where more than half have it set.

    Eight counters of eight bits ride in one word; groups of more than 255 features are summed in segments."""
    sizes = np.diff(first)
    segments = -(-sizes // 255)
    owner = np.cumsum(segments) - segments
    starts = np.repeat(first[:-1], segments) + 255 * (np.arange(int(segments.sum())) - np.repeat(owner, segments))
    out = np.zeros(len(sizes), np.uint64)
    for k in range(8):
        lanes = np.add.reduceat((features >> np.uint64(k)) & np.uint64(0x0101010101010101), starts)
        for byte in range(8):
            counts = np.add.reduceat(((lanes >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.int64), owner)
            out |= (2 * counts > sizes).astype(np.uint64) << np.uint64(8 * byte + k)
    return out


def _words(column: pa.Array, least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, line number, first word, word after the last, word hashes, characters before each word's end) of blocks of texts."""
    for at, _, data, offs in text_blocks(column):
        row, number, begin, end = lines_of(data, offs)
        text = _DIGIT[lower_ascii(data)]
        starts, ends, _ = word_spans(text, offs, _PARTS)
        lo, hi = np.searchsorted(starts, begin), np.searchsorted(starts, end)
        good = hi - lo >= least
        if good.any():
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            size = np.concatenate([[0], np.cumsum(chars[ends] - chars[starts])])
            yield at + row[good], number[good], lo[good], hi[good], word_hashes(text, starts, ends), size


def word_classes(rows: DataFrame, least: int = MIN_WORDS) -> np.ndarray:
    """The logarithm of the number of words in lines under each 16-bit beginning of the hash, no less than twice the median's.

    It puts rare words first in the order of words.  Any such table gives the same pairs within two words, only in groups of other sizes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            for _, _, _, _, words, _ in _words(batch.column(0), least):
                held += np.bincount((words >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=len(held))
        place = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(held[place])], ["place", "n"])

    found = rows.select("text").mapInArrow(released(count), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << COUNT_BITS, np.int64)
    out[found.column("place").to_numpy()] = found.column("n").to_numpy()
    return np.log2(np.maximum(out, 2 * np.median(out) + 1)).astype(np.uint8)


def least_words(words: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The LEAST_WORDS least words of each group, as rows of 32-bit hashes in order; a word's second occurrence is another word."""
    lines = len(first) - 1
    if lines > 65_536:  # the number of a line rides in sixteen bits
        half = lines // 2
        return np.concatenate([least_words(words[: first[half]], first[: half + 1], classes), least_words(words[first[half] :], first[half:] - first[half], classes)])
    line = np.repeat(np.arange(lines, dtype=np.uint64), np.diff(first)) << np.uint64(48)
    low = np.uint64((1 << 48) - 1)
    own = np.sort(line | (words >> np.uint64(16)))
    new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    nth = np.arange(len(own)) - np.repeat(new, np.diff(np.append(new, len(own))))
    word = own & low
    mixed = mix(word + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    rank = (classes[(word >> np.uint64(48 - COUNT_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(42)) | (mixed >> np.uint64(22))
    rank = np.sort((own & ~low) | rank) & low
    at = first[:-1, None] + np.arange(LEAST_WORDS)
    # lines of fewer words have a place for each of those they lack
    return np.where(at < first[1:, None], mix(rank[np.minimum(at, len(rank) - 1)]) >> np.uint64(32), np.arange(LEAST_WORDS, dtype=np.uint64)).astype(np.uint32)


def line_signatures(column: pa.Array, least: int = MIN_WORDS, classes: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, line number, key of the normalised words, SimHash, words, characters, least words) of lines of at least ``least`` words.

    Normalised: A-Z in lower case, every digit 0, what is not a letter or digit parts words.  SimHash's features are pairs of words that
    follow one another, the last with the line's end."""
    classes = np.zeros(1 << COUNT_BITS, np.uint8) if classes is None else classes
    for row, number, lo, hi, words, size in _words(column, least):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(words * powers(len(words)), dtype=np.uint64)])
        key = mix((sums[hi] - sums[lo]) * powers(len(words) + 1, inverse=True)[lo] + (hi - lo).astype(np.uint64))
        take = np.repeat(lo, hi - lo) + np.arange(int((hi - lo).sum())) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
        first = np.concatenate([[0], np.cumsum(hi - lo)])
        following = words[np.minimum(take + 1, len(words) - 1)]
        following[first[1:] - 1] = np.uint64(0x5851F42D4C957F2D)
        yield row, number, key, simhash(mix(words[take] * np.uint64(0xC2B2AE3D27D4EB4F) + following), first), hi - lo, size[hi] - size[lo] + hi - lo - 1, least_words(words[take], first, classes)


def block_keys(signatures: np.ndarray) -> Iterator[np.ndarray]:
    """For each pair of blocks the bits of both, with the pair's number: ten keys of about 26 bits."""
    for n, (a, b) in enumerate(combinations(BLOCKS, 2)):
        part = [(signatures >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1) for lo, hi in (a, b)]
        yield (np.uint64(n) << np.uint64(32)) | (part[0] << np.uint64(13)) | part[1]


def near_signatures(keys: np.ndarray, signatures: np.ndarray, most: int = HAMMING) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of distinct signatures under one key at most ``most`` bits apart.

    Within a key each signature is linked to the least one that has it near, which stands for those near it; pairs under one
    such star are not listed, so a key's pairs stay in proportion to its members where they are alike."""
    order = np.lexsort((signatures, keys))
    keys, signatures = keys[order], signatures[order]
    cut_at = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
    sizes = np.diff(cut_at)
    two = cut_at[:-1][sizes == 2]
    near = (np.bitwise_count(signatures[two] ^ signatures[two + 1]) <= most) & (signatures[two] != signatures[two + 1])
    left, right = [signatures[two[near]]], [signatures[two[near] + 1]]
    for a, b in zip(cut_at[:-1][sizes > 2], cut_at[1:][sizes > 2], strict=True):
        own = np.unique(signatures[a:b])
        star = np.full(len(own), -1)
        for i in range(len(own) - 1):
            close = np.flatnonzero(np.bitwise_count(own[i + 1 :] ^ own[i]) <= most) + i + 1
            close = close[(star[close] < 0) | (star[close] != star[i])] if star[i] >= 0 else close
            left.append(np.full(len(close), own[i]))
            right.append(own[close])
            if star[i] < 0:
                star[i] = i
                star[close[star[close] < 0]] = i
    return np.concatenate(left), np.concatenate(right)


def edit_similarity(a: str, b: str, least: float = SIMILARITY) -> bool:
    """Whether 1 - (edit distance / longer length) is at least ``least``; a common beginning and end cost nothing."""
    longer = max(len(a), len(b))
    most = int((1 - least) * longer + 1e-9)
    if a == b or abs(len(a) - len(b)) > most:
        return a == b
    left, right = a.split(" "), b.split(" ")
    if len(left) == len(right) and sum(max(len(p), len(q)) for p, q in zip(left, right, strict=True) if p != q) <= most:
        return True  # replacing the words that differ is enough
    x, y = (np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in (a, b))
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    head = int(differ[0]) if len(differ) else n
    x, y = x[head:], y[head:]
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[::-1][:n] != y[::-1][:n])
    tail = int(differ[0]) if len(differ) else n
    x, y = x[: len(x) - tail], y[: len(y) - tail]
    if not len(x) or not len(y):
        return max(len(x), len(y)) <= most
    return not _surely_apart(x, y, most) and _distance(x, y, most) <= most


def _surely_apart(x: np.ndarray, y: np.ndarray, most: int) -> bool:
    """Whether runs of two or three characters alone show more than ``most`` edits; one edit changes at most as many of either side."""
    for run in (2, 3):
        if min(len(x), len(y)) < run:
            return False
        bags = []
        for v in (x, y):
            code = np.zeros(len(v) - run + 1, np.uint32)
            for k in range(run):
                code = code * np.uint32(0x9E3779B1) + v[k : len(v) - run + 1 + k]
            bags.append(np.bincount((code * np.uint32(0x85EBCA6B)) >> np.uint32(20), minlength=4096))
        if np.abs(bags[0] - bags[1]).sum() > 2 * run * most:
            return True
    return False


def _distance(x: np.ndarray, y: np.ndarray, most: int) -> int:
    """Edit distance if it is at most ``most``, else something larger.

    A band of ``most`` diagonals to either side of the table's main one is held in whole numbers of a bit a row.  Values along a
    diagonal never fall, so the one that ends in the last cell tells soon when lines are too far apart.  A narrow band is tried
    first: lines with few edits need no other."""
    if len(x) < len(y):
        x, y = y, x
    places: dict[int, int] = {}
    if len(x) < 2_000:
        bit = 1
        for c in x.tolist():
            places[c] = places.get(c, 0) | bit
            bit <<= 1
    else:
        for c in np.unique(x).tolist():
            places[c] = int.from_bytes(np.packbits(x == c, bitorder="little").tobytes(), "little")
    columns, extra, found = y.tolist(), len(x) - len(y), most + 1
    for band in (NARROW, most) if max(NARROW, extra) < most else (most,):
        if band >= extra:
            found = _banded(places, columns, extra, band)
        if found <= band:
            return found
    return most + 1


def _banded(places: dict[int, int], columns: list[int], extra: int, band: int) -> int:
    """The edit distance of two lines, the longer by ``extra``, if it is at most ``band``; else something larger."""
    every = (1 << (2 * band + 1)) - 1
    up, down, score, end = every ^ ((1 << band) - 1), 0, extra, band + extra
    for at, c in enumerate(columns, -band):
        same = places.get(c, 0)
        same = (same >> at if at > 0 else same << -at) & every
        keep = ((((same & up) + up) ^ up) | same | down) & every
        score += not (keep >> end) & 1
        if score > band:
            return score
        more, less, keep_next = down | (every & ~(keep | up)), keep & up, keep >> 1
        up, down = less | (every & ~(keep_next | more)), keep_next & more
    return score


def normalised(line: str) -> str:
    """The words of a line as they are compared: one blank between them."""
    data = _DIGIT[lower_ascii(np.frombuffer(line.encode(), np.uint8))]
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), _PARTS)
    raw = data.tobytes()
    return " ".join(raw[a:b].decode(errors="replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True))


def choice_keys(least: np.ndarray) -> Iterator[np.ndarray]:
    """For each choice of words out of the rows of least ones the key of that choice."""
    for chosen in combinations(range(LEAST_WORDS), CHOICE):
        key = np.zeros(len(least), np.uint64)
        for k in chosen:
            key = mix(key * np.uint64(0xC2B2AE3D27D4EB4F) + least[:, k].astype(np.uint64))
        yield key


def proposed(table: pa.Table, pairwise: int, similarity: float = SIMILARITY) -> pa.RecordBatch:
    """Pairs (g, a, b, whole) of the members (g, key, size) of groups, those alone whose lengths may be similar.

    Groups of up to ``pairwise`` members are whole: all pairs; in larger ones each member meets the first quarter as many, and the
    rest is for ``across``."""
    g, key, size = (table.column(c).to_numpy() for c in ("g", "key", "size"))
    order = np.lexsort((key, g))
    g, key, size = g[order], key[order], size[order]
    cut_at = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]]))
    left, right, whole = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    sizes = np.diff(cut_at)
    for n in np.unique(sizes).tolist():
        starts = cut_at[:-1][sizes == n]
        for k in range(n - 1 if n <= pairwise else max(1, pairwise // 4)):
            other = (starts[:, None] + np.arange(k + 1, n)).ravel()
            left.append(np.repeat(starts + k, n - 1 - k))
            right.append(other)
            whole.append(np.full(len(other), n <= pairwise))
    i, j, full = np.concatenate(left), np.concatenate(right), np.concatenate(whole)
    near = (np.abs(size[i] - size[j]) <= (1 - similarity) * np.maximum(size[i], size[j]) + 1e-9) | ~full  # so that large groups stay known
    i, j, full = i[near], j[near], full[near]
    return pa.RecordBatch.from_arrays([pa.array(g[i]), pa.array(key[i]), pa.array(key[j]), pa.array(full)], ["g", "a", "b", "whole"])


def letter_counts(lines: list[str]) -> np.ndarray:
    """How often each line has characters of each of BINS classes; one edit takes from one class and adds to one, at most."""
    return np.stack([np.bincount(np.frombuffer(line.encode("utf-32-le"), np.uint32) % BINS, minlength=BINS) for line in lines]).astype(np.int32)


def across(table: pa.Table, similarity: float = SIMILARITY) -> pa.RecordBatch:
    """Similar pairs (a, b) of the left and right members (t, key, part, left, right, words) of tasks, enough to connect the parts.

    Parts that a pair has connected are one from there on; of others every pair is compared, unless their characters alone show too
    many edits."""
    t, key, part, left, right = (table.column(c).to_numpy() for c in ("t", "key", "part", "left", "right"))
    words, a, b = table.column("words").to_pylist(), [], []
    cut_at = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1], [True]]))
    for lo, hi in zip(cut_at[:-1].tolist(), cut_at[1:].tolist(), strict=True):
        own, label = words[lo:hi], np.unique(part[lo:hi], return_inverse=True)[1]
        counts = letter_counts(own)
        size = counts.sum(axis=1)
        mine, other = np.flatnonzero(left[lo:hi]), np.flatnonzero(right[lo:hi])
        for i in mine.tolist():
            near = other[(label[other] != label[i]) & ((other > i) | ~left[lo + other])]
            most = (1 - similarity) * np.maximum(size[near], size[i]) + 1e-9
            near, most = near[np.abs(size[near] - size[i]) <= most], most[np.abs(size[near] - size[i]) <= most]
            more = counts[near] - counts[i]
            near = near[np.maximum(np.maximum(more, 0).sum(axis=1), np.maximum(-more, 0).sum(axis=1)) <= most]
            for j in near.tolist():
                if label[j] != label[i] and edit_similarity(own[i], own[j], similarity):
                    a.append(key[lo + i])
                    b.append(key[lo + j])
                    label[label == label[j]] = label[i]
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def similar_lines(lines: DataFrame, docs: DataFrame, hamming: int = HAMMING, similarity: float = SIMILARITY) -> DataFrame:
    """Verified pairs (a, b) of line keys out of distinct ``lines`` (key, sim, size, least, doc, line), enough of them to connect all found.

    Candidates are groups: lines that share a choice of words, lines of one SimHash, lines whose SimHash is near that of a star.
    Small groups are compared pair by pair.  In larger ones lines meet a few leaders first; what isn't connected by then, through any
    group, is compared pair by pair, in blocks.  So every pair of a group is either connected or was compared."""
    spark = lines.sparkSession
    buckets = partitions(spark)

    def deal_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, size = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy().astype(np.uint32)
            least = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, LEAST_WORDS)
            for key in choice_keys(least):
                yield pack(key, buckets, g=key, key=ids, size=size)

    def meet_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, c in unpack(batches, g=np.uint64, key=np.uint64, size=np.uint32):
            order = np.argsort(c["g"], kind="stable")
            g = c["g"][order]
            alike = g[1:] == g[:-1]
            order = order[np.append(alike, False) | np.insert(alike, 0, False)]
            yield pa.RecordBatch.from_arrays([pa.array(c["g"][order].view(np.int64)), pa.array(c["key"][order].view(np.int64)), pa.array(c["size"][order].astype(np.int32))], ["g", "key", "size"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signatures = batch.column(0).to_numpy().view(np.uint64)
            for key in block_keys(signatures):
                yield pack(key, buckets, key=key, sim=signatures)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, c in unpack(batches, key=np.uint64, sim=np.uint64):
            a, b = near_signatures(c["key"], c["sim"], hamming)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["x", "y"])

    by_words = by_bucket(lines.select("key", "size", "least").mapInArrow(released(deal_words), packed_schema("g", "key", "size"))).mapInArrow(released(meet_words), "g long, key long, size int")
    near = by_bucket(lines.select("sim").mapInArrow(released(deal), packed_schema("key", "sim"))).mapInArrow(released(meet), "x long, y long").distinct()
    several = lines.groupBy("sim").count().where("count > 1").select(F.col("sim").alias("g"), "sim")
    stars = cut(near.select(F.col("x").alias("g"), F.explode(F.array("x", "y")).alias("sim")).union(several).distinct())
    by_sim = lines.where(likely_in(stars.select(F.col("sim").alias("id")), F.col("sim"))).select("key", "size", "sim").join(stars.hint("shuffle_hash"), "sim").select(F.xxhash64("g").alias("g"), "key", "size")
    members = cut(by_words.unionByName(by_sim))

    # the text of each line of a group, from the document where it stands first
    ids = members.select(F.col("key").alias("id")).distinct()
    wanted = lines.where(likely_in(ids, F.col("key"))).select("key", "doc", "line").join(ids.withColumnRenamed("id", "key").hint("shuffle_hash"), "key", "left_semi")
    wanted = cut(wanted.groupBy("doc").agg(F.collect_list(F.struct("line", "key")).alias("wanted")))
    near_docs = docs.where(likely_in(wanted.select(F.col("doc").alias("id")), F.col("doc")))
    texts = near_docs.select("doc", "text").join(wanted.hint("shuffle_hash"), "doc").select("text", "wanted")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_slices(batch, 0):
                keys, lines_ = [], []
                for text, want in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    own = text.split("\n") if text is not None else []
                    keys += [w["key"] for w in want if w["line"] < len(own)]
                    lines_ += [normalised(own[w["line"]]) for w in want if w["line"] < len(own)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(lines_, pa.string())], ["key", "words"])

    # rows of one doc may differ in text: each gives a line, the least stands for the key
    words = cut(texts.mapInArrow(released(pick), "key long, words string").groupBy("key").agg(F.min("words").alias("words")))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_slices(batch, 2):
                good = [edit_similarity(p, q, similarity) for p, q in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    def similar(pairs: DataFrame) -> DataFrame:
        left, right = (words.select(F.col("key").alias(c), F.col("words").alias(f"{c}w")) for c in "ab")
        met = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
        # dealt anew, so that no task has more than its share of long lines however few partitions the joins were given
        return met.select("a", "b", "aw", "bw").repartition(2 * buckets).mapInArrow(released(verify), "a long, b long")

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "g"):
            yield proposed(table, PAIRWISE, similarity)

    pairs = cut(members.repartition("g").sortWithinPartitions("g").mapInArrow(released(propose), "g long, a long, b long, whole boolean"))
    good = cut(similar(pairs.select("a", "b").distinct()))
    large = cut(pairs.where("not whole").select("g").distinct())
    if large.isEmpty():
        return good
    parts = cut(connected_components(good))
    labels = parts.select(F.col("id").alias("key"), F.col("component").alias("part"))
    rest = cut(members.join(large.hint("merge"), "g", "left_semi").join(labels.hint("merge"), "key", "left").select("g", "key", F.coalesce("part", "key").alias("part")))
    sizes = rest.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("g", "n")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = rest.join(sizes.hint("merge"), "g").withColumn("own", F.pmod(F.xxhash64("key"), blocks).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = own.select("key", "part", F.xxhash64("g", F.least("own", "k"), F.greatest("own", "k")).alias("t"), (F.col("own") <= F.col("k")).alias("left"), (F.col("own") >= F.col("k")).alias("right"))

    def meet_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "t", BLOCK):
            yield across(table, similarity)

    met = dealt.join(words.hint("merge"), "key").repartition("t").sortWithinPartitions("t").select("t", "key", "part", "left", "right", "words")
    return parts.select(F.col("id").alias("a"), F.col("component").alias("b")).where("a <> b").unionByName(cut(met.mapInArrow(released(meet_parts), "a long, b long")))


def removed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = MIN_WORDS, hamming: int = HAMMING, similarity: float = SIMILARITY) -> DataFrame:
    """(doc, lines): the numbers of the lines of each document that repeat, exactly or nearly, a line that stands earlier.

    Order is by (key, line number).  Exact repeats are counted with a partial aggregate, so a line in a third of all documents
    costs a row for each task; their removal is a join in which such lines are broadcast.  All lines count, whole."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).where("doc is not null")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, number, own, sim, _, size, first in line_signatures(batch.column(1), least, classes.value):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(own.view(np.int64)), pa.array(sim.view(np.int64)), pa.array(size.astype(np.int32)), binary_rows(first)], ["doc", "line", "key", "sim", "size", "least"])

    place = f"{ensure_checkpoints(spark)}/lines-{uuid.uuid4().hex}"
    classes = spark.sparkContext.broadcast(word_classes(rows, least))
    rows.mapInArrow(released(sign), "doc long, line int, key long, sim long, size int, least binary").write.parquet(place)
    signed = spark.read.parquet(place)
    lines = signed.groupBy("key").agg(F.min(F.struct("doc", "line")).alias("at"), F.min("sim").alias("sim"), F.min("size").alias("size"), F.min("least").alias("least"), F.count(F.lit(1)).alias("n"))
    lines = cut(lines.select("key", "sim", "size", "least", "n", "at.doc", "at.line"))
    parts = connected_components(similar_lines(lines.select("key", "sim", "size", "least", "doc", "line"), rows, hamming, similarity)).withColumnRenamed("id", "key")
    groups = cut(lines.select("key", "n", "doc", "line").join(parts.hint("shuffle_hash"), "key", "left").where("n > 1 or component is not null").withColumn("component", F.coalesce("component", "key")))
    firsts = groups.groupBy("component").agg(F.min(F.struct("doc", "line")).alias("keep"), F.count(F.lit(1)).alias("w"))
    keep = cut(skew_join(groups.select("key", "component", "n"), firsts, "component", "w").select("key", "keep", "n"))
    gone = skew_join(signed.select("key", "doc", "line"), keep, "key", "n").where("struct(doc, line) <> keep")
    return gone.groupBy("doc").agg(F.collect_set("line").alias("lines"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", removed: str = "removed", **how) -> DataFrame:
    """``docs`` with every repeated line taken out of its text (with its line break), and a column ``removed`` with the number
    (``removed_2`` where ``docs`` has a column of that name, and so on).

    One occurrence of each group of like lines stays, that of least (key, line number).  Lines of fewer than five words never
    go.  Null text stays null, rows with a null key stay as they are, and rows of one key are treated alike.  All columns of
    ``docs`` are returned, in their order; texts without a repeated line are untouched.  An empty table gives an empty result."""
    doc, lines, count = fresh(docs, "doc_of_lines"), fresh(docs, "lines_gone"), fresh(docs, removed)
    gone = cut(removed_lines(docs, key, text, **how).withColumnRenamed("doc", doc).withColumnRenamed("lines", lines))
    maybe = likely_in(gone.select(F.col(doc).alias("id")), F.col(key))
    near, far = docs.where(maybe), docs.where(~maybe)
    joined = near.join(gone.hint("shuffle_hash"), near[key].cast("long") == F.col(doc), "left").drop(doc)
    joined = joined.unionByName(far.withColumn(lines, F.lit(None).cast("array<int>")))
    own = F.split(F.col(text), "\n", -1)
    left = F.filter(own, lambda _, i: ~F.array_contains(lines, i))
    whole = F.when(F.col(lines).isNull() | F.col(text).isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))
    number = F.when(F.col(text).isNull() | F.col(lines).isNull(), 0).otherwise(F.size(lines))
    return joined.select(*[whole.alias(text) if c == text else F.col(c) for c in docs.columns], number.alias(count))


def digest(text: str | None) -> str:
    return hashlib.sha256((text or "").encode()).hexdigest()
