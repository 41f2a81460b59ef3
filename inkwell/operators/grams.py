"""Character n-grams as numbers: texts are counted where they are, in a few array passes over all texts of a slice."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import col

#: Code points that are counted at once, and rows that are multiplied at once.
SLICE, DENSE_ROWS = 500_000, 128
#: Letters of a vocabulary up to which its grams are found by tables (up to 32 MB); beyond, by search.
MOST_LETTERS = 2000
EMPTY = "_empty_"


def plain(text: Column | str) -> Column:
    """What n-grams are taken from: lower case, without white space."""
    return F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), r"(?U)\s+", "")


def encode(gram: str) -> int:
    """A gram of up to three code points as a number, 21 bits for each; the mark of an empty text is 0."""
    return 0 if gram == EMPTY else sum((ord(c) + 1) << (21 * i) for i, c in enumerate(gram))


def decode(code: int) -> str:
    out = ""
    while code:
        out, code = out + chr((code & 0x1FFFFF) - 1), code >> 21
    return out or EMPTY


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, code points, their number in each row) of runs of rows; a row that alone is longer is a run of its own."""
    lengths = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        begin = ends[at] - lengths[at]
        to = max(at + 1, int(np.searchsorted(ends, begin + size, side="right")))
        text = "".join(column.slice(at, to - at).to_pylist())
        yield at, np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64), lengths[at:to]
        at = to


def grams(points: np.ndarray, lengths: np.ndarray, sizes: tuple[int, ...] = (2, 3)) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of every n-gram; a text shorter than n is its own n-gram, an empty one gives one mark."""
    codes, rows = [], []
    row = np.repeat(np.arange(len(lengths)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(points))  # code points from here to the end of the row
    part = points + 1
    for n in sizes:
        at = np.flatnonzero(left >= n)
        code = part[at]
        for k in range(1, n):
            code = code | (part[at + k] << (21 * k))
        codes.append(code)
        rows.append(row[at])
        short = np.flatnonzero((lengths > 0) & (lengths < n))
        if len(short):
            begin = np.cumsum(lengths)[short] - lengths[short]
            codes.append(np.array([sum(int(part[b + k]) << (21 * k) for k in range(m)) for b, m in zip(begin.tolist(), lengths[short].tolist(), strict=True)], np.int64))
            rows.append(short)
    none = np.flatnonzero(lengths == 0)
    return np.concatenate([*rows, none]), np.concatenate([*codes, np.zeros(len(none), np.int64)])


def apart(points: np.ndarray, lengths: np.ndarray, least: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows of at least ``least`` code points, their points, their lengths; points and lengths with no others than shorter rows)."""
    long = lengths >= least
    if long.all():
        return np.arange(len(lengths)), points, lengths, points[:0], np.zeros_like(lengths)
    of = np.repeat(long, lengths)
    return np.flatnonzero(long), points[of], lengths[long], points[~of], np.where(long, 0, lengths)


def held_by(points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, in how many rows) of a slice's pairs and triples.  Letters are numbered first, so one sort of small numbers tells."""
    rows, own, sizes, short, rest = apart(points, lengths)
    codes, counts = [], []
    letters = np.flatnonzero(np.bincount(own)) if len(own) else own
    base = len(letters)
    grams_all = base**2 + base**3
    if len(rows) and len(rows) * grams_all < 2**62:
        number = np.zeros(letters[-1] + 1, np.int64)
        number[letters] = np.arange(base)
        at, row = number[own], np.repeat(np.arange(len(rows)) * grams_all, sizes)
        ends = np.cumsum(sizes) - 1
        pair = at[:-1] * base + at[1:]
        triple = base**2 + pair[:-1] * base + at[2:]
        whole = np.ones(len(at), bool)
        whole[ends] = False
        two = whole[:-1]
        three = two[:-1] & two[1:]
        gram, n = np.unique(np.unique(np.concatenate([(row[:-1] + pair)[two], (row[:-2] + triple)[three]])) % grams_all, return_counts=True)
        is_pair = gram < base**2
        g = np.where(is_pair, gram, gram - base**2)
        last, first = letters[g % base] + 1, g // base
        codes.append(np.where(is_pair, (letters[np.minimum(first, base - 1)] + 1) | (last << 21), (letters[np.minimum(first // base, base - 1)] + 1) | ((letters[first % base] + 1) << 21) | (last << 42)))
        counts.append(n)
    elif len(rows):
        row, code = grams(own, sizes)
        known, which = np.unique(code, return_inverse=True)
        codes.append(known)
        counts.append(np.bincount(np.unique(row * len(known) + which) % len(known), minlength=len(known)))
    if len(rows) < len(lengths):
        row, code = grams(short, rest)
        keep = lengths[row] < 3
        pairs = np.unique(np.stack([row[keep], code[keep]]), axis=1)
        known, n = np.unique(pairs[1], return_counts=True)
        codes.append(known)
        counts.append(n)
    return (np.concatenate(codes), np.concatenate(counts).astype(np.int64)) if codes else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt to all cores where they come from fewer files than there are cores; tables of many files stay where they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows


def document_frequency(docs: DataFrame, text: str) -> DataFrame:
    """(gram, df): how many rows hold each gram.  Rows are counted by slice before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, points, lengths in slices(batch.column(0)):
                yield pa.RecordBatch.from_arrays([*map(pa.array, held_by(points, lengths))], ["code", "n"])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([decode(c) for c in batch.column(0).to_pylist()], pa.string()), batch.column(1)], ["gram", "df"])

    counted = spread(docs.select(plain(text).alias("s"))).mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("df"))
    return counted.mapInArrow(name, "gram string, df long")


class Vocabulary:
    """Grams as sorted codes with their places and weights; small, for its fit bounds it."""

    def __init__(self, rows: list[tuple[str, int, float]], width: int | None = None):
        rows = sorted((encode(g), i, w) for g, i, w in rows)
        self.codes, self.places = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
        self.width = width or int(self.places.max(initial=-1)) + 1
        self.idf = np.zeros(self.width)
        self.idf[self.places] = [r[2] for r in rows]
        self._number_letters()

    def _number_letters(self) -> None:
        """Tables from numbered letters to pairs, and from pairs and letters to triples; none where the letters are too many for them."""
        part = [(self.codes >> (21 * k)) & 0x1FFFFF for k in range(3)]
        size = (part[0] > 0).astype(int) + (part[1] > 0) + (part[2] > 0)
        letters = np.unique(np.concatenate([p[size >= 2] for p in part]))
        letters = letters[letters > 0] - 1
        self.base = len(letters) + 1
        self.letter = None
        if len(letters) == 0 or self.base > MOST_LETTERS:
            return
        self.letter = np.zeros(0x110000, np.int64)
        self.letter[letters] = np.arange(1, self.base)
        a, b, c = (np.where(p > 0, self.letter[p - 1], 0) for p in part)
        pairs = np.unique((a * self.base + b)[size >= 2])
        self.pair = np.zeros(self.base**2, np.int32)
        self.pair[pairs] = np.arange(1, len(pairs) + 1)
        self.of_pair, self.of_triple = np.full(len(pairs) + 1, -1, np.int32), np.full((len(pairs) + 1) * self.base, -1, np.int32)
        own = self.pair[a * self.base + b].astype(np.int64)
        self.of_pair[own[size == 2]] = self.places[size == 2]
        self.of_triple[(own * self.base + c)[size == 3]] = self.places[size == 3]

    def _sought(self, row: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, place) of those grams that are known."""
        at = np.minimum(np.searchsorted(self.codes, code), max(len(self.codes) - 1, 0))
        hit = self.codes[at] == code if len(self.codes) else np.zeros(len(code), bool)
        return row[hit], self.places[at[hit]]

    def _found(self, points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, place) of every known gram of a slice; pairs and triples of texts of three letters or more by the tables."""
        if self.letter is None:
            return self._sought(*grams(points, lengths))
        rows, own, sizes, short, rest = apart(points, lengths)
        out = []
        if len(rows):
            at, ends, row = self.letter[own], np.cumsum(sizes) - 1, np.repeat(rows, sizes)
            pair = self.pair[at[:-1] * self.base + at[1:]]
            pair[ends[:-1]] = 0
            two = self.of_pair[pair]
            three = self.of_triple[pair[:-1].astype(np.int64) * self.base + at[2:]]
            three[ends[:-1] - 1] = -1
            out = [(row[i], place[i].astype(np.int64)) for place in (two, three) for i in [np.flatnonzero(place >= 0)]]
        if len(rows) < len(lengths):
            row, code = grams(short, rest)
            keep = lengths[row] < 3
            out.append(self._sought(row[keep], code[keep]))
        return np.concatenate([r for r, _ in out]), np.concatenate([p for _, p in out])

    def weigh(self, points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, x) of a slice, in order: the share of each known gram among all grams of a text, times its idf."""
        row, place = self._found(points, lengths)
        total = np.where(lengths > 2, 2 * lengths - 3, np.minimum(lengths, 1) + 1)
        cell, cells = row * max(self.width, 1) + place, len(lengths) * max(self.width, 1)
        if cells <= 8 * len(cell):  # dense enough to be counted without a sort
            n = np.bincount(cell, minlength=cells)
            cell = np.flatnonzero(n)
            n = n[cell]
        else:
            cell, n = np.unique(cell, return_counts=True)
        row, place = np.divmod(cell, max(self.width, 1))
        return row, place, n / total[row] * self.idf[place]

    def dense(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, matrix of a few rows by all places)."""
        for begin, points, lengths in slices(column):
            row, place, x = self.weigh(points, lengths)
            for at in range(0, len(lengths), DENSE_ROWS):
                a, b = np.searchsorted(row, [at, at + DENSE_ROWS])
                out = np.zeros((min(DENSE_ROWS, len(lengths) - at), self.width))
                out[row[a:b] - at, place[a:b]] = x[a:b]
                yield begin + at, out


def collect_vocabulary(vocabulary: DataFrame) -> Vocabulary:
    return Vocabulary([tuple(r) for r in vocabulary.select("gram", "idx", "idf").collect()])


def sparse_rows(docs: DataFrame, vocabulary: DataFrame, key: str, text: str) -> DataFrame:
    """(key, idx array<int>, x array<double>, norm): a text's known grams in order of place, not of unit length yet; nothing is shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(collect_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, points, lengths in slices(batch.column(1)):
                row, place, x = held.value.weigh(points, lengths)
                offs = pa.array(np.searchsorted(row, np.arange(len(lengths) + 1)).astype(np.int32))
                norm = np.sqrt(np.bincount(row, x * x, minlength=len(lengths))) + 1e-9
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(lengths)), pa.ListArray.from_arrays(offs, pa.array(place.astype(np.int32))), pa.ListArray.from_arrays(offs, pa.array(x)), pa.array(norm)], [key, "idx", "x", "norm"])

    return spread(docs.select(key, plain(text).alias("s"))).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, idx array<int>, x array<double>, norm double")


def projected(docs: DataFrame, vocabulary: DataFrame, projection: np.ndarray | None, key: str, text: str) -> DataFrame:
    """(key, vector): texts' weighted grams times a matrix (places by dimensions), of unit length; without a matrix the weights themselves."""
    held = docs.sparkSession.sparkContext.broadcast((collect_vocabulary(vocabulary), projection))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, matrix = held.value
        for batch in batches:
            for begin, x in words.dense(batch.column(1)):
                y = x if matrix is None else x @ matrix
                y = y / (np.linalg.norm(y, axis=1, keepdims=True) + 1e-9)
                offs = pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(y)), pa.ListArray.from_arrays(offs, pa.array(y.ravel()))], [key, "vector"])

    return spread(docs.select(key, plain(text).alias("s"))).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, vector array<double>")


def hashed(docs: DataFrame, key: str, text: str, dim: int = 128, unit: bool = True) -> DataFrame:
    """(key, vector): signed counts of the texts' character pairs, each in the place that its hash names; each distinct pair of a slice is hashed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, points, lengths in slices(batch.column(1)):
                row, code = grams(points, lengths, (2,))
                known, which = np.unique(code, return_inverse=True)
                h = np.array([int(hashlib.md5(decode(c).encode()).hexdigest()[:8], 16) for c in known.tolist()], np.int64)
                sign = np.where((h >> 1) & 1, 1.0, -1.0)
                out = np.bincount(row * dim + (h % dim)[which], sign[which], minlength=len(lengths) * dim).reshape(len(lengths), dim)
                if unit:
                    out = out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-9)
                offs = pa.array(np.arange(len(out) + 1, dtype=np.int32) * dim)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(out)), pa.ListArray.from_arrays(offs, pa.array(out.ravel()))], [key, "vector"])

    return spread(docs.select(key, plain(text).alias("s"))).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, vector array<double>")


def leading_directions(docs: DataFrame, vocabulary: DataFrame, text: str, target: int, more: int = 32, rounds: int = 6, seed: int = 20240103) -> np.ndarray:
    """The ``target`` leading right singular vectors of the texts' weighted grams (places by directions), by a randomised range finder.

    Every round multiplies all rows X with a thin matrix and back (X' X Q) where they are, adds the tasks' products block by block, and
    makes the sum orthonormal again, so what is shuffled and fetched is as large as the vocabulary times ``target + more`` numbers,
    whatever the texts.  A last round gives the small eigenproblem within that range.  With as many directions as texts the range is exact.
    Signs are such that a direction's largest part is positive."""
    words = collect_vocabulary(vocabulary)
    width = words.width
    thin = min(width, target + more)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, thin)))[0]
    texts, sc, block = docs.select(plain(text).alias("s")), docs.sparkSession.sparkContext, 256
    z = q
    for _ in range(rounds):
        held = sc.broadcast((words, q))

        def multiply(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            own, q = held.value
            out = np.zeros_like(q)
            for batch in batches:
                for _, x in own.dense(batch.column(0)):
                    out += x.T @ (x @ q)
            for at in range(0, len(out), block):
                yield pa.RecordBatch.from_arrays([pa.array([at // block]), pa.array([out[at : at + block].tobytes()], pa.binary())], ["block", "part"])

        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(b, np.float64) for b in table.column("part").to_pylist())
            return pa.table({"block": table.column("block")[:1], "part": pa.array([total.tobytes()], pa.binary())})

        summed = texts.mapInArrow(multiply, "block long, part binary").groupBy("block").applyInArrow(add, "block long, part binary").toArrow().sort_by("block")
        z = np.concatenate([np.frombuffer(b, np.float64) for b in summed.column("part").to_pylist()]).reshape(width, thin) if summed.num_rows else np.zeros((width, thin))
        last, q = q, np.linalg.qr(z)[0]
    values, turns = np.linalg.eigh((last.T @ z + z.T @ last) / 2)
    top = last @ turns[:, np.argsort(-values, kind="stable")[:target]]
    return top * np.where(top[np.abs(top).argmax(axis=0), np.arange(top.shape[1])] < 0, -1, 1)
