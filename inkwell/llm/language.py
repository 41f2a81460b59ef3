"""Language identification by nearest centroids of n-gram vectors (operator 1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.llm.common import cut, lowered_blocks, mix, released

DIM = 8192
#: ASCII letters stay (lower case); every other ASCII character is one space; bytes of other letters stay.
_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def ngram_counts(column: pa.Array, dim: int = DIM) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, matrix of hashed byte-trigram counts) of blocks of at most 256 rows; trigrams of blanks only don't count."""
    for at, to, data, offs in lowered_blocks(column):
        folded = np.concatenate([_FOLD[data], np.full(2, 32, np.uint8)])
        b = folded.astype(np.uint32)
        code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
        gram = (mix(code.astype(np.uint64)) % np.uint64(dim)).astype(np.int64)
        good = (code != 0x202020) & ((code >> 8) != 0x2020) & ((code & 0xFFFF) != 0x2020)
        row = np.repeat(np.arange(to - at), np.diff(offs))
        inside = np.ones(len(data), dtype=bool)
        for k in (1, 2):  # a trigram ends within its document
            ends = offs[1:] - k
            inside[ends[ends >= offs[:-1]]] = False
        keep = good & inside
        gram, row = gram[keep], row[keep]
        for lo in range(0, to - at, 256):
            hi = min(lo + 256, to - at)
            part = slice(*np.searchsorted(row, [lo, hi]))
            yield at + lo, np.bincount((row[part] - lo) * dim + gram[part], minlength=(hi - lo) * dim).reshape(hi - lo, dim).astype(np.float32)


def unit_vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weighted = np.log1p(counts) * idf
    norm = np.linalg.norm(weighted, axis=1, keepdims=True)
    return weighted / np.where(norm > 0, norm, 1)


def document_frequency(docs: DataFrame, text: str = "text", dim: int = DIM) -> tuple[int, np.ndarray]:
    """(documents, documents that hold each hashed trigram), counted over every row; the driver gets ``dim`` sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(dim, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, counts in ngram_counts(batch.column(0), dim):
                held += (counts > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([*range(dim), dim], pa.int32()), pa.array([*held, n], pa.int64())], ["gram", "n"])

    rows = docs.select(text).mapInArrow(released(count), "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(dim + 1, np.int64)
    for r in rows:
        out[r["gram"]] = r["n"]
    return int(out[dim]), out[:dim]


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(unit centroids, cluster of each row); starts from the farthest points, so it's the same each time."""
    k = max(1, min(k, len(x)))
    centres = [x.mean(axis=0)]
    centres[0] = centres[0] / max(np.linalg.norm(centres[0]), 1e-12)
    while len(centres) < k:
        centres.append(x[int(np.argmin(np.max(x @ np.array(centres).T, axis=1)))])
    c = np.array(centres)
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        c = np.array([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(k)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c, np.argmax(x @ c.T, axis=1)


class LanguageModel:
    """Unit centroids, their language and the distance beyond which each rejects."""

    def __init__(self, idf: np.ndarray, centroids: np.ndarray, languages: list[str], radius: np.ndarray):
        self.idf, self.centroids, self.languages, self.radius = idf.astype(np.float32), centroids.astype(np.float32), languages, radius

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(centroid, cosine, rejected) of each row."""
        near = unit_vectors(counts, self.idf) @ self.centroids.T
        best = near.argmax(axis=1)
        cosine = np.clip(near[np.arange(len(best)), best], 0, 1)
        return best, cosine, 1 - cosine > self.radius[best]


def fit_languages(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", clusters: int = 3, per_language: int = 400, quantile: float = 0.995) -> LanguageModel:
    """Learns from rows with a text and a language.

    Document frequencies are counted over all rows.  The clusters are fitted on at most ``per_language`` rows of each language,
    those of least hash: the bounded sample of labelled rows.  A centroid's radius is the given quantile of its members'
    distances, widened by half.  Without labelled rows the model has no language and predicts ``und``.

    Ties of hash go by key; rows that share a key are sampled together; null and empty texts of a language count like any other;
    other columns are not looked at; texts of any length count whole."""
    labelled = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    n, df = document_frequency(labelled, text)
    idf = np.log((1 + n) / (1 + df)) + 1
    # the least hashes of each language; a bar by its number of rows leaves about four times as many to be ranked
    own = labelled.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.xxhash64(F.col(key)).alias("h"))
    bars = cut(own.groupBy("lang").agg((F.lit(-(2.0**63)) + F.least(F.lit(1.0), F.lit(4.0 * per_language) / F.count(F.lit(1))) * F.lit(2.0**64)).alias("bar")))
    few = own.join(F.broadcast(bars), "lang").where(F.col("h") <= F.col("bar")).drop("bar")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "key"))
    ids = few.withColumn("place", place).where(F.col("place") <= per_language).select(F.col("key").alias(key))
    sample = labelled.select(key, text, lang).join(F.broadcast(ids.distinct()), key, "left_semi")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, counts in ngram_counts(batch.column(0)):
                raw = [np.concatenate([np.flatnonzero(r), r[np.flatnonzero(r)].astype(np.int64)]).astype(np.int32).tobytes() for r in counts]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(at, len(raw)), pa.array(raw, pa.binary())], ["lang", "cells"])

    rows = sample.select(text, lang).mapInArrow(released(vectors), "lang string, cells binary").collect()
    by: dict[str, list[np.ndarray]] = {}
    for r in rows:
        cells = np.frombuffer(r["cells"], np.int32)
        counts = np.zeros(DIM, np.float32)
        counts[cells[: len(cells) // 2]] = cells[len(cells) // 2 :]
        by.setdefault(r["lang"], []).append(counts)
    centroids, languages, radius = [], [], []
    for name in sorted(by):
        x = unit_vectors(np.array(sorted(by[name], key=lambda v: v.tobytes())), idf)
        c, own = spherical_kmeans(x, clusters)
        for j in range(len(c)):
            if (own == j).any():
                centroids.append(c[j])
                languages.append(name)
                radius.append(min(1.0, 1.5 * float(np.quantile(1 - x[own == j] @ c[j], quantile))))
    return LanguageModel(idf, np.array(centroids).reshape(len(centroids), DIM), languages, np.array(radius))


def identify(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, rejected): the language of the nearest centroid and its cosine; ``rejected`` if that is too far.

    A text that is null or has no letter, and any text where nothing was learned, is ``und`` with score 0, rejected.  Of centroids that
    are equally near the first counts (languages in order of name).  Null keys and repeated rows are judged like any other, each for
    itself; an empty table gives an empty result; other columns are not looked at."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            letters = batch.column(2).to_pylist()
            for at, counts in ngram_counts(batch.column(1)):
                n = len(counts)
                best, cosine, far = m.predict(counts) if m.languages else (np.zeros(n, int), np.zeros(n), np.ones(n, bool))
                known = [bool(letters[at + i]) and bool(m.languages) for i in range(n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array([m.languages[b] if k else "und" for b, k in zip(best, known, strict=True)], pa.string()), pa.array([float(c) if k else 0.0 for c, k in zip(cosine, known, strict=True)], pa.float64()), pa.array([bool(f) or not k for f, k in zip(far, known, strict=True)], pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(released(predict), "doc_id long, lang_pred string, score double, rejected boolean").withColumnRenamed("doc_id", key)


def held_out(key: str, of: int, remainder: int):
    """Whether crc32 of the key as text leaves this remainder; a null key does not."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % of == remainder, F.lit(False))


def language_of_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    model = fit_languages(docs.where(~F.coalesce(held_out("doc_id", 5, 0), F.lit(False))))
    return identify(docs, model)
