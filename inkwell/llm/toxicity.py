"""Counterfactual-regularised toxicity classifier (operator 5)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import in_slices, lowered_blocks, mix, prefix_hash, released, span_hash, word_spans

BITS, MAX_LABELLED, FAIRNESS = 20, 10_000, 5.0
#: Pairs of terms for groups of people, each other's counterfactual.
IDENTITY_PAIRS = (
    ("women", "men"), ("woman", "man"), ("female", "male"), ("black", "white"), ("muslim", "christian"), ("muslims", "christians"),
    ("jewish", "catholic"), ("jews", "catholics"), ("gay", "straight"), ("lesbian", "heterosexual"), ("transgender", "cisgender"),
    ("immigrant", "citizen"), ("immigrants", "citizens"), ("african", "european"), ("asian", "american"), ("mexican", "canadian"),
    ("disabled", "able"), ("blind", "sighted"), ("deaf", "hearing"), ("old", "young"),
    ("frauen", "männer"), ("juden", "christen"), ("ausländer", "einheimische"), ("femmes", "hommes"), ("juifs", "chrétiens"),
    ("mujeres", "hombres"), ("judíos", "cristianos"), ("inmigrantes", "ciudadanos"),
)
#: A neutral mention, for pairs that no labelled sentence has.
TEMPLATE = "they are {}"
_PARTS = np.ones(256, dtype=bool)
_PARTS[97:123] = False
_PARTS[128:] = False


def swapper(pairs: Iterable[tuple[str, str]] = IDENTITY_PAIRS) -> Callable[[str], str | None]:
    """A function that gives the lower-cased text with every term swapped for its partner; None where it has none."""
    swap = {a: b for pair in pairs for a, b in (pair, pair[::-1])}
    if not swap:
        return lambda text: None
    terms = re.compile(r"(?<!\w)(" + "|".join(sorted(map(re.escape, swap), key=len, reverse=True)) + r")(?!\w)")

    def run(text: str) -> str | None:
        swapped, n = terms.subn(lambda m: swap[m[0]], text.lower())
        return swapped if n else None

    return run


def features(column: pa.Array, bits: int = BITS) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, for each row its distinct hashed features): words, and beginnings of 4 to 10 bytes of longer words."""
    mask = np.uint64((1 << bits) - 1)
    for at, to, data, offs in lowered_blocks(column):
        starts, ends, first = word_spans(data, offs, _PARTS)
        if not len(starts):
            yield at, [np.zeros(0, np.int32)] * (to - at)
            continue
        prefix = prefix_hash(data)
        row = np.repeat(np.arange(to - at), np.diff(first))
        parts = [(row, mix(span_hash(prefix, starts, ends)) & mask)]
        for size in (4, 6, 8, 10):
            long = ends - starts > size
            parts.append((row[long], mix(span_hash(prefix, starts[long], starts[long] + size) + np.uint64(size)) & mask))
        both = np.unique((np.concatenate([r for r, _ in parts]).astype(np.uint64) << np.uint64(32)) | np.concatenate([h for _, h in parts]))
        cut_at = np.searchsorted(both, np.arange(to - at + 1, dtype=np.uint64) << np.uint64(32))
        cells = (both & np.uint64(0xFFFFFFFF)).astype(np.int32)
        yield at, [cells[a:b] for a, b in zip(cut_at[:-1], cut_at[1:], strict=True)]


def features_of(texts: list[str], bits: int = BITS) -> list[np.ndarray]:
    return [c for _, block in features(pa.array(texts, pa.large_string()), bits) for c in block]


class ToxicityModel:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), bias

    def score(self, cells: list[np.ndarray]) -> np.ndarray:
        margin = np.array([float(self.weights[c].sum()) for c in cells]) + self.bias
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _margins(cells: list[np.ndarray], w: np.ndarray) -> np.ndarray:
    sizes = np.array([len(c) for c in cells])
    flat = np.concatenate(cells) if len(cells) else np.zeros(0, np.int64)
    out = np.zeros(len(cells))
    np.add.at(out, np.repeat(np.arange(len(cells)), sizes), w[flat])
    return out


def _pull(cells: list[np.ndarray], r: np.ndarray, dim: int) -> np.ndarray:
    return np.bincount(np.concatenate(cells) if cells else np.zeros(0, np.int64), weights=np.repeat(r, [len(c) for c in cells]), minlength=dim)


def fit_logistic(cells: list[np.ndarray], y: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], dim: int, ridge: float = 2e-3, fairness: float = 1.0, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Gradient descent with momentum and scaled steps on log loss + ridge + ``fairness`` * squared change of the margin between a text and its counterfactual."""
    n = max(1, len(cells))
    w, b, vw, vb = np.zeros(dim), 0.0, np.zeros(dim), 0.0
    left, right = [p for p, _ in pairs], [q for _, q in pairs]
    gw2, gb2 = np.full(dim, 1e-8), 1e-8
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(_margins(cells, w) + b, -30, 30)))
        r = (p - y) / n
        gw, gb = _pull(cells, r, dim) + ridge * w, r.sum()
        if pairs:
            change = 2 * fairness * (_margins(left, w) - _margins(right, w)) / len(pairs)
            gw += _pull(left, change, dim) - _pull(right, change, dim)
        gw2, gb2 = 0.95 * gw2 + 0.05 * gw * gw, 0.95 * gb2 + 0.05 * gb * gb
        vw, vb = 0.9 * vw - 0.03 * gw / np.sqrt(gw2), 0.9 * vb - 0.03 * gb / np.sqrt(gb2)
        w, b = w + vw, b + vb
    return w, b


def select_features(cells: list[np.ndarray], y: np.ndarray, dim: int, least: float = 12.0, fewest: int = 4) -> np.ndarray:
    """Features whose presence goes with the label: chi-squared of at least ``least`` in at least ``fewest`` texts."""
    n, pos = len(cells), y.sum()
    have = _pull(cells, np.ones(n), dim)
    both = _pull(cells, y.astype(float), dim)
    expected = have * pos / n
    chi = (both - expected) ** 2 / np.maximum(expected * (1 - have / n) * (1 - pos / n), 1e-9)
    return np.flatnonzero((have >= fewest) & (chi >= least))


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    max_labelled: int = MAX_LABELLED,
    bits: int = BITS,
    threshold: float = 0.7,
    pairs: tuple[tuple[str, str], ...] = IDENTITY_PAIRS,
    fairness: float = FAIRNESS,
) -> ToxicityModel:
    """Learns from rows of ``labels`` (key, toxic 0 or 1) and their texts.

    At most ``max_labelled`` labelled keys, those of least hash, are used: the bounded sample.  It goes to all tasks, so texts stay
    where they are.  Features are made on the executors; the driver gets feature numbers, keeps those that go with the label and
    those of the terms in ``pairs``, and fits the weights.  Every labelled sentence with such a term has a counterfactual, the
    sentence with the terms swapped; a pair that no sentence has gets one from a neutral template with either term.  ``fairness``
    weighs the penalty on the change of the score between the two.

    A label that is null is left out; a key with both labels counts as toxic; of rows that share a key the one of least features
    counts.  The bias is set so that ``threshold`` is where the training rows, scored by models that haven't seen them, are told
    apart best.  Without labels, or with one label only, every score is 0.  Other columns of either table are not looked at."""
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max("toxic").alias("toxic"))
    marked = marked.orderBy(F.xxhash64(key), key).limit(max_labelled)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        swap = swapper(pairs)
        for batch in batches:
            for part in in_slices(batch, 0):
                other = [swap(t or "") for t in part.column(0).to_pylist()]
                twins = iter(features_of([t for t in other if t is not None], bits))
                own = [c.tobytes() for _, block in features(part.column(0), bits) for c in block]
                twin = [None if t is None else next(twins).tobytes() for t in other]
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(own, pa.binary()), pa.array(twin, pa.binary())], ["key", "toxic", "cells", "twin"])

    made = docs.select(key, text).join(F.broadcast(marked), key).select(text, F.col(key).cast("long"), F.col("toxic").cast("int")).mapInArrow(released(cells), "key long, toxic int, cells binary, twin binary")
    rows = made.groupBy("key").agg(F.max("toxic").alias("toxic"), F.min(F.struct("cells", "twin")).alias("f")).select("key", "toxic", "f.cells", "f.twin").collect()
    dim = 1 << bits
    if not rows or len({r["toxic"] for r in rows}) < 2:
        return ToxicityModel(np.zeros(dim), -30.0)
    rows.sort(key=lambda r: r["key"])
    full = [np.frombuffer(r["cells"], np.int32) for r in rows]
    y = np.array([r["toxic"] for r in rows])
    mentions = [features_of([TEMPLATE.format(t) for t in pair], bits) for pair in pairs]
    terms = [np.setxor1d(a, b) for a, b in mentions]
    have = _pull(full, np.ones(len(full)), dim)
    chosen = np.unique(np.concatenate([select_features(full, y, dim), *[t[have[t] > 0] for t in terms]]))
    place = np.full(dim, -1)
    place[chosen] = np.arange(len(chosen))
    short = lambda c: place[c][place[c] >= 0]
    small = [short(c) for c in full]
    twins = [(full[i], np.frombuffer(r["twin"], np.int32)) for i, r in enumerate(rows) if r["twin"] is not None]
    met = np.unique(np.concatenate([np.setxor1d(a, b) for a, b in twins])) if twins else np.zeros(0, np.int32)
    twins += [m for m, t in zip(mentions, terms, strict=True) if not np.isin(t, met).any()]
    twins = [(short(a), short(b)) for a, b in twins]
    twins = [(a, b) for a, b in twins if len(np.setxor1d(a, b))]  # others have the same score whatever the weights
    k = len(chosen)
    margins, fold = np.zeros(len(rows)), np.zeros(len(rows), np.int64)
    for label in (0, 1):  # either label in both folds
        fold[y == label] = np.arange(int((y == label).sum())) % 2
    for f in (0, 1):
        own = [c for c, g in zip(small, fold, strict=True) if g != f]
        w, b = fit_logistic(own, y[fold != f], twins, k, fairness=fairness)
        margins[fold == f] = _margins([c for c, g in zip(small, fold, strict=True) if g == f], w) + b
    w, b = fit_logistic(small, y, twins, k, fairness=fairness)
    order = np.argsort(margins)
    m, t = margins[order], y[order]
    caught = t.sum() - np.concatenate([[0], np.cumsum(t)])[:-1]
    f1 = 2 * caught / (len(t) - np.arange(len(t)) + t.sum())
    best = int(np.argmax(np.where(np.concatenate([[True], m[1:] > m[:-1]]), f1, 0)))
    split = (m[best] + m[best - 1]) / 2 if best else m[0] - 1e-3
    weights = np.zeros(dim)
    weights[chosen] = w
    return ToxicityModel(weights, float(b - split + np.log(threshold / (1 - threshold))))


def score_toxicity(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """(key, score, predicted) of every row; a null or empty text has the score of a text without features.

    Null keys and repeated rows are scored like any other, each for itself; an empty table gives an empty result; other columns are
    not looked at.  Texts of any length are scored whole."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, block in features(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(block)), pa.array(held.value.score(block), pa.float64())], ["doc_id", "score"])

    out = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(released(score), "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumnRenamed("doc_id", key)


def drop_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` without rows of a score of ``threshold`` or more, in one pass; columns stay as they are, whatever their names.

    Null and empty texts are scored as texts without features; repeated rows go or stay alike; an empty table stays empty."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, block in features(batch.column(place)):
                yield batch.slice(at, len(block)).filter(pa.array(held.value.score(block) < threshold, pa.bool_()))

    return docs.mapInArrow(released(keep), docs.schema)
