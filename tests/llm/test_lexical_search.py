"""Ranked search against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from inkwell.llm import lexical_search

PARTS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return PARTS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=10):
    held = [(i, Counter(terms(t))) for i, t in docs if i is not None and terms(t)]
    n_docs, n_words = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * k + 1))) for t, k in df.items()}
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 25 + 75 * sum(c.values()) * n_docs // n_words
            s = sum(w[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0:
                scores.append((-s, i))
        out += [(item, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def corpus(seed, docs=300, words=40):
    rng = random.Random(seed)
    stock = [f"w{k}" for k in range(words)] + ["Élan", "élan", "3d", "X"]
    text = lambda n: rng.choice([" ", "--", "\n"]).join(rng.choice(stock[: rng.randrange(2, len(stock))]) for _ in range(n))
    rows = [(rng.randrange(-1000, 10**12), text(rng.randrange(0, 60))) for _ in range(docs)]
    rows += [(2**60 + k, rows[5][1]) for k in range(40)] + [rows[7], rows[7], (None, "w1 w2"), (5, None), (6, " .. ")]
    items = [(k, text(rng.randrange(0, 25))) for k in range(12)] + [(3, rows[5][1]), (None, "w1 w1 w2"), (99, None), (98, "unheard of")]
    return rows, items


def found(spark, docs, items, parts=3, **how):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    return sorted((tuple(r) for r in lexical_search.search(d, spark.createDataFrame(items, "item_id long, text string"), **how).collect()), key=str)


@pytest.mark.parametrize(("how", "parts"), [({}, 3), ({"top": 3, "item_bytes": 200}, 1)])
def test_all_scores(spark, how, parts):
    docs, items = corpus(1)
    assert found(spark, docs, items, parts, **how) == brute(docs, items, how.get("top", 10))


@pytest.mark.parametrize("limits", [(512, 64), (1, 1), (7, 3)])
def test_intervals_of_any_size(monkeypatch, limits):
    """Small leaves and one split at a time find what a scan finds; ties go to smaller ids; segments follow each other."""
    monkeypatch.setattr(lexical_search, "LEAF", limits[0])
    monkeypatch.setattr(lexical_search, "AT_ONCE", limits[1])
    rng = np.random.default_rng(4)
    weights = rng.integers(0, 4, 30)
    best, scores = lexical_search.Best(5), {}
    for s in range(3):
        ids = rng.permutation(200) + 200 * (2 - s)
        doc, term = np.nonzero(rng.random((200, 30)) < 0.3)
        tf = rng.integers(1, 3, len(doc))
        row = {"docs": ids.tobytes(), "sizes": np.full(200, 10, np.int32).tobytes(), "doc": doc.astype(np.int32).tobytes(), "term": term.astype(np.int32).tobytes(), "tf": tf.astype(np.int32).tobytes()}
        segment = lexical_search.Segment([row], weights, 600, 6000)
        terms_, times = np.arange(0, 30, 2), np.arange(15) % 3 + 1
        lexical_search.search_segment(segment, terms_, times, best)
        for d, t, f in zip(doc.tolist(), term.tolist(), tf.tolist(), strict=True):
            if t % 2 == 0:
                own = weights[t] * (10**9 * f // (1000 * f + 8 * 100)) * times[t // 2]
                scores[int(ids[d])] = scores.get(int(ids[d]), 0) + int(own)
    want = sorted((-s, i) for i, s in scores.items() if s > 0)[:5]
    assert [(-int(s), int(i)) for s, i in zip(best.scores, best.ids, strict=True)] == want


def test_few_intervals_are_opened(monkeypatch):
    """A document that stands out is found without reading the lists out."""
    docs = 4096
    doc, term = np.divmod(np.arange(docs * 8), 8)
    row = {"docs": np.arange(docs).tobytes(), "sizes": np.full(docs, 9, np.int32).tobytes(), "doc": np.append(doc, 777).astype(np.int32).tobytes(), "term": np.append(term, 8).astype(np.int32).tobytes(), "tf": np.ones(docs * 8 + 1, np.int32).tobytes()}
    segment = lexical_search.Segment([row], np.array([1] * 8 + [50]), docs, docs * 9)
    opened, peaks = [], segment.peaks
    monkeypatch.setattr(segment, "peaks", lambda a, b: opened.append(len(a)) or peaks(a, b))
    best = lexical_search.Best(1)
    lexical_search.search_segment(segment, np.arange(9), np.ones(9, np.int64), best)
    assert best.ids.tolist() == [777] and sum(opened) < 12


def test_empty_tables_and_clashing_names(spark):
    docs, items = "doc_id long, text string", "item_id long, text string"
    assert found(spark, [], [(1, "a")]) == found(spark, [(1, "a b")], []) == found(spark, [(1, "a b")], [(1, "q")]) == []
    d = spark.createDataFrame([(1, "a b", 5, 6), (2, "b c " * 50_000, 7, 8)], docs + ", rank int, score int")
    i = spark.createDataFrame([(4, "c", 9)], items + ", number int")
    got = lexical_search.search(d, i)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and [tuple(r)[:3] for r in got.collect()] == [(4, 1, 2)]
