"""Spelling variants against all pairs of words."""

import random
import zlib

import pytest

from inkwell.llm import queries, spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=5):
    out, forms = {}, {}
    for w, n in counts.items():
        close = sorted((-m, v) for v, m in counts.items() if near(w, v))
        if close and -close[0][0] >= ratio * n:
            forms[w] = close[0][1]
        out[w] = [n, forms.get(w), -close[0][0] if w in forms else None, None, len(close)]
    for w in out:
        root = w
        while root in forms:
            root = forms[root]
        out[w][3] = root
    return {w: tuple(x) for w, x in out.items()}


def found(spark, counts, **how):
    vocabulary = spark.createDataFrame(list(counts.items()), "word string, n long")
    return {r.word: (r.n, r.form, r.form_n, r.root, r.n_near) for r in spelling.spelling_variants(vocabulary, **how).collect()}


def family(seed, letters="abeéÀÿ𝒳", words=220):
    rng = random.Random(seed)
    counts = {}
    for _ in range(words):
        base = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 6)))
        counts[base] = rng.choice([5, 25, 125, 130, 700])
    return counts


@pytest.mark.parametrize("most_bytes", [spelling.FILTER_BYTES, 1])
def test_all_pairs(spark, most_bytes):
    """Short words over a few code points have many neighbours, ties and chains; filters that are full only let more pass."""
    counts = family(1)
    want = brute(counts)
    assert max(x[4] for x in want.values()) > 5 and any(x[1] and want[x[1]][1] for x in want.values())
    assert found(spark, counts, most_bytes=most_bytes) == want


def test_small_blocks_of_probes(spark, monkeypatch):
    counts = family(2, words=60)
    points = [w for w in counts if len(w) == 4]
    monkeypatch.setattr(spelling, "PROBES", 7)
    vocabulary = spark.createDataFrame(list(counts.items()), "word string, n long")
    filters = spelling.build_filters(vocabulary)
    import numpy as np

    alphabet = np.array(sorted({ord(c) for w in counts for c in w}))
    matrix = np.array([[ord(c) for c in w] for w in points], np.uint32)
    got = {(points[r], t) for row, texts in spelling._edits(matrix, alphabet, filters) for r, t in zip(row.tolist(), texts, strict=True) if t in counts}
    assert got == {(a, b) for a in points for b in counts if near(a, b) and (len(b) < len(a) or len(a) == len(b) and a < b)}


def test_chains_ties_and_long_words(spark):
    """Forms are followed to the end; of equal counts the smallest word; words of thousands of code points are taken whole."""
    long = "ab" * 3_000
    counts = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "zzzzzz": 1, "zzzzzy": 5, "zzzzzx": 5, long: 10, long[1:]: 2, long + "q": 1, "alone": 9}
    assert found(spark, counts) == brute(counts)
    got = found(spark, counts)
    assert got["aaaaaa"][3] == "aaabbb" and got["zzzzzz"][1] == "zzzzzx" and got[long[1:]][1] == long


def test_empty_and_null(spark):
    empty = spark.createDataFrame([], "word string, n long, form string")
    assert spelling.spelling_variants(empty).collect() == []
    odd = spark.createDataFrame([(None, 3, "x"), ("", 9, "y"), ("a", 1, "z")], "word string, n long, form string")
    got = spelling.spelling_variants(odd)
    assert got.columns == ["word", "n", "form", "form_n", "root", "n_near"]
    assert sorted((str(r.word), r.n, r.form, r.root, r.n_near) for r in got.collect()) == [("", 9, None, "", 0), ("None", 3, None, None, 0), ("a", 1, None, "a", 0)]
    words = spark.createDataFrame([("ab",), ("ab",), (None,), ("a",)], "word string")
    assert [tuple(r) for r in spelling.count_words(words, min_chars=2, min_count=2).collect()] == [("ab", 2)]


def test_query_on_documents(spark, tmp_path):
    """Runs, capitals, deletions by checksum, nulls and repeated rows as the contract has them."""
    rng = random.Random(8)
    stock = ["Ééglise", "maison", "Maisons", "jardinier", "jardinière", "éGLISEs", "court", "a×b÷cde"]
    docs = [(i, None if i % 50 == 7 else " ".join(rng.choice(stock) for _ in range(rng.randrange(0, 40))), i) for i in range(400)]
    docs += [docs[3], (None, "maison maison", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, word long").write.parquet(f"{tmp_path}/documents.parquet")
    counts = {}
    for doc_id, text, _ in docs:
        for part in (text or "").split(" "):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in part)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and run and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] = counts.get(run, 0) + 1
    counts = {w: n for w, n in counts.items() if n >= 5}
    got = {r.word: (r.n, r.form, r.form_n, r.root, r.n_near) for r in queries.op12_spelling_variants(spark, str(tmp_path)).collect()}
    assert got == brute(counts)
