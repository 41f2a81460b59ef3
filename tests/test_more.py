"""Packing and joining of slices, the picker hook, and neighbours by inverted lists, each against a plain loop."""

import random

import numpy as np

from inkwell.operators import folding, packing, pages, vectors

SECTIONS = "doc string, pos int, sid string, paras array<string>"


def packed(secs, limit):
    """(job, pos, first, last) as one goes through the sections by hand."""
    out, job, open_, size = [], 0, False, 0
    for pos, paras in secs:
        n = [len("".join(p.split())) for p in paras]
        if not n:
            continue
        if sum(n) > limit:
            job, open_, size = job + open_, False, 0
            first = held = 0
            for i, m in enumerate(n):
                if i > first and held + m > limit:
                    out.append((job, pos, first, i - 1))
                    job, first, held = job + 1, i, 0
                held += m
            out.append((job, pos, first, len(n) - 1))
            job += 1
            continue
        if open_ and size + sum(n) > limit:
            job, size = job + 1, 0
        out.append((job, pos, 0, len(n) - 1))
        open_, size = True, size + sum(n)
    return out


def test_sections_pack_as_by_hand(spark):
    rng = random.Random(1)
    docs = {f"d{d}": [(pos, ["x " * rng.randrange(12) for _ in range(rng.randrange(5))]) for pos in range(rng.randrange(1, 9))] for d in range(60)}
    docs["nine"] = [(0, ["甲" * 348]), *((i, ["乙" * n]) for i, n in enumerate([1007, 365, 169, 367, 292, 370, 275, 604], start=1))]
    docs["big"] = [(0, ["z" * 100]), (1, ["x" * 2500, "y" * 2500])]
    rows = spark.createDataFrame([(d, p, f"s{p}", paras) for d, secs in docs.items() for p, paras in secs], SECTIONS)
    for limit in (15, 4000):
        got = {}
        for r in packing.pack_sections(rows, limit).collect():
            assert r.sid == f"s{r.pos}"
            got.setdefault(r.doc, []).append((r.job, r.pos, r["first"], r["last"]))
        assert {d: sorted(v) for d, v in got.items()} == {d: sorted(p) for d, secs in docs.items() if (p := packed(secs, limit))}
    assert len({j for j, *_ in got["nine"]}) == 1 and sorted(got["big"]) == [(0, 0, 0, 0), (1, 1, 0, 0), (2, 1, 1, 1)]


def test_neighbouring_slices_join(spark):
    rows = [("d", 0, "a", ["p1"]), ("d", 1, "a", ["p2", "p3"]), ("d", 2, "b", ["q"]), ("d", 3, "a", ["p4"]), ("e", 5, None, []), ("e", 6, None, ["r"]), ("e", 7, "a", ["s"])]
    got = packing.merge_slices(spark.createDataFrame(rows, "doc string, seq int, sid string, paras array<string>")).orderBy("doc", "seq")
    assert [tuple(r) for r in got.collect()] == [("d", 0, "a", ["p1", "p2", "p3"]), ("d", 2, "b", ["q"]), ("d", 3, "a", ["p4"]), ("e", 5, None, ["r"]), ("e", 7, "a", ["s"])]


def test_picker_answers(spark):
    """Places out of range and captions too long are mended; no list, too few answers and failures fall back, each page on its own."""
    photos = [(i, p, f"u{p}", "cover" if p == 2 and i % 2 else "body") for i in range(6) for p in range(4)]
    c = spark.createDataFrame(photos, "page_id long, pos int, url string, role string")
    a = spark.createDataFrame([(i, "t", None) for i in range(5)], "page_id long, title string, body string")
    calls = []

    def scorer(frame):
        calls.append(len(frame))
        if (frame["page_id"] == 3).any():
            raise RuntimeError("down")
        said = {0: {"keep": [3, 9, -1, "1", 0, 2, 1], "captions": ["x" * 40, "", "", None, "c"]}, 1: {"keep": []}, 2: {"keep": None}, 4: "no", 5: {"keep": [1], "captions": "no"}}
        return [said[i] for i in frame["page_id"]]

    got = {}
    for r in pages.choose_images(c.coalesce(1), a, scorer, rows=2).orderBy("page_id", "n").collect():
        got.setdefault(r.page_id, []).append((r.n, r.url, r.caption))
    assert got == {0: [(1, "u3", "x" * 24), (2, "u1", None), (3, "u0", "c")], 2: [(1, "u0", None), (2, "u1", None)], 3: [(1, "u2", None), (2, "u0", None), (3, "u1", None)], 4: [(1, "u0", None), (2, "u1", None)], 5: [(1, "u1", None)]}
    plain = lambda df: sorted((r.page_id, r.n, r.url) for r in df.collect())
    assert plain(pages.choose_images(c, a)) == plain(pages.pick_images(c))
    assert pages.choose_images(c.limit(0), a, lambda f: [{}]).count() == 0


def test_neighbours_by_lists(spark):
    """Nine of ten neighbours at least are met by default; with as many probes as lists the result is exact, blocks of any size."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((30, 24))
    rows = [(i, [float(x) for x in centres[i % 30] * (i % 3 > 0) + 0.6 * rng.standard_normal(24)]) for i in range(900)]
    v = spark.createDataFrame(rows, "id long, vector array<double>")
    q = v.where("id % 7 = 0")
    exact = {(r.query, r.place): (r.id, round(r.cosine, 6)) for r in vectors.nearest(q, v, 8).collect()}
    same = {(r.query, r.place): (r.id, round(r.cosine, 6)) for r in vectors.nearest_in_lists(q, v, 8, lists=9, probes=9, block=50).collect()}
    assert same == exact
    found = {(r.query, r.id) for r in vectors.nearest_in_lists(q, v, 8).collect()}
    assert len(found & {(k[0], x[0]) for k, x in exact.items()}) >= 0.9 * len(exact)
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 0.0])], "id long, vector array<double>")
    assert [(r.query, r.id, r.place) for r in vectors.nearest_in_lists(odd.where("id = 1"), odd, 2, lists=2, probes=2).orderBy("place").collect()] == [(1, 1, 1), (1, 4, 2)]


def test_few_fold_as_many_do(spark):
    """A bounded list folds in one task as the rounds of joins fold it, ties and copies of copies among them."""
    rng = np.random.default_rng(6)
    h, rows = [0], []
    for i in range(60):
        base = int(h[rng.integers(len(h))]) if rng.random() < 0.6 else int(rng.integers(-(2**63), 2**63 - 1))
        for b in rng.choice(64, rng.integers(0, 4), replace=False):
            base ^= 1 << int(b) if b < 63 else -(1 << 63)
        h.append(base)
    for i, x in enumerate(h):
        rows.append((i, x, [float(v) for v in rng.standard_normal(3)], None if i % 9 == 0 else float(rng.integers(4))))
    d = spark.createDataFrame(rows, "id long, h long, vector array<double>, score double")
    for least in (0.82, 0.97):
        many = {r.id: r.primary for r in folding.fold_events(d, d, d, least).collect()}
        assert {r.id: r.primary for r in folding.fold_few(d, d, d, least).collect()} == many
    assert {r.id: r.primary for r in folding.fold_few(d, d, d, 0.97, limit=10).collect()} == many and len(set(many.values())) < len(many)
