"""N-gram vectors against counts in plain Python, the range finder against a full decomposition, and stages saved and loaded."""

import math
import re
from collections import Counter

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from inkwell.operators import folding, grams, taste, vectors

from .conftest import SF

ODD = [None, "", "   ", "a", "A b", "abc", "abcabc", "日本語テキスト", "é𝒳é", "aa aa\taa", "x" * 3000, "The fox, the fox; the FOX."]


def plain(text):
    s = re.sub(r"\s+", "", (text or "").lower())
    return Counter(["_empty_"] if not s else [g for n in (2, 3) for g in ([s] if len(s) < n else [s[i : i + n] for i in range(len(s) - n + 1)])])


def test_grams_of_odd_texts(spark, monkeypatch):
    """Slices of any size give the counts, shares and weights of every text."""
    d = spark.createDataFrame(list(enumerate(ODD)), "id long, text string").coalesce(1)
    counts = [plain(t) for t in ODD]
    df = Counter(g for c in counts for g in c)
    top = sorted(df, key=lambda g: (-df[g], g))[:40]
    for size in (grams.SLICE, 4):
        monkeypatch.setattr(grams, "SLICE", size)
        monkeypatch.setattr(grams.slices, "__defaults__", (size,))
        v = vectors.fit_vocabulary(d, "id", "text", 40)
        assert [(r.gram, r.df) for r in v.orderBy("idx").collect()] == [(g, df[g]) for g in top]
        got = {r.id: r for r in grams.sparse_rows(d, v, "id", "text").collect()}
        for i, c in enumerate(counts):
            want = {k: c[g] / sum(c.values()) * (math.log((len(ODD) + 1) / (df[g] + 1)) + 1) for k, g in enumerate(top) if g in c}
            assert got[i].idx == sorted(want) and np.allclose(got[i].x, [want[k] for k in sorted(want)])
            assert math.isclose(got[i].norm, math.sqrt(sum(x * x for x in want.values())) + 1e-9)
    assert all(grams.decode(grams.encode(g)) == g for g in df)
    assert grams.sparse_rows(d.limit(0), v, "id", "text").count() == 0


def test_range_finder_is_the_decomposition(spark):
    """The leading directions of fifty texts span what numpy's full decomposition spans, with fewer directions than texts too."""
    d = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 50").select(F.col("doc_id").alias("id"), "text").repartition(3)
    v = vectors.fit_vocabulary(d, "id", "text", 600).cache()
    words = grams.collect_vocabulary(v)
    import pyarrow as pa

    texts = pa.array([r.s for r in d.select(grams.plain("text").alias("s")).collect()])
    x = np.concatenate([m for _, m in words.dense(texts)])
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    for target in (8, 32):
        top = grams.leading_directions(d, v, "text", target)
        assert np.allclose(top.T @ top, np.eye(target))
        assert np.allclose(np.linalg.norm(x @ top, axis=0), s[:target], rtol=1e-4)
        assert np.linalg.norm(top @ top.T - vt[:target].T @ vt[:target]) < 1e-3


def test_pipelines_are_saved_and_loaded(spark, tmp_path):
    """Fitted and unfitted stages come back with their params, columns of any name among them."""
    d = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("n"), F.col("text").alias("body"), F.char_length("text").alias("chars")).where("n < 60")
    stages = [vectors.NgramEmbedder("n", "body", dim=8, vector="v"), taste.Taste(k=2, seeds=2, vector="v", length="chars")]
    Pipeline(stages=stages).write().overwrite().save(f"{tmp_path}/p")
    again = Pipeline.load(f"{tmp_path}/p")
    assert [s.getOrDefault("vectorCol") for s in again.getStages()] == ["v", "v"] and again.getStages()[1].getOrDefault("k") == 2
    model = again.fit(d)
    model.write().overwrite().save(f"{tmp_path}/m")
    other = PipelineModel.load(f"{tmp_path}/m")
    a, b = ({r.n: (r.v, r.sim, r.len_score) for r in m.transform(d).collect()} for m in (model, other))
    assert set(a) == set(b) and all(np.allclose(a[k][0], b[k][0]) and np.allclose(a[k][1:], b[k][1:]) for k in a)
    assert other.stages[0].uid == model.stages[0].uid and len(a[0][0]) == 8
    h = vectors.HashEmbedder("n", "body", 16)
    h.write().overwrite().save(f"{tmp_path}/h")
    assert len(vectors.HashEmbedder.load(f"{tmp_path}/h").fit(d).transform(d).first().vector) == 16


def test_best_of_rows_with_ties(monkeypatch, spark):
    """The best of each row are those of a whole sort, ties by id, whatever is compared at once; a task holds few cosines and gives few rows."""
    rng = np.random.default_rng(3)
    for ids in (rng.permutation(40), np.stack([rng.permutation(40) for _ in range(25)])):
        s = rng.integers(0, 4, (25, 40)) / 4.0
        for k in (1, 7, 40, 50):
            c, got = vectors._best(s, ids, k)
            cells = np.broadcast_to(ids, s.shape)
            for r in range(25):
                assert sorted(zip(-c[r], got[r])) == sorted(zip(-s[r], cells[r]))[:k]
    rows = [(i, [float(x) for x in rng.integers(-1, 2, 4)]) for i in range(300)]
    v = spark.createDataFrame(rows, "id int, vector array<float>").coalesce(1)
    q = v.where("id % 10 = 0")
    want = {(r.query, r.place): (r.id, r.cosine) for r in vectors.nearest(q, v, 5).collect()}
    m = np.array([x for _, x in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True) + 1e-9
    s = np.round(m @ m.T, 9)
    assert {k: i for k, (i, _) in want.items()} == {(a, p + 1): int(b) for a in range(0, 300, 10) for p, b in enumerate(np.lexsort((np.arange(300), -s[a]))[:5])}
    monkeypatch.setattr(vectors, "CELLS", 200)
    assert {(r.query, r.place): (r.id, r.cosine) for r in vectors.nearest(q, v, 5).collect()} == want
    sent = [(r["id"], np.array(r["vector"], np.float64)) for r in q.collect()]
    assert vectors._nearest_of(sent, v, 5).count() == 30 * 5  # not that many for each batch or slice


def test_pairs_of_growing_blocks(spark, monkeypatch):
    """Blocks grow with the table, so a vector is sent to a bounded number of tasks for long; the pairs are all and each comes once."""
    rng = np.random.default_rng(8)
    m = np.concatenate([rng.standard_normal((90, 6)), np.ones((30, 6))])
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, vector array<double>")
    u = m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-9)
    want = sorted((i, j) for i in range(120) for j in range(i + 1, 120) if u[i] @ u[j] >= 0.5)
    for block, cells in ((2, folding.CELLS), (512, 50), (5, 7)):
        monkeypatch.setattr(folding, "CELLS", cells)
        assert sorted((r.a, r.b) for r in folding.cosine_pairs(v, 0.5, block=block).collect()) == want
    dealt = folding._in_blocks(v.selectExpr("id", "vector", "0L AS bucket", "120 AS size"), 2)
    assert dealt.count() == 16 * 120  # one for each of 60 blocks before
