"""Printed texts, restored bodies, readers, folds, embedders and the ranking of an edition against known values and brute force."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.functions import text as X
from inkwell.operators import edition, folding, graph, merge, newsroom, pages, ranking, taste, vectors
from inkwell.sources import dumps

ITEM = "content_hash string, source string, kind string, title string, url string, summary string, content string, collector string, published_at timestamp, fetched_at timestamp, heat double, rank int"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_daily_digest(spark):
    body = "1、为什么天空在傍晚会变成红色的？背景 无关 2、人为什么在睡前会想很多事情？ 3. 短？ 小李精选 4、这一条不应该出现在目录里吗？"
    args = [F.lit(x) for x in ("zhihu", "知乎早报：今天…", "c")]
    assert one(spark, X.display_title(*args)) == "今日知乎日报"
    assert one(spark, X.display_title(F.lit("rss"), F.lit("<b>A</b> &amp;\n B"), F.lit("c"))) == "A & B"
    assert one(spark, X.expand_daily_title(F.lit("t"), F.lit(body))) == "为什么天空在傍晚会变成红色的？；人为什么在睡前会想很多事情？"
    assert one(spark, X.expand_daily_title(F.lit("t"), F.lit("1、只有一条足够长的问题吗？"))) == "t"
    paper = one(spark, X.newspaper_body(F.lit("article"), F.lit(body), F.lit(None).cast("string"), *args))
    assert paper.startswith("**为什么天空在傍晚会变成红色的？；") and paper.endswith(body)


def test_paragraphs(spark):
    text = "# 标题\n\n> 引\n![x](y)\n第一行 [链接](http://a) **粗**\n第二行\n\n第三段"
    assert one(spark, X.first_paragraph(F.lit(text))) == "第一行 链接 粗 第二行"
    assert one(spark, X.first_paragraph(F.lit("字" * 200))) == "字" * 139 + "…"
    assert one(spark, X.trim_boilerplate(F.lit("正文\n 风险提示：x\n后面"))) == "正文"
    assert one(spark, X.item_slug(F.lit("Hello, 世界 one!"), F.lit("abcdef0123"), F.lit(3))) == "03-Hello-世界-one"


@pytest.mark.parametrize(
    "content, summary, stub",
    [("begin", "begin of it", True), ("same", "same", True), ("x" * 500, "y", True), ("x" * 501, "x" * 501, False), ("other", "begin", False), ("", "begin", False), (None, "s", False)],
)
def test_stubs(spark, content, summary, stub):
    assert one(spark, X.is_stub(F.lit(content).cast("string"), F.lit(summary))) is stub


def test_restored_bodies(spark):
    long = "正文" * 400
    rows = [("a", "正文正文", "正文正文正文"), ("b", "写好的文章" * 200, "写好"), ("c", "正文", "正文"), ("d", "正文", "正文")]
    items = spark.createDataFrame(rows, "content_hash string, content string, summary string")
    payload = json.dumps({"content": [{"value": f"<p>{long}</p><div>author 相关文章 x</div>"}, "short"], "summary": "s"})
    kept = spark.createDataFrame([("a", payload), ("b", payload), ("c", "not json"), ("c", json.dumps({"description": {"value": "<b>正文甲</b>"}}))], "content_hash string, payload string")
    got = {r.content_hash: (r.restored, r.content) for r in merge.restore_bodies(items, kept).collect()}
    assert got == {"a": (True, long), "b": (False, "写好的文章" * 200), "c": (True, "正文甲"), "d": (False, "正文")}


def test_lede(spark):
    rows = [("e1", f"h{i}", "headline", "story", i, f"Title {i}", f"The sentence number {i} is here. More.") for i in range(4)]
    rows += [("e1", "x", "health", "story", 9, "Health", "Never in the lede at all."), ("e1", "y", "oral", "index", 10, "Index", "Not a story, so not named."), ("e2", "z", "health", "story", 1, "H", "Body of health.")]
    got = {r.edition_id: r.lede for r in edition.lede(spark.createDataFrame(rows, "edition_id string, id string, section string, role string, seq int, title string, body string"), "am", spark.createDataFrame([("e1",), ("e2",)], "edition_id string")).collect()}
    assert got["e1"] == "今晨：The sentence number 0 is here.The sentence number 1 is here.The sentence number 2 is here.。内页还有Title 3。"
    assert got["e2"] == "本期早报稿件不足,请先看体检页,再决定要不要当它是一份报。"


def test_section_texts(spark):
    d = spark.sql("SELECT 'e' AS edition_id, 1 AS pos, 'video' AS kind, 'T' AS title, 'bilibili' AS source, 'me' AS author, 'c' AS collector, '' AS content, CAST(NULL AS STRING) AS summary, 'https://x' AS url, '' AS dateline, CAST(NULL AS STRING) AS already")
    text = d.select(edition.item_text(already="already").alias("t")).first().t
    assert text == "## T\n\n> 时间未知 · bilibili · me\n\n_视频暂不转写，只保留标题和链接。_\n\n原文地址(需上网,纸上看不到点): `https://x`\n"
    feeds = spark.createDataFrame([("c", "rss", None, 2.0)], "collector string, source string, kind string, weight double")
    page = edition.subscription_pages(d, feeds, "now").first().text
    assert "> 订阅源 1 · 本页 1 条 · 其中 0 条有正文" in page and "- **c** · `rss` / `article` · weight=2.0" in page and "1. T · bilibili · 无正文" in page
    both = spark.createDataFrame([("e", "headline", "B"), ("e", "lede", "A"), ("e", "hotlist", "C")], "edition_id string, section string, text string")
    assert edition.digest(both).first().text == "A\n\nB\n\nC"


def test_atom_creator_and_api_dumps(spark, tmp_path):
    long = "word " * 30
    (tmp_path / "a.xml").write_text(f'<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Atom one</title><link rel="self" href="http://x/s"/><link href="http://x/1"/><summary>short</summary><content type="html">&lt;p&gt;{long}&lt;/p&gt;</content><author><name>Ann</name></author><published>2024-01-02T03:04:05Z</published><category term="t1"/></entry><entry><title>Two</title><link href="http://x/2"/><updated>2024-01-03T00:00:00Z</updated></entry></feed>')
    got = sorted((r.title, r.url, r.author, r.content, str(r.published_at), r.tags) for r in dumps.read_feed(spark, str(tmp_path / "a.xml"), "n", atom=True).collect())
    assert got == [("Atom one", "http://x/1", "Ann", long.strip(), "2024-01-02 03:04:05", ["t1"]), ("Two", "http://x/2", "n", None, "2024-01-03 00:00:00", None)]
    (tmp_path / "c.jsonl").write_text('{"note_id":"1","type":"video","title":" ","desc":"Long text of a note","time":"1700000000000","user":{"nickname":"N","user_id":"u"},"interact_info":{"liked_count":"1.2万"}}\n{"title":"no id"}\n')
    r = dumps.read_creator(spark, str(tmp_path / "c.jsonl"), "n").collect()
    assert [(x.title, x.kind, x.author, x.author_id, x.heat, x.url) for x in r] == [("https://www.xiaohongshu.com/explore/1", "post", "N", "u", None, "https://www.xiaohongshu.com/explore/1"), ("no id", "post", None, None, None, "urn:xhs:n:no id")]
    (tmp_path / "p.json").write_text('{"code":20000,"data":{"title":" A ","content":"<p>x</p><p>y</p>"}}')
    assert [(x.title, x.text) for x in dumps.read_article_api(spark, str(tmp_path / "p.json")).collect()] == [("A", "x\n\ny")]
    (tmp_path / "q.json").write_text('{"code":404,"data":{"title":"A"}}')
    assert dumps.read_article_api(spark, str(tmp_path / "q.json")).count() == 0


def test_fold_of_a_long_chain(spark):
    n = 2000
    nodes = spark.range(n).select("id", F.col("id").alias("place"))
    edges = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r.id: r.leader for r in graph.greedy_fold(nodes, edges).collect()}
    assert got == {i: i - i % 2 for i in range(n)}
    few = graph.greedy_fold(nodes.where("id < 40"), edges.where("a < 39"), together=1)  # in rounds
    assert {r.id: r.leader for r in few.collect()} == {i: i - i % 2 for i in range(40)}


def test_fold_of_copies_is_the_sequential_one(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) - 2**63 for _ in range(12)]
    rows = []
    for i in range(150):
        h = rng.choice(base)
        for _ in range(rng.randrange(0, 4)):
            h ^= 1 << rng.randrange(63)
        rows.append((i, h, rng.randrange(40) / 10))
    leader, kept = {}, []
    for i, h, _ in sorted(rows, key=lambda r: (-r[2], r[0])):
        leader[i] = next((k for k, g in kept if bin((h ^ g) & (2**64 - 1)).count("1") <= 3), i)
        if leader[i] == i:
            kept.append((i, h))
    d = spark.createDataFrame(rows, "id long, h long, score double")
    assert {r.id: r.leader for r in folding.fold_simhash(d, d.select("id", "h")).collect()} == leader
    assert {r.id: r.leader for r in folding.fold_simhash(d, d.select("id", "h"), F.col("score") * 2, F.col("id")).collect()} == leader
    near = {(a, b) for a, g, _ in rows for b, h, _ in rows if a < b and bin((g ^ h) & (2**64 - 1)).count("1") <= 3}
    assert {(r.a, r.b) for r in folding.near_pairs(d).collect()} == near


def test_cosine_buckets_find_nine_of_ten(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 32))
    rows = [(i, [float(x) for x in centres[i % 40] + 0.32 * rng.standard_normal(32)]) for i in range(400)]
    v = spark.createDataFrame(rows, "id long, vector array<double>")
    exact = {(r.a, r.b) for r in folding.cosine_pairs(v, 0.82).collect()}
    found = {(r.a, r.b) for r in folding.cosine_pairs(v, 0.82, tables=32).collect()}
    assert found <= exact and len(exact) > 500 and len(found) >= 0.9 * len(exact)
    same = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(5)], "id long, vector array<double>")
    assert folding.cosine_pairs(same, 0.82, tables=1).count() == 10


def test_embedders(spark, tmp_path):
    texts = [(i, t) for i, t in enumerate(["strong coffee in the morning", "strong coffee in the evening", "the fox and the hound", "the fox and the goose", *(f"filler text {'abcdefgh'[k]} {k * 37}" for k in range(8))])]
    d = spark.createDataFrame(texts, "id long, text string").withColumn("length", F.char_length("text")).withColumn("weight", F.lit(1.0))
    h = {r.id: np.array(r.vector) for r in vectors.HashEmbedder().fit(d).transform(d).collect()}
    assert h[0] @ h[1] > 0.8 > h[0] @ h[2] and len(h[0]) == 128
    model, embedder = taste.load_or_fit(spark, str(tmp_path / "m"), d, vectors.NgramEmbedder(dim=8), k=2, seeds=2)
    again, other = taste.load_or_fit(spark, str(tmp_path / "m"), d.where("false"))
    a, b = ({r.id: (np.array(r.vector), r.sim) for r in m.transform(e.transform(d)).collect()} for m, e in ((model, embedder), (again, other)))
    assert all(np.allclose(a[i][0], b[i][0]) and math.isclose(a[i][1], b[i][1]) for i in a)
    assert len(a[0][0]) == 8 and a[0][0] @ a[1][0] > 0.9 > a[0][0] @ a[2][0] and abs(np.linalg.norm(a[3][0]) - 1) < 1e-6


def test_images_of_feeds_and_outcomes(spark):
    html = '<img class="AuthorInfo-x" src="https://a/1.jpg"><img src="https://a/2.jpg"><img src="https://a/2.jpg?w=3"><img src="https://a/t.jpg" width="20" height="999">'
    d = spark.createDataFrame([(1, "https://mp.weixin.qq.com/s/1", html), (2, "https://other/1", html)], "page_id long, url string, html string")
    assert [(r.page_id, r.url) for r in pages.feed_images(d).collect()] == [(1, "https://a/2.jpg")]
    got = pages.outcome_counts(pages.extract(d.withColumn("status", F.lit(200)).withColumn("error", F.when(F.col("page_id") == 1, "x"))), spark.createDataFrame([(True,), (False,)], "restored boolean")).first()
    assert (got.ok, got.degraded, got.blocked, got.error, got.cached, got.restored) == (0, 1, 0, 1, 0, 1)


def _edition_rows():
    rng = random.Random(12)
    rows, vecs = [], []
    for i in range(60):
        body = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "然而", "数据 12%"]) + str(rng.randrange(50)) for _ in range(rng.randrange(30, 60)))
        kind = ("article", "post", "video", "article")[i % 4]
        rows.append((f"h{i:03d}", ("rss", "zhihu", "weibo")[i % 7 % 3], kind, f"title {i}", f"https://x/{i}", None, body, "c", "2024-01-30 10:00:00", "2024-01-30 10:00:00", float(i * 1000), None))
        v = np.array([rng.gauss(0, 1) for _ in range(6)])
        vecs.append((f"h{i:03d}", [float(x) for x in v]))
    return rows, vecs


def test_rank_edition_by_brute_force(spark):
    """Limit, verdicts, threshold, diversity and sections of one edition, step by step; no two items are near."""
    rows, vecs = _edition_rows()
    items = spark.createDataFrame([(*r[:8], *[__import__("datetime").datetime.fromisoformat(t) for t in r[8:10]], *r[10:]) for r in rows], ITEM).withColumn("length", X.item_length("content", "summary", "title"))
    v = spark.createDataFrame(vecs, "content_hash string, vector array<double>")
    centroids = spark.createDataFrame([(0, [1.0] + [0.0] * 5, 5), (1, [0.0, 1.0] + [0.0] * 4, 3)], "cluster int, centroid array<double>, size long")
    model = taste.TasteModel(centroids, spark.createDataFrame([(6.0, 0.5)], "mu double, sigma double"))
    scorer = lambda title, body: F.when(title.endswith("7"), F.struct(F.lit(0.95).alias("score"), F.lit("r").alias("reason")))
    groups = [{"name": "g", "must": [], "any": ["alpha1"], "exclude": [], "weight": 1.0}]
    got = newsroom.rank_edition(items, v, model, groups, "2024-01-30 12:00:00", "pm", scorer=scorer, coarse=30, slots=12, near=0.999).orderBy("n").collect()

    base = ranking.keyword_matches(model.transform(ranking.rank_candidates(items).join(v, "content_hash")), groups, body=ranking.body_of())
    facts = {r.content_hash: r for r in newsroom.judged(base.withColumn("id", F.lit(0)), scorer).collect()}
    assert {k for k, r in facts.items() if r.critic.source == "scorer"} == {k for k in facts if k.endswith("7")}

    def total(r, critic):
        z = math.log1p(r.heat) / math.log1p(1e6) if r.heat else 0.3
        hot = 0.0 if r.source == "weibo" else min(1.0, z) * 0.15
        return round(max(0.0, 0.35 * r.sim + 0.15 * r.len_score + 0.35 * critic + 0.05 * hot + 0.10 * r.keyword) * 0.5 ** (2 / 24), 9)

    coarse = sorted(facts, key=lambda k: (-total(facts[k], 0.5), k))[:30]
    score = {k: total(facts[k], facts[k].critic.score) for k in coarse}
    left = sorted((k for k in coarse if score[k] >= 0.12), key=lambda k: (-score[k], k))
    unit = {k: np.array(x) / np.linalg.norm(x) for k, x in vecs}
    chosen = [left[0]]
    while len(chosen) < min(12, len(left)):
        rest = [k for k in left if k not in chosen]
        chosen.append(max(rest, key=lambda k: (round(0.7 * score[k] - 0.3 * max(unit[k] @ unit[c] for c in chosen), 9), -left.index(k))))
    head = chosen[:3]
    deep = [k for k in chosen[3:] if len(facts[k].content) >= 200][:8]
    critical = sorted((k for k in chosen if k not in head + deep), key=lambda k: (-facts[k].critic.score, chosen.index(k)))[:3]
    assert [(r.section, r.content_hash) for r in got] == [*(("headline", k) for k in head), *(("deepread", k) for k in deep), *(("critical", k) for k in critical)]
    assert all(math.isclose(r.score, score[r.content_hash], abs_tol=1e-6) for r in got)


def test_threshold_leaves_a_thin_edition(spark):
    rows, _ = _edition_rows()
    d = spark.createDataFrame([r[:8] for r in rows[:8]], "content_hash string, source string, kind string, title string, url string, summary string, content string, collector string").withColumn("total", F.when(F.col("content_hash") == "h001", 0.12).otherwise(0.1199))
    assert [r.content_hash for r in ranking.viable(d).collect()] == ["h001"]


def test_oral_section_and_digest(spark):
    """Notes come under the head, an edition without items says so; a digest names what failed, also where nothing else is there."""
    row = "SELECT 'e-am' AS edition_id, 1 AS pos, 'article' AS kind, 'T' AS title, 'rss' AS source, 'me' AS author, 'c' AS collector, 'Body.' AS content, CAST(NULL AS STRING) AS summary, '' AS url, 'today' AS dateline, '![](i)' AS images"
    editions = spark.createDataFrame([("e-am",), ("f-pm",)], "edition_id string")
    got = {r.edition_id: r.text for r in edition.oral_pages(spark.sql(row), editions, "now", ("one",)).collect()}
    head = "# 口播\n\n> 合集按天滴灌，订阅 UP 新片转写后见报。不进头版打分。 · now\n\n> one\n\n"
    assert got == {"e-am": head + "## T\n\n> today · rss · me\n\n![](i)\n\nBody.\n\n---\n", "f-pm": head + "_今日口播未成。_\n"}
    sections = spark.createDataFrame([("e-am", "hotlist", "H\n\n"), ("e-am", "oral", "O")], "edition_id string, section string, text string")
    failed = spark.createDataFrame([("f-pm", "health", None), ("f-pm", "lede", "down")], "edition_id string, section string, error string")
    got = {r.edition_id: r.text for r in edition.digest(sections, failed, "now").collect()}
    assert got["e-am"] == "# 自动日报 · 早报 · e-am\n\n> 期号 `e-am` · 生成于 now\n> 版面 2 · 失败 0\n\nO\n\n---\n\nH\n"
    assert got["f-pm"] == "# 自动日报 · 晚报 · f-pm\n\n> 期号 `f-pm` · 生成于 now\n> 版面 0 · 失败 2\n\n**本期残缺。** 失败版面:\n\n- `lede`: down\n- `health`:\n"
    assert {r.edition_id for r in edition.digest(sections, generated="now").collect()} == {"e-am"}
