"""Known values and properties of the library's operators."""

import random

import pytest
from pyspark.sql import functions as F

from inkwell.functions import scoring
from inkwell.functions import text as X
from inkwell.operators import graph, merge, packing, ranking, timeline
from inkwell.sources import dumps


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "url, want",
    [
        ("http://www.bilibili.com/video/BV1?p=2&spm_id_from=x", "https://www.bilibili.com/video/BV1?p=2"),
        ("//m.weibo.cn/status/1?utm_source=a#top", "https://weibo.com/status/1"),
        ("https://example.com/a/?b=2&a=1&utm_medium=q", "https://example.com/a?a=1&b=2"),
        ("example.com", "https://example.com/"),
        ("https://EXAMPLE.com:443/x?q=a~b*c&e=", "https://example.com/x?q=a~b%2Ac"),
        ("https://mp.weixin.qq.com/s?__biz=1&mid=2&scene=3", "https://mp.weixin.qq.com/s?__biz=1&mid=2"),
        ("", ""),
    ],
)
def test_urls(spark, url, want):
    assert one(spark, X.normalize_url(F.lit(url))) == want


def test_titles_and_identity(spark):
    assert one(spark, X.normalize_title(F.lit("1、 宇树科技 发布新机器人！!"))) == one(spark, X.normalize_title(F.lit("宇树科技发布新机器人！")))
    same = [one(spark, X.content_hash(F.lit("rss"), F.lit(u), F.lit("t"))) for u in ("http://a.com/x/", "https://a.com/x?utm_source=1")]
    assert same[0] == same[1] and len(same[0]) == 32


@pytest.mark.parametrize("raw, want", [("123.4万", 1234000.0), ("2亿", 2e8), ("42", 42.0), ("1,234", 1234.0), ("x", None), (None, None)])
def test_heat(spark, raw, want):
    assert one(spark, X.parse_heat(F.lit(raw).cast("string"))) == want


def test_epochs(spark):
    got = [one(spark, F.unix_timestamp(X.parse_epoch(F.lit(v)))) for v in ("1700000000", "1700000000000", "1700000000000000", "99999999999", "2023-11-14T22:13:20Z")]
    assert got == [1700000000, 1700000000, 1700000000, None, 1700000000]


def test_tokens_and_ngrams(spark):
    assert one(spark, X.tokenize(F.lit("GPT 宇树机 foo_bar éclair a1"))) == ["gpt", "宇树", "树机", "a1"]
    assert one(spark, X.char_ngrams(F.lit("ab c"))) == ["ab", "bc", "abc"]
    assert one(spark, X.char_ngrams(F.lit("  "))) == ["_empty_"]


def test_html(spark):
    assert one(spark, X.html_to_text(F.lit("<p>a&nbsp; b</p><p>c<br/>d</p>"))) == "a b\n\nc\n\nd"


def test_hot_score_treats_zero_as_none(spark):
    got = spark.sql("SELECT * FROM VALUES (0.0D, 1), (0.0D, 0), (1000000.0D, 3) AS t(h, r)").select(scoring.hot_score("h", "r").alias("s")).collect()
    assert [round(r.s, 3) for r in got] == [0.824, 0.3, 1.0]


def test_new_and_rising(spark):
    rows = [("A", h, r) for h, r in ((-10, 1), (-3, 2), (0, 3))] + [("B", -3, 30), ("B", 0, 28), ("C", -3, 40), ("C", 0, 5)]
    s = spark.createDataFrame(rows, "content_hash string, h int, rank int").select(F.lit("b").alias("board"), "content_hash", "rank", F.expr("timestamp'2024-01-01 12:00:00' + make_interval(0,0,0,0,h)").alias("observed_at"))
    assert {r.content_hash for r in timeline.newly_entered(s, "2024-01-01 12:10:00").collect()} == {"B", "C"}
    assert [(r.content_hash, r.delta) for r in timeline.fast_rising(s, "2024-01-01 12:10:00").collect()] == [("C", 35)]


def test_upsert_is_idempotent(spark):
    row = lambda seq, content, heat: (seq, "k", "rss", 1, heat, content, None, None)
    kind = "seq long, content_hash string, source string, rank int, heat double, content string, summary string, images array<string>"
    new = spark.createDataFrame([row(1, None, 1.0), row(2, "body", None)], kind)
    none = spark.createDataFrame([], kind).drop("seq")
    got = merge.upsert_items(none, new).first()
    assert (got.content, got.heat, got.is_new, got.duplicates) == ("body", None, True, 1)
    again = merge.upsert_items(merge.upsert_items(none, new).select(*none.columns), new).first()
    assert (again.is_new, again.duplicates) == (False, 2)


def test_greedy_fold_is_the_sequential_one(spark):
    for seed in range(3):
        rng = random.Random(seed)
        n = 60
        edges = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(70)}
        near = {i: {b if a == i else a for a, b in edges if i in (a, b)} for i in range(n)}
        leader = {}
        for i in range(n):
            if i not in leader:
                leader[i] = i
                for j in near[i]:
                    leader.setdefault(j, i)
        nodes = spark.createDataFrame([(i, i) for i in range(n)], "id long, place long")
        got = {r.id: r.leader for r in graph.greedy_fold(nodes, spark.createDataFrame(sorted(edges), "a long, b long")).collect()}
        assert got == leader


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 60)], "a long, b long")
    got = {r.id: r.label for r in graph.components(spark.range(70), edges).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[60] == 50 and got[69] == 69


def test_round_robin_is_taking_turns(spark):
    rng = random.Random(5)
    rows = [(f"c{rng.randrange(4)}", f"{i:03d}", "x" if rng.random() < 0.7 else "", rng.randrange(1000)) for i in range(40)]
    items = spark.createDataFrame(rows, "collector string, content_hash string, content string, h int").select("collector", "content_hash", "content", F.lit(None).cast("string").alias("summary"), F.lit("article").alias("kind"), F.lit("rss").alias("source"), F.lit(None).cast("timestamp").alias("published_at"), F.timestamp_seconds("h").alias("fetched_at"))
    weights = spark.createDataFrame([("c2", 3.0)], "collector string, weight double")
    queues = {}
    for c, k, body, h in sorted(rows, key=lambda r: (r[2] == "", -r[3], r[1])):
        queues.setdefault(c, []).append(k)
    queues = {c: q[:5] for c, q in queues.items()}
    want, order = [], sorted(queues, key=lambda c: (-{"c2": 3.0}.get(c, 1.0), c))
    while len(want) < 12 and any(queues.values()):
        for c in order:
            if queues[c] and len(want) < 12:
                want.append(queues[c].pop(0))
    assert [r.content_hash for r in ranking.round_robin(items, weights, 5, 12).collect()] == want


def test_packing_sections(spark):
    s = spark.createDataFrame([(1, 0, "a", ["x" * 10]), (1, 1, "b", ["y" * 25, "z" * 25]), (1, 2, "c", ["w" * 5]), (1, 3, "d", ["v" * 5])], "doc long, pos int, sid string, paras array<string>")
    got = [(r.sid, r.job, r["first"], r["last"]) for r in packing.pack_sections(s, 30).orderBy("job", "sid").collect()]
    assert got == [("a", 0, 0, 0), ("b", 1, 0, 0), ("b", 2, 1, 1), ("c", 3, 0, 0), ("d", 3, 0, 0)]


def test_board_and_feed_dumps(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"data":[{"title":"A","url":"","mobileUrl":"http://m/a","hot":"1.5万"},{"title":" "},{"title":"C","url":"http://c"}]}')
    got = dumps.read_board(spark, str(tmp_path / "b.json"), "weibo").orderBy("rank").collect()
    assert [(r.title, r.url, r["rank"], r.heat) for r in got] == [("A", "http://m/a", 1, 15000.0), ("C", "http://c", 3, None)]
    long = "word " * 30
    (tmp_path / "f.xml").write_text(f"<rss><channel><item><title>Keep</title><link>http://x/1</link><description>{long}</description><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate></item><item><title>Ad drop</title><link>http://x/2</link></item></channel></rss>")
    rows = dumps.read_feed(spark, str(tmp_path / "f.xml"), "n", exclude="^Ad").collect()
    assert [(r.title, r.author, r.content is not None, str(r.published_at)) for r in rows] == [("Keep", "n", True, "2024-01-02 03:04:05")]
    with pytest.raises(dumps.EmptyDump):
        dumps.require_rows(dumps.read_feed(spark, str(tmp_path / "f.xml"), "n", include="zzz"), "n")


def test_size_estimates_do_not_grow_with_the_rounds_of_components(spark):
    """They are whole numbers of any length at the driver; a chain takes many rounds, each of several joins."""
    nodes = spark.range(64)
    out = graph.components(nodes, spark.range(63).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert {r.label for r in out.collect()} == {0} and out.count() == 64
    assert out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 2**60
