"""Landed dumps of all kinds through the data source: entries, places, failures, and a stream that goes on from its offset."""

import json

import pytest

from inkwell.sources import dumps, landed
from inkwell.streaming import streams


def read(spark, path, kind="board", **options):
    return landed.register(spark).read.format("landed_dumps").options(path=str(path), dump=kind, **options).load()


def test_board_places_and_values(spark, tmp_path):
    data = [{"title": " A ", "url": "u", "hot": "123.4万", "timestamp": 1700000000}, {"title": " ", "hot": 1}, "no object", {"title": "B", "mobileUrl": "m", "hot": 42, "timestamp": 1700000000000}, {"title": "C", "hot": None, "timestamp": 9e17}, {"title": "D", "hot": "2亿"}]
    (tmp_path / "weibo.json").write_text(json.dumps({"data": data}, ensure_ascii=False, indent=1))
    (tmp_path / "_part.json").write_text("not yet")
    rows = dumps.entries(read(spark, tmp_path), "board")
    got = [(r.title, r.url, r["rank"], r.heat, str(r.published_at)) for r in dumps.board_items(rows, "weibo").orderBy("rank").collect()]
    at = "2023-11-14 22:13:20"
    assert got == [("A", "u", 1, 1234000.0, at), ("B", "m", 4, 42.0, at), ("C", "", 5, None, "None"), ("D", "", 6, 2e8, "None")]


def test_feeds_read_as_the_built_in_reader_does(spark, tmp_path):
    long = "<p>" + "word " * 40 + "</p>"
    rss = f"""<?xml version="1.0"?><rss xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>feed</title>
      <item><title>Full</title><link>http://x/1</link><description>short</description><content:encoded><![CDATA[{long}]]></content:encoded><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate><category>a</category><category>b</category></item>
      <item><title>Long &amp; plain</title><link> http://x/2 </link><description>{"text " * 30}</description><author>Ann</author></item>
      <item><title>Brief</title><link>http://x/3</link><description>only this</description></item><item><title/><link/></item></channel></rss>"""
    atom = f"""<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>One</title><link rel="self" href="http://x/s"/><link href="http://x/4"/><summary>s</summary><content type="html">{long.replace("<", "&lt;")}</content><author><name>Bo</name></author><published>2024-01-02T03:04:05Z</published><category term="t"/></entry></feed>"""
    for name, text, is_atom in (("r", rss, False), ("a", atom, True)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "f.xml").write_text(text)
        own = dumps.entries(read(spark, tmp_path / name, "feed"), "atom" if is_atom else "feed").select("r.*")
        got = dumps.feed_items(own, "n", atom=is_atom).orderBy("url").collect()
        want = dumps.read_feed(spark, str(tmp_path / name / "f.xml"), "n", atom=is_atom).orderBy("url").collect()
        plain = lambda rows: [(*tuple(r)[:-1], tuple(r.tags or ())) for r in rows]
        assert plain(got) == plain(want) and len(got) == (1 if is_atom else 3)


def test_notes_and_articles(spark, tmp_path):
    notes = [{"note_id": "n1", "title": "", "desc": " Desc ", "time": 1722000000000, "user": {"nickname": "N", "user_id": "u"}, "interact_info": {"liked_count": "1,204"}, "tag_list": ["x", " "]}, {"title": " ", "desc": ""}, {"id": 7, "title": "T", "author": "A", "heat": "1.2万", "tags": "p, q"}]
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "a.jsonl").write_text("\n".join(json.dumps(n) for n in [*notes, ["no object"]]) + "\n\n")
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text("﻿ " + json.dumps([*notes, 3]))
    want = [("Desc", "https://www.xiaohongshu.com/explore/n1", "Desc", "N", "u", 1204.0, ["x"]), ("T", "https://www.xiaohongshu.com/explore/7", None, "A", None, None, ["p", "q"])]
    for folder in ("l", "j"):
        items = dumps.creator_items(dumps.entries(read(spark, tmp_path / folder, "notes"), "notes").select("r.*"), "c")
        assert [(r.title, r.url, r.summary, r.author, r.author_id, r.heat, r.tags) for r in items.orderBy("title").collect()] == want
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "one.json").write_text(json.dumps({"code": 20000, "data": {"title": " A ", "content": "", "content_text": " x  y "}}, indent=1))
    (tmp_path / "p" / "more.json").write_text("\n".join(json.dumps(x) for x in ({"code": 404, "title": "no"}, {"title": " ", "content": "<p>b</p><p>c</p>"})))
    items = dumps.article_items(dumps.entries(read(spark, tmp_path / "p", "article"), "article").select("r.*"))
    assert sorted((str(r.title), r.text) for r in items.collect()) == [("A", "x y"), ("None", "b\n\nc")]


def test_a_source_that_gave_nothing_has_failed(spark, tmp_path):
    with pytest.raises(Exception, match="EmptyDump"):
        read(spark, tmp_path).count()
    assert read(spark, tmp_path, onEmpty="keep").count() == 0
    (tmp_path / "a.json").write_text('{"data": []}')
    with pytest.raises(Exception, match="EmptyDump"):
        read(spark, tmp_path).count()
    (tmp_path / "b.json").write_text('{"data": [{"title": "x"}]}')
    kept = read(spark, tmp_path, onEmpty="keep")
    assert sorted((r.path.rsplit("/", 1)[1], r.pos) for r in kept.collect()) == [("a.json", None), ("b.json", 0)]
    assert dumps.board_items(dumps.entries(kept, "board"), "b").count() == 1


def test_partitions_by_bytes(tmp_path, monkeypatch):
    monkeypatch.setattr(landed, "PARTITION_BYTES", 50)
    for k in range(5):
        (tmp_path / f"{k}.json").write_text("x" * 20)
    assert [len(p.paths) for p in landed.DumpReader({"path": str(tmp_path)}).partitions()] == [2, 2, 1]


def test_stream_takes_each_dump_once(spark, tmp_path):
    """Started again from its checkpoint, the stream reads only what has landed since."""
    for k in range(3):
        (tmp_path / "in" / f"{k}").mkdir(parents=True)
        (tmp_path / "in" / f"{k}" / "b.json").write_text(json.dumps({"data": [{"title": f"t{k}{i}"} for i in range(k + 1)]}))
        if k:
            stream = landed.register(spark).readStream.format("landed_dumps").option("path", str(tmp_path / "in")).load()
            out = streams.drain(dumps.board_items(dumps.entries(stream, "board"), "b").select("title", "rank"), f"{tmp_path}/w")
    assert sorted((r.title, r["rank"]) for r in out.collect()) == [("t00", 1), ("t10", 1), ("t11", 2), ("t20", 1), ("t21", 2), ("t22", 3)]
