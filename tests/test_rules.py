"""Keyword rules as a table, and titles by automata, against loops over all rules and titles."""

import random
import re

from inkwell.operators import ranking, rules, titles


def find(variants, text):
    for v in variants:
        if v and (re.search(rf"(?<![A-Za-z0-9]){re.escape(v)}(?![A-Za-z0-9])", text, re.I) if v.isascii() else v.lower() in text):
            return v
    return None


def match(g, title, body):
    head, full = title.lower(), (title + "\n" + body).lower()
    expand = lambda role: [[w, *(g["aliases"] or {}).get(w, [])] for w in g[role] or []]
    if any(find(v, full) for v in expand("exclude")):
        return None
    must, some = [find(v, full) for v in expand("must")], [h for v in expand("any") if (h := find(v, full))]
    if not all(must) or not must and not some:
        return None
    in_title = any(find([h], head) for h in must + some)
    return (g["name"], (1.0 if g["weight"] is None else g["weight"]) * (1.5 if in_title else 1.0), in_title)


def test_rules_as_a_loop_has_them(spark):
    """Whole words in ASCII, anywhere else; aliases in order; exclusion first; words of several words; blocks of any size."""
    rng = random.Random(2)
    stock = ["AI", "said", "gpt-4", "大模型", "模型", "open source", "c++", "Éa", "x"]
    pick = lambda n: [rng.choice(stock) for _ in range(rng.randrange(n))]
    made = [{"name": f"g{i}", "must": pick(3), "any": pick(3), "exclude": pick(2), "weight": rng.choice([None, 0.5, 2.0]), "aliases": {rng.choice(stock): pick(3)}} for i in range(60)]
    made += [{"name": "none", "must": None, "any": None, "exclude": None, "weight": 1.0, "aliases": None}, {"name": "blank", "must": [""], "any": ["", "x"], "exclude": [""], "weight": 1.0, "aliases": {}}]
    text = lambda: "".join(rng.choice(stock) + rng.choice([" ", "", "-", "的", "\n"]) for _ in range(rng.randrange(7)))
    items = [(f"h{i}", text(), text()) for i in range(80)] + [("n", None, None), (None, "AI x", "x")]
    frame = spark.createDataFrame(items, "content_hash string, title string, summary string").selectExpr("*", "cast(null as string) content")
    own = spark.createDataFrame([tuple(g[k] for k in ("name", "must", "any", "exclude", "weight", "aliases")) for g in made], rules.RULES)
    # an empty word can't be found: as one of must it fails its rule
    want = {}
    for h, title, summary in items:
        found = [m for g in made if (m := match(g, title or "", summary or ""))] if h else []
        want[str(h)] = sorted((-w, n, t) for n, w, t in found)
    for block in (rules.BLOCK_BYTES, 10):
        got = {str(r.content_hash): [(-m.weight, m.group, m.in_title) for m in r.matches] for r in rules.match_rules(frame, own, block_bytes=block).collect()}
        assert got == want
    assert any(len(m) > 3 for m in want.values())


def test_rules_equal_the_compiled_ones(spark):
    groups = [{"name": "a", "must": ["AI"], "any": ["芯片"], "exclude": ["广告"], "weight": 2.0, "aliases": {"AI": ["人工智能"]}}, {"name": "b", "must": [], "any": ["开源", "open"], "exclude": [], "weight": 1.0}]
    frame = spark.createDataFrame([("1", "AI 芯片", "开源"), ("2", "SAID", "人工智能"), ("3", "广告 AI", "open"), ("4", "openly", "")], "content_hash string, title string, summary string").selectExpr("*", "cast(null as string) content")
    own = spark.createDataFrame([tuple(g.get(k) for k in ("name", "must", "any", "exclude", "weight", "aliases")) for g in groups], rules.RULES)
    plain = lambda df: sorted((r.content_hash, [tuple(m) for m in r.matches], round(r.keyword, 9)) for r in df.collect())
    assert plain(rules.match_rules(frame, own)) == plain(ranking.keyword_matches(frame, groups))
    assert rules.match_rules(frame, own.limit(0)).where("keyword = 0 and size(matches) = 0").count() == 4


def test_titles_both_ways(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abc") for _ in range(rng.randrange(n)))
    ranked = [(p, word(5), p / 10) for p in rng.sample(range(1000), 60)] + [(2000, None, 1.0), (None, "a", 1.0)]
    articles = [(i, word(7)) for i in range(120)] + [(900, None), (901, "")]

    def score(title):
        own = sorted((p, t, s) for p, t, s in ranked if p is not None and t is not None)
        same = [s for _, t, s in own if t == title]
        near = [s for _, t, s in own if title is not None and t and (t in title or title in t)]
        return same[0] if same else near[0] if near else 0.2

    a = spark.createDataFrame(articles, "id long, title string")
    r = spark.createDataFrame(ranked, "pos long, title string, score double")
    for block in (titles.BLOCK_BYTES, 20):
        assert {x.id: x.score for x in titles.match_titles(a, r, block_bytes=block).collect()} == {i: score(t) for i, t in articles}
    wide = titles.match_titles(a.selectExpr("id", "title", "id * 2 AS pos"), r)
    assert wide.columns == ["id", "title", "pos", "score"] and {x.id: (x.pos, x.score) for x in wide.collect()} == {i: (2 * i, score(t)) for i, t in articles}
    assert {x.score for x in titles.match_titles(a, r.limit(0)).collect()} == {0.2} and titles.match_titles(a.limit(0), r).count() == 0


def test_blocks_of_rules_and_totals(spark):
    """Rules that go out in blocks match the same; totals are those of the lists, and no row for a match or a hit is shuffled for them."""
    rng = random.Random(5)
    stock = [f"w{i}" for i in range(30)]
    pick = lambda lo, n: [rng.choice(stock) for _ in range(rng.randrange(lo, n))]
    made = [{"name": f"r{i}", "must": pick(0, 4), "any": pick(0, 3), "exclude": pick(0, 2), "weight": rng.choice([1.0, 2.0]), "aliases": {rng.choice(stock): pick(1, 3)}} for i in range(200)]
    items = [(i, " ".join(pick(0, 4)), " ".join(pick(0, 25))) for i in range(60)]
    frame = spark.createDataFrame(items, "content_hash long, title string, summary string").selectExpr("*", "cast(null as string) content")
    own = spark.createDataFrame([tuple(g[k] for k in ("name", "must", "any", "exclude", "weight", "aliases")) for g in made], rules.RULES)
    want = {h: sorted((-w, n, t) for g in made if (m := match(g, title, text)) for n, w, t in [m]) for h, title, text in items}
    sums = {h: (m[0][1], len(m), -sum(w for w, _, _ in m)) for h, m in want.items() if m}
    for block in (rules.BLOCK_WORDS, 100):
        got = {r.content_hash: [(-m.weight, m.group, m.in_title) for m in r.matches] for r in rules.match_rules(frame, own, block_words=block).collect()}
        assert got == want
        totals = rules.rule_totals(frame, own, block_words=block)
        assert {r.content_hash: (r.group, r.hits, r.total) for r in totals.collect()} == sums
    assert len(sums) > 20 and max(n for _, n, _ in sums.values()) > 20
    assert rules.rule_totals(frame, own.limit(0)).count() == 0
