"""The filter cascade against sets, and URL rules against a plain loop over all rules."""

import random
import re

from pyspark.sql import functions as F

from inkwell.llm import url_filter

RULES = "host string, path string, verdict string"


def judge(url, rules, otherwise="allow"):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = {}
    for h, p, v in rules:
        if h and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.setdefault(h + p, set()).add(v)
    if not fits:
        return host, path, None, otherwise
    rule = max(fits, key=lambda k: (len(k), k))
    return host, path, rule, "block" if "block" in fits[rule] else "allow"


def judged(spark, urls, rules, **how):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    out = url_filter.judge_urls(pages, spark.createDataFrame(rules, RULES), **how)
    return [tuple(r)[2:] for r in out.orderBy("page_id").collect()]


def test_cascade_is_exact(spark):
    """Many listed keys among few others make several levels; every key of the corpus is told right, whatever its repeats."""
    rng = random.Random(3)
    keys = [f"host{i}.example/{rng.randrange(9)}" for i in range(6_000)]
    listed = set(rng.sample(keys, 2_500)) | {"never/seen"}
    universe = spark.createDataFrame([(k,) for k in keys + keys[:500] + [None]], "key string")
    cascade = url_filter.build_cascade(universe, spark.createDataFrame([(k,) for k in [*listed, *listed, None]], "key string"))
    got = {r.key: r.held for r in universe.where("key is not null").select("key", cascade.holds(F.col("key")).alias("held")).distinct().collect()}
    assert len(cascade.levels) > 3
    assert got == {k: k in listed for k in keys}


def test_cascade_of_nothing(spark):
    empty = spark.createDataFrame([], "key string")
    one = spark.createDataFrame([("a",)], "key string")
    assert one.select(url_filter.build_cascade(one, empty).holds(F.col("key")).alias("h")).first().h is False
    assert one.select(url_filter.build_cascade(empty, one).holds(F.col("key")).alias("h")).first().h is True


def test_judges_as_a_loop_does(spark):
    rng = random.Random(4)
    names = ["com", "net", "a.com", "b.a.com", "x.net", "example.org", "B.net"]
    paths = ["", "/", "/e", "/en", "/en/", "/en/x", "/fr/é"]
    rules = [(rng.choice(names), rng.choice(paths), rng.choice(["allow", "block"])) for _ in range(25)]
    lowered = [(h.lower(), p, v) for h, p, v in rules]
    urls = [f"{rng.choice(['http', 'https'])}://{rng.choice(['', 'www.', 'q.', 'not'])}{rng.choice(names).upper() if rng.random() < 0.2 else rng.choice(names)}{rng.choice(paths)}{rng.choice(['', 'more', '?a=/en/', '#://com/'])}" for _ in range(400)]
    assert judged(spark, urls, rules) == [judge(u, lowered) for u in urls]


def test_odd_urls(spark):
    rules = [("com", "/", "allow"), ("bad.com", "/", "block"), ("bad.com", "/", "allow"), (None, "/", "block"), ("", "/", "block"), ("com", None, "block")]
    urls = [None, "", "com/", "http://", "http://com", "http://com/", "x://y://com/", "http://bad.com/" + "a" * 300_000, "http://u@bad.com:80/", "http://a.bad.com/\n?", "http://..com/", "http://bad.com/", "http://bad.com/", "HTTP://BAD.COM/É"]
    assert judged(spark, urls, rules, otherwise="block") == [judge(u, rules, "block") for u in urls]


def test_without_rules_or_rows_and_with_clashing_names(spark):
    assert judged(spark, ["http://a.com/"], []) == [("a.com", "/", None, "allow")]
    assert judged(spark, [], [("com", "/", "block")]) == []
    pages = spark.createDataFrame([("http://a.com/b", 7, "mine")], "url string, host int, Rule string")
    out = url_filter.judge_urls(pages, spark.createDataFrame([("com", "/", "block")], RULES))
    assert out.columns == ["url", "host", "Rule", "host_2", "path", "rule_2", "verdict"]
    assert tuple(out.first()) == ("http://a.com/b", 7, "mine", "a.com", "/b", "com/", "block")


def test_no_python_and_no_join_on_the_way(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    plan = url_filter.judge_urls(pages, spark.createDataFrame([("com", "/", "block")], RULES))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan and "Exchange" not in plan
