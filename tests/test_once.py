"""Texts are read once for each use: plans don't repeat a long expression, and what is read in one pass equals the step-by-step form."""

import random
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from inkwell.functions import scoring
from inkwell.functions import text as X
from inkwell.operators import grams, merge, ranking

TEXTS = ["", " ", "a", "ab\U0001f600c", "The Cat, the 2 cats' tail_x é中文字 字a1 z  y", "  lead\n\n\n\n tail \r\n x\ry\t z 　\n \n", " wide ", "a b", "中", "x y\n\n \n\nz", None]


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _rows(spark, c):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").repartition(2)
    return [r[0] for r in d.select("i", c.alias("c")).orderBy("i").select("c").collect()]


def _normal(t):
    t = re.sub(r"\r\n?", "\n", t or "")
    t = re.sub(r"(?m)^ +| +$", "", re.sub(r"[^\S\n]+", " ", t))
    return re.sub(r"\n{3,}", "\n\n", t).strip()


def test_texts(spark):
    assert _rows(spark, X.normalize_paragraphs("t")) == [_normal(t) for t in TEXTS]
    assert _rows(spark, X.strip("t")) == [None if t is None else t.strip() for t in TEXTS]

    def grams(t):
        s = re.sub(r"\s+", "", (t or "").lower())
        return [g for k in (2, 3) for g in ([s[i : i + k] for i in range(len(s) - k + 1)] or [s])] if s else ["_empty_"]

    def tokens(t):
        out = []
        for p in re.sub(r"[^\w一-鿿]+", " ", (t or "").lower()).split(" "):
            han = [c for c in p if "一" <= c <= "鿿"]
            out += [p] if re.fullmatch("[a-z0-9]+", p) else [a + b for a, b in zip(han, han[1:], strict=False)]
        return out

    assert _rows(spark, X.char_ngrams("t")) == [grams(t) for t in TEXTS]
    assert _rows(spark, X.tokenize("t")) == [tokens(t) for t in TEXTS]


def test_restored_payloads_are_read_once(spark):
    """F16: a footer was looked for in a text that was made plain anew for each use of it."""
    rows = spark.createDataFrame([("k", "short", "short", '{"content":[{"value":"<p>short and more</p>"}]}')], "content_hash string, content string, summary string, payload string")
    out = merge.restore_bodies(rows.drop("payload"), rows.select("content_hash", "payload"))
    assert out.select("restored", "content").first() == (True, "short and more")
    assert plan(rows.select(X.payload_text("payload").alias("c"))).count("相关文章") == 1
    assert plan(rows.select(X.payload_text("payload").alias("c"))).count("from_json") == 1


def test_printed_bodies_are_read_once(spark):
    """the body was made readable anew for the test, the catalog and the print; columns keep their meaning beside an alias."""
    row = ("article", "zhihu", "早报 <b>x</b>", "c", "1. Why is the sky blue?\n2、How do birds sleep?", None)
    d = spark.createDataFrame([row], "kind string, source string, title string, collector string, content string, summary string")
    out = d.select(F.lit("none").alias("title"), X.newspaper_body("kind", "content", "summary", "source", "title", "collector").alias("b"))
    assert out.first().b == "**Why is the sky blue?；How do birds sleep?**\n\n1. Why is the sky blue?\n2、How do birds sleep?"
    assert plan(out).count("相关文章") == 1
    assert plan(ranking.rank_candidates(d)).count("相关文章") == 1


def test_keywords_are_looked_up_once(spark):
    """each use of a word was a pattern of its own over a text that was lowered anew."""
    d = spark.createDataFrame([("The AI", "cat", ""), ("x", "main ai2", "AI的 cat")], "title string, summary string, content string")
    groups = [{"name": "g", "must": ["cat"], "any": ["AI", "的"], "exclude": ["dog"], "weight": 2.0}, {"name": "h", "must": [], "any": ["main", "AI"], "exclude": [], "weight": 1.0}]
    out = ranking.keyword_matches(d, groups).select("title", F.col("matches.group"), F.col("matches.weight")).orderBy("title")
    assert [tuple(r) for r in out.collect()] == [("The AI", ["g", "h"], [3.0, 1.5]), ("x", ["g", "h"], [2.0, 1.0])]
    assert plan(ranking.keyword_matches(d, groups).select("matches")).count("(?<![a-z0-9]dog)") == 1


def test_lengths_of_vectors_are_computed_once(spark):
    """a vector's length was summed anew for each of its places, and that for each centroid."""
    d = spark.createDataFrame([([3.0, 4.0], [[0.6, 0.8], [1.0, 0.0]], [4.0, 1.0])], "v array<double>, c array<array<double>>, n array<double>")
    out = d.select(scoring.unit("v").alias("u"), scoring.taste_similarity("v", "c", "n").alias("s"))
    assert [round(x, 6) for x in out.first().u] == [0.6, 0.8] and round(out.first().s, 6) == 1.0
    assert "/ (SQRT(aggregate" not in plan(out) and plan(out).count("SQRT(aggregate") == 2


def _step_by_step(texts, vocabulary):
    row, code = grams.grams(*texts)
    known = {grams.encode(g): (i, w) for g, i, w in vocabulary}
    total, n = Counter(row.tolist()), Counter((r, known[c]) for r, c in zip(row.tolist(), code.tolist(), strict=True) if c in known)
    return sorted((r, i, k / total[r] * w) for (r, (i, w)), k in n.items()), Counter(c for _, c in set(zip(row.tolist(), code.tolist(), strict=True)))


def test_grams_by_tables(monkeypatch):
    """numbered letters find and count what codes do, for texts of any length and letters that no table holds."""
    rnd = random.Random(5)
    for most in (2000, 2):
        monkeypatch.setattr(grams, "MOST_LETTERS", most)
        for _ in range(40):
            own = ["".join(rnd.choice("ab中\U0001f600") for _ in range(rnd.choice([0, 1, 2, 3, 12]))) for _ in range(rnd.randint(1, 9))]
            pool = sorted({t[i : i + k] for t in own for k in (1, 2, 3) for i in range(len(t))} | {"zq", "zqx", "_empty_"})
            vocabulary = [(g, i, 1.0 + i) for i, g in enumerate(rnd.sample(pool, rnd.randint(0, len(pool))))]
            ((_, points, lengths),) = grams.slices(pa.array(own))
            cells, df = _step_by_step((points, lengths), vocabulary)
            assert list(zip(*(c.tolist() for c in grams.Vocabulary(vocabulary).weigh(points, lengths)), strict=True)) == cells
            got = Counter()
            for code, n in zip(*(c.tolist() for c in grams.held_by(points, lengths)), strict=True):
                got[code] += n
            assert got == df
            assert (grams.Vocabulary(vocabulary).letter is None) == (most == 2 or not any(len(g) in (2, 3) for g, _, _ in vocabulary))
