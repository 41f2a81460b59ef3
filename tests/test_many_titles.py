from inkwell.operators import titles


def test_copies_of_titles_cost_nothing_and_change_nothing(spark, monkeypatch):
    """Thousands of copies are matched once, in one job for all blocks that fit together."""
    r = spark.createDataFrame([(p, t, p / 10) for p, t in enumerate(["ab", "b", "xyz", "a", ""] * 500, 1)], "pos long, title string, score double")
    a = spark.createDataFrame([(i, t) for i, t in enumerate(["ab", "cab", "xy", "q", "", None] * 300)], "id long, title string")
    want = {"ab": 0.1, "cab": 0.1, "xy": 0.3, "q": 0.2, "": 0.5, None: 0.2}
    built = []
    monkeypatch.setattr(spark.sparkContext.__class__, "broadcast", lambda self, value, keep=spark.sparkContext.__class__.broadcast: built.append(value) or keep(self, value))
    got = titles.match_titles(a, r, block_bytes=4).collect()
    assert len(got) == 1800 and all(x.score == want[x.title] for x in got)
    assert len(built) == 1 and sorted(t for block in built[0] for _, t, _ in block) == ["", "a", "ab", "b", "xyz"]
