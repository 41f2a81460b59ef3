from inkwell.operators import folding, graph


def test_a_leader_kept_in_a_later_round_still_comes_first(spark):
    """9 is near 3 and 5; 3 is kept only once 2 has folded into 1, after 5 was."""
    nodes = spark.createDataFrame([(i, i) for i in (1, 2, 3, 5, 9)], "id long, place long")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 9), (5, 9)], "a long, b long")
    want = [(1, 1), (2, 1), (3, 3), (5, 5), (9, 3)]
    for together in (0, 50_000):
        assert sorted(map(tuple, graph.greedy_fold(nodes, edges, together).collect())) == want


def test_simhash_of_some_rows_at_a_time(spark, monkeypatch):
    """Hashes don't depend on how many tokens are held at once; rows without tokens are 0 anywhere."""
    d = spark.range(40).selectExpr("id", "CASE WHEN id % 7 = 3 THEN NULL WHEN id % 5 = 0 THEN array() ELSE transform(sequence(1, id), x -> concat('w', x * id)) END AS tokens").coalesce(1)
    want = {r.id: r.h for r in folding.simhash(d).collect()}
    for size in (1, 30):
        monkeypatch.setattr(folding, "TOKENS", size)
        assert {r.id: r.h for r in folding.simhash(d).collect()} == want
    assert want[3] == want[5] == 0 and len(set(want.values())) > 20
