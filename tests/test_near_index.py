"""The persistent index of SimHashes against the batch join."""

import random

from inkwell.operators import folding
from inkwell.operators.near_index import NearIndex


def hashes(n, seed):
    """Hashes of which many are some bits away from an earlier one, at the bar and beyond it, and some equal."""
    rng = random.Random(seed)
    out = [0, -1]
    while len(out) < n:
        h = rng.choice(out) if rng.random() < 0.5 else rng.getrandbits(64) - 2**63
        for b in rng.sample(range(64), rng.randrange(5)):
            h ^= 1 << b if b < 63 else -(1 << 63)
        out.append(h)
    return list(enumerate(out))


def near(rows, most=3):
    return {(a, b) for i, (a, g) in enumerate(rows) for b, h in rows[i + 1 :] if ((g ^ h) & (2**64 - 1)).bit_count() <= most}


def test_drops_give_the_pairs_of_all(spark, tmp_path):
    rows = hashes(160, 1)
    index = NearIndex(spark, f"{tmp_path}/i", buckets=4)
    frame = lambda part: spark.createDataFrame(part, "id long, h long")
    got, drops = [], [rows[k::4] for k in range(4)]
    for k, drop in enumerate(drops):
        got += [tuple(r) for r in index.link(frame(drop), k).collect()]
        if k == 2:  # run again after a failure
            again = index.link(frame(drop), k)
            assert sorted(map(tuple, again.collect())) == sorted(got[-again.count() :])
    assert len(got) == len(set(got)) and set(got) == near(rows)
    assert sorted(map(tuple, folding.near_pairs(frame(rows)).collect())) == sorted(got)


def test_index_outlives_its_session_and_is_compacted(spark, tmp_path):
    rows = hashes(60, 2)
    index = NearIndex(spark, f"{tmp_path}/i", buckets=4)
    for k in range(3):
        index.add(spark.createDataFrame(rows[k::3], "id long, h long"), k)
    for table in (index.keys, index.members):
        spark.sql(f"DROP TABLE {table}")
    index = NearIndex(spark, f"{tmp_path}/i", buckets=4)
    want = {(rows[0][0], b) for b in [i for i, h in rows if ((h ^ rows[0][1]) & (2**64 - 1)).bit_count() <= 3]}
    one = spark.createDataFrame([(0, rows[0][1], "extra")], "id long, h long, near string")
    assert {(r.id, r.near) for r in index.find(one).collect()} == want
    assert {(r.id, r.near) for r in index.find(one, 1).collect()} == {(a, b) for a, b in want if b % 3 == 0}
    index.compact(2)
    assert {(r.id, r.near) for r in index.find(one).collect()} == want
    assert [r[0] for r in spark.sql(f"SHOW PARTITIONS {index.keys}").collect()] == ["batch=2"]


def test_look_up_leaves_the_index_where_it_is(spark, tmp_path):
    index = NearIndex(spark, f"{tmp_path}/i", buckets=4)
    index.add(spark.createDataFrame(hashes(40, 3), "id long, h long"), 0)
    new = spark.createDataFrame([(7, 1)], "id long, h long")
    plan = index.near_hashes(new)._jdf.queryExecution().sparkPlan().toString() + index.near_hashes(new)._jdf.queryExecution().executedPlan().toString()
    scan = [x for x in plan.split("\n") if "FileScan parquet" in x]
    assert scan and all("Bucketed: true" in x for x in scan)


def test_odd_batches(spark, tmp_path):
    index = NearIndex(spark, f"{tmp_path}/i", buckets=2)
    empty = spark.createDataFrame([], "id long, h long")
    assert index.link(empty, 0).count() == 0 and index.find(spark.createDataFrame([(1, 5)], "id long, h long")).count() == 0
    odd = spark.createDataFrame([(1, None), (None, 5), (2, 5), (2, 5)], "id long, h long")
    assert {tuple(r) for r in index.find(odd.where("h is null")).collect()} == set()
    index.add(odd, 1)
    assert sorted((r.id, str(r.near), r.bits) for r in index.find(spark.createDataFrame([(9, 4)], "id long, h long")).collect()) == [(9, "2", 1), (9, "2", 1), (9, "None", 1)]
