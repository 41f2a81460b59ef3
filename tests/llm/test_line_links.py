from pyspark.sql import functions as F

from inkwell.llm import line_dedup
from inkwell.llm.common import connected_components, cut, likely_in


def test_lines_between_leaders_of_a_large_group_are_compared(spark):
    """Ten lines of one choice of words: near lines whose leaders are far apart, or that no leader is near to, are still linked."""
    head = "alpha beta gamma"  # what all share
    near = lambda k: f"{head} " + " ".join(f"{'x' * i}{'y' * (6 - i)}{c}" for c, i in zip("abcdefgh", ([6] * k + [0] * 8)[:8], strict=True))
    texts = [near(k) for k in range(9)] + [f"{head} {'qrstuv ' * 8}".strip()]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc long, text string")
    import numpy as np

    same = np.arange(5, dtype=np.uint32).tobytes()
    lines = spark.createDataFrame([(i, (i + 1) * 0x0123456789ABCDE, len(t), bytearray(same), i, 0) for i, t in enumerate(texts)], "key long, sim long, size int, least binary, doc long, line int")
    parts = connected_components(line_dedup.similar_lines(lines, docs))
    got = {r.id: r.component for r in parts.collect()}
    want = {i: i for i in range(len(texts))}
    for i in range(len(texts)):
        for j in range(i):
            if line_dedup.edit_similarity(texts[i], texts[j]):
                low, high = sorted((want[i], want[j]))
                want = {k: low if v == high else v for k, v in want.items()}
    assert {k: got.get(k, k) for k in want} == want and len(set(want.values())) == 2


def test_joins_and_python_filters_stay_above_the_coalesce_of_a_cut_table(spark):
    """Below it, a task of many partitions would hold the memory of all their joins at once."""
    rows = cut(spark.range(1000).withColumn("k", F.col("id") % 10))
    some = cut(spark.range(3).withColumnRenamed("id", "k"))
    for how, want in (("left_semi", 300), ("left_anti", 700)):
        out = rows.join(some.hint("merge"), "k", how)
        lines = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
        depth = lambda word, lines=lines: min(i for i, line in enumerate(lines) if word in line)
        assert depth("Join") < depth("Repartition") and out.count() == want
    tested = rows.where(likely_in(some.select(F.col("k").alias("id")), F.col("k")))
    plan = tested._jdf.queryExecution().executedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Coalesce") and tested.count() == 300
