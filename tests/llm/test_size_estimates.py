from inkwell.llm import near_duplicates as nd
from inkwell.llm.common import cut


def test_estimates_do_not_grow_from_level_to_level(spark, monkeypatch):
    """What is built on a plan is sized at the driver by products of its estimate, which must not gain digits with each level."""
    monkeypatch.setattr(nd, "WIDE", 0)  # so that nodes branch on to the last level
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(f"x{i}" if j == i % 6 or j == i % 5 + 20 else w for j, w in enumerate(words))) for i in range(24)]
    own = spark.createDataFrame(docs, "doc_id long, text string")
    sketches = cut(nd.sketch(own, "doc_id", "text", 5).select("id", "tokens", "low"))
    links = nd.linked_pairs(sketches, nd.Texts(own, "doc_id", "text", 5, 20), trees=2, leaf=2, levels=4)
    bits = int(links._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()).bit_length()
    assert bits < 12_000 and not links.isEmpty()
