"""Connected components and greedy folding over edge tables, as rounds of joins and aggregates."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_folder(spark) -> str:
    """Where all executors can read and write: the folder of spark.checkpoint.dir, or one below the warehouse where none is set."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    return own.rstrip("/") if own else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """Goes on from a checkpoint in the shared folder, so the loss of an executor costs nothing that was done before."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written below the shared folder and read back, for loops of joins.

    The estimated size of a checkpoint is still that of its plan, a product over all joins before it: from round to round its digits
    multiply until the driver's memory is full.  That of files is their own."""
    place = f"{shared_folder(df.sparkSession)}/round-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, label): the least id of each node's component; ``nodes`` (id), ``edges`` (a, b).

    Minimum labels spread along edges and then jump to their label's label, so long chains halve each round."""
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(edges.where("a <> b").select(F.explode(ways).alias("e")).select("e.*").distinct())
    labels = written(nodes.select("id").distinct().withColumn("label", F.col("id")))
    for _ in range(rounds):
        near = both.join(labels.hint("merge"), both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("m"))
        once = labels.join(near.hint("merge"), labels["id"] == near["a"], "left").select("id", "label", F.least("label", F.coalesce("m", "label")).alias("m"))
        jump = once.select(F.col("id").alias("m"), F.col("m").alias("mm"))
        moved = written(once.join(jump.hint("merge"), "m", "left").select("id", "label", F.least("m", F.coalesce("mm", "m")).alias("next")))
        changed = moved.where("next <> label").limit(1).count()
        labels = moved.select("id", F.col("next").alias("label"))
        if not changed:
            return labels
    raise RuntimeError("components did not settle")


def greedy_fold(nodes: DataFrame, edges: DataFrame, together: int = 50_000) -> DataFrame:
    """(id, leader) of a greedy pass over ``nodes`` (id, place) in order of place: a node that no kept neighbour precedes is kept
    and takes its undecided neighbours; leader is the first kept neighbour, its own id if it is kept.

    Components of up to ``together`` edges are passed over in one task each, node by node.  Larger ones are decided in parallel rounds:
    a node whose undecided neighbours all come later is kept, their neighbours fold into the first kept one, until none is undecided."""
    place = nodes.select("id", "place")
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct()
    both = both.join(place.select(F.col("id").alias("a"), F.col("place").alias("pa")).hint("merge"), "a").join(place.select(F.col("id").alias("b"), F.col("place").alias("pb")).hint("merge"), "b")
    both = cut(both)
    alone = place.join(both.select(F.col("a").alias("id")).distinct().hint("merge"), "id", "left_anti").select("id", F.col("id").alias("leader"))
    labels = cut(components(both.select(F.col("a").alias("id")).distinct(), both))
    marked = both.join(labels.select(F.col("id").alias("a"), "label").hint("merge"), "a")
    sizes = cut(marked.groupBy("label").agg(F.count(F.lit(1)).alias("n")))
    small = marked.join(sizes.where(F.col("n") <= 2 * together).hint("merge"), "label", "left_semi")
    large = cut(marked.join(sizes.where(F.col("n") > 2 * together).hint("merge"), "label", "left_semi").drop("label"))
    return alone.unionByName(_one_by_one(small, dict(place.dtypes)["id"])).unionByName(_in_rounds(large))


def _one_by_one(edges: DataFrame, kind: str) -> DataFrame:
    """The sequential pass within each component (label) of ``edges`` (label, a, b, pa)."""
    rows = edges.groupBy("label", "a").agg(F.min("pa").alias("place"), F.collect_list("b").alias("near"))
    rows = rows.repartition("label").sortWithinPartitions("label", "place").select("label", "a", "near")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leader = None, {}
        for batch in batches:
            ids, found = [], []
            for label, own, near in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if label != at:
                    at, leader = label, {}
                if own not in leader:
                    leader[own] = own
                    for other in near:
                        leader.setdefault(other, own)
                ids.append(own)
                found.append(leader[own])
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(1).type), pa.array(found, batch.schema.field(1).type)], ["id", "leader"])

    return rows.mapInArrow(run, f"id {kind}, leader {kind}")


def _in_rounds(both: DataFrame) -> DataFrame:
    """The same for edges (a, b, pa, pb) in either direction, all nodes at a time.

    Rounds only tell which nodes fold; leaders are looked up when all kept ones are known, since an earlier neighbour may be kept in a
    later round."""
    nodes = both.select(F.col("a").alias("id")).distinct()
    if both.isEmpty():
        return nodes.select("id", F.col("id").alias("leader"))
    folded, open_ = None, both
    while not open_.isEmpty():
        kept = cut(open_.groupBy("a").agg(F.min("pb").alias("first"), F.min("pa").alias("pa")).where("pa < first").select("a"))
        near = cut(open_.join(kept.hint("merge"), "a", "left_semi").select(F.col("b").alias("id")).distinct())
        folded = near if folded is None else cut(folded.unionByName(near))
        gone = kept.select(F.col("a").alias("id")).unionByName(near)
        open_ = cut(open_.join(gone.select(F.col("id").alias("a")).hint("merge"), "a", "left_anti").join(gone.select(F.col("id").alias("b")).hint("merge"), "b", "left_anti"))
    to = both.join(folded.select(F.col("id").alias("b")).hint("merge"), "b", "left_semi").join(folded.select(F.col("id").alias("a")).hint("merge"), "a", "left_anti")
    leaders = to.groupBy("b").agg(F.min_by("a", "pa").alias("leader")).select(F.col("b").alias("id"), "leader")
    left = nodes.join(folded.hint("merge"), "id", "left_anti")
    return leaders.unionByName(left.select("id", F.col("id").alias("leader")))
