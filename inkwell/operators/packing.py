"""Ordered packing of paragraphs into batches, and drip queues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions.text import char_count, col


def split_sentences(text):
    """Sentences of a text without white space, cut after full stops."""
    return F.filter(F.split(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"(?U)\s+", ""), "(?<=[。！？])"), lambda s: s != "")


def pack(rows: DataFrame, limit: int = 4000, key: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """(key, order, batch): consecutive texts of a key go together while their characters stay within ``limit``.

    A batch closes where the next text would exceed the limit, so the number of a batch depends on all before it; the texts of
    one document are packed together, as arrays of sizes, not texts."""
    sized = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), char_count(text).alias("n")))).alias("s"))
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("size"), F.array().cast("array<int>").alias("out"))

    def step(acc, x):
        opens = (acc["size"] > 0) & (acc["size"] + x["n"] > limit)
        batch = F.when(opens, acc["batch"] + 1).otherwise(acc["batch"])
        return F.struct(batch.alias("batch"), F.when(opens, x["n"]).otherwise(acc["size"] + x["n"]).alias("size"), F.concat(acc["out"], F.array(batch)).alias("out"))

    packed = sized.withColumn("b", F.aggregate("s", start, step, lambda acc: acc["out"]))
    return packed.select(key, F.explode(F.arrays_zip(F.col("s.o").alias("o"), F.col("b").alias("b"))).alias("z")).select(key, F.col("z.o").alias(order), F.col("z.b").alias("batch"))


def pack_sections(sections: DataFrame, limit: int = 4000, key: str = "doc") -> DataFrame:
    """(key, job, pos, sid, first, last): sections (key, pos, sid, paras array<string>) share a job up to ``limit`` characters; a longer
    one is cut at paragraphs into jobs of its own.  Sections without paragraphs have no job.

    A document's section sizes are folded as one array; texts stay where they are."""
    sizes = F.transform("paras", char_count)
    rows = sections.where(F.size("paras") > 0).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "sid", sizes.alias("n")))).alias("s"))
    kinds = dict(sections.dtypes)
    slices = F.array().cast(f"array<struct<job:int,pos:{kinds['pos']},sid:{kinds['sid']},first:int,last:int>>")
    piece = lambda job, x, first, last: F.array(F.struct(job.cast("int").alias("job"), x["pos"].alias("pos"), x["sid"].alias("sid"), first.cast("int").alias("first"), last.cast("int").alias("last")))
    state = lambda job, open_, size, out: F.struct(job.cast("int").alias("job"), open_.alias("open"), size.cast("int").alias("size"), out.alias("out"))
    total = lambda x: F.aggregate(x["n"], F.lit(0), lambda a, b: a + b)

    def cut_up(acc, x):
        """A section over the limit: like ``pack`` over its paragraphs, from a new job on."""
        start = F.struct((acc["job"] + acc["open"].cast("int")).alias("job"), F.lit(0).alias("first"), F.lit(0).alias("held"), acc["out"].alias("out"))

        def step(a, i):
            n = F.get(x["n"], i)
            full = (i > a["first"]) & (a["held"] + n > limit)
            out = F.when(full, F.concat(a["out"], piece(a["job"], x, a["first"], i - 1))).otherwise(a["out"])
            return F.struct((a["job"] + full.cast("int")).alias("job"), F.when(full, i).otherwise(a["first"]).alias("first"), F.when(full, n).otherwise(a["held"] + n).alias("held"), out.alias("out"))

        end = lambda a: state(a["job"] + 1, F.lit(False), F.lit(0), F.concat(a["out"], piece(a["job"], x, a["first"], F.size(x["n"]) - 1)))
        return F.aggregate(F.sequence(F.lit(0), F.size(x["n"]) - 1), start, step, end)

    def take(acc, x):
        opens = acc["open"] & (acc["size"] + total(x) > limit)
        job = acc["job"] + opens.cast("int")
        out = F.concat(acc["out"], piece(job, x, F.lit(0), F.size(x["n"]) - 1))
        return F.when(total(x) > limit, cut_up(acc, x)).otherwise(state(job, F.lit(True), F.when(opens, 0).otherwise(acc["size"]) + total(x), out))

    packed = F.aggregate("s", state(F.lit(0), F.lit(False), F.lit(0), slices), take, lambda acc: acc["out"])
    return rows.select(key, F.explode(packed).alias("j")).select(key, "j.*")


def merge_slices(slices: DataFrame, key: str = "doc") -> DataFrame:
    """(key, seq, sid, paras): slices (key, seq, sid, paras array<string>) in order of seq; neighbours of one section are joined again.

    Slices of one section that others part stay apart.  Null sections are one another's equals; a document's slices are ordered by
    one window, their paragraphs joined run by run."""
    own = slices.withColumn("opens", (F.row_number().over(Window.partitionBy(key).orderBy("seq")) == 1) | ~F.col("sid").eqNullSafe(F.lag("sid").over(Window.partitionBy(key).orderBy("seq"))))
    run = F.sum(F.col("opens").cast("int")).over(Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    joined = own.withColumn("run", run).groupBy(key, "run").agg(F.min("seq").alias("seq"), F.first("sid").alias("sid"), F.array_sort(F.collect_list(F.struct("seq", "paras"))).alias("p"))
    return joined.select(key, "seq", "sid", F.flatten("p.paras").alias("paras"))


def next_units(queue: DataFrame, state: DataFrame, used: DataFrame, most_skips: int = 5) -> DataFrame:
    """(queue_id, unit_id, pos): the next unit of every enabled queue.

    ``queue`` (queue_id, pos, unit_id, body) from position 0, ``state`` (queue_id, enabled, index, last_id), ``used`` (unit_id).
    The cursor stands after ``last_id``; one that the queue no longer holds starts anew; without one it is ``index``, at most the
    length.  Used units are skipped, five at most; a unit without body stops the queue."""
    last = queue.join(state.select("queue_id", F.col("last_id").alias("unit_id")), ["queue_id", "unit_id"]).select("queue_id", F.col("pos").alias("found"))
    length = queue.groupBy("queue_id").agg(F.count(F.lit(1)).alias("n"))
    cursor = state.where("enabled").join(length, "queue_id").join(last, "queue_id", "left")
    start = F.when(F.col("found").isNotNull(), F.col("found") + 1).when(F.col("last_id").isNotNull(), 0).otherwise(F.least(F.greatest("index", F.lit(0)), "n"))
    ahead = queue.join(cursor.select("queue_id", start.alias("start")), "queue_id").where((F.col("pos") >= F.col("start")) & (F.col("pos") <= F.col("start") + most_skips))
    ahead = ahead.join(used.select("unit_id", F.lit(1).alias("__used")).distinct(), "unit_id", "left")
    first = ahead.where("__used is null").withColumn("k", F.row_number().over(Window.partitionBy("queue_id").orderBy("pos"))).where("k = 1")
    return first.where(F.coalesce(F.col("body"), F.lit("")) != "").select("queue_id", "unit_id", "pos")


def advance(state: DataFrame, printed: DataFrame, queue: DataFrame) -> DataFrame:
    """State after confirmed prints (queue_id, unit_id): the cursor follows the last printed unit; queues without one stay."""
    done = printed.join(queue.select("queue_id", "unit_id", "pos"), ["queue_id", "unit_id"]).groupBy("queue_id").agg(F.max_by(F.struct("pos", "unit_id"), "pos").alias("p"))
    return state.join(done, "queue_id", "left").select("queue_id", "enabled", F.coalesce(F.col("p.pos") + 1, "index").alias("index"), F.coalesce("p.unit_id", "last_id").alias("last_id"))
