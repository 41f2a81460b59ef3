"""A persistent index of SimHashes: batches append to it, and new items find what is near them without any old text being read."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators.folding import block_keys, near_pairs
from inkwell.operators.graph import cut


class NearIndex:
    """Two tables below ``folder``, both bucketed and sorted, partitioned by batch: ``keys`` (k, h) holds each distinct hash under the
    ten pairs of its blocks, ``members`` (h, id) which items have it.

    A look-up shuffles the new hashes alone: both tables are read bucket by bucket where they stand, so its cost beside the reading
    follows the batch.  Whoever opens the folder, in whatever session, goes on with the same index; ``buckets`` is fixed by whoever
    made it and must be given again."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, most: int = 3):
        self.spark, self.folder, self.buckets, self.most = spark, folder.rstrip("/"), buckets, most
        name = "near_" + hashlib.sha256(self.folder.encode()).hexdigest()[:24]
        self.keys, self.members = f"{name}_keys", f"{name}_members"
        for table, columns, by in ((self.keys, "k BIGINT, h BIGINT", "k"), (self.members, "h BIGINT, id BIGINT", "h")):
            place = self._place(table)
            self._files(place, "mkdirs")
            spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}, batch BIGINT) USING parquet PARTITIONED BY (batch) CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{place}'")
            spark.sql(f"MSCK REPAIR TABLE {table}")

    def _place(self, table: str) -> str:
        return f"{self.folder}/{table.rsplit('_', 1)[1]}"

    def _files(self, place: str, what: str, *how) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        getattr(path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), what)(path, *how)

    def _rows(self, table: str, before: int | None) -> DataFrame:
        rows = self.spark.table(table)
        return (rows if before is None else rows.where(F.col("batch") < before)).drop("batch")

    def _write(self, rows: DataFrame, table: str, by: str, batch: int) -> None:
        """Overwrites one batch of a table, one sorted file for each bucket."""
        dealt = rows.repartition(self.buckets, by).sortWithinPartitions(by)
        view = f"{table}_{batch}"
        dealt.createOrReplaceTempView(view)
        dealt.sparkSession.sql(f"INSERT OVERWRITE TABLE {table} PARTITION (batch = {int(batch)}) SELECT * FROM {view}")
        dealt.sparkSession.catalog.dropTempView(view)

    def near_hashes(self, hashed: DataFrame, before: int | None = None) -> DataFrame:
        """(h, g): the distinct hashes of ``hashed`` (h) and those of the index that differ in at most ``most`` bits, equal ones too."""
        new = hashed.select("h").distinct().select("h", F.explode(block_keys("h", self.most)).alias("k"))
        old = self._rows(self.keys, before).select("k", F.col("h").alias("g")).hint("merge")
        near = F.bit_count(F.col("h").bitwiseXOR(F.col("g"))) <= self.most
        return new.repartition(self.buckets, "k").join(old, "k").where(near).select("h", "g").distinct()

    def find(self, hashed: DataFrame, before: int | None = None) -> DataFrame:
        """(id, near, bits): for each item of ``hashed`` (id, h) the items of the index whose hashes are near, and in how many bits they differ.

        With ``before`` only batches below that number count.  Null hashes have nothing near them."""
        link = cut(self.near_hashes(hashed.where("h is not null"), before)).repartition(self.buckets, "g")
        met = link.join(self._rows(self.members, before).select(F.col("h").alias("g"), F.col("id").alias("near")).hint("merge"), "g")
        own = hashed.select("h", F.col("id").cast("long").alias("id"))
        return met.join(own.hint("merge"), "h").select("id", "near", F.bit_count(F.col("h").bitwiseXOR(F.col("g"))).alias("bits"))

    def add(self, hashed: DataFrame, batch: int) -> None:
        """Appends the items of ``hashed`` (id, h) as batch number ``batch``; one that is written again replaces what it wrote before.

        Hashes that an earlier batch has under its keys aren't written twice, so copies cost one row of members each."""
        rows = hashed.where("h is not null").select("h", F.col("id").cast("long").alias("id"))
        keyed = rows.select("h").distinct().select(F.explode(block_keys("h", self.most)).alias("k"), "h").repartition(self.buckets, "k")
        known = self._rows(self.keys, batch).hint("merge")
        self._write(cut(keyed.join(known, ["k", "h"], "left_anti").select("k", "h")), self.keys, "k", batch)
        self._write(rows, self.members, "h", batch)

    def link(self, hashed: DataFrame, batch: int) -> DataFrame:
        """(a, b), a < b, of a new batch: its items' pairs with each other and with all earlier batches; then the batch is added.

        The pairs of all batches in turn are the pairs of ``near_pairs`` over all items.  A batch that is run again finds the same pairs."""
        hashed = cut(hashed.select("id", "h"))
        found = self.find(hashed, batch).where("id <> near").select(F.least("id", "near").alias("a"), F.greatest("id", "near").alias("b"))
        pairs = cut(near_pairs(hashed, self.most).unionByName(found))
        self.add(hashed, batch)
        return pairs

    def compact(self, upto: int) -> None:
        """Brings batches up to ``upto`` together as that one, so that a bucket is one file again; none of them may be run again after that."""
        for table, by in ((self.keys, "k"), (self.members, "h")):
            self._write(cut(self._rows(table, upto + 1).distinct()), table, by, upto)
            gone = [r[0].split("=")[1] for r in self.spark.sql(f"SHOW PARTITIONS {table}").collect() if int(r[0].split("=")[1]) < upto]
            for batch in gone:
                self.spark.sql(f"ALTER TABLE {table} DROP PARTITION (batch = {batch})")
                self._files(f"{self._place(table)}/batch={batch}", "delete", True)


def link_stream(stream: DataFrame, index: NearIndex, folder: str):
    """Links every micro-batch of ``stream`` (id, h) to the index and to itself and writes the pairs (a, b) below ``folder``.

    A micro-batch has its own number in the index and in the output, so running it again after a failure changes nothing."""

    def land(batch: DataFrame, number: int) -> None:
        index.link(batch, number).write.mode("overwrite").parquet(f"{folder}/pairs/batch={number}")

    return stream.writeStream.foreachBatch(land).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
