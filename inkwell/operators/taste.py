"""Taste profiles: clusters of liked texts, their centroids and lengths; an Estimator and its Model."""

from __future__ import annotations

from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable, MLReadable, MLWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions.scoring import length_score, taste_similarity, unit
from inkwell.operators.graph import cut
from inkwell.operators.vectors import NgramEmbedder, NgramEmbedderModel, TablesReader, TablesWriter


def weighted_centroids(rows: DataFrame, cluster: str = "cluster", vector: str = "vector", weight: str = "weight", least: int = 3) -> DataFrame:
    """(cluster, centroid, size): weighted means of unit vectors, again of unit length; clusters under ``least`` members go.

    Where none is left, one centroid of all rows stands for them (cluster -1)."""
    cells = rows.select(F.col(cluster).alias("cluster"), F.greatest(F.col(weight).cast("double"), F.lit(1e-9)).alias("w"), F.posexplode(unit(vector)).alias("d", "x"))

    def means(df: DataFrame, *by) -> DataFrame:
        dense = df.groupBy(*by, "d").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"), F.count(F.lit(1)).alias("size"))
        out = dense.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("v"), F.max("size").alias("size")).withColumn("v", F.col("v.x"))
        return out.select(*by, unit("v").alias("centroid"), "size")

    own = means(cells, "cluster").where(F.col("size") >= least)
    alone = means(cells).withColumn("cluster", F.lit(-1)).select(*own.columns)
    none = own.agg(F.count(F.lit(1)).alias("n"))
    return own.unionByName(alone.join(F.broadcast(none), F.col("n") == 0).drop("n"))


def length_stats(rows: DataFrame, length: str = "length") -> DataFrame:
    """(mu, sigma) of the logs of lengths of 50 at least; sigma is 0.35 at least."""
    log = F.ln(F.greatest(F.col(length).cast("double"), F.lit(50.0)))
    return rows.agg(F.avg(log).alias("mu"), F.greatest(F.stddev_pop(log), F.lit(0.35)).alias("sigma"))


def cluster(rows: DataFrame, vector: str = "vector", k: int | None = None, seeds: int = 8) -> DataFrame:
    """``rows`` with a cluster number: k-means, the best of ``seeds`` starts; k grows with the root of half the rows, from 2 to 8."""
    n = rows.count()
    k = min(k or max(2, min(8, round((n / 2) ** 0.5))), max(1, n // 3))
    if k <= 1:
        return rows.withColumn("cluster", F.lit(0))
    data = rows.withColumn("features", array_to_vector(F.transform(vector, lambda x: x.cast("double")))).cache()
    fits = [KMeans(k=k, seed=s, maxIter=40).fit(data) for s in range(1, seeds + 1)]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    data.unpersist()
    return best.transform(data).withColumnRenamed("prediction", "cluster").drop("features")


def label_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))


class _TasteColumns(Params):
    vectorCol = Param(Params._dummy(), "vectorCol", "vector", TypeConverters.toString)
    lengthCol = Param(Params._dummy(), "lengthCol", "length of the text", TypeConverters.toString)

    def _columns(self, vector: str, length: str) -> None:
        self._set(vectorCol=vector, lengthCol=length)

    vector = property(lambda self: self.getOrDefault("vectorCol"))
    length = property(lambda self: self.getOrDefault("lengthCol"))


class Taste(_TasteColumns, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator: ``fit`` on liked rows (vector, length, and weight, 1 where there is none) gives a TasteModel.  ``k`` 0 goes by the rows."""

    k = Param(Params._dummy(), "k", "clusters", TypeConverters.toInt)
    seeds = Param(Params._dummy(), "seeds", "starts of k-means", TypeConverters.toInt)
    least = Param(Params._dummy(), "least", "members of a cluster", TypeConverters.toInt)

    def __init__(self, k: int | None = None, seeds: int = 8, least: int = 3, vector: str = "vector", length: str = "length"):
        super().__init__()
        self._columns(vector, length)
        self._set(k=k or 0, seeds=seeds, least=least)

    def _fit(self, rows: DataFrame) -> TasteModel:
        rows = rows if "weight" in rows.columns else rows.withColumn("weight", F.lit(1.0))
        grouped = cut(cluster(rows, self.vector, self.getOrDefault("k") or None, self.getOrDefault("seeds")))
        centroids = weighted_centroids(grouped, vector=self.vector, least=self.getOrDefault("least"))
        return TasteModel(centroids, length_stats(rows, self.length), self.vector, self.length)


class TasteModel(_TasteColumns, Model, MLReadable, MLWritable):
    """At most eight centroids and one row of length statistics; saved and loaded with its params."""

    TABLES = ("centroids", "lengths")

    def __init__(self, centroids: DataFrame, lengths: DataFrame, vector: str = "vector", length: str = "length"):
        super().__init__()
        self._columns(vector, length)
        self.centroids, self.lengths = centroids, lengths

    def profile(self) -> DataFrame:
        held = self.centroids.agg(F.array_sort(F.collect_list(F.struct("cluster", "centroid", "size"))).alias("p"))
        return held.select(F.col("p.centroid").alias("centroids"), F.transform(F.col("p.size"), lambda n: n.cast("double")).alias("sizes")).join(F.broadcast(self.lengths))

    def _transform(self, items: DataFrame) -> DataFrame:
        """``items`` with ``sim`` and ``len_score``."""
        out = items.join(F.broadcast(self.profile()))
        return out.withColumn("sim", taste_similarity(self.vector, "centroids", "sizes")).withColumn("len_score", length_score(self.length, "mu", "sigma")).drop("centroids", "sizes", "mu", "sigma")

    def write(self) -> TablesWriter:
        return TablesWriter(self, self.TABLES)

    @classmethod
    def read(cls) -> TablesReader:
        return TablesReader(cls, cls.TABLES)


def load_or_fit(spark, folder: str, rows: DataFrame, embedder: NgramEmbedder | None = None, **how) -> tuple[TasteModel, NgramEmbedderModel]:
    """(taste, embedder) of ``folder``, fitted on ``rows`` (id, text, length, weight) and saved there as one pipeline first if it is absent.

    A mark that is written last says that all is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/whole/_SUCCESS")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        own = (embedder or NgramEmbedder()).fit(rows)
        model = PipelineModel([own, Taste(**how).fit(cut(own.transform(rows)))])
        model.write().overwrite().save(f"{folder}/model")
        spark.range(1).write.mode("overwrite").parquet(f"{folder}/whole")
    stages = PipelineModel.load(f"{folder}/model").stages
    return stages[1], stages[0]
