"""Vector operators: n-gram models, hashing vectors, look-ups and nearest neighbours."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions.scoring import unit
from inkwell.functions.text import col
from inkwell.operators import grams
from inkwell.operators.graph import cut


#: Cosines that a task holds at once.
CELLS = 2_000_000


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / (np.linalg.norm(rows, axis=1, keepdims=True) + 1e-9)


def _dense(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _best(s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(cosines, ids) of the ``k`` greatest of each row of ``s``, ties by id, in no order; ``ids`` are of columns or of cells."""
    if s.shape[1] <= k:
        return s, np.broadcast_to(ids, s.shape)
    bar = np.partition(s, -k, axis=1)[:, -k, None]
    over = s > bar
    short = k - over.sum(axis=1)
    ties = s == bar
    many = np.flatnonzero(ties.sum(axis=1) > short)
    if len(many):
        of = np.where(ties[many], np.broadcast_to(ids, s.shape)[many], np.iinfo(np.int64).max)
        order = np.argsort(of, axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(s.shape[1])[None], axis=1)
        ties[many] &= place < short[many, None]
    keep = over | ties
    return s[keep].reshape(len(s), k), np.broadcast_to(ids, s.shape)[keep].reshape(len(s), k)


def fit_vocabulary(docs: DataFrame, key: str, text: str, most: int = 4096) -> DataFrame:
    """(gram, idx, df, idf) of the ``most`` grams of highest document frequency, ties by gram; every row is a document."""
    n = docs.count()
    top = grams.document_frequency(docs, text).orderBy(F.desc("df"), "gram").limit(most)
    idx = F.row_number().over(Window.orderBy(F.desc("df"), "gram")) - 1
    return top.withColumn("idx", idx).withColumn("idf", F.ln((F.lit(n) + 1.0) / (F.col("df") + 1.0)) + 1.0)


def tfidf(docs: DataFrame, vocabulary: DataFrame, key: str, text: str) -> DataFrame:
    """(key, idx, weight): sparse unit vectors, a row for each cell; the count is divided by all grams of the text, known or not.

    The vocabulary's size is bounded by its fit, so it's broadcast; ``grams.sparse_rows`` gives one row for each text instead."""
    rows = grams.sparse_rows(docs, vocabulary, key, text)
    return rows.select(key, "norm", F.explode(F.arrays_zip("idx", "x")).alias("c")).select(key, F.col("c.idx").alias("idx"), (F.col("c.x") / F.col("norm")).alias("weight"))


def project(docs: DataFrame, vocabulary: DataFrame, projection: DataFrame, key: str, text: str) -> DataFrame:
    """(key, vector): the texts' weights times a matrix (idx, row array<double>), of unit length."""
    return grams.projected(docs, vocabulary, _matrix(projection), key, text)


def _matrix(projection: DataFrame) -> np.ndarray:
    """A projection's rows in order of idx; it's as small as the vocabulary."""
    rows = {r.idx: r.row for r in projection.select("idx", "row").collect()}
    out = np.zeros((max(rows, default=-1) + 1, len(next(iter(rows.values()), []))))
    for i, row in rows.items():
        out[i] = row
    return out


def hash_cells(docs: DataFrame, key: str, text: str, dim: int = 128) -> DataFrame:
    """(key, idx, x): signed counts of character pairs by hash, sparse; cells that cancel out are dropped."""
    rows = grams.hashed(docs, key, text, dim, unit=False)
    return rows.select(key, F.posexplode("vector").alias("idx", "x")).where("x <> 0")


def hash_vectors(docs: DataFrame, key: str, text: str, dim: int = 128) -> DataFrame:
    """(key, vector): dense vectors of ``hash_cells`` for each row where it is, of unit length; where all cells cancel out, all are 0."""
    return grams.hashed(docs, key, text, dim)


def lookup(keys: DataFrame, embeddings: DataFrame, model: str | None = None) -> DataFrame:
    own = embeddings if model is None else embeddings.where(F.col("model") == model)
    return keys.join(own, "content_hash")


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 20, block: int = 10_000) -> DataFrame:
    """(query, id, cosine, place): the ``k`` vectors of highest cosine for each of ``queries`` (id, vector), ties by id.

    Queries are dealt into blocks of about ``block``; each block in turn is sent out.  A task compares it with some vectors at a time
    and keeps its own best ``k`` of a query, so it holds no more than ``CELLS`` cosines, and so many rows are shuffled."""
    n = queries.count()
    parts = max(1, -(-n // block))
    out = None
    for b in range(parts):
        own = queries if parts == 1 else queries.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == b)
        found = _nearest_of([(r["id"], np.array(r["vector"], np.float64)) for r in own.select("id", "vector").collect()], vectors, k)
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy("query").orderBy(F.desc("cosine"), "id")
    return out.withColumn("place", F.row_number().over(w)).where(col("place") <= k)


def _nearest_of(held: list[tuple[int, np.ndarray]], vectors: DataFrame, k: int) -> DataFrame:
    ids = [i for i, _ in held]
    q = np.stack([v for _, v in held]) if held else np.zeros((0, 1))
    sent = vectors.sparkSession.sparkContext.broadcast(q / (np.linalg.norm(q, axis=1, keepdims=True) + 1e-9))

    def search(batches):
        if not ids:
            return
        best, rows = None, max(k, CELLS // len(ids))
        for batch in batches:
            own, m = batch.column(0).to_numpy(), _unit(_dense(batch.column(1)))
            for at in range(0, len(m), rows):
                found = _best(np.round(sent.value @ m[at : at + rows].T, 9), own[at : at + rows], k)
                best = found if best is None else _best(*(np.concatenate(x, axis=1) for x in zip(best, found, strict=True)), k)
        if best is not None:
            s, own = best
            for at in range(0, len(ids), 10_000):
                part = own[at : at + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[at : at + 10_000], part.shape[1])), pa.array(part.ravel()), pa.array(s[at : at + 10_000].ravel())], ["query", "id", "cosine"])

    return vectors.select(F.col("id").cast("long").alias("id"), "vector").mapInArrow(search, "query long, id long, cosine double")


class _TextColumns(Params):
    """Columns of an embedder: the key that goes along, the text, and where the vector goes."""

    keyCol = Param(Params._dummy(), "keyCol", "key of a row", TypeConverters.toString)
    textCol = Param(Params._dummy(), "textCol", "text", TypeConverters.toString)
    vectorCol = Param(Params._dummy(), "vectorCol", "vector", TypeConverters.toString)

    def _columns(self, key: str, text: str, vector: str) -> None:
        self._setDefault(keyCol="id", textCol="text", vectorCol="vector")
        self._set(keyCol=key, textCol=text, vectorCol=vector)

    key = property(lambda self: self.getOrDefault("keyCol"))
    text = property(lambda self: self.getOrDefault("textCol"))
    vector = property(lambda self: self.getOrDefault("vectorCol"))

    def _beside(self, dataset: DataFrame, vectors: DataFrame) -> DataFrame:
        own = vectors.withColumnRenamed("vector", self.vector) if self.vector != "vector" else vectors
        return dataset.join(own.hint("merge"), self.key, "left")


class HashEmbedder(_TextColumns, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Vectors by hashing pairs of characters; nothing is learned from the corpus.  Adds ``vector`` to rows (key, text)."""

    dim = Param(Params._dummy(), "dim", "places of a vector", TypeConverters.toInt)

    def __init__(self, key: str = "id", text: str = "text", dim: int = 128, vector: str = "vector"):
        super().__init__()
        self._columns(key, text, vector)
        self._set(dim=dim)

    def _fit(self, dataset: DataFrame) -> HashEmbedderModel:
        return HashEmbedderModel(self.key, self.text, self.getOrDefault("dim"), self.vector)


class HashEmbedderModel(_TextColumns, Model, DefaultParamsReadable, DefaultParamsWritable):
    dim = Param(Params._dummy(), "dim", "places of a vector", TypeConverters.toInt)

    def __init__(self, key: str = "id", text: str = "text", dim: int = 128, vector: str = "vector"):
        super().__init__()
        self._columns(key, text, vector)
        self._set(dim=dim)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self._beside(dataset, hash_vectors(dataset, self.key, self.text, self.getOrDefault("dim")))


class NgramEmbedder(_TextColumns, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Vectors of character n-grams weighted by tf-idf, projected on the leading directions of the texts that it was fitted on.

    The vocabulary of ``most`` grams and the projection are bounded, whatever the texts.  With fewer than nine texts nothing is
    projected and the vectors have one place for each gram."""

    dim = Param(Params._dummy(), "dim", "directions kept", TypeConverters.toInt)
    most = Param(Params._dummy(), "most", "grams kept", TypeConverters.toInt)

    def __init__(self, key: str = "id", text: str = "text", dim: int = 64, most: int = 4096, vector: str = "vector"):
        super().__init__()
        self._columns(key, text, vector)
        self._set(dim=dim, most=most)

    def _fit(self, dataset: DataFrame) -> NgramEmbedderModel:
        spark = dataset.sparkSession
        vocabulary = cut(fit_vocabulary(dataset, self.key, self.text, self.getOrDefault("most")))
        n, width = dataset.count(), vocabulary.count()
        target = min(self.getOrDefault("dim"), n - 1, width)
        top = np.eye(width) if target < 8 else grams.leading_directions(dataset, vocabulary, self.text, target)
        projection = spark.createDataFrame([(i, row) for i, row in enumerate(top.tolist())], "idx int, row array<double>")
        return NgramEmbedderModel(vocabulary, projection, self.key, self.text, self.vector)


class TablesWriter(MLWriter):
    """A stage's params as metadata, and its tables as Parquet beside them."""

    def __init__(self, stage, tables: tuple[str, ...]):
        super().__init__()
        self.stage, self.tables = stage, tables

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        for name in self.tables:
            getattr(self.stage, name).write.parquet(f"{path}/{name}")


class TablesReader(MLReader):
    def __init__(self, kind, tables: tuple[str, ...]):
        super().__init__()
        self.kind, self.tables = kind, tables

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        out = self.kind(*[self.sparkSession.read.parquet(f"{path}/{name}") for name in self.tables])
        out._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(out, metadata)
        return out


class NgramEmbedderModel(_TextColumns, Model, MLReadable, MLWritable):
    """A vocabulary (gram, idx, df, idf) and a projection (idx, row), saved and loaded with its params."""

    TABLES = ("vocabulary", "projection")

    def __init__(self, vocabulary: DataFrame, projection: DataFrame, key: str = "id", text: str = "text", vector: str = "vector"):
        super().__init__()
        self.vocabulary, self.projection = vocabulary, projection
        self._columns(key, text, vector)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self._beside(dataset, project(dataset, self.vocabulary, self.projection, self.key, self.text))

    def write(self) -> TablesWriter:
        return TablesWriter(self, self.TABLES)

    @classmethod
    def read(cls) -> TablesReader:
        return TablesReader(cls, cls.TABLES)


class InvertedLists:
    """Coarse centroids of vectors (at most ``most_lists``, fitted on about ``sample`` of them); a vector stands in the list of its nearest one."""

    def __init__(self, vectors: DataFrame, lists: int | None = None, sample: int = 100_000, most_lists: int = 4096, seed: int = 7):
        n = vectors.count()
        self.lists = max(1, min(lists or round(n**0.5), most_lists, n))
        data = vectors.select("vector") if n <= sample else vectors.select("vector").sample(sample / n, seed)
        data = cut(data.select(array_to_vector(unit("vector")).alias("features")))
        centres = KMeans(k=self.lists, seed=seed, maxIter=15).fit(data).clusterCenters() if n > 1 else [np.ones(1)]
        self.sent = vectors.sparkSession.sparkContext.broadcast(_unit(np.array(centres, np.float64)))
        self.lists = len(centres)

    def deal(self, rows: DataFrame, probes: int) -> DataFrame:
        """``rows`` (id, vector) once for each of their ``probes`` nearest lists: (id, vector, list, place)."""
        sent, probes = self.sent, min(probes, self.lists)

        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    m = _dense(part.column(1))
                    s = _unit(m) @ sent.value.T if len(sent.value) > 1 else np.zeros((len(m), 1))
                    order = np.argsort(-np.round(s, 9), axis=1, kind="stable")[:, :probes]
                    row = pa.array(np.repeat(np.arange(len(m)), order.shape[1]))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), pa.array(order.ravel().astype(np.int32)), pa.array(np.tile(np.arange(order.shape[1], dtype=np.int32), len(m)))], ["id", "vector", "list", "place"])

        return rows.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, "id long, vector array<double>, list int, place int")


def probes_for(index: InvertedLists, queries: DataFrame, vectors: DataFrame, k: int, recall: float = 0.95, sample: int = 200, seed: int = 7) -> int:
    """How many lists a query must probe so that about ``recall`` of its ``k`` nearest are met, measured on about ``sample`` queries exactly."""
    n = queries.count()
    some = cut(queries.select("id", "vector") if n <= sample else queries.select("id", "vector").sample(min(1.0, sample / n), seed).limit(2 * sample))
    found = nearest(some, vectors, k).select("query", "id")
    own = index.deal(vectors, 1).select("id", "list")
    order = index.deal(some, index.lists).select(F.col("id").alias("query"), "list", "place")
    places = found.join(own.hint("merge"), "id").join(order.hint("merge"), ["query", "list"])
    got = places.agg(F.percentile("place", F.lit(recall)).alias("p")).first().p
    return index.lists if got is None else min(index.lists, int(got) + 1)


def nearest_in_lists(queries: DataFrame, vectors: DataFrame, k: int = 20, lists: int | None = None, probes: int | None = None, block: int = 1024, recall: float = 0.95) -> DataFrame:
    """(query, id, cosine, place) as ``nearest`` has it, for two tables of any size: a query is compared with the vectors of its ``probes`` nearest lists.

    What is compared is compared exactly.  Without ``probes`` their number is set so that about ``recall`` of the neighbours are met
    (``probes_for``); with as many probes as lists all are.  A list is dealt into blocks of about ``block`` vectors and of as many
    queries, so no task holds a large one whole, and neither side comes to the driver.  Null vectors are nobody's neighbours."""
    queries, vectors = (df.select("id", "vector").where("vector is not null") for df in (queries, vectors))
    index = InvertedLists(vectors, lists)
    probes = probes or probes_for(index, queries, vectors, k, recall)

    def dealt(rows: DataFrame, name: str) -> DataFrame:
        sizes = rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(f"n_{name}"))
        own = rows.join(F.broadcast(sizes), "list")  # a row for each list, at most ``most_lists``
        return own.withColumn(name, F.pmod(F.xxhash64("id"), F.col(f"n_{name}")).cast("int"))

    here, there = dealt(cut(index.deal(queries, probes)), "i"), dealt(cut(index.deal(vectors, 1)), "j")
    count = lambda rows, name: rows.select("list", F.col(f"n_{name}").alias("n")).distinct()
    left = here.join(F.broadcast(count(there, "j")), "list").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("list", "i", "j", "id", "vector")
    right = there.join(F.broadcast(count(here, "i")), "list").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("list", "i", "j", "id", "vector")

    def compare(q: pa.Table, v: pa.Table) -> pa.Table:
        names, kinds = ["query", "id", "cosine"], [pa.int64(), pa.int64(), pa.float64()]
        if not q.num_rows or not v.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names)
        (a, b), queries = (_unit(_dense(t.column("vector"))) for t in (q, v)), q.column("id").to_numpy()
        step, parts = max(1, CELLS // len(b)), []
        for at in range(0, len(a), step):
            s, ids = _best(np.round(a[at : at + step] @ b.T, 9), v.column("id").to_numpy(), k)
            parts.append(pa.table([pa.array(np.repeat(queries[at : at + step], s.shape[1])), pa.array(ids.ravel()), pa.array(s.ravel())], names))
        return pa.concat_tables(parts)

    by = ["list", "i", "j"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(compare, "query long, id long, cosine double")
    w = Window.partitionBy("query").orderBy(F.desc("cosine"), "id")
    return found.withColumn("place", F.row_number().over(w)).where(col("place") <= k)
