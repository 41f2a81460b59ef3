from pyspark.sql import functions as F

from inkwell.plans import stream_queries as q

from .conftest import SF


def test_a_large_drop_lands_as_several_files_of_one_batch(spark, monkeypatch):
    monkeypatch.setattr(q, "DROP_ROWS", 50)
    monkeypatch.setattr(q._files, "__defaults__", (50,))
    rows = q._landing(spark, SF, "documents", "doc_id")
    seen = []

    def land(batch, n):
        own = batch.select("doc_id", F.input_file_name().alias("f")).toPandas()
        seen.append((len(own), own["f"].nunique(), own["doc_id"].min(), own["doc_id"].max()))

    rows.writeStream.foreachBatch(land).option("checkpointLocation", q._folder(spark)).trigger(availableNow=True).start().awaitTermination()
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert sum(s[0] for s in seen) == n and len(seen) == 4
    assert all(s[1] == n // 200 + 1 > 1 for s in seen) and all(a[3] < b[2] for a, b in zip(seen, seen[1:], strict=False))
