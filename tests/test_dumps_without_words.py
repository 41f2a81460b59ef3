import duckdb
import pytest

from inkwell.plans import dump_queries


@pytest.fixture(scope="module")
def wordless(spark, tmp_path_factory):
    """Twelve documents of each kind: with words, without letters, empty, null."""
    place = str(tmp_path_factory.mktemp("wordless"))
    rows = [(12 * k + i, t, "en", "s", 0) for k, t in enumerate(("Some words.", "123 !?", "", None)) for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{place}/documents.parquet")
    return place


@pytest.mark.parametrize("name", ["s3_note_dumps", "s13_article_dumps"])
def test_documents_without_letters_agree_with_sql(spark, wordless, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{wordless}/documents.parquet/*.parquet')")
    order = lambda rows: sorted(map(tuple, rows), key=str)
    assert order(dump_queries.QUERIES[name](spark, wordless).collect()) == order(con.execute(dump_queries.ORACLE[name]).fetchall())
