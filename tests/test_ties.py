"""Results that hang on a letter's case, on a half, or on how a table is stored."""

from pyspark.sql import functions as F

from tenderlens.operators import rules as R
from tenderlens.operators import text as X
from tenderlens.streaming import feeds as S


def test_mentions_keep_letters_apart(spark):
    docs = spark.createDataFrame([(1, "die straße lang"), (2, "die strasse lang"), (3, "STRAßE LANG")], "doc_id bigint, text string")
    names = spark.createDataFrame([(1, "Straße Lang Ltd")], "id int, text string")
    assert sorted(r["doc_id"] for r in X.mentions(docs, names, "doc_id", "id").collect()) == [1, 3]


def test_confidence_rounds_halves_up(spark):
    """Overall 95, 75, ... and qualities in half thousandths, against whole numbers."""
    rows = [(k, f"R{i}", 10, "PASS", 10, 95, 0, 3, n / 2000) for k, n in enumerate(range(1, 2001, 7)) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "doc_id int, rule string, weight int, status string, score int, authenticity int, anomalies int, files int, quality double")
    for r in R.risk_profile(df, "doc_id").collect():
        n = range(1, 2001, 7)[r["doc_id"]]
        assert r["confidence"] == max(10, min(100, (700 * r["overall"] + 30 * ((n + 1) // 2) + 500) // 1000)), n


def test_streams_read_a_table_of_many_files(spark, tmp_path):
    docs = [(i, f"text {i} of the owner", "en", "src1", 10) for i in range(20)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = S.replay(S.ingest_documents(S.document_stream(spark, str(tmp_path))))
    assert got.count() == 20 and got.filter(F.col("esg").isNull()).count() == 0
