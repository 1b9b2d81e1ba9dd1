"""What is written for later steps: how much, and in how many files."""

import pytest

from tenderlens.operators import text as X
from tenderlens.streaming import feeds as S


@pytest.mark.parametrize("each,files", [(10, 3), (20_000, 1)])
def test_arrivals_in_several_files(spark, each, files):
    """Three micro-batches of 30 rows, each in ``files`` files."""
    rows = spark.range(90).withColumnRenamed("id", "doc_id").repartition(3)
    stream = S.arrivals(rows, "doc_id", cuts=[29, 59], each=each)
    got = S.replay(stream.selectExpr("doc_id")).selectExpr("doc_id", "split(input_file_name(), 'batch=')[1] as b").selectExpr("doc_id", "int(split(b, '/')[0]) as batch").collect()
    assert {(r["doc_id"] // 30, r["batch"]) for r in got} == {(0, 0), (1, 1), (2, 2)} and len(got) == 90
    assert len({f for f in spark.read.parquet(stream_folder(stream)).inputFiles()}) == 3 * files


def stream_folder(stream):
    text = stream._jdf.queryExecution().analyzed().toString()
    return text[text.index("FileSource[") + 11 :].split("]")[0]


def test_lone_shingles_are_not_written(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(X, "stored", lambda df, keep=X.stored: kept.append(keep(df)) or kept[-1])
    alone = [(i, "en", " ".join(f"u{i}x{k}" for k in range(100))) for i in range(20)]
    base = " ".join(f"w{i}" for i in range(40))
    docs = [*alone, (100, "en", base), (101, "en", base + " more words here"), (102, "de", base)]
    got = X.shingle_jaccard(spark.createDataFrame(docs, "doc_id bigint, lang string, text string"), "doc_id", "lang", 0.35).collect()
    assert [(r["a"], r["b"], r["shared"], round(r["jaccard"], 6)) for r in got] == [(100, 101, 38, round(38 / 41, 6))]
    assert kept[0].count() == 76
