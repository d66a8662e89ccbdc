import pytest
from pyspark.sql import functions as F

from corpusmill import ports
from corpusmill.operators import retrieval as r


def test_embedding(spark):
    rows = spark.createDataFrame([("Some words here",), ("some WORDS here",), ("nothing alike",), (None,)], "t string").select("t", ports.HashEmbedding(32)(F.col("t")).alias("v")).collect()
    assert rows[0]["v"] == rows[1]["v"] != rows[2]["v"] and len(rows[0]["v"]) == 32
    assert sum(x * x for x in rows[0]["v"]) == pytest.approx(1, abs=1e-5) and set(rows[3]["v"]) == {0.0}


def test_rerank(spark):
    hits = spark.createDataFrame([(1, 5, 0.9, 1, "cat dog", "bird"), (1, 6, 0.8, 2, "cat dog", "dog cat"), (1, 7, 0.7, 3, "cat dog", "cat dog")], "query_id long, chunk_id long, score double, rank int, query string, content string")
    got = [(x["chunk_id"], x["score"]) for x in ports.rerank(hits, "query", "content", ports.OverlapRerank(), top=2).orderBy("rank").collect()]
    assert got == [(6, 1.0), (5, 0.0), (7, 0.7)]


def test_scripted_llm(spark):
    llm = ports.ScriptedLLM([("^a", "first"), ("b", "second")], "none")
    assert [x["x"] for x in spark.createDataFrame([("ab",), ("b",), ("c",)], "p string").select(llm(F.col("p")).alias("x")).collect()] == ["first", "second", "none"]


def test_grade_and_retry(spark):
    rows = spark.createDataFrame([(1, 0.9), (2, 0.6)], "query_id long, score double")
    got = ports.grade_and_retry(lambda mode, least: rows.filter(F.col("score") >= least), lambda h: h.select("query_id").distinct(), ["a", "b"], 0.8)
    assert sorted((x["query_id"], x["attempt"]) for x in got.collect()) == [(1, 0), (2, 1)]


def test_knn_of_stated_queries_is_exact(spark):
    v = spark.createDataFrame([(i, [float(i % 3), 1.0, 0.0]) for i in range(9)], "chunk_id long, embedding array<float>")
    top = r.knn(v, spark.createDataFrame([(1, [0.0, 1.0, 0.0])], "query_id long, vector array<float>"), 3)
    assert [x["chunk_id"] for x in top.orderBy("rank").collect()] == [0, 3, 6]
