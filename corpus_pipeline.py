"""A corpus pipeline of five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet into
the shared folder and reads it back as the next one's docs.

Defined results: extra columns of docs pass through all stages but the last, whatever their names; an empty table stays empty; texts
of any length count whole; rows that repeat are rows of their own, but for the near duplicates, where one of a class stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm import decontamination, language_id, mixing, ngram_join, sharding
from corpusmill.llm.common import fresh, stored


def language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents whose language can't be told go: null and empty texts and those without a letter among them."""
    return language_id.identify(docs).filter("language_kept").select(*docs.columns)


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: one document of each class stays, that of the smallest doc_id, null last, and of these of the first text hash.

    Null texts are a class each; rows that agree in doc_id and text are one document.
    """
    return ngram_join.first_of_each_class(docs)


def decontaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a passage of a benchmark item go; null and empty texts hold none and stay."""
    doc, key = fresh(docs, "doc", "key")
    hit = decontamination.phrase_matches(decontamination.keyed_documents(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    rows = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("string"), F.lit("")), key: F.coalesce(F.xxhash64("text"), F.lit(0))})
    return rows.join(hit.select(F.col("doc").alias(doc), F.col("key").alias(key)), [doc, key], "left_anti").select(*docs.columns)


def mixed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: a document is repeated in whole copies, which hold the words the mix takes of each source; 0 times is gone.

    Rows that agree in doc_id, source and size share their copies as evenly as whole ones allow; a null source is one more source;
    texts without words, null ones among them, are taken 0 times.
    """
    doc, host, size, rows_alike, times, nth, copy = fresh(docs, "doc", "host", "size", "rows", "times", "nth", "copy")
    text = lambda c: F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-"))
    taken = stored(mixing.mix(docs.select("doc_id", "source", "text")).filter("size > 0").select("doc_id", "source", "size", "taken"), "mix-taken")
    counts = mixing.whole_copies(taken).groupBy(text("doc_id").alias(doc), text("source").alias(host), F.col("size").alias(size)).agg(F.count(F.lit(1)).alias(rows_alike), F.sum("copies").alias(times))
    rows = docs.withColumns({doc: text("doc_id"), host: text("source"), size: mixing.n_words(F.col("text"))})
    joined = rows.join(counts.filter(F.col(times) > 0), [doc, host, size])
    alike = Window.partitionBy(doc, host, size).orderBy(F.xxhash64("text"))
    joined = joined.withColumn(nth, F.row_number().over(alike))
    own = F.floor(F.col(times) / F.col(rows_alike)) + F.when(F.col(nth) <= F.pmod(times, rows_alike), 1).otherwise(0)
    joined = joined.withColumn(times, own.cast("int")).filter(F.col(times) > 0)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def sharded(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sharding: each row's shard and its slot there, null texts and repeated rows included; columns as sharding gives them."""
    return sharding.shard_by_bytes(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminated", decontaminated), ("mixed", mixed), ("sharded", sharded)]

#: The text model and the forest aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
