"""Sinks: chunk tables partitioned by space and knowledge base, upserts and deletes by partition, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stored

PARTITIONS = ("space_id", "kb_id")


def newest(chunks: DataFrame, order: str = "version") -> DataFrame:
    """One row for each chunk_id, that of the largest version."""
    rest = [c for c in chunks.columns if c != "chunk_id"]
    return chunks.groupBy("chunk_id").agg(F.max_by(F.struct(*rest), order).alias("_r")).select("chunk_id", "_r.*").select(*chunks.columns)


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a table: a folder with something in it.  One that can't be read is there all the same, and reading it fails."""
    fs, p = _file_system(spark, path)
    return fs.exists(p) and len(fs.listStatus(p)) > 0


def ensure(spark: SparkSession, path: str, schema: str) -> None:
    """An empty table of that schema, unless there is one."""
    if not exists(spark, path):
        spark.createDataFrame([], schema).write.mode("append").partitionBy(*PARTITIONS).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """No table; nothing happens if there is none."""
    fs, p = _file_system(spark, path)
    if fs.exists(p):
        fs.delete(p, True)


def _replace(spark: SparkSession, after: DataFrame, path: str) -> None:
    # the new partitions are settled in the shared folder before the old ones are replaced: a broken replacement can be repeated
    stored(after, "sink").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path)


def upsert(spark: SparkSession, chunks: DataFrame, path: str) -> None:
    """Writes the newest of old and new rows; only partitions with new rows are rewritten.  Writing the same rows twice changes nothing."""
    if exists(spark, path):
        touched = chunks.select(*PARTITIONS).distinct()
        chunks = spark.read.parquet(path).join(touched, list(PARTITIONS), "left_semi").select(*chunks.columns).unionByName(chunks)
    _replace(spark, newest(chunks), path)


def delete(spark: SparkSession, gone: DataFrame, path: str, key: str = "document_id") -> None:
    """Removes the rows of the given keys; a partition left empty is kept as an empty one."""
    old = spark.read.parquet(path)
    hit = old.join(gone.select(key).distinct(), key, "left_semi").select(*PARTITIONS).distinct()
    left = old.join(hit, list(PARTITIONS), "left_semi").join(gone.select(key).distinct(), key, "left_anti").select(*old.columns)
    emptied = hit.join(left.select(*PARTITIONS).distinct(), list(PARTITIONS), "left_anti").collect()
    _replace(spark, left, path)
    for r in emptied:
        drop(spark, "/".join([path, *[f"{c}={r[c]}" for c in PARTITIONS]]))


def chunk_pages(chunks: DataFrame, offset: int, limit: int, order: tuple[str, ...] = ("chunk_index", "chunk_id")) -> DataFrame:
    """One page of each document's chunks in order, with `total`, how many there are."""
    document = Window.partitionBy("document_id")
    paged = chunks.withColumns({"_rn": F.row_number().over(document.orderBy(*order)), "total": F.count(F.lit(1)).over(document)})
    return paged.filter(F.col("_rn").between(offset + 1, offset + limit)).drop("_rn")


def chunk_page(spark: SparkSession, path: str, document_id: int, offset: int, limit: int) -> DataFrame:
    """A page of one document's chunks in a table."""
    return chunk_pages(spark.read.parquet(path).filter(F.col("document_id") == document_id), offset, limit)


def save_full_texts(texts: DataFrame, path: str) -> DataFrame:
    """Parsed texts (doc_id, text) as a table, read back: what splits them later needn't parse again."""
    texts.select("doc_id", "text").write.mode("overwrite").parquet(path)
    return texts.sparkSession.read.parquet(path)


def export_results(details: DataFrame, path: str, kind: str = "csv") -> None:
    """Evaluation details as JSON lines, or flattened as CSV with a header; arrays become JSON text."""
    if kind == "json":
        details.write.mode("overwrite").json(path)
        return
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in details.dtypes]
    details.select(*flat).write.mode("overwrite").option("header", "true").csv(path)
