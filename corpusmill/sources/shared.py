"""Intermediate tables in the folder that driver and executors share, and the size of what goes to Python."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders that this process wrote: (session, path).
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset and all runs on one machine, one set here."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="corpusmill-"))
    return sc.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to; drop_stored removes what is written there."""
    path = f"{shared_dir(spark).rstrip('/')}/corpusmill-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Sets the session to hand at most so many rows to Python at a time, as whole texts make 10 000 too much memory for a worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back, so that later stages restart from the files.

    An empty frame comes back with its schema.  The files stay until drop_stored, or the end of the driver's process.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession | None = None) -> None:
    """Removes the intermediate tables of a session, or of all; results that still read them must have been written before."""
    for held in [w for w in _written if spark is None or w[0] is spark]:
        _written.remove(held)
        sc = held[0].sparkContext
        if sc._jsc is not None:
            path = sc._jvm.org.apache.hadoop.fs.Path(held[1])
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def _at_exit() -> None:
    # the session may have been stopped before, and its connection with it
    with contextlib.suppress(Exception):
        drop_stored()


atexit.register(_at_exit)
