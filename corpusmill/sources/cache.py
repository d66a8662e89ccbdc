"""A cache of search results with a lifetime: an append-only table whose batches expire.

A batch is written beside the table and renamed into it, so readers see all of it or nothing; its folder's name says when it was stored
and when it expires, so expired batches aren't even listed for reading.  Writers never touch each other's batches: of a key stored
twice the newest counts.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored
from .sinks import _file_system


def cache_key(*parameters: Column) -> Column:
    """A key over all parameters that change a result; texts without their outer blanks, in lower case.  Null isn't blank."""
    text = lambda c: F.lower(F.trim(c.cast("string")))
    return F.md5(F.to_json(F.array(*map(text, parameters))))


class ResultCache:
    """Results of searches by key, as arrays of rows, kept for `lifetime` seconds."""

    def __init__(self, spark: SparkSession, path: str, lifetime: float = 3600.0) -> None:
        self.spark, self.path, self.lifetime = spark, path.rstrip("/"), lifetime

    def _batches(self) -> list[tuple[str, float, float]]:
        """Folder, time stored and time of expiry of each batch."""
        fs, path = _file_system(self.spark, self.path)
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        parts = [(n, n.split("-")) for n in names if n.startswith("batch-")]
        return [(f"{self.path}/{n}", int(p[1]) / 1000, int(p[2]) / 1000) for n, p in parts]

    def put(self, results: DataFrame, now: float | None = None) -> None:
        """Adds results (key, rows)."""
        now = time.time() if now is None else now
        name = f"batch-{round(1000 * now):015}-{round(1000 * (now + self.lifetime)):015}-{uuid.uuid4().hex}"
        staging = f"{self.path}/.staging-{name}"
        results.select("key", "rows").write.parquet(staging)
        fs, path = _file_system(self.spark, staging)
        if not fs.rename(path, self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")):
            raise OSError(f"could not commit {name}")

    def get(self, keys: DataFrame, now: float | None = None) -> DataFrame | None:
        """(key, rows) of those keys (key) that are stored and not expired; None if the table holds no live batch."""
        now = time.time() if now is None else now
        live = [(p, at) for p, at, until in self._batches() if at <= now < until]
        if not live:
            return None
        held = None
        for path, at in live:
            batch = self.spark.read.parquet(path).select("key", "rows", F.lit(at).alias("_at"), F.lit(path).alias("_path"))
            held = batch if held is None else held.unionByName(batch)
        wanted = held.join(keys.select("key").distinct(), "key", "left_semi")
        return wanted.groupBy("key").agg(F.max_by("rows", F.struct("_at", "_path")).alias("rows"))

    def get_or_compute(self, queries: DataFrame, search: Callable[[DataFrame], DataFrame], now: float | None = None) -> DataFrame:
        """The hits of queries (key, ...): stored ones as they are, the others from search(queries), whose hits (key, ...) are stored.

        A key without hits is stored too, so that it isn't searched for again.  Two callers that miss the same key both search; either result
        is whole, and the newest stays.
        """
        known = self.get(queries, now)
        known = None if known is None else stored(known, "cached")
        missing = queries if known is None else queries.join(known, "key", "left_anti")
        missing = stored(missing, "cache-missing")
        if known is None or not missing.isEmpty():
            hits = search(missing)
            rows = hits.groupBy("key").agg(F.collect_list(F.struct(*[c for c in hits.columns if c != "key"])).alias("rows"))
            empty = F.array().cast(dict(rows.dtypes)["rows"])
            fresh = stored(missing.select("key").distinct().join(rows, "key", "left").select("key", F.coalesce("rows", empty).alias("rows")), "cache-fresh")
            self.put(fresh, now)
            known = fresh if known is None else known.unionByName(fresh)
        return known.select("key", F.explode("rows").alias("r")).select("key", "r.*")

    def sweep(self, now: float | None = None) -> int:
        """Removes expired batches; how many there were."""
        now = time.time() if now is None else now
        gone = [p for p, _, until in self._batches() if until <= now]
        for path in gone:
            fs, p = _file_system(self.spark, path)
            fs.delete(p, True)
        return len(gone)
