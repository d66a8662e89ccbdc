"""Sharding by sampled splitters: range-partitions records into shards of nearly equal bytes.

1. Every record gets a sort key (a hash of its text) and a size.
2. A size-weighted sample of keys is drawn: a record of size s is drawn about s / step times, where
   step is the total size over the number of samples asked for.  The number of samples is a
   parameter, so the sample is bounded whatever the input.
3. The quantiles of the sample are the splitters of many fine ranges, some per shard.
4. The exact bytes of each range are counted; a range beyond `overfull` times its share is
   subdivided by a hash of the text, so that equal texts stay together, but a text whose copies alone are larger than
   a share is dealt by a hash of doc_id.
5. Ranges are laid end to end in key order and cut into shards at exact shares of the total.

Equal texts have equal keys, so copies meet in one piece of a range and one shard, unless they are larger than a
range's share.  Defined results: a null text has size 8 and CRC 0; null and repeated doc_ids
are ordinary rows; a text of any length is one record, however large its shard grows; an empty table gives an empty result; extra columns are kept out of the result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, stored


def text_size(text: Column) -> Column:
    """UTF-8 bytes plus 8 for the record's frame."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(8)


def unit(h: Column) -> Column:
    """A hash as a number in [0, 1)."""
    return F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))


def find_range(key: Column, splitters: list[int]) -> Column:
    """How many splitters are at most the key: first among the heads of sqrt(n) groups, then within one group."""
    if not splitters:
        return F.lit(0)
    width = max(1, math.isqrt(len(splitters)))
    groups = [splitters[i : i + width] for i in range(0, len(splitters), width)]
    heads = F.array(*[F.lit(g[0]).cast("long") for g in groups])
    table = F.array(*[F.array(*[F.lit(x).cast("long") for x in g]) for g in groups])
    g = F.size(F.filter(heads, lambda x: x <= key))
    within = F.size(F.filter(F.element_at(table, F.greatest(g, F.lit(1))), lambda x: x <= key))
    return F.when(g == 0, F.lit(0)).otherwise((g - 1) * width + within)


def sample_splitters(keyed: DataFrame, total: int, n_ranges: int, samples: int, seed: int) -> list[int]:
    """Quantiles of a size-weighted sample of keys; at most about `samples` rows and n_ranges - 1 boundaries reach the driver."""
    if total == 0 or n_ranges < 2:
        return []
    step = max(1.0, total / samples)
    draws = F.floor(F.col("size") / F.lit(step) + unit(F.xxhash64(F.lit(seed), "doc_id", "key"))).cast("long")
    drawn = keyed.select("key", draws.alias("n")).filter("n > 0").groupBy("key").agg(F.sum("n").alias("n"))
    below = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    cut = F.floor((F.sum("n").over(below) * n_ranges) / F.sum("n").over(Window.partitionBy()))
    cuts = drawn.select("key", cut.alias("cut")).groupBy("cut").agg(F.min("key").alias("key")).filter(F.col("cut").between(1, n_ranges - 1))
    return sorted({r["key"] for r in cuts.select("key").collect()})


def shard_by_bytes(docs: DataFrame, n_shards: int = 24, ranges_per_shard: int = 40, samples_per_range: int = 20, overfull: float = 2.0, seed: int = 5) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row of docs (doc_id, text); see the module."""
    light = stored(
        docs.select(
            F.col("doc_id"),
            text_size(F.col("text")).alias("size"),
            F.coalesce(F.crc32(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
            F.xxhash64(F.lit(seed), F.coalesce(F.col("text"), F.lit(""))).alias("key"),
        ),
        "shard-keys",
    )
    total = light.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("t")).first()["t"]
    n_ranges = n_shards * ranges_per_shard
    splitters = sample_splitters(light, total, n_ranges, n_ranges * samples_per_range, seed)
    ranged = light.withColumn("range", find_range(F.col("key"), splitters))
    # as many pieces as an overfull range's bytes need; the table of ranges is bounded by n_ranges
    share = max(1.0, total / n_ranges)
    full = ranged.groupBy("range").agg(F.sum("size").alias("bytes"))
    pieces = full.filter(F.col("bytes") > F.lit(overfull * share)).select("range", F.ceil(F.col("bytes") / F.lit(share)).cast("long").alias("pieces"))
    ranged = ranged.join(F.broadcast(pieces), "range", "left")
    # texts that fill a share by themselves: fewer than there are shares
    hot = ranged.filter("pieces is not null").groupBy("key").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > F.lit(share))
    ranged = ranged.join(F.broadcast(hot.select("key", F.lit(True).alias("hot"))), "key", "left")
    dealt = F.when(F.col("hot"), F.xxhash64(F.lit(seed + 1), "doc_id", "key")).otherwise(F.xxhash64(F.lit(seed + 1), "key"))
    part = F.coalesce(F.pmod(dealt, F.col("pieces")), F.lit(0))
    ranged = stored(ranged.select("doc_id", "size", "text_crc32", "key", "range", part.alias("piece")), "shard-ranges")
    # pieces end to end: offsets in bytes give the shard, offsets in rows the slot; one row for each piece
    laid = Window.orderBy("range", "piece").rowsBetween(Window.unboundedPreceding, -1)
    units = ranged.groupBy("range", "piece").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    start = F.coalesce(F.sum("bytes").over(laid), F.lit(0))
    shard = F.least(F.floor((start + F.col("bytes") / 2) * n_shards / F.lit(float(max(total, 1)))), F.lit(n_shards - 1)).cast("int")
    units = units.select("range", "piece", "rows", shard.alias("shard"))
    first = Window.partitionBy("shard").orderBy("range", "piece").rowsBetween(Window.unboundedPreceding, -1)
    units = units.select("range", "piece", "shard", F.coalesce(F.sum("rows").over(first), F.lit(0)).alias("first"))
    # overfull ranges hold `share` bytes a piece, so pieces are at most about twice n_ranges
    placed = ranged.join(bounded_broadcast(units, 4 * n_ranges + 16), ["range", "piece"])
    slot = F.col("first") + F.row_number().over(Window.partitionBy("range", "piece").orderBy("key", F.col("doc_id").asc_nulls_last(), "size", "text_crc32")) - 1
    return placed.select("doc_id", "size", "text_crc32", "shard", slot.cast("long").alias("slot"))


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
