"""Scans over all rows of a table in one order, spread over tasks: rows are dealt to blocks of the order, and what a row takes
from rows before or after it is carried over the blocks' borders.

The order is a range partitioning; a row's place, what it sees of its neighbours and running aggregates don't depend on how many
partitions or blocks there are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

#: Rows of a block; each block is one task's window, and one row of the table that carries sums over blocks.
BLOCK = 1 << 16


def indexed(df: DataFrame, *order: str) -> DataFrame:
    """df with _i, the place of each row in the order, from 0; the order must tell all rows apart."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "scan")
    # a row for each partition
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    first = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(first, "_part").withColumn("_i", F.col("_first") + place - 1).drop("_part", "_first")


def neighbours(df: DataFrame, wanted: dict[str, tuple[str, int]], block: int = BLOCK) -> DataFrame:
    """df (_i, ...) with columns of rows so many places further on (or back, if negative): {name: (column, places)}; null beyond the ends.

    The rows at a block's borders go to its neighbour too.
    """
    offsets = [n for _, n in wanted.values()]
    ahead, back = max(0, *offsets), max(0, *(-n for n in offsets))
    if block <= max(ahead, back):
        raise ValueError("a block holds more rows than the furthest neighbour is away")
    own, at = F.floor(F.col("_i") / block), F.col("_i") % block
    seats = F.array_compact(F.array(own, F.when((at < ahead) & (own > 0), own - 1), F.when(at >= block - back, own + 1)))
    order = Window.partitionBy("_block").orderBy("_i")
    seated = df.withColumn("_block", F.explode(seats))
    seated = seated.withColumns({name: F.lead(c, n).over(order) if n > 0 else F.lag(c, -n).over(order) for name, (c, n) in wanted.items()})
    return seated.filter(F.col("_block") == own).drop("_block")


def running(df: DataFrame, name: str, how: Callable[[Column], Column], value: Column, block: int = BLOCK) -> DataFrame:
    """df (_i, ...) with `name`: F.sum or F.max of value over all rows before this one; null if there are none, or none with a value.

    Blocks are aggregated first; what is carried into a block comes from a table of a row for each block.
    """
    if how not in (F.sum, F.max):
        raise ValueError("running aggregates are sums and maxima")
    given = df.withColumns({"_block": F.floor(F.col("_i") / block), "_value": value})
    totals = given.groupBy("_block").agg(how("_value").alias("_total"))
    carried = totals.select("_block", how("_total").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    inside = how("_value").over(Window.partitionBy("_block").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1))
    both = F.greatest("_carried", inside) if how is F.max else F.coalesce(F.col("_carried") + inside, "_carried", inside)
    return given.join(carried, "_block").withColumn(name, both).drop("_block", "_value", "_carried")


def merge_small_chunks(pieces: DataFrame, order: list[str], least: int, size: int, block: int = BLOCK) -> DataFrame:
    """Chunks of pieces (text, ...) in one pass over all documents: columns of a chunk's first piece, its text and chunk_index, through all documents.

    A piece under `least` characters joins its successor by a line break if the two fit into `size`, or else the chunk before it, or else
    stands alone; the last piece of all joins none.

    What a pass does at a piece follows from few others.  Whether a piece could join its successor depends on the two alone;
    after a piece that couldn't, the next one surely begins anew; between such places every second piece is taken by the one
    before it.  And a piece that goes back fits only into a chunk that it directly follows: if that chunk's own last piece had
    gone back, the two pieces wouldn't have fitted together.
    """
    x = indexed(pieces, *order).withColumn("_len", F.length(F.coalesce("text", F.lit(""))))
    x = neighbours(x, {"_len1": ("_len", 1)}, block)
    joins = (F.col("_len") < least) & F.col("_len1").isNotNull() & (F.col("_len") + 1 + F.col("_len1") <= size)
    x = running(x.withColumn("_joins", joins), "_anew", F.max, F.when(~F.col("_joins"), F.col("_i") + 1), block)
    x = x.withColumn("_begins", (F.col("_i") - F.coalesce("_anew", F.lit(0))) % 2 == 0)
    x = neighbours(x, {"_text1": ("text", 1), "_text2": ("text", 2), "_len2": ("_len", 2), "_len3": ("_len", 3), "_joins1": ("_joins", 1), "_joins2": ("_joins", 2), "_back1": ("_len", -1), "_back2": ("_len", -2), "_begins_before": ("_begins", -1)}, block)
    unit = F.when(F.col("_joins"), F.col("_len") + 1 + F.col("_len1")).otherwise(F.col("_len"))
    # the next piece that begins a unit: whether it goes back to this one
    after = lambda a, b: F.when(F.col("_joins"), F.col(b)).otherwise(F.col(a))
    takes = ~after("_joins1", "_joins2") & (after("_len1", "_len2") < least) & after("_len2", "_len3").isNotNull() & (unit + 1 + after("_len1", "_len2") <= size)
    before = F.when(F.col("_begins_before"), F.col("_back1")).otherwise(F.col("_back2") + 1 + F.col("_back1"))
    goes = (F.col("_i") > 0) & ~F.col("_joins") & (F.col("_len") < least) & F.col("_len1").isNotNull() & (before + 1 + F.col("_len") <= size)
    texts = F.array_compact(F.array(F.coalesce("text", F.lit("")), F.when(F.col("_joins"), F.coalesce("_text1", F.lit(""))), F.when(F.coalesce(takes, F.lit(False)), F.coalesce(after("_text1", "_text2"), F.lit("")))))
    chunks = x.withColumns({"_head": F.col("_begins") & ~F.coalesce(goes, F.lit(False)), "_merged": F.array_join(texts, "\n")})
    chunks = running(chunks, "_before", F.sum, F.col("_head").cast("long"), block).filter("_head")
    rest = [c for c in pieces.columns if c != "text"]
    return chunks.select(*rest, F.col("_merged").alias("text"), F.coalesce("_before", F.lit(0)).alias("chunk_index"))
