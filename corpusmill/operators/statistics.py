"""Relational shapes behind listings and statistics: latest rows, status summaries, counters, optional filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def where_given(df: DataFrame, **predicates: Column | None) -> DataFrame:
    """Filters by those predicates that are given, all together, so that they reach the scan as one."""
    given = [p for p in predicates.values() if p is not None]
    return df.filter(reduce(lambda a, b: a & b, given)) if given else df


def latest(df: DataFrame, key: str, order: str, n: int = 1, offset: int = 0) -> DataFrame:
    """The n latest rows of each key after skipping `offset`."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))
    return df.withColumn("_rn", rn).filter(F.col("_rn").between(offset + 1, offset + n)).drop("_rn")


def latest_by_max(df: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key by a grouped maximum, which combines before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def count_when(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def batch_status(pending: Column, processing: Column, completed: Column, failed: Column) -> Column:
    """A batch's status from its tasks' counts."""
    total = pending + processing + completed + failed
    return (
        F.when(total == 0, "empty")
        .when(completed == total, "completed")
        .when(failed == total, "failed")
        .when((processing > 0) | ((pending > 0) & (completed + failed > 0)), "processing")
        .when(pending == total, "pending")
        .otherwise("partial")
    )


def page(df: DataFrame, *order, offset: int, limit: int) -> DataFrame:
    """One page of a listing; the order must end in a unique column."""
    return df.orderBy(*order).offset(offset).limit(limit)


def clamped(counter: Column, change: Column) -> Column:
    return F.greatest(F.lit(0), counter + change)


def fuzzy_price(models: DataFrame, prices: DataFrame) -> DataFrame:
    """The price of each model: equal names first, then either name a prefix of the other, first in the list.

    prices (price_model, price_order, ...) is a price list: it is broadcast, and refused if it has over 10 000 rows.
    """
    if prices.limit(10_001).count() > 10_000:
        raise ValueError("a price list has at most 10 000 models")
    near = (F.col("model") == F.col("price_model")) | F.col("model").startswith(F.col("price_model")) | F.col("price_model").startswith(F.col("model"))
    order = Window.partitionBy("model").orderBy((F.col("model") != F.col("price_model")).cast("int"), "price_order")
    return models.join(F.broadcast(prices), near, "left").withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def decimal_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage (model, input_tokens, output_tokens, cache_read_tokens, cache_write_tokens, ...) with cost, an exact decimal; 0 for a model without a price.

    prices (price_model, price_order, input, output, cache_read, cache_write) for a million tokens each, as decimals; points in a model's name count
    as dashes, letter case doesn't.
    """
    named = usage.withColumn("_model", F.replace(F.lower("model"), F.lit("."), F.lit("-")))
    priced = named.join(fuzzy_price(named.select(F.col("_model").alias("model")).distinct(), prices).withColumnRenamed("model", "_model"), "_model", "left")
    part = lambda n, price: F.coalesce(F.col(n).cast("decimal(18,0)") * F.col(price).cast("decimal(12,6)"), F.lit(0).cast("decimal(31,6)"))
    total = part("input_tokens", "input") + part("output_tokens", "output") + part("cache_read_tokens", "cache_read") + part("cache_write_tokens", "cache_write")
    cost = (total.cast("decimal(30,6)") * F.expr("cast(0.000001 as decimal(7,6))")).cast("decimal(30,12)")
    return priced.select(*usage.columns, cost.alias("cost"))
