"""Ordered sequences under budgets: conversations, timelines, frames, tool calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_recent(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return df.withColumn("_rn", rn).filter(F.col("_rn") <= n).drop("_rn")


def truncate_to_budget(df: DataFrame, key: str, order: str, cost: str, budget: int) -> DataFrame:
    """The longest tail of each sequence within the budget, one row at least."""
    back = Window.partitionBy(key).orderBy(F.desc(order))
    out = df.withColumn("_sum", F.sum(cost).over(back.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_rn", F.row_number().over(back))
    return out.filter((F.col("_sum") <= budget) | (F.col("_rn") == 1)).drop("_sum", "_rn")


def compress_session(df: DataFrame, key: str, order: str, cost: str, threshold: int, keep: int) -> DataFrame:
    """Sequences within the threshold as they are, others their last `keep` rows."""
    total = F.sum(cost).over(Window.partitionBy(key))
    rn = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return df.withColumn("_total", total).withColumn("_rn", rn).filter((F.col("_total") <= threshold) | (F.col("_rn") <= keep)).drop("_total", "_rn")


def newest_of_equal(df: DataFrame, key: str, order: str, text: str, least: int = 200) -> DataFrame:
    """Replaces all but the newest of equal long texts of a sequence by a mark."""
    rn = F.row_number().over(Window.partitionBy(key, F.md5(text)).orderBy(F.desc(order)))
    old = (F.length(text) >= least) & (F.col("_rn") > 1)
    return df.withColumn("_rn", rn).withColumn(text, F.when(old, F.concat(F.lit("[same as a later output "), F.substring(F.md5(text), 1, 12), F.lit("]"))).otherwise(F.col(text))).drop("_rn")


def loops(calls: DataFrame, key: str, order: str, signature: Column, warn: int = 3, stop: int = 5, window: int = 20) -> DataFrame:
    """n_same, verdict: how often a call's signature is among the run's last `window` calls; the warning comes once."""
    last = Window.partitionBy(key).orderBy(order).rowsBetween(-(window - 1), 0)
    out = calls.withColumn("signature", signature).withColumn("_last", F.collect_list("signature").over(last))
    out = out.withColumn("n_same", F.size(F.filter("_last", lambda x: x == F.col("signature")))).drop("_last")
    warned = F.sum((F.col("n_same") >= warn).cast("int")).over(Window.partitionBy(key, "signature").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("verdict", F.when(F.col("n_same") >= stop, "stop").when((F.col("n_same") >= warn) & (warned == 1), "warning"))


def pair_calls(calls: DataFrame, results: DataFrame, key: str, tool: str, order: str) -> DataFrame:
    """The k-th call of a tool takes the k-th result's id of that tool, else call_{id}."""
    k = F.row_number().over(Window.partitionBy(key, tool).orderBy(order))
    a = calls.withColumn("_k", k)
    b = results.withColumn("_k", k).select(key, tool, "_k", F.col("result_id"))
    return a.join(b, [key, tool, "_k"], "left").withColumn("call_id", F.coalesce("result_id", F.concat(F.lit("call_"), F.col("id").cast("string")))).drop("_k")


def timeline(frames: DataFrame, key: str) -> DataFrame:
    """Each frame's end is the next frame's start; the last has none."""
    return frames.withColumn("end", F.lead("start").over(Window.partitionBy(key).orderBy("start", "idx")))


def align_chunks(chunks: DataFrame, line: DataFrame, indices: Column) -> DataFrame:
    """start, end, frame_indices of chunks (key, chunk_id, ...) whose text has anchors of frames; unknown frames are ignored."""
    each = chunks.select("key", "chunk_id", F.explode(indices).alias("idx"))
    found = each.join(line, ["key", "idx"]).groupBy("key", "chunk_id").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_set("idx")).alias("frame_indices"))
    return chunks.join(found, ["key", "chunk_id"], "left")


def chi_square(a: Column, b: Column) -> Column:
    """Distance of two histograms over the bins that either fills; 0 if there are none."""
    parts = F.filter(F.zip_with(a, b, lambda x, y: F.when(x + y > 0, (x - y) * (x - y) / (x + y))), lambda v: v.isNotNull())
    total = F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(total / F.nullif(F.size(parts), F.lit(0)), F.lit(0.0))


def keyframes(distances: Column, threshold: float, min_interval: int, max_frames: int) -> Column:
    """Indices of scene changes: the first frame, then frames whose distance to the one before reaches the threshold, min_interval or more after the last one taken."""
    start = F.array(F.lit(0))
    step = lambda acc, x: F.when((x["d"] >= threshold) & (x["i"] - F.element_at(acc, -1) >= min_interval), F.concat(acc, F.array(x["i"]))).otherwise(acc)
    taken = F.aggregate(F.transform(distances, lambda d, i: F.struct(d.alias("d"), (i + 1).cast("int").alias("i"))), start, step)
    return uniform(taken, max_frames)


def uniform(items: Column, most: int) -> Column:
    """`most` items spread evenly, or all."""
    n = F.size(items)
    picked = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.get(items, F.floor(k * n / most).cast("int")))
    return F.when(n <= most, items).otherwise(picked)


def ordered_dedupe(hits: DataFrame, session: str, order: str, keys: list[str]) -> DataFrame:
    """Drops a hit if any of its keys was seen on a kept hit of its session before.

    Sessions are sorted by `order` within partitions and folded batch by batch with a set of the keys seen, so a session is never
    gathered whole.  Null and blank keys are none.
    """
    given = [F.when(F.coalesce(F.trim(F.col(k).cast("string")), F.lit("")) != "", F.concat(F.lit(f"{k}:"), F.col(k).cast("string"))) for k in keys]
    rows = hits.withColumn("_keys", F.filter(F.array(*given), lambda x: x.isNotNull()))

    def fold(batches):
        import pyarrow as pa

        now, seen = (), set()
        for batch in batches:
            kept = []
            for own, found in zip(batch.column(session).to_pylist(), batch.column("_keys").to_pylist(), strict=True):
                if (own,) != now:
                    now, seen = (own,), set()
                kept.append(seen.isdisjoint(found))
                if kept[-1]:
                    seen.update(found)
            yield batch.filter(pa.array(kept, pa.bool_()))

    return rows.repartition(session).sortWithinPartitions(session, order).mapInArrow(fold, rows.schema).drop("_keys")


def tail_cut(messages: DataFrame, key: str, order: str, budget: int, least: int = 3) -> DataFrame:
    """(key, cut, n) of messages (key, order, role, cost, calls_tools): the position from which on messages are protected.

    From the end, messages are taken while their cost stays within one and a half budgets; the last `least` (all but one, if there are
    fewer) are taken anyway, and so is the last user message.  Results of tools aren't parted from the call before them.
    The first message is never in the tail, unless it's the only one.
    """
    each = Window.partitionBy(key)
    x = messages.withColumns({"_pos": F.row_number().over(each.orderBy(order)) - 1, "_n": F.count(F.lit(1)).over(each)})
    x = x.withColumn("_sum", F.sum("cost").over(each.orderBy(F.desc("_pos")).rowsBetween(Window.unboundedPreceding, 0)))
    fewest = F.least(F.lit(least), F.col("_n") - 1)
    over = (F.col("_sum") > int(budget * 1.5)) & (F.col("_n") - F.col("_pos") >= fewest) & (F.col("_pos") >= 1)
    user = F.max(F.when((F.col("role") == "user") & (F.col("_pos") >= 1), F.col("_pos"))).over(each)
    start = F.when(F.col("_n") == 1, F.lit(1)).otherwise(F.coalesce(F.max(F.when(over, F.col("_pos") + 1)).over(each), F.lit(1)))
    x = x.withColumns({"_user": user, "_cut": F.least(start, F.col("_n") - fewest)})
    x = x.withColumn("_cut", F.when(F.col("_user") < F.col("_cut"), F.col("_user")).otherwise(F.col("_cut")))
    # the last message before the cut that isn't a tool's result, and whether it is the call
    head = (F.col("_pos") >= 1) & (F.col("_pos") < F.col("_cut")) & (F.col("role") != "tool")
    ends = x.groupBy(key).agg(F.max("_cut").alias("cut"), F.max("_n").alias("n"), F.max(F.when(head, F.struct("_pos", "calls_tools"))).alias("h"))
    inner = F.coalesce(F.col("h._pos") + 1 - F.when(F.col("h.calls_tools"), 1).otherwise(0), F.lit(1))
    aligned = F.when((F.col("cut") > 1) & (F.col("cut") < F.col("n")), F.greatest(F.least(inner, F.col("cut")), F.lit(1))).otherwise(F.col("cut"))
    return ends.select(key, aligned.cast("int").alias("cut"), "n")


def without_like_frames(frames: DataFrame, key: str, order: str, similarity: float) -> DataFrame:
    """(key, order, new_idx) of frames (key, order, hist): those whose histogram differs from the last one kept; a null histogram is kept and compares with none.

    A video's histograms are gathered in one array, sorted, and folded there.
    """
    h = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("hist").alias("h"))))
    fields = dict(frames.dtypes)
    start = F.struct(F.array().cast(f"array<{fields[order]}>").alias("kept"), F.lit(None).cast(fields["hist"]).alias("last"))

    def step(acc, x):
        alike = x["h"].isNotNull() & acc["last"].isNotNull() & (chi_square(acc["last"], x["h"]) <= F.lit(1.0 - similarity))
        return F.struct(F.when(alike, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(x["o"]))).alias("kept"), F.when(alike, acc["last"]).otherwise(F.coalesce(x["h"], acc["last"])).alias("last"))

    kept = frames.groupBy(key).agg(F.aggregate(h, start, step, lambda acc: acc["kept"]).alias("kept"))
    return kept.select(key, F.posexplode("kept").alias("new_idx", order))
