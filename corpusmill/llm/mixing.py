"""Mixing sources to target weights by Sainte-Lague apportionment.

1. Every source has a size in words and a weight; the targets share `scale` times all words by
   weight, but stop at `cap` times the source's own size, the excess going to the others by weight.
2. The mix is laid out in blocks of `block` words.  The blocks go to the sources by the highest
   quotients target / (2k + 1) (Sainte-Lague), which gives each source an integer quota for each
   output shard; the method never takes a block back as the house grows, so a shard's quota is the
   difference of two apportionments.
3. A source's documents, in seeded order, form one stream of words, cut into blocks of the same
   length.  The source's blocks are ranked by a seeded hash.  The shards draw one after the other from that
   order, each as many blocks as its quota, beginning anew where it ends; so a shard has a block twice
   only if its quota is larger than the source.
4. What a shard takes of a document is the words of it that lie in the shard's blocks, repeats counted; `taken` sums
   the shards.
5. Where documents must stay whole (`whole_copies`), each has taken div size copies, and the words still
   owed are paid by one more copy of some: in order of size, those at which the running sum of the
   fractions owed passes a half.  A source's copies then hold the words taken to within its longest document
   (and a twentieth of one for each further `rows_per_run` documents of about one size).

Defined results: a null text has no words and is taken 0 times; a null source is one more source and comes
last; a null doc_id is one more id; rows that agree in doc_id and text are interchangeable; a text of any length is cut
into as many blocks as it has; an empty table gives an empty
result; extra columns are kept out of the result.

Tables of one row for each source (weights, targets, quotas) are ordered as a whole, in one task: sources are
data sets that someone weighs, some thousands at most.  Rows of documents and blocks never are: a source is dealt to
runs of its seeded order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, n_words, stored

#: The hash that orders documents and blocks has 60 bits.
SPAN = float(1 << 60)
#: Blocks that one row of the table of sources is unrolled to at a time.
CHUNK = 1 << 16
#: Sources up to this many are broadcast (about 100 bytes each), more are joined by a shuffle.
MAX_BROADCAST_SOURCES = 100_000
#: Runs up to this many (about 60 bytes each) are broadcast, more are joined by a shuffle.
MAX_BROADCAST_RUNS = 300_000


def seeded(seed: int, *parts: Column) -> Column:
    """60 bits that the seed and the parts determine, on any engine that has MD5; a null part is empty."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p, F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def cycle_weights(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """Adds weight: sources by code point, null last, weigh weights[0], weights[1], ... repeating."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int")))


def capped_targets(sources: DataFrame, scale_percent: int = 150, cap: int = 2) -> DataFrame:
    """Adds target to (source, source_size, weight).

    In order of cap / weight, sources fill up before those after them.  With the first i sources
    full, the rest share what is left by weight; the level holds at the first source whose share
    doesn't exceed its cap.
    """
    limit = F.col("source_size") * cap
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    total = F.sum("source_size").over(whole) * scale_percent / F.lit(100.0)
    level = (total - F.coalesce(F.sum("limit").over(before), F.lit(0))) / F.sum("weight").over(after)
    out = sources.withColumn("limit", limit).withColumn("level", level)
    out = out.withColumn("level", F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level")))
    # past the first source that holds, the level is the same; it is the least of those that hold
    out = out.withColumn("level", F.first("level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(F.col("level").isNull(), F.col("limit").cast("double")).otherwise(F.least(F.col("limit").cast("double"), F.col("level") * F.col("weight")))
    return out.withColumn("target", target).drop("limit", "level")


def sainte_lague(houses: DataFrame) -> DataFrame:
    """seats for each row of (house, seats_in_all, source, target): the highest quotients target / (2k + 1) of each house.

    A divisor method gives source i round(x * t_i) seats for some x, and over n sources x * T is
    within n / 2 of the house, so only the quotients that near to the exact share need ranking.
    """
    house = Window.partitionBy("house")
    exact = F.col("seats_in_all") * F.col("target") / F.sum("target").over(house)
    share = F.col("target") / F.sum("target").over(house)
    near = F.ceil(F.count(F.lit(1)).over(house) * share / 2).cast("long") + 1
    base = houses.filter(F.col("target") > 0).withColumn("exact", exact).withColumn("near", near)
    base = base.withColumn("base", F.greatest(F.lit(0).cast("long"), F.floor("exact") - F.col("near")))
    base = base.withColumn("open", F.col("seats_in_all") - F.sum("base").over(house))
    k = F.explode(F.sequence(F.col("base"), F.floor("exact") + F.col("near") + 1))
    ranked = base.select("*", k.alias("k")).withColumn("rank", F.row_number().over(house.orderBy((F.col("target") / (2 * F.col("k") + 1)).desc(), F.col("source").asc_nulls_last(), "k")))
    seats = F.max("base") + F.sum(F.when(F.col("rank") <= F.col("open"), 1).otherwise(0))
    return ranked.groupBy("house", "source").agg(seats.cast("long").alias("seats"))


def shard_quotas(targets: DataFrame, block: int, n_shards: int) -> DataFrame:
    """(source, shard, quota): blocks of each source in each output shard."""
    seats = F.floor(F.sum("target").over(Window.partitionBy()) / F.lit(block) + 0.5)
    houses = targets.select("source", "target", seats.alias("all"))  # the window first: a generator beside it would come before it
    houses = houses.withColumn("house", F.explode(F.sequence(F.lit(1), F.lit(n_shards))))
    houses = houses.withColumn("seats_in_all", F.floor(F.col("all") * F.col("house") / n_shards))
    grown = sainte_lague(houses)
    earlier = F.lag("seats", 1, 0).over(Window.partitionBy("source").orderBy("house"))
    return grown.select("source", (F.col("house") - 1).alias("shard"), (F.col("seats") - earlier).alias("quota"))


def ranked_in_runs(rows: DataFrame, key: str, order: str, runs: Column, value: Column, name: str, *ties: Column) -> DataFrame:
    """rows with `name`: the sum of value over the rows before, in the order of `order` and ties within the key.

    The order is a hash of SPAN values, so cutting it into `runs` equal stretches deals the rows of a large key evenly; sums of
    the stretches give each its start.  These are counted before the join, so that the rows aren't broadcast: Spark takes those that
    explode makes for as few as the rows they come from.
    """
    run, start, other = "_run", "_run_start", "_run_key"
    placed = rows.withColumn(run, F.floor(F.col(order) / F.lit(SPAN) * runs).cast("long"))
    before = Window.partitionBy(key).orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(key, run).agg(F.sum(value).alias("_sum"))
    sums = sums.select(F.col(key).alias(other), F.col(run).alias("_run_no"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias(start))
    sums = stored(sums, "mix-runs")
    small = bounded_broadcast(sums, MAX_BROADCAST_RUNS)
    placed = placed.join(sums.hint("merge") if small is sums else small, F.col(key).eqNullSafe(F.col(other)) & (F.col(run) == F.col("_run_no")))
    inside = Window.partitionBy(key, run).orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn(name, F.col(start) + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop(run, start, other, "_run_no", "_sum")


def block_shares(table: DataFrame, rows_per_run: int, seed: int) -> DataFrame:
    """(b_source, block_no, times): how often each shard takes each block, as an array by shard; blocks that none takes are left out.

    table holds source, n_blocks and ends: the quotas of the shards added up, one after the other.
    """
    chunks = table.filter("n_blocks > 0").select("source", "n_blocks", "ends", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_blocks") - 1) / CHUNK))).alias("chunk"))
    # by number, as few bytes make many blocks and Spark would put them together
    chunks = chunks.repartition(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source", "chunk")
    last = F.least((F.col("chunk") + 1) * CHUNK, F.col("n_blocks")) - 1
    blocks = chunks.select("source", "n_blocks", "ends", F.explode(F.sequence(F.col("chunk") * CHUNK, last)).alias("block_no"))
    blocks = blocks.withColumn("order", seeded(seed, F.col("source"), F.col("block_no").cast("string")))
    ranked = ranked_in_runs(blocks, "source", "order", F.ceil(F.col("n_blocks") / F.lit(rows_per_run)), F.lit(1), "rank", F.col("block_no"))
    # the places rank, rank + n, rank + 2 n ... below an end
    upto = lambda end: F.floor((end + F.col("n_blocks") - 1 - F.col("rank")) / F.col("n_blocks"))
    times = F.transform("ends", lambda end, i: upto(end) - F.when(i == 0, F.lit(0)).otherwise(upto(F.get("ends", i - 1))))
    return ranked.filter(F.col("rank") < F.element_at("ends", -1)).select(F.col("source").alias("b_source"), F.col("block_no").alias("b_block"), times.alias("times"))


def mix_shards(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), scale_percent: int = 150, cap: int = 2, block: int = 64, n_shards: int = 8, rows_per_run: int = 4_000, seed: int = 9) -> DataFrame:
    """doc_id, source, size, source_size, target, shard_words of every row of docs (doc_id, source, text).

    shard_words holds the words that each shard takes of the document, by shard.
    """
    order = seeded(seed, F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    light = stored(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), order.alias("order")), "mix-sizes")
    sources = light.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    targets = stored(capped_targets(cycle_weights(sources, weights), scale_percent, cap), "mix-targets")
    quota = shard_quotas(targets, block, n_shards).groupBy("source").agg(F.sort_array(F.collect_list(F.struct("shard", "quota"))).alias("quotas"))
    quota = quota.withColumnRenamed("source", "q_source")
    table = targets.join(quota, F.col("source").eqNullSafe(F.col("q_source")), "left")
    table = table.withColumn("n_blocks", F.ceil(F.col("source_size") / F.lit(block)))
    # no more than `cap` times the source's blocks, however its last block rounds
    none = F.array(*[F.lit(0).cast("long")] * n_shards)
    grown = F.transform("quotas", lambda q, i: F.least(F.col("n_blocks") * cap, F.aggregate(F.slice("quotas", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, x: a + x["quota"])))
    table = stored(table.select("source", "source_rows", "source_size", "target", "n_blocks", F.coalesce(grown, none).alias("ends")), "mix-quotas")
    named = table.select(F.col("source").alias("t_source"), "source_rows", "source_size", "target")
    placed = light.join(bounded_broadcast(named, MAX_BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    placed = ranked_in_runs(placed, "source", "order", F.ceil(F.col("source_rows") / F.lit(rows_per_run)), F.col("size"), "start", F.col("doc_id").asc_nulls_last(), F.col("size"))
    placed = stored(placed.select("doc_id", "source", "size", "source_size", "target", "start", F.xxhash64("doc_id", "source", "order", "start").alias("row")), "mix-places")
    shares = block_shares(table, 10 * rows_per_run, seed + 1)
    end = F.col("start") + F.col("size")
    pieces = placed.filter("size > 0").select("source", "start", "row", end.alias("end"), F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))).alias("block_no"))
    words = F.least("end", (F.col("block_no") + 1) * block) - F.greatest("start", F.col("block_no") * block)
    # both sides are made by explode, whose rows Spark takes for few: neither may be broadcast
    met = pieces.withColumn("words", words).join(shares.hint("merge"), F.col("source").eqNullSafe(F.col("b_source")) & (F.col("block_no") == F.col("b_block")))
    sums = F.array(*[F.sum(F.col("words") * F.get("times", F.lit(i))) for i in range(n_shards)])
    # a row's place in its source's stream names it
    taken = met.groupBy(F.col("source").alias("m_source"), F.col("start").alias("m_start"), F.col("row").alias("m_row")).agg(sums.alias("shard_words"))
    same = F.col("source").eqNullSafe(F.col("m_source")) & (F.col("start") == F.col("m_start")) & (F.col("row") == F.col("m_row")) & (F.col("size") > 0)
    out = placed.join(taken, same, "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("shard_words", none).alias("shard_words"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (the words that the mix takes, repeats counted), shard_words."""
    out = mix_shards(docs, **how)
    taken = F.aggregate("shard_words", F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "shard_words")


def whole_copies(taken: DataFrame, rows_per_run: int = 20_000, seed: int = 9) -> DataFrame:
    """Adds copies to rows (doc_id, source, size, taken): how often each whole document is to be given, so that sources keep their words."""
    one = 1 << 32
    order = seeded(seed + 2, F.col("doc_id").cast("string"), F.col("size").cast("string"))
    some = F.greatest("size", F.lit(1))
    light = taken.withColumns({"order": order, "like": F.floor(F.log2(some) * 8), "owed": F.floor(F.pmod("taken", some) * F.lit(one) / some).cast("long")})
    # documents of about one size, dealt to runs by seeded order where they are many
    many = light.groupBy("source", "like").agg(F.count(F.lit(1)).alias("n")).select(F.col("source").alias("m_source"), F.col("like").alias("m_like"), F.ceil(F.col("n") / F.lit(rows_per_run)).alias("runs"))
    placed = light.join(many, F.col("source").eqNullSafe(F.col("m_source")) & (F.col("like") == F.col("m_like")))
    placed = stored(placed.withColumn("run", F.floor(F.col("order") / F.lit(float(1 << 60)) * F.col("runs")).cast("long")).drop("m_source", "m_like", "runs"), "mix-owed")
    before = Window.partitionBy("source").orderBy("like", "run").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("source", "like", "run").agg(F.sum("owed").alias("run_owed"))
    sums = sums.select(F.col("source").alias("r_source"), F.col("like").alias("r_like"), F.col("run").alias("r_run"), F.coalesce(F.sum("run_owed").over(before), F.lit(0)).alias("run_start"))
    placed = placed.join(sums, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("like") == F.col("r_like")) & (F.col("run") == F.col("r_run")))
    inside = Window.partitionBy("source", "like", "run").orderBy("size", "order", F.col("doc_id").asc_nulls_last(), "taken").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("run_start") + F.coalesce(F.sum("owed").over(inside), F.lit(0)) + one // 2
    placed = placed.withColumn("start", start)
    paid = F.shiftright(F.col("start") + F.col("owed"), 32) - F.shiftright("start", 32)
    return placed.select(*taken.columns, (F.floor(F.col("taken") / some) + paid).cast("int").alias("copies"))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", F.array_join(F.col("shard_words").cast("array<string>"), ",").alias("shard_words"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)] AS weight, 2 * source_size AS lim FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 150 / 100 - coalesce(sum(lim) OVER (ORDER BY lim / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
  / (sum(weight) OVER (ORDER BY lim / weight::DOUBLE, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w),
m AS (SELECT *, first_value(CASE WHEN level * weight <= lim THEN level END IGNORE NULLS) OVER (ORDER BY lim / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lev FROM l),
t AS (SELECT source, source_size, CASE WHEN lev IS NULL THEN lim::DOUBLE ELSE least(lim::DOUBLE, lev * weight) END AS target FROM m),
e AS (SELECT *, floor(floor(sum(target) OVER (PARTITION BY house) / 64 + 0.5) * house / 8)::BIGINT AS seats FROM t, (SELECT unnest(range(1, 9)) AS house)),
x AS (SELECT *, seats * target / sum(target) OVER h AS exact, ceil(count(*) OVER h * (target / sum(target) OVER h) / 2)::BIGINT + 1 AS near FROM e WHERE target > 0 WINDOW h AS (PARTITION BY house)),
b AS (SELECT *, greatest(0, floor(exact)::BIGINT - near) AS base FROM x),
c AS (SELECT *, unnest(range(base, floor(exact)::BIGINT + near + 2)) AS k FROM (SELECT *, seats - sum(base) OVER (PARTITION BY house) AS open FROM b)),
r AS (SELECT *, row_number() OVER (PARTITION BY house ORDER BY target / (2 * k + 1) DESC, source NULLS LAST, k) AS rank FROM c),
q AS (SELECT source, house, max(base) + count(*) FILTER (rank <= open) AS grown FROM r GROUP BY source, house),
n AS (SELECT t.source, house, source_size, target, ceil(source_size / 64.0)::BIGINT AS n_blocks, least(coalesce(grown, 0), 2 * ceil(source_size / 64.0)::BIGINT) AS stop
  FROM t CROSS JOIN (SELECT unnest(range(1, 9)) AS house) LEFT JOIN q USING (house) WHERE q.source IS NOT DISTINCT FROM t.source),
y AS (SELECT *, coalesce(lag(stop) OVER (PARTITION BY source ORDER BY house), 0) AS begin FROM n),
z AS (SELECT source, n_blocks, unnest(range(n_blocks)) AS j FROM n WHERE house = 1),
k AS (SELECT source, j, row_number() OVER (PARTITION BY source ORDER BY ('0x' || substr(md5('10|' || coalesce(source, '') || '|' || j), 1, 15))::BIGINT, j) - 1 AS rank FROM z),
u AS (SELECT k.source, k.j, y.house, (stop + n_blocks - 1 - rank) // n_blocks - (begin + n_blocks - 1 - rank) // n_blocks AS times FROM k JOIN y ON k.source IS NOT DISTINCT FROM y.source),
p AS (SELECT *, row_number() OVER () AS id, coalesce(sum(size) OVER (PARTITION BY source ORDER BY ('0x' || substr(md5('9|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d),
o AS (SELECT id, source, start, start + size AS stop, unnest(range(start // 64, (start + size - 1) // 64 + 1)) AS j FROM p WHERE size > 0),
g AS (SELECT id, house, sum((least(o.stop, (o.j + 1) * 64) - greatest(o.start, o.j * 64)) * times)::BIGINT AS words FROM o JOIN u ON o.source IS NOT DISTINCT FROM u.source AND o.j = u.j GROUP BY id, house),
f AS (SELECT id, sum(words)::BIGINT AS taken, string_agg(words::VARCHAR, ',' ORDER BY house) AS shard_words FROM g GROUP BY id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, coalesce(shard_words, '0,0,0,0,0,0,0,0') AS shard_words
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source LEFT JOIN f USING (id)
"""
