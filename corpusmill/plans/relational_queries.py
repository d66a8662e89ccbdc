"""Relational statistics over the star schema: orders stand for documents, line items for tasks, customers for members."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import resume
from ..operators import statistics as st

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def take(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return take


def t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


# filters and projections


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice IS NOT NULL")
def flt_equality(spark, d):
    return t(spark, d, "orders").filter((F.col("o_orderstatus") == "F") & F.col("o_totalprice").isNotNull()).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (1, 3, 5, 7)")
def flt_in_list(spark, d):
    return t(spark, d, "customer").filter(F.col("c_nationkey").isin(1, 3, 5, 7)).select("c_custkey", "c_name")


@query("SELECT event_id, user_id, event_type, value FROM events WHERE event_type = (SELECT min(event_type) FROM events) AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'")
def flt_optional(spark, d):
    """Type and time range given, user not."""
    e = t(spark, d, "events")
    kind = e.agg(F.min("event_type").alias("k"))
    rows = st.where_given(e, user=None, since=F.col("ts") >= F.lit("2024-01-05").cast("timestamp"), until=F.col("ts") < F.lit("2024-01-20").cast("timestamp"))
    return rows.join(F.broadcast(kind), F.col("event_type") == F.col("k")).select("event_id", "user_id", "event_type", "value")


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events WHERE json_extract(props, '$.k')::BIGINT = 3")
def flt_json_path(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return t(spark, d, "events").select("event_id", k.alias("k")).filter("k = 3")


@query("SELECT doc_id FROM documents WHERE list_contains([lang, source], 'src3')")
def flt_tag_contains(spark, d):
    """A JSON list of tags that holds one."""
    tags = F.to_json(F.array("lang", "source"))
    return t(spark, d, "documents").withColumn("tags", tags).filter(F.array_contains(F.from_json("tags", "array<string>"), "src3")).select("doc_id")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus IS NULL OR o_orderstatus = 'O' GROUP BY c_custkey")
def flt_null_or_equals(spark, d):
    j = t(spark, d, "customer").join(t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.filter(F.col("o_orderstatus").isNull() | (F.col("o_orderstatus") == "O")).groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("SELECT event_id, event_type, value FROM events WHERE event_type <> (SELECT min(event_type) FROM events) OR value >= 50")
def flt_threshold_kind(spark, d):
    """A threshold that only one kind of row must meet."""
    e = t(spark, d, "events")
    kind = e.agg(F.min("event_type").alias("k"))
    return e.join(F.broadcast(kind)).filter((F.col("event_type") != F.col("k")) | (F.coalesce("value", F.lit(0.0)) >= 50)).select("event_id", "event_type", "value")


@query("SELECT event_id FROM events WHERE (event_id % 2 = 0 AND ts < TIMESTAMP '2024-01-10') OR (event_id % 2 = 1 AND ts < TIMESTAMP '2024-01-05')")
def flt_timeouts(spark, d):
    """Two kinds of rows with a cut-off each."""
    at = lambda x: F.lit(x).cast("timestamp")
    even = F.col("event_id") % 2 == 0
    return t(spark, d, "events").filter((even & (F.col("ts") < at("2024-01-10"))) | (~even & (F.col("ts") < at("2024-01-05")))).select("event_id")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber >= 3 THEN 'failed' ELSE 'requeued' END AS next FROM lineitem WHERE l_returnflag = 'R'")
def flt_retry(spark, d):
    """Rows in progress go back to the queue until their tries are used up."""
    rows = t(spark, d, "lineitem").filter("l_returnflag = 'R'")
    return rows.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") >= 3, "failed").otherwise("requeued").alias("next"))


@query("SELECT doc_id, text AS content, source AS kb_id, {'lang': lang, 'n_chars': n_chars}.lang AS lang FROM documents")
def flt_enrich(spark, d):
    """A nested hit as a flat result."""
    hit = t(spark, d, "documents").select("doc_id", F.struct(F.col("text").alias("content"), F.col("source").alias("kb_id"), F.struct("lang", "n_chars").alias("metadata")).alias("s"))
    return hit.select("doc_id", "s.content", "s.kb_id", "s.metadata.lang")


@query("SELECT c_custkey, greatest(0, c_nationkey - 10) AS counter FROM customer")
def flt_clamped(spark, d):
    return t(spark, d, "customer").select("c_custkey", st.clamped(F.col("c_nationkey"), F.lit(-10)).alias("counter"))


@query("SELECT doc_id, substr(sha256(text), 1, 48) || '_del_' || doc_id AS file_hash FROM documents")
def flt_deleted_hash(spark, d):
    return t(spark, d, "documents").select("doc_id", F.concat(F.substring(F.sha2("text", 256), 1, 48), F.lit("_del_"), F.col("doc_id").cast("string")).alias("file_hash"))


@query(
    """WITH u AS (SELECT user_id, CASE user_id % 4 WHEN 0 THEN 'mini' WHEN 1 THEN 'large-2024' WHEN 2 THEN 'lar' ELSE 'other' END AS model, count(*) AS input_tokens, sum(json_extract(props, '$.k')::BIGINT) AS output_tokens FROM events GROUP BY ALL),
p AS (SELECT * FROM (VALUES ('mini', 0, 0.15::DECIMAL(12,6), 0.6::DECIMAL(12,6)), ('large', 1, 2.5::DECIMAL(12,6), 10::DECIMAL(12,6))) AS x(price_model, o, pi, po)),
m AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (model <> price_model)::INT, o) AS rn FROM u LEFT JOIN p ON model = price_model OR starts_with(model, price_model) OR starts_with(price_model, model))
SELECT user_id, model, round(coalesce(input_tokens * pi::DOUBLE + output_tokens * po::DOUBLE, 0) / 1000000, 8) AS cost FROM m WHERE rn = 1"""
)
def flt_cost(spark, d):
    """Cost of each user's usage by a short price list, names matched fuzzily."""
    k = F.get_json_object("props", "$.k").cast("long")
    model = F.when(F.col("user_id") % 4 == 0, "mini").when(F.col("user_id") % 4 == 1, "large-2024").when(F.col("user_id") % 4 == 2, "lar").otherwise("other")
    u = t(spark, d, "events").groupBy("user_id", model.alias("model")).agg(F.count(F.lit(1)).alias("input_tokens"), F.sum(k).alias("output_tokens"))
    prices = spark.createDataFrame([("mini", 0, 0.15, 0.6), ("large", 1, 2.5, 10.0)], "price_model string, price_order int, pi double, po double")
    priced = u.join(st.fuzzy_price(u.select("model").distinct(), prices), "model")
    cost = F.coalesce(F.col("input_tokens") * F.col("pi") + F.col("output_tokens") * F.col("po"), F.lit(0.0)) / 1_000_000
    return priced.select("user_id", "model", F.round(cost, 8).alias("cost"))


@query(
    """WITH u AS (SELECT event_id, (event_id * 37) % 5000 AS i, (event_id * 11) % 900 AS o, event_id % 70 AS r, CASE event_id % 5 WHEN 0 THEN 'GPT-4.1-mini' WHEN 1 THEN 'qwen-max' WHEN 2 THEN 'qwen' WHEN 3 THEN 'other' ELSE 'GPT-4.1' END AS model FROM events)
SELECT event_id, (CASE event_id % 5 WHEN 3 THEN 0 WHEN 1 THEN i * 240000 + o * 960000 WHEN 2 THEN i * 40000 + o * 120000 ELSE i * 200000 + o * 800000 + r * 50000 END::BIGINT // 100000 || '.' || lpad((CASE event_id % 5 WHEN 3 THEN 0 WHEN 1 THEN i * 240000 + o * 960000 WHEN 2 THEN i * 40000 + o * 120000 ELSE i * 200000 + o * 800000 + r * 50000 END::BIGINT % 100000)::VARCHAR, 5, '0')) AS millionths FROM u"""
)
def flt_decimal_cost(spark, d):
    """Costs of calls as exact decimals, here in millionths: equal names, or one the beginning of the other, first in the list."""
    k = F.col("event_id")
    model = F.when(k % 5 == 0, "GPT-4.1-mini").when(k % 5 == 1, "qwen-max").when(k % 5 == 2, "qwen").when(k % 5 == 3, "other").otherwise("GPT-4.1")
    usage = t(spark, d, "events").select("event_id", model.alias("model"), (k * 37 % 5000).alias("input_tokens"), (k * 11 % 900).alias("output_tokens"), (k % 70).alias("cache_read_tokens"), F.lit(None).cast("long").alias("cache_write_tokens"))
    prices = [("gpt-4-1", 0, "2", "8", "0.5", "0"), ("qwen-plus", 1, "0.4", "1.2", "0", "0"), ("qwen-max", 2, "2.4", "9.6", "0", "0")]
    table = spark.createDataFrame(prices, "price_model string, price_order int, input string, output string, cache_read string, cache_write string")
    table = table.select("price_model", "price_order", *[F.col(c).cast("decimal(12,6)").alias(c) for c in ("input", "output", "cache_read", "cache_write")])
    cost = st.decimal_cost(usage, table)
    return cost.select("event_id", (F.col("cost") * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(30,5)").cast("string").alias("millionths"))


# joins


@query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def jn_inner(spark, d):
    return t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, max(o_orderkey) AS last_order FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def jn_left(spark, d):
    last = t(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("last_order"))
    return t(spark, d, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "last_order")


@query(
    """WITH f AS (SELECT conv_id, arg_min(substr(text, 1, 30), turn) AS title FROM conversations WHERE role = 'user' GROUP BY conv_id), l AS (SELECT conv_id, max(turn) AS last_turn FROM conversations GROUP BY conv_id), s AS (SELECT DISTINCT conv_id FROM conversations)
SELECT s.conv_id, title, last_turn FROM s LEFT JOIN f USING (conv_id) JOIN l USING (conv_id)"""
)
def jn_sessions(spark, d):
    """Sessions with their first user message and last turn."""
    c = t(spark, d, "conversations")
    title = F.min_by(F.when(F.col("role") == "user", F.substring("text", 1, 30)), F.when(F.col("role") == "user", F.col("turn")))
    return c.groupBy("conv_id").agg(title.alias("title"), F.max("turn").alias("last_turn"))


@query("SELECT o_orderkey FROM orders WHERE (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) > 0")
def jn_has_child(spark, d):
    return t(spark, d, "orders").join(t(spark, d, "lineitem").filter("l_quantity > 45"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 5)")
def jn_in_subquery(spark, d):
    return t(spark, d, "orders").join(t(spark, d, "customer").filter("c_nationkey = 5"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def jn_pending(spark, d):
    """Rows without any task: customers without a large order."""
    return t(spark, d, "customer").join(t(spark, d, "orders").filter("o_totalprice > 450000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT l_orderkey, l_linenumber, s_name FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey")
def jn_lookup(spark, d):
    """Names from an id map."""
    return t(spark, d, "lineitem").join(t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left").select("l_orderkey", "l_linenumber", "s_name")


@query(
    """WITH w AS (SELECT l_orderkey AS person, l_linenumber AS id, 'company ' || l_partkey % 40 AS a, 'Company ' || l_suppkey % 7 AS b FROM lineitem),
m AS (SELECT p.person, p.id AS project_id, min(w.id) AS work_id FROM w p JOIN w ON p.person = w.person AND (contains(lower(p.b), w.a) OR contains(w.a, lower(p.b))) GROUP BY ALL)
SELECT DISTINCT w.person, id AS project_id, work_id FROM w LEFT JOIN m ON w.person = m.person AND w.id = m.project_id"""
)
def jn_substring_first(spark, d):
    """Each project's first work whose company's name holds the project's or is held by it; null for none."""
    x = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("person"), F.col("l_linenumber").alias("id"), F.concat(F.lit("company "), F.col("l_partkey") % 40).alias("a"), F.concat(F.lit("Company "), F.col("l_suppkey") % 7).alias("b"))
    projects = x.select("person", F.col("id").alias("project_id"), F.col("b").alias("company"))
    return resume.match_projects(x.select("person", F.col("id").alias("work_id"), F.col("a").alias("company")), projects).distinct()


@query(
    """WITH b AS (SELECT l_orderkey AS page, l_linenumber AS id, l_quantity AS x0, l_quantity + 10 AS x1 FROM lineitem)
SELECT a.page, a.id AS left_id, c.id AS right_id, least(a.x1, c.x1) - greatest(a.x0, c.x0) AS overlap FROM b a JOIN b c ON a.page = c.page AND a.id < c.id AND a.x0 < c.x1 AND c.x0 < a.x1"""
)
def jn_overlap(spark, d):
    """Boxes of a page that overlap: a range join within an equal key."""
    b = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("id"), F.col("l_quantity").alias("x0"), (F.col("l_quantity") + 10).alias("x1"))
    a, c = b.alias("a"), b.alias("c")
    on = (F.col("a.page") == F.col("c.page")) & (F.col("a.id") < F.col("c.id")) & (F.col("a.x0") < F.col("c.x1")) & (F.col("c.x0") < F.col("a.x1"))
    return a.join(c, on).select("a.page", F.col("a.id").alias("left_id"), F.col("c.id").alias("right_id"), (F.least("a.x1", "c.x1") - F.greatest("a.x0", "c.x0")).alias("overlap"))


@query(
    """WITH b AS (SELECT l_orderkey AS page, l_linenumber AS id, l_quantity AS x, l_returnflag AS kind FROM lineitem)
SELECT page, id, near FROM (SELECT a.page, a.id, c.id AS near, row_number() OVER (PARTITION BY a.page, a.id ORDER BY (a.x - c.x) * (a.x - c.x), c.id) AS rn FROM b a JOIN b c ON a.page = c.page WHERE a.kind = 'N' AND c.kind <> 'N') WHERE rn = 1"""
)
def jn_nearest(spark, d):
    """The nearest figure of each caption on its page."""
    b = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("id"), F.col("l_quantity").alias("x"), F.col("l_returnflag").alias("kind"))
    a, c = b.filter("kind = 'N'"), b.filter("kind <> 'N'").select("page", F.col("id").alias("near"), F.col("x").alias("cx"))
    far = F.pow(F.col("x") - F.col("cx"), 2)
    return a.join(c, "page").groupBy("page", "id").agg(F.min(F.struct(far.alias("d"), "near"))["near"].alias("near"))


@query(
    """WITH c AS (SELECT conv_id, turn, role FROM conversations), a AS (SELECT conv_id, turn FROM c WHERE role = 'assistant'), u AS (SELECT conv_id, turn FROM c WHERE role = 'user')
SELECT a.conv_id, a.turn, 'orphan' AS kind FROM a LEFT JOIN u ON a.conv_id = u.conv_id AND u.turn = a.turn - 1 WHERE u.turn IS NULL
UNION ALL SELECT u.conv_id, u.turn + 1, 'stub' FROM u LEFT JOIN a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE a.turn IS NULL"""
)
def jn_pairing(spark, d):
    """Results without a call, and stubs for calls without a result."""
    c = t(spark, d, "conversations").select("conv_id", "turn", "role")
    a, u = c.filter("role = 'assistant'").drop("role"), c.filter("role = 'user'").withColumn("turn", F.col("turn") + 1).drop("role")
    orphan = a.join(u, ["conv_id", "turn"], "left_anti").withColumn("kind", F.lit("orphan"))
    return orphan.unionByName(u.join(a, ["conv_id", "turn"], "left_anti").withColumn("kind", F.lit("stub")))


# aggregates


@query("SELECT count(*) AS n, coalesce(sum(o_totalprice), 0) AS total, coalesce(avg(o_totalprice), 0) AS mean FROM orders WHERE o_orderkey < 0")
def ag_empty(spark, d):
    """Nothing counted: sums are 0, not null."""
    o = t(spark, d, "orders").filter("o_orderkey < 0")
    return o.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("o_totalprice"), F.lit(0.0)).alias("total"), F.coalesce(F.avg("o_totalprice"), F.lit(0.0)).alias("mean"))


@query("SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' GROUP BY event_type")
def ag_by_action(spark, d):
    at = lambda x: F.lit(x).cast("timestamp")
    return t(spark, d, "events").filter((F.col("ts") >= at("2024-01-10")) & (F.col("ts") < at("2024-01-20"))).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


_KB = """WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_quantity DESC, l_returnflag DESC) AS rn FROM lineitem {where}) WHERE rn = 1)
SELECT o_custkey AS kb_id, count(*) AS n_docs, coalesce(sum(l_quantity), 0) AS n_chunks, round(sum(o_totalprice) / 1048576, 2) AS mb,
  sum(CASE WHEN l_returnflag IS NULL THEN 1 ELSE 0 END) AS pending, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS completed, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS failed, sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS processing
FROM orders LEFT JOIN l ON o_orderkey = l_orderkey GROUP BY o_custkey"""


def _kb(spark, d, tasks):
    order = F.struct("l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    last = st.latest_by_max(tasks.select("l_orderkey", "l_quantity", "l_returnflag", order.alias("task_id")), "l_orderkey", "task_id")
    j = t(spark, d, "orders").join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    flag = F.col("l_returnflag")
    return j.groupBy(F.col("o_custkey").alias("kb_id")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("l_quantity"), F.lit(0)).alias("n_chunks"), F.round(F.sum("o_totalprice") / 1048576, 2).alias("mb"),
        st.count_when(flag.isNull()).alias("pending"), st.count_when(flag == "A").alias("completed"), st.count_when(flag == "R").alias("failed"), st.count_when(flag == "N").alias("processing"),
    )


@query(_KB.format(where=""))
def ag_kb_statistics(spark, d):
    """Statistics of each knowledge base over its documents' latest tasks."""
    return _kb(spark, d, t(spark, d, "lineitem"))


@query(_KB.format(where="WHERE l_returnflag = 'A'"))
def ag_space_statistics(spark, d):
    """The same over the latest completed tasks."""
    return _kb(spark, d, t(spark, d, "lineitem").filter("l_returnflag = 'A'"))


@query(
    """WITH c AS (SELECT l_orderkey AS batch, count(*) FILTER (l_linestatus = 'O' AND l_returnflag = 'N') AS pending, count(*) FILTER (l_linestatus = 'F' AND l_returnflag = 'N') AS processing, count(*) FILTER (l_returnflag = 'A') AS completed, count(*) FILTER (l_returnflag = 'R') AS failed FROM lineitem GROUP BY l_orderkey)
SELECT *, CASE WHEN completed = pending + processing + completed + failed THEN 'completed' WHEN failed = pending + processing + completed + failed THEN 'failed' WHEN processing > 0 OR (pending > 0 AND completed + failed > 0) THEN 'processing' WHEN pending = pending + processing + completed + failed THEN 'pending' ELSE 'partial' END AS status FROM c"""
)
def ag_batch_status(spark, d):
    """Tasks of a batch by state, and the batch's own state."""
    r, s = F.col("l_returnflag"), F.col("l_linestatus")
    c = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("batch")).agg(
        st.count_when((s == "O") & (r == "N")).alias("pending"), st.count_when((s == "F") & (r == "N")).alias("processing"), st.count_when(r == "A").alias("completed"), st.count_when(r == "R").alias("failed")
    )
    return c.withColumn("status", st.batch_status(*map(F.col, ("pending", "processing", "completed", "failed"))))


@query("SELECT user_id, max(ts) AS last_seen FROM events GROUP BY user_id")
def ag_last_active(spark, d):
    return t(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last_seen"))


@query("SELECT tag, count(*) AS n FROM (SELECT unnest([lang, source, lang || '-' || source]) AS tag FROM documents) GROUP BY tag ORDER BY n DESC, tag LIMIT 20")
def ag_tags(spark, d):
    """The commonest tags over JSON lists."""
    tags = t(spark, d, "documents").select(F.to_json(F.array("lang", "source", F.concat_ws("-", "lang", "source"))).alias("tags"))
    return tags.select(F.explode(F.from_json("tags", "array<string>")).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag").limit(20)


@query("SELECT DISTINCT lang, source FROM documents")
def ag_distinct(spark, d):
    return t(spark, d, "documents").select("lang", "source").distinct()


@query("SELECT user_id, count(*) AS calls, sum(json_extract(props, '$.k')::BIGINT) AS tokens FROM events GROUP BY user_id")
def ag_usage(spark, d):
    return t(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("tokens"))


@query("SELECT l_orderkey AS page, median(l_quantity) AS height FROM lineitem GROUP BY l_orderkey")
def ag_median(spark, d):
    return t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.median("l_quantity").alias("height"))


@query("SELECT source AS page, count(*) FILTER (regexp_matches(text, '[#$%]')) AS dirty FROM documents GROUP BY source HAVING count(*) FILTER (regexp_matches(text, '[#$%]')) > 3")
def ag_dirty_pages(spark, d):
    return t(spark, d, "documents").groupBy(F.col("source").alias("page")).agg(F.count_if(F.col("text").rlike("[#$%]")).alias("dirty")).filter("dirty > 3")


@query("""WITH c AS (SELECT l_orderkey AS page, l_returnflag AS kind, count(*) AS n, min(l_linenumber) AS first FROM lineitem GROUP BY ALL) SELECT page, kind FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY n DESC, first, kind DESC) AS rn FROM c) WHERE rn = 1""")
def ag_dominant(spark, d):
    """The commonest kind of a page; of equals the one seen first."""
    c = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("page"), F.col("l_returnflag").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min("l_linenumber").alias("first"))
    return c.groupBy("page").agg(F.max_by("kind", F.struct("n", -F.col("first"), "kind")).alias("kind"))


@query("SELECT doc_id, round(len(regexp_extract_all(text, '[0-9]')) / length(text), 6) AS ratio FROM documents")
def ag_numeric_ratio(spark, d):
    return t(spark, d, "documents").select("doc_id", F.round(F.regexp_count("text", F.lit("[0-9]")) / F.length("text"), 6).alias("ratio"))


@query("SELECT l_orderkey AS grp, min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_discount) AS y0, max(l_discount) AS y1 FROM lineitem GROUP BY l_orderkey")
def ag_bounding_box(spark, d):
    return t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("grp")).agg(F.min("l_quantity").alias("x0"), F.max("l_quantity").alias("x1"), F.min("l_discount").alias("y0"), F.max("l_discount").alias("y1"))


@query("SELECT (SELECT count(*) FROM nation) AS n_kbs, (SELECT count(*) FROM orders) AS n_docs, (SELECT count(*) FROM customer) AS n_members")
def ag_overview(spark, d):
    """Three counts in one row."""
    n = lambda name, c: t(spark, d, name).agg(F.count(F.lit(1)).alias(c))
    return n("nation", "n_kbs").crossJoin(n("orders", "n_docs")).crossJoin(n("customer", "n_members"))


@query("SELECT user_id, round(avg(value) + 1e-9, 2) AS rating, count(*) AS n FROM events GROUP BY user_id")
def ag_reviews(spark, d):
    return t(spark, d, "events").groupBy("user_id").agg(F.round(F.avg("value") + 1e-9, 2).alias("rating"), F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, round(CASE WHEN length(text) > 4000 THEN 3000 + 5 + 800 ELSE length(text) END / greatest(length(text), 1), 6) AS ratio FROM documents")
def ag_compression(spark, d):
    """How much of each text its head and tail are, with the mark between them."""
    x = t(spark, d, "documents")
    return x.select("doc_id", F.round(F.length(tx.head_tail(F.col("text"))) / F.greatest(F.length("text"), F.lit(1)), 6).alias("ratio"))


# sorting, pages, sets


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def sort_page(spark, d):
    return st.page(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), F.desc("o_totalprice"), "o_orderkey", offset=40, limit=20)


@query("SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= 5")
def sort_top_k(spark, d):
    rn = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return t(spark, d, "documents").select("source", "doc_id", "n_chars", rn.alias("rn")).filter("rn <= 5").drop("rn")


@query("SELECT c_custkey AS k FROM customer UNION SELECT o_custkey FROM orders")
def set_union(spark, d):
    return t(spark, d, "customer").select(F.col("c_custkey").alias("k")).union(t(spark, d, "orders").select("o_custkey")).distinct()


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 450000")
def set_except(spark, d):
    return t(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(t(spark, d, "orders").filter("o_totalprice > 450000").select("o_custkey"))


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def set_intersect(spark, d):
    return t(spark, d, "customer").select(F.col("c_custkey").alias("k")).intersect(t(spark, d, "orders").select("o_custkey"))


@query("SELECT source AS kb_id, sha256(text) AS file_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY ALL")
def dedup_files(spark, d):
    """Equal files within a knowledge base: one stays."""
    return t(spark, d, "documents").groupBy(F.col("source").alias("kb_id"), F.sha2("text", 256).alias("file_hash")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query("SELECT user_id, date_trunc('minute', ts) AS minute, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def st_rate_limit(spark, d):
    """Minutes in which a key went over its limit (here 1)."""
    w = F.window("ts", "1 minute")
    return t(spark, d, "events").groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("user_id", F.col("w.start").alias("minute"), "n")


@query("SELECT event_type, time_bucket(INTERVAL '1 day', ts) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def ext_tumbling(spark, d):
    """Daily sums by event time."""
    return t(spark, d, "events").groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.col("w.start").alias("day"), "n", "total")


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def ext_pricing_summary(spark, d):
    r = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)
    return t(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp")).groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), r.alias("revenue"), F.count(F.lit(1)).alias("n"))
