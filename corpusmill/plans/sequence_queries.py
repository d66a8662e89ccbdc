"""Queries over ordered sequences and evaluation: conversations, events as calls and frames, labelled vectors as judged hits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import evaluation as ev
from ..operators import retrieval as r
from ..operators import sequences as sq
from .retrieval_queries import KNN, _vector_queries, _vectors

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


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def wn_latest(spark, d):
    """The latest row of each key, by a grouped maximum."""
    return t(spark, d, "events").groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), "event_id").alias("r")).select("user_id", "r.*")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 2")
def wn_previous(spark, d):
    """The row before the latest."""
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))
    return t(spark, d, "events").select("user_id", "event_id", rn.alias("rn")).filter("rn = 2").drop("rn")


@query("SELECT conv_id, substr(text, 1, 30) AS title FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE role = 'user') WHERE rn = 1")
def wn_first_message(spark, d):
    return t(spark, d, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.min_by(F.substring("text", 1, 30), "turn").alias("title"))


@query("SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents")
def wn_rank(spark, d):
    return t(spark, d, "documents").select("source", "doc_id", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))


@query("SELECT user_id, event_id, epoch(ts) AS start, lead(epoch(ts)) OVER (PARTITION BY user_id ORDER BY epoch(ts), event_id) AS \"end\" FROM events")
def wn_timeline(spark, d):
    """Frames end where the next begins."""
    e = t(spark, d, "events").select("user_id", F.col("event_id").alias("idx"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("start"))
    return sq.timeline(e, "user_id").withColumnRenamed("idx", "event_id")


@query("SELECT conv_id, idx, text FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, text FROM conversations) WHERE length(text) > 100")
def wn_segments(spark, d):
    """Segments keep their index when short ones go."""
    idx = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return t(spark, d, "conversations").select("conv_id", idx.alias("idx"), "text").filter(F.length("text") > 100)


@query(
    """WITH line AS (SELECT user_id AS key, event_id % 10 AS idx, min(epoch(ts)) AS s, max(epoch(ts)) AS e FROM events GROUP BY ALL), c AS (SELECT DISTINCT user_id AS key, g AS chunk_id FROM events, range(3) AS r(g)),
x AS (SELECT key, chunk_id, unnest([chunk_id * 3, chunk_id * 3 + 1, 99]) AS idx FROM c)
SELECT c.key, c.chunk_id, min(s) AS start, max(e) AS "end", array_to_string(list_sort(list(line.idx) FILTER (line.idx IS NOT NULL)), ',') AS frames FROM c LEFT JOIN x USING (key, chunk_id) LEFT JOIN line ON x.key = line.key AND x.idx = line.idx GROUP BY ALL"""
)
def wn_align(spark, d):
    """Chunks with anchors of frames get their times; unknown frames are ignored."""
    e = t(spark, d, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    line = e.groupBy(F.col("user_id").alias("key"), (F.col("event_id") % 10).cast("int").alias("idx")).agg(F.min("s").alias("start"), F.max("s").alias("end"))
    c = e.select(F.col("user_id").alias("key")).distinct().withColumn("chunk_id", F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])))
    text = F.concat(tx.anchor(F.lit(1), F.col("chunk_id") * 3), F.lit(" a "), tx.anchor(F.lit(2), F.col("chunk_id") * 3 + 1), F.lit(" b "), tx.anchor(F.lit(3), F.lit(99)))
    out = sq.align_chunks(c.withColumn("text", text), line, tx.anchor_indices(F.col("text")))
    return out.select("key", "chunk_id", "start", "end", F.coalesce(F.array_join("frame_indices", ","), F.lit(None).cast("string")).alias("frames"))


_HIST = "SELECT user_id, event_id, [(value % 7)::DOUBLE, (value % 5)::DOUBLE, (event_id % 3)::DOUBLE, 0::DOUBLE] AS h FROM events"


@query(
    f"""WITH a AS ({_HIST}), b AS (SELECT *, lag(h) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM a),
c AS (SELECT user_id, event_id, list_filter(list_transform(range(1, 5), lambda i: CASE WHEN h[i] + p[i] > 0 THEN (h[i] - p[i]) * (h[i] - p[i]) / (h[i] + p[i]) END), lambda v: v IS NOT NULL) AS x FROM b WHERE p IS NOT NULL)
SELECT user_id, event_id, round(coalesce(list_sum(x) / nullif(len(x), 0), 0), 6) AS distance FROM c"""
)
def wn_frame_distance(spark, d):
    """Distance of each frame's histogram to the one before."""
    h = F.array((F.col("value") % 7).cast("double"), (F.col("value") % 5).cast("double"), (F.col("event_id") % 3).cast("double"), F.lit(0.0))
    a = t(spark, d, "events").select("user_id", "event_id", h.alias("h")).withColumn("p", F.lag("h").over(Window.partitionBy("user_id").orderBy("event_id")))
    return a.filter("p is not null").select("user_id", "event_id", F.round(sq.chi_square(F.col("h"), F.col("p")), 6).alias("distance"))


@query()
def wn_keyframes(spark, d):
    """Scene changes of each user's frames: a fold, held against a plain loop in the tests."""
    f = wn_frame_distance(spark, d).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "distance"))), lambda x: x["distance"]).alias("ds"))
    return f.select("user_id", F.array_join(sq.keyframes(F.col("ds"), 0.8, 3, 20), ",").alias("frames"))


@query("SELECT user_id, k * 10 AS at FROM (SELECT user_id, least((max(event_id) - min(event_id)) // 1000, 30) AS n FROM events GROUP BY user_id), range(30) AS r(k) WHERE k < greatest(n, 1)")
def wn_interval_frames(spark, d):
    """Frames at fixed intervals, one at least, 30 at most."""
    n = F.least(F.floor((F.max("event_id") - F.min("event_id")) / 1000), F.lit(30))
    e = t(spark, d, "events").groupBy("user_id").agg(F.greatest(n, F.lit(1)).alias("n"))
    return e.select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k")).select("user_id", (F.col("k") * 10).alias("at"))


@query("SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS grp, turn FROM conversations")
def wn_group(spark, d):
    """Frames in groups of three."""
    return t(spark, d, "conversations").select("conv_id", F.floor((F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1) / 3).alias("grp"), "turn")


@query(
    """WITH c AS (SELECT user_id, event_id, event_type AS sig FROM events), n AS (SELECT *, len(list_filter(list(sig) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), lambda x: x = sig)) AS n_same FROM c),
w AS (SELECT *, sum((n_same >= 3)::INT) OVER (PARTITION BY user_id, sig ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS warned FROM n)
SELECT user_id, event_id, n_same, CASE WHEN n_same >= 5 THEN 'stop' WHEN n_same >= 3 AND warned = 1 THEN 'warning' END AS verdict FROM w"""
)
def wn_loops(spark, d):
    """Repeated calls among a run's last 20."""
    return sq.loops(t(spark, d, "events"), "user_id", "event_id", F.col("event_type")).select("user_id", "event_id", "n_same", "verdict")


@query("SELECT conv_id, turn, text FROM (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE s <= 300 OR rn = 1")
def wn_truncate(spark, d):
    """The tail of each conversation within 300 characters."""
    c = t(spark, d, "conversations").withColumn("cost", F.length("text"))
    return sq.truncate_to_budget(c, "conv_id", "turn", "cost", 300).select("conv_id", "turn", "text")


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 4")
def wn_keep_recent(spark, d):
    return sq.keep_recent(t(spark, d, "conversations"), "conv_id", "turn", 4).select("conv_id", "turn")


@query("SELECT conv_id, turn FROM (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE s <= 1000 OR rn <= 3")
def wn_compress(spark, d):
    """Long conversations keep their last three messages."""
    c = t(spark, d, "conversations").withColumn("cost", F.length("text"))
    return sq.compress_session(c, "conv_id", "turn", "cost", 1000, 3).select("conv_id", "turn")


@query("""SELECT source, doc_id, CASE WHEN length(text) >= 200 AND row_number() OVER (PARTITION BY source, md5(text) ORDER BY doc_id DESC) > 1 THEN '[same as a later output ' || substr(md5(text), 1, 12) || ']' ELSE text END AS text FROM documents""")
def wn_newest_output(spark, d):
    return sq.newest_of_equal(t(spark, d, "documents").select("source", "doc_id", "text"), "source", "doc_id", "text")


@query("SELECT conv_id, turn, pos >= n - greatest(3, n // 3) AS kept FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)")
def wn_last_third(spark, d):
    """Messages outside the last third (three at least) are pruned."""
    w = Window.partitionBy("conv_id")
    n = F.count(F.lit(1)).over(w)
    pos = F.row_number().over(w.orderBy("turn")) - 1
    return t(spark, d, "conversations").select("conv_id", "turn", pos.alias("pos"), n.alias("n")).select("conv_id", "turn", (F.col("pos") >= F.col("n") - F.greatest(F.lit(3), F.floor(F.col("n") / 3))).alias("kept"))


@query("""WITH s AS (SELECT conv_id, max(turn) AS cut FROM conversations WHERE role = 'user' AND turn < 3 GROUP BY conv_id) SELECT c.conv_id, turn FROM conversations c LEFT JOIN s USING (conv_id) WHERE cut IS NULL OR turn > cut""")
def wn_since_summary(spark, d):
    """Messages after the latest summary."""
    c = t(spark, d, "conversations")
    cut = F.max(F.when((F.col("role") == "user") & (F.col("turn") < 3), F.col("turn"))).over(Window.partitionBy("conv_id"))
    return c.select("conv_id", "turn", cut.alias("cut")).filter("cut is null or turn > cut").drop("cut")


@query("""SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS summary, max(turn) AS boundary FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn > 2 GROUP BY conv_id""")
def wn_incremental_summary(spark, d):
    """All but the last two messages joined into a summary, and where it ends."""
    rn = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    old = t(spark, d, "conversations").withColumn("rn", rn).filter("rn > 2")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("x")))), lambda s: s["x"])
    return old.groupBy("conv_id").agg(F.array_join(lines, "\n").alias("summary"), F.max("turn").alias("boundary"))


@query(
    """WITH a AS (SELECT user_id, event_type AS tool, event_id AS id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events WHERE event_id % 2 = 0), b AS (SELECT user_id, event_type AS tool, 'r' || event_id AS result_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events WHERE event_id % 2 = 1)
SELECT a.user_id, a.tool, a.id, coalesce(result_id, 'call_' || a.id) AS call_id FROM a LEFT JOIN b USING (user_id, tool, k)"""
)
def wn_pair_calls(spark, d):
    """The k-th call of a tool takes the k-th result."""
    e = t(spark, d, "events").select("user_id", F.col("event_type").alias("tool"), F.col("event_id").alias("id"))
    results = e.filter("id % 2 = 1").withColumn("result_id", F.concat(F.lit("r"), F.col("id").cast("string")))
    return sq.pair_calls(e.filter("id % 2 = 0"), results, "user_id", "tool", "id").select("user_id", "tool", "id", "call_id")


@query("SELECT l_orderkey AS page, l_linenumber AS line, l_quantity AS top, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey % 2, l_quantity, l_linenumber, l_partkey) AS pos FROM lineitem")
def wn_reading_order(spark, d):
    """Boxes in reading order: page, column, top."""
    w = Window.partitionBy("l_orderkey").orderBy(F.col("l_suppkey") % 2, "l_quantity", "l_linenumber", "l_partkey")
    return t(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("top"), F.row_number().over(w).alias("pos"))


@query()
def ret_research_dedupe(spark, d):
    """Hits whose url, title or chunk was seen before in their session go: an ordered fold, held against a loop in the tests."""
    docs = t(spark, d, "documents")
    hits = docs.select(F.col("source").alias("session"), F.col("doc_id").alias("seq"), F.when(F.col("doc_id") % 3 == 0, (F.col("doc_id") % 17).cast("string")).alias("url"), F.substring_index("text", "\n", 1).alias("title"), F.when(F.col("doc_id") % 2 == 0, (F.col("doc_id") % 13).cast("string")).alias("chunk"))
    return sq.ordered_dedupe(hits, "session", "seq", ["url", "title", "chunk"])


_MESSAGES = """SELECT conv_id, turn, CASE WHEN role = 'assistant' AND turn % 4 = 3 THEN 'tool' ELSE role END AS role, length(text) AS cost, role = 'assistant' AND turn % 4 = 1 AS calls_tools FROM conversations"""


@query(
    f"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM ({_MESSAGES})),
s AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) AS s, least(3, n - 1) AS fewest FROM m),
c AS (SELECT conv_id, any_value(n) AS n, least(CASE WHEN any_value(n) = 1 THEN 1 ELSE coalesce(max(pos + 1) FILTER (s > 450 AND n - pos >= fewest AND pos >= 1), 1) END, any_value(n - fewest)) AS cut, max(pos) FILTER (role = 'user' AND pos >= 1) AS u FROM s GROUP BY conv_id),
e AS (SELECT conv_id, n, CASE WHEN u < cut THEN u ELSE cut END AS cut FROM c),
h AS (SELECT e.conv_id, max(pos) AS p, arg_max(calls_tools, pos) AS calls FROM e JOIN m USING (conv_id) WHERE pos >= 1 AND pos < cut AND role <> 'tool' GROUP BY e.conv_id)
SELECT conv_id, (CASE WHEN cut > 1 AND cut < n THEN greatest(least(coalesce(p + 1 - calls::INT, 1), cut), 1) ELSE cut END)::INT AS cut, n FROM e LEFT JOIN h USING (conv_id)"""
)
def wn_tail_cut(spark, d):
    """Where the protected end of each conversation begins, within a budget of 300 characters and its soft ceiling."""
    c = t(spark, d, "conversations")
    says = F.col("role") == "assistant"
    role = F.when(says & (F.col("turn") % 4 == 3), "tool").otherwise(F.col("role"))
    m = c.select("conv_id", "turn", role.alias("role"), F.length("text").alias("cost"), (says & (F.col("turn") % 4 == 1)).alias("calls_tools"))
    return sq.tail_cut(m, "conv_id", "turn", 300)


@query()
def wn_like_frames(spark, d):
    """Frames that differ from the last one kept: a fold, held against a plain loop in the tests."""
    h = F.when(F.col("event_id") % 11 > 0, F.array((F.col("value") % 7).cast("double"), (F.col("value") % 5).cast("double"), (F.col("event_id") % 3).cast("double")))
    return sq.without_like_frames(t(spark, d, "events").select("user_id", "event_id", h.alias("hist")), "user_id", "event_id", 0.4)


@query("SELECT doc_id, CASE WHEN judge IS NULL THEN NULL ELSE greatest(1, least(10, round_even(judge * 0.7::DOUBLE + sim * 0.3::DOUBLE, 0)::INT)) END AS score FROM (SELECT doc_id, CASE WHEN doc_id % 9 > 0 THEN doc_id % 11 END AS judge, quality * 9 + 1 AS sim FROM labels)")
def ev_correctness(spark, d):
    """A judge's score and that of a similarity, 0.7 and 0.3."""
    x = t(spark, d, "labels").select("doc_id", F.when(F.col("doc_id") % 9 > 0, F.col("doc_id") % 11).alias("judge"), (F.col("quality") * 9 + 1).alias("sim"))
    return x.select("doc_id", ev.correctness(F.col("judge").cast("double"), F.col("sim").cast("double")).alias("score"))


# evaluation: hits of a vector search are relevant if they share the query's label


def _judged(spark, d):
    v, q = _vectors(spark, d), _vector_queries(spark, d)
    hits = r.knn(v, q.drop("query_label"), 10).join(v.select("chunk_id", "label"), "chunk_id").join(q.select("query_id", "query_label"), "query_id")
    return hits.select(F.col("query_id").alias("case_id"), "rank", (F.col("label") == F.col("query_label")).alias("is_relevant"))


_J = "WITH " + KNN.format(name="hits", where="true", k=10) + ", j AS (SELECT query_id AS case_id, rank, c.label = q.label AS rel FROM hits JOIN embeddings c ON c.vec_id = chunk_id JOIN embeddings q ON q.vec_id = query_id), e AS (SELECT case_id, round(avg(rel::INT) + 1e-9, 4) AS precision_at_k, bool_or(rel) AS hit, min(rank) FILTER (rel) AS first_relevant_rank FROM j GROUP BY case_id) "


@query(_J + "SELECT * FROM e")
def ev_cases(spark, d):
    return ev.per_case(_judged(spark, d))


@query(_J + "SELECT round(avg(precision_at_k) + 1e-9, 4) AS precision_at_k, round(avg(hit::INT) + 1e-9, 4) AS hit_rate, round(avg(coalesce(1.0::DOUBLE / first_relevant_rank, 0)) + 1e-9, 4) AS mrr FROM e")
def ev_overall(spark, d):
    return ev.overall(ev.per_case(_judged(spark, d)))


@query(_J + ", n AS (SELECT q.vec_id AS case_id, count(*) AS n_relevant FROM embeddings q JOIN embeddings c ON q.label = c.label WHERE q.vec_id % 100 = 0 GROUP BY ALL) SELECT case_id, round(coalesce(f, 0) / n_relevant + 1e-9, 4) AS recall_at_k FROM n LEFT JOIN (SELECT case_id, count(*) AS f FROM j WHERE rel GROUP BY case_id) USING (case_id)")
def ext_recall_at_k(spark, d):
    v = _vectors(spark, d)
    n = v.groupBy("label").agg(F.count(F.lit(1)).alias("n_relevant"))
    relevant = _vector_queries(spark, d).join(n, F.col("query_label") == F.col("label")).select(F.col("query_id").alias("case_id"), "n_relevant")
    return ev.recall_at_k(_judged(spark, d), relevant, 10)


@query("SELECT a.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.5 AS relevant, greatest(1, least(10, round_even(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) * 10, 0)::INT)) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id // 10 * 10")
def ev_similarity(spark, d):
    """Cosine to a reference answer, a flag and a score of ten."""
    v = _vectors(spark, d)
    ref = v.select(F.col("chunk_id").alias("ref_id"), F.col("embedding").alias("ref"))
    j = v.withColumn("ref_id", F.floor(F.col("chunk_id") / 10) * 10).join(ref, "ref_id")
    cos = r.cosine(F.col("embedding"), F.col("ref"))
    return j.select(F.col("chunk_id").alias("vec_id"), (cos >= 0.5).alias("relevant"), ev.similarity_score(cos).alias("score"))


@query("SELECT user_id AS case_id, greatest(1, coalesce(round_even(avg((value > 50)::INT) * 10, 0)::INT, 1)) AS faithfulness FROM events GROUP BY user_id")
def ev_faithfulness(spark, d):
    return ev.faithfulness(t(spark, d, "events").select(F.col("user_id").alias("case_id"), (F.col("value") > 50).alias("supported")))


@query("SELECT user_id AS case_id, round(avg((value > 50)::INT) + 1e-9, 4) AS context_recall FROM events GROUP BY user_id")
def ev_context_recall(spark, d):
    return ev.context_recall(t(spark, d, "events").select(F.col("user_id").alias("case_id"), (F.col("value") > 50).alias("supported")))


@query("SELECT doc_id, round(list_avg(list_filter([quality::DOUBLE, toxic::DOUBLE, (doc_id % 5)::DOUBLE], lambda x: x <> 0)) + 1e-9, 1) AS overall FROM labels")
def ev_case_overall(spark, d):
    """The mean of the scores that are given."""
    l = t(spark, d, "labels").withColumn("third", F.col("doc_id") % 5)
    return l.select("doc_id", ev.mean_of_given("quality", "toxic", "third").alias("overall"))


@query("SELECT round(avg(quality) + 1e-9, 1) AS quality, round(avg(toxic) FILTER (quality = 1) + 1e-9, 4) AS toxic, count(*) FILTER (quality = 1) AS n_success, count(*) AS n FROM labels")
def ev_summary(spark, d):
    l = t(spark, d, "labels")
    good = F.col("quality") == 1
    return l.agg(F.round(F.avg("quality") + 1e-9, 1).alias("quality"), F.round(F.avg(F.when(good, F.col("toxic"))) + 1e-9, 4).alias("toxic"), F.count_if(good).alias("n_success"), F.count(F.lit(1)).alias("n"))


@query("SELECT source, count(quality) AS n_scored, round(avg(quality) + 1e-9, 2) AS mean FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def ev_human(spark, d):
    return t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left").groupBy("source").agg(F.count("quality").alias("n_scored"), F.round(F.avg("quality") + 1e-9, 2).alias("mean"))


_DETAILS = "SELECT l_orderkey, l_returnflag, CASE WHEN l_partkey % 11 > 0 THEN l_partkey % 10 + 1 END AS faithfulness, l_suppkey % 10 + 1 AS relevance, CASE WHEN l_linenumber % 3 > 0 THEN l_quantity / 5 END AS correctness, CASE WHEN l_linenumber > 1 THEN l_quantity % 97 / 97.0 END AS cp, l_quantity / 53.0 AS similarity FROM lineitem"


@query(
    f"""WITH x AS ({_DETAILS}), s AS (SELECT count(*) AS processed_cases, count(*) FILTER (l_returnflag NOT IN ('A', 'R')) AS successful_cases, round(avg(faithfulness) + 1e-9, 1) AS faithfulness, round(avg(relevance) + 1e-9, 1) AS answer_relevance, round(avg(correctness) + 1e-9, 1) AS correctness, NULL::DOUBLE AS quality,
round(avg(cp) FILTER (l_returnflag NOT IN ('A', 'R')) + 1e-9, 4) AS context_precision, round(avg(similarity) FILTER (l_returnflag NOT IN ('A', 'R')) + 1e-9, 4) AS answer_similarity FROM x)
SELECT *, round((faithfulness + answer_relevance + correctness) / 3 + 1e-9, 1) AS overall FROM s"""
)
def ev_test_set(spark, d):
    """The summary of a test set over all its dimensions; failed and cancelled cases only count as processed."""
    x = t(spark, d, "lineitem")
    status = F.when(F.col("l_returnflag") == "A", "error").when(F.col("l_returnflag") == "R", "cancelled").otherwise("done")
    details = x.select(status.alias("status"), F.when(F.col("l_partkey") % 11 > 0, F.col("l_partkey") % 10 + 1).cast("double").alias("faithfulness"), (F.col("l_suppkey") % 10 + 1).cast("double").alias("answer_relevance"), F.when(F.col("l_linenumber") % 3 > 0, F.col("l_quantity") / 5).cast("double").alias("correctness"), F.lit(None).cast("double").alias("quality"), F.when(F.col("l_linenumber") > 1, F.col("l_quantity") % 97 / 97).cast("double").alias("context_precision"), (F.col("l_quantity") / 53).cast("double").alias("answer_similarity"))
    return ev.summary(details)


@query("WITH e AS (SELECT vec_id // 10 AS case_id, vec_id % 10 AS k, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.case_id, round(max(list_cosine_similarity(a.v, c.v)) + 1e-9, 4) AS context_recall FROM e a JOIN e c ON a.case_id = c.case_id WHERE a.k = 0 AND c.k > 0 GROUP BY a.case_id")
def ev_embedding_recall(spark, d):
    """The largest cosine of an expected answer to what was found."""
    e = t(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("case_id"), (F.col("vec_id") % 10).alias("k"), F.col("embedding").alias("vector"))
    return ev.embedding_recall(e.filter("k = 0").drop("k"), e.filter("k > 0").drop("k"))
