"""Queries around model output and model ports: parsing of answers, token accounting, reranking, retries, résumé fields."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import ports
from ..functions import text as tx
from ..operators import resume
from ..operators import retrieval as r
from ..operators import scan
from ..operators import splitters as sp
from .retrieval_queries import KNN, _chunks, _queries, _vector_queries, _vectors, bm25_sql

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


def extract_json(answer):
    """JSON in a model's answer: all of it, a fenced block, or from the first brace or bracket to the last."""
    a = F.regexp_replace(answer, r"^\s+|\s+$", "")
    fenced = F.regexp_extract(a, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    braces = F.regexp_extract(a, r"(?s)([\[{].*[\]}])", 1)
    return F.when(a.rlike(r"^[\[{]"), a).when(fenced != "", fenced).otherwise(F.nullif(braces, F.lit("")))


def questions(answer, most: int = 5):
    """Questions of a model's answer: a JSON list, else its lines without list marks; blank ones go."""
    listed = F.from_json(extract_json(answer), "array<string>")
    lines = F.transform(F.split(answer, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(\d+[.)]|[-*])\s*", "")))
    return F.slice(F.filter(F.coalesce(listed, lines), lambda x: F.trim(x) != ""), 1, most)


def message_tokens(role, text, is_tool):
    """Words and characters of the counter, 4 for each message, 9 more for a tool's."""
    return F.size(tx.tokens(text)) + 4 + F.when(is_tool, 9).otherwise(0)


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '{"source":"' || source || '"}' WHEN 1 THEN '["' || lang || '","' || n_chars || '"]' ELSE '{"b": [' || n_chars || ']}' END AS found FROM documents""")
def mdl_json(spark, d):
    """JSON of a document's fields in plain, fenced and surrounded answers."""
    n = F.col("n_chars").cast("string")
    plain = F.concat(F.lit('  {"source":"'), "source", F.lit('"}\n'))
    fenced = F.concat(F.lit('Sure:\n```json\n["'), "lang", F.lit('","'), n, F.lit('"]\n```\nDone'))
    a = F.when(F.col("doc_id") % 3 == 0, plain).when(F.col("doc_id") % 3 == 1, fenced).otherwise(F.concat(F.lit('It is {"b": ['), n, F.lit("]}, as said")))
    return t(spark, d, "documents").select("doc_id", extract_json(a).alias("found"))


@query(r"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[^\p{L} ]', '', 'g'))), lambda x: x <> '')[1:5], '|') AS questions FROM documents""")
def mdl_questions(spark, d):
    """Question lists from JSON and from numbered lines: a document's lines, letters only, stand for questions."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, r"[^\p{L} ]", ""))), lambda x: x != "")
    listed = F.concat(F.lit("Here:\n"), F.to_json(lines))
    numbered = F.array_join(F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n\n")
    a = F.when(F.col("doc_id") % 2 == 0, listed).otherwise(numbered)
    return t(spark, d, "documents").select("doc_id", F.array_join(questions(a), "|").alias("questions"))


@query(f"SELECT conv_id, sum(len(regexp_extract_all(text, '{tx.TOKEN}')) + 4 + CASE WHEN role = 'system' THEN 9 ELSE 0 END) AS n_tokens FROM conversations GROUP BY conv_id")
def mdl_message_tokens(spark, d):
    """Tokens of each conversation; system messages stand for tool results."""
    c = t(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.sum(message_tokens(F.col("role"), F.col("text"), F.col("role") == "system")).alias("n_tokens"))


@query("SELECT doc_id, source || ': ' || format('{:,}', n_chars) || ' chars' AS summary FROM documents")
def mdl_tool_summary(spark, d):
    """One line for each tool result."""
    return t(spark, d, "documents").select("doc_id", F.concat("source", F.lit(": "), F.format_number("n_chars", 0), F.lit(" chars")).alias("summary"))


@query("SELECT doc_id, source AS name, length(text) AS body_length FROM documents")
def mdl_front_matter(spark, d):
    """Front matter and body of a file."""
    raw = F.concat(F.lit("---\nname: "), F.col("source"), F.lit("\ntags: [a]\n---\n"), F.col("text"))
    x = t(spark, d, "documents").select("doc_id", raw.alias("raw"))
    head, body = F.regexp_extract("raw", r"(?s)^---\n(.*?)\n---\n", 1), F.regexp_replace("raw", r"(?s)^---\n.*?\n---\n", "")
    return x.select("doc_id", F.regexp_extract(head, r"(?m)^name:\s*(.*)$", 1).alias("name"), F.length(body).alias("body_length"))


@query("SELECT conv_id, count(*) FILTER (length(text) % 7 = 0) = 0 AS same FROM conversations GROUP BY conv_id")
def mdl_anchor_check(spark, d):
    """Whether a rewritten transcript has the anchors of the original: here turns go whose length is a multiple of seven, and the order is another."""
    c = t(spark, d, "conversations")
    said = F.concat(tx.anchor(F.col("turn"), F.col("turn")), F.lit(" "), F.regexp_replace("text", r"[\[\]]", ""))
    turns = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", said.alias("s")))).alias("b"), F.array_sort(F.collect_list(F.when(F.length("text") % 7 != 0, F.struct((-F.col("turn")).alias("turn"), said.alias("s"))))).alias("a"))
    joined = lambda name: F.array_join(F.transform(name, lambda x: x["s"]), " ")
    same = F.array_sort(tx.anchor_indices(joined("b"))) == F.array_sort(tx.anchor_indices(joined("a")))
    return turns.select("conv_id", same.alias("same"))


@query("WITH " + bm25_sql(k=10) + r""", s AS (SELECT query_id, chunk_id, rank, list_distinct(regexp_extract_all(lower(b.text), '[\p{L}\p{N}]+')) AS w, regexp_extract_all(lower(d.text), '[\p{L}\p{N}]+') AS c FROM hits JOIN benchmark b ON query_id = item_id JOIN documents d ON chunk_id = doc_id),
x AS (SELECT query_id, chunk_id, rank, round(len(list_filter(w, lambda y: list_contains(c, y))) / len(w), 6) AS score FROM s)
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS rank FROM x""")
def ret_rerank(spark, d):
    """Keyword hits reordered by a rerank port."""
    chunks, q = _chunks(spark, d), _queries(spark, d)
    hits = r.bm25(chunks, q, 10).join(chunks.select("chunk_id", "content"), "chunk_id").join(q, "query_id")
    return ports.rerank(hits, "query", "content", ports.OverlapRerank()).select("query_id", "chunk_id", "score", "rank")


@query("""WITH s AS (SELECT source AS session, CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS kind, doc_id AS seq FROM documents)
SELECT session, kind, seq, row_number() OVER (PARTITION BY session ORDER BY kind, seq) AS position FROM s""")
def ret_web_and_kb(spark, d):
    """Sources of two kinds one after the other, numbered through; every document is of one kind."""
    x = t(spark, d, "documents").select(F.col("source").alias("session"), F.col("doc_id").alias("seq"), "lang")
    web, kb = x.filter("lang = 'en'").withColumn("kind", F.lit(0)), x.filter("lang is distinct from 'en'").withColumn("kind", F.lit(1))
    both = web.unionByName(kb).drop("lang")
    return both.withColumn("position", F.row_number().over(Window.partitionBy("session").orderBy("kind", "seq")))


_GRADED = "WITH " + KNN.format(name="h", where="true", k=10) + """, a AS (SELECT *, 0 AS attempt FROM h WHERE score >= 0.75), good AS (SELECT query_id FROM a GROUP BY query_id HAVING count(*) >= 3),
b AS (SELECT *, 1 AS attempt FROM h WHERE score >= 0.75 * 0.7 AND query_id NOT IN (SELECT query_id FROM good))
SELECT query_id, chunk_id, score, rank, attempt FROM a WHERE query_id IN (SELECT query_id FROM good) UNION ALL SELECT query_id, chunk_id, score, rank, attempt FROM b"""


@query(_GRADED)
def ret_grade_and_retry(spark, d):
    """Queries with fewer than three good hits try again at a lower threshold."""
    hits = r.knn(_vectors(spark, d), _vector_queries(spark, d))
    enough = lambda h: h.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3").select("query_id")
    return ports.grade_and_retry(lambda mode, least: hits.filter(F.col("score") >= least), enough, ["first", "second"], 0.75)


@query("WITH " + bm25_sql(where="lang = 'en'", name="a") + ", " + bm25_sql(name="b") + """, one AS (SELECT *, 0 AS attempt FROM a WHERE score >= 20), good AS (SELECT query_id FROM one GROUP BY query_id HAVING count(*) >= 3)
SELECT query_id, chunk_id, score, attempt FROM one WHERE query_id IN (SELECT query_id FROM good) UNION ALL SELECT query_id, chunk_id, score, 1 FROM b WHERE score >= 20 * 0.7 AND query_id NOT IN (SELECT query_id FROM good)""")
def ret_grade_modes(spark, d):
    """English documents first; queries with fewer than three good hits go on to all documents, at a lower threshold."""
    chunks, q = _chunks(spark, d), _queries(spark, d)
    modes = {"english": F.col("lang") == "en", "all": F.lit(True)}
    search = lambda mode, least: r.bm25(chunks, q, 10, keep=modes[mode], extra=("lang",)).filter(F.col("score") >= least)
    enough = lambda h: h.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3").select("query_id")
    return ports.grade_and_retry(search, enough, ["english", "all"], 20).select("query_id", "chunk_id", "score", "attempt")


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN least(greatest(n_chars % 14 - 1, 1), 10) WHEN 1 THEN n_chars % 10 + 1 ELSE 5 END::INT AS score, CASE doc_id % 4 WHEN 0 THEN least(greatest(n_chars % 14 - 1, 1), 10) >= 5 WHEN 1 THEN n_chars % 10 + 1 >= 5 WHEN 2 THEN true ELSE false END AS passed, CASE doc_id % 4 WHEN 0 THEN source WHEN 3 THEN 'no grade' ELSE '' END AS reason FROM documents""")
def mdl_grades(spark, d):
    """Grades of answers with JSON, in a fence, without a score, and without JSON."""
    k, n = F.col("doc_id") % 4, F.col("n_chars")
    full = F.concat(F.lit('{"score": '), (n % 14 - 1).cast("string"), F.lit(', "reason": "'), "source", F.lit('"}'))
    fenced = F.concat(F.lit('Here:\n```json\n{"score": '), (n % 10 + 1).cast("string"), F.lit("}\n```"))
    g = ports.grades(F.when(k == 0, full).when(k == 1, fenced).when(k == 2, '{"other": 1}').otherwise("score: 9"))
    return t(spark, d, "documents").select("doc_id", g["score"].alias("score"), g["passed"].alias("passed"), g["reason"].alias("reason"))


@query("SELECT conv_id, CASE WHEN contains(lower(string_agg(text, ' ')), 'the') THEN 'yes' ELSE 'no' END AS verdict FROM conversations GROUP BY conv_id")
def mdl_verdict(spark, d):
    """A scripted model's verdict on each conversation."""
    said = F.array_join(F.collect_list("text"), " ")
    return t(spark, d, "conversations").groupBy("conv_id").agg(said.alias("said")).select("conv_id", ports.ScriptedLLM([("(?i)the", "yes")], "no")(F.col("said")).alias("verdict"))


@query()
def mdl_embed(spark, d):
    """Cosine of each document to the one before it under the stand-in embedding; held against a loop in the tests."""
    e = scan.indexed(t(spark, d, "documents").select("doc_id", ports.HashEmbedding(64)(F.col("text")).alias("v")), "doc_id")
    return scan.neighbours(e, {"p": ("v", -1)}).filter("p is not null").select("doc_id", F.round(r.cosine(F.col("p"), F.col("v")), 6).alias("cosine"))


@query("""WITH p AS (SELECT doc_id, i AS chunk_index, trim(substr(text, i * 500 + 1, 500)) AS content FROM (SELECT doc_id, text, unnest(range(greatest(CAST(ceil(length(text) / 500.0) AS BIGINT), 1))) AS i FROM documents) WHERE trim(substr(text, i * 500 + 1, 500)) <> ''),
c AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) - 1) // 3 AS call FROM p), f AS (SELECT doc_id, call, bool_or(contains(content, 'License')) AS failed FROM c GROUP BY ALL)
SELECT doc_id, chunk_index::INT AS chunk_index, CASE WHEN failed THEN '' ELSE 'What is ' || left(content, 10) || '?|Why ' || length(content) || '?' END AS questions, failed FROM c JOIN f USING (doc_id, call)""")
def mdl_question_batches(spark, d):
    """Questions for the chunks of all documents, three a call; a call with a license among its chunks fails by itself."""

    def ask(contents):
        if any("License" in c for c in contents):
            raise RuntimeError("the model refuses")
        return [[f"What is {c[:10]}?", f"Why {len(c)}?"] for c in contents]

    chunks = sp.split_documents(t(spark, d, "documents"), "fixed")
    return ports.question_batches(chunks, ask).select("doc_id", "chunk_index", F.array_join("questions", "|").alias("questions"), "failed")


_LINES = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[^\p{L} ]', '', 'g'))), lambda x: x <> '')"


@query(f"""WITH h AS (SELECT conv_id, list(CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || text ORDER BY turn) AS h, count(*) AS n, arg_max(text, turn) AS query FROM conversations GROUP BY conv_id),
c AS (SELECT conv_id AS query_id, 'completion' AS strategy, 'completion' || chr(10) || array_to_string(h[greatest(n - 5, 1):], chr(10)) || chr(10) || query AS queries, false AS degraded FROM h),
s AS (SELECT doc_id AS query_id, 'decompose' AS strategy, CASE WHEN len({_LINES}) > 0 THEN array_to_string({_LINES}, '|') ELSE text END AS queries, len({_LINES}) = 0 AS degraded FROM documents),
y AS (SELECT doc_id, 'synonym', CASE WHEN doc_id % 3 = 0 THEN text ELSE source || ' ' || lang END, doc_id % 3 = 0 FROM (SELECT doc_id, source, lang, text FROM documents))
SELECT * FROM c UNION ALL SELECT * FROM s UNION ALL SELECT * FROM y""")
def ret_rewrite(spark, d):
    """Queries rewritten by three strategies; scripted models repeat, list or refuse."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    talks = t(spark, d, "conversations").groupBy(F.col("conv_id").alias("query_id")).agg(turns.alias("history"), F.max_by("text", "turn").alias("query"))
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"), F.concat_ws(" ", "source", "lang").alias("other"))
    listed = lambda p: F.concat(F.lit("以下：\n"), F.array_join(F.transform(F.split(F.substring_index(F.concat(p, F.lit("")), "decompose\n", -1), "\n"), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), F.trim(F.regexp_replace(x, r"[^\p{L} ]", "")))), "\n"))
    done = [
        ports.rewritten(talks, "completion", lambda p: p).withColumn("strategy", F.lit("completion")),
        ports.rewritten(docs, "decompose", listed).withColumn("strategy", F.lit("decompose")),
        ports.rewritten(docs, "synonym", lambda p: F.when(F.col("query_id") % 3 != 0, F.col("other"))).withColumn("strategy", F.lit("synonym")),
    ]
    each = [x.select("query_id", "strategy", F.array_join("queries", "|").alias("queries"), "degraded") for x in done]
    return each[0].unionByName(each[1]).unionByName(each[2])


# résumés: fields of people, customers standing in


def year_month(text):
    """(year, month) of an epoch or a partial date; an impossible month is 1, a year outside 1900 to 2100 null."""
    epoch = F.when(text.rlike(r"^\d{9,10}$"), F.date_format(F.timestamp_seconds(text.cast("long")), "yyyy-MM-dd")).otherwise(text)
    year = F.try_to_number(F.nullif(F.regexp_extract(epoch, r"^(\d{4})", 1), F.lit("")), F.lit("9999")).cast("int")
    month = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(epoch, r"^\d{4}\D+(\d{1,2})", 1), F.lit("")), F.lit("99")).cast("int"), F.lit(1))
    return F.struct(F.when(year.between(1900, 2100), year).alias("year"), F.when(month.between(1, 12), month).otherwise(1).alias("month"))


def phone(text):
    """Digits only, without the country code of an eleven-digit number."""
    return F.regexp_replace(F.regexp_replace(text, r"\D", ""), r"^86(?=1\d{10}$)", "")


@query("SELECT o_orderkey, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month FROM orders")
def rsm_dates(spark, d):
    """Years and months of dates in several shapes."""
    o = t(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("x"))
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, F.date_format("x", "yyyy-MM-dd")).when(k == 1, F.date_format("x", "yyyy/M")).otherwise(F.date_format("x", "yyyy年MM月"))
    return o.select("o_orderkey", year_month(text).alias("ym")).select("o_orderkey", "ym.*")


@query("SELECT c_custkey, '138' || lpad(c_custkey::VARCHAR, 8, '0') AS phone FROM customer")
def rsm_phones(spark, d):
    n = F.lpad(F.col("c_custkey").cast("string"), 8, "0")
    return t(spark, d, "customer").select("c_custkey", phone(F.concat(F.lit("+86 (138) "), n)).alias("phone"))


@query("SELECT n_nationkey, r_name || ' / ' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey")
def rsm_regions(spark, d):
    """A code's chain of names through its parents, by a recursive query."""
    rows = t(spark, d, "nation").select((F.col("n_nationkey") + 100).alias("id"), F.col("n_regionkey").alias("parent"), F.col("n_name").alias("name"))
    rows = rows.unionByName(t(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.lit(None).cast("long").alias("parent"), F.col("r_name").alias("name")))
    rows.createOrReplaceTempView("mill_regions")
    chain = spark.sql("""WITH RECURSIVE c(id, path) AS (SELECT id, name FROM mill_regions WHERE parent IS NULL UNION ALL SELECT r.id, c.path || ' / ' || r.name FROM mill_regions r JOIN c ON r.parent = c.id) SELECT id - 100 AS n_nationkey, path FROM c WHERE id >= 100""")
    return chain


@query("""WITH e AS (SELECT l_orderkey AS person, CASE l_returnflag WHEN 'A' THEN 3 WHEN 'N' THEN 2 ELSE 1 END AS rank FROM lineitem) SELECT person, CASE max(rank) WHEN 3 THEN 'A' WHEN 2 THEN 'N' ELSE 'R' END AS highest FROM e GROUP BY person""")
def rsm_highest(spark, d):
    """The highest degree of each person by a ranking of codes."""
    ranks = spark.createDataFrame([("A", 3), ("N", 2), ("R", 1)], "degree string, rank int")
    x = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("person"), F.col("l_returnflag").alias("degree"))
    return resume.highest_degree(x, ranks).select("person", F.col("degree").alias("highest"))


@query("""SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS gender, CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS married,
CASE WHEN c_custkey % 5 > 0 THEN '555' || c_custkey ELSE 'tel' || c_custkey END AS phone, 'early ' || c_nationkey AS first_company, 'late ' || c_nationkey AS last_company, CASE WHEN c_custkey % 4 > 0 THEN 'school' END AS last_school FROM customer""")
def rsm_flattened(spark, d):
    """Sections of résumés in JSON as typed columns."""
    c, k = t(spark, d, "customer"), F.col("c_custkey")
    basic = F.struct(F.col("c_name").alias("name"), F.when(k % 2 == 0, "M").otherwise("F").alias("gender"), F.when(k % 5 > 0, F.concat(F.lit(" 555"), k.cast("string"))).otherwise(" ").alias("phone"), F.concat(F.lit("tel"), k.cast("string")).alias("tel"), F.when(k % 3 == 0, "Y").when(k % 3 == 1, "N").alias("marital"))
    job = lambda name, start: F.struct(F.concat(F.lit(f"{name} "), F.col("c_nationkey").cast("string")).alias("company"), F.lit(start).alias("start"))
    school = F.array(F.struct(F.lit("school").alias("school"), F.when(k % 4 > 0, "2001-09").alias("start")))
    raw = F.to_json(F.struct(basic.alias("basic"), F.array(job("late", "2019-03"), job("early", "2011-01")).alias("work"), school.alias("education")))
    return resume.flattened(c.select(k.alias("id"), raw.alias("raw")))


@query("SELECT c_custkey AS id, n_nationkey::INT AS school_id, n_regionkey::INT AS rank FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def rsm_schools(spark, d):
    """Schools by name, English name or alias."""
    n = t(spark, d, "nation")
    schools = n.select(F.col("n_nationkey").cast("int").alias("school_id"), "n_name", F.col("n_regionkey").cast("int").alias("rank"))
    schools = schools.select("school_id", F.concat(F.lit("University of "), "n_name").alias("name"), F.concat("n_name", F.lit(" Tech.")).alias("english"), F.concat(F.lit("UO"), "n_name", F.lit("+The "), "n_name").alias("alias"), "rank")
    k = F.col("c_custkey") % 3
    said = F.when(k == 0, F.concat(F.lit("university of "), "n_name")).when(k == 1, F.concat("n_name", F.lit(" tech (main)"))).otherwise(F.concat(F.lit("THE "), "n_name"))
    people = t(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), said.alias("school"))
    return resume.school_lookup(people, schools).select("id", "school_id", "rank")


@query()
def ret_hyde(spark, d):
    """Hybrid search by the vector of a model's answer and the words of the query."""
    port = ports.HashEmbedding(64)
    return r.hyde(_chunks(spark, d), _queries(spark, d), lambda q: F.concat(q, F.lit(" the answer")), port)


@query()
def ret_research(spark, d):
    """Deep research in its quick mode: rounds of searches within and outside the English documents take turns until a query has enough hits."""
    c = _chunks(spark, d)
    english = F.col("lang") == "en"

    def search(some):
        return lambda q, n: r.bm25(some, q, 4 * (n + 1)).withColumnRenamed("chunk_id", "key").select("query_id", "key", "score")

    return r.deep_research(_queries(spark, d), search(c.filter(english)), search(c.filter(~english)), mode="quick")


@query("""WITH c AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN replace(replace(lower(n_name), ' ', ''), '_', '') WHEN 1 THEN '深圳东方' || n_nationkey || '厂二部' WHEN 2 THEN '东方' || c_custkey % 3 ELSE 'x' || n_name END AS company, c_custkey % 8 = 1 AS lent FROM customer JOIN nation ON c_nationkey = n_nationkey),
k AS (SELECT n_nationkey * 2 + 1 AS place, replace(replace(lower(n_name), ' ', ''), '_', '') AS name, n_name AS tag FROM nation UNION ALL SELECT n_nationkey * 2 + 2, '东方' || n_nationkey || '厂', 'works ' || n_nationkey FROM nation UNION ALL SELECT 0, '东方', 'east'),
m AS (SELECT c_custkey, min(place) AS place FROM c JOIN k ON CASE WHEN regexp_full_match(name, '[0-9a-zA-Z., ]+') THEN company = name ELSE contains(company, name) AND (length(name) >= 3 OR length(company) < 2 * length(name)) END GROUP BY c_custkey)
SELECT c_custkey AS id, tag, m.place IS NOT NULL AND NOT lent AS good FROM c LEFT JOIN m USING (c_custkey) LEFT JOIN k ON k.place = m.place""")
def rsm_companies(spark, d):
    """Companies of customers found in a table of names: equal in ASCII, else contained."""
    n = t(spark, d, "nation")
    k = F.col("c_custkey")
    said = F.when(k % 4 == 0, F.col("n_name")).when(k % 4 == 1, F.concat(F.lit("深圳 东方"), F.col("n_nationkey").cast("string"), F.lit("厂（二）二部"))).when(k % 4 == 2, F.concat(F.lit("东方"), (k % 3).cast("string"))).otherwise(F.concat(F.lit("x"), "n_name"))
    people = t(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(k.alias("id"), F.when(k % 8 == 1, F.concat(said, F.lit("外派"))).otherwise(said).alias("company"))
    number = F.col("n_nationkey").cast("string")
    table = n.select((F.col("n_nationkey") * 2 + 1).alias("place"), F.col("n_name").alias("name"), F.col("n_name").alias("tag"))
    table = table.unionByName(n.select((F.col("n_nationkey") * 2 + 2).alias("place"), F.concat(F.lit("东方 "), number, F.lit("厂")).alias("name"), F.concat(F.lit("works "), number).alias("tag")))
    east = n.limit(1).select(F.lit(0).cast("long").alias("place"), F.lit("东方").alias("name"), F.lit("east").alias("tag"))
    return resume.company_lookup(people, table.unionByName(east)).select("id", "tag", "good")


@query("""WITH s AS (SELECT unnest(['the', 'license', 'ing']) AS skill) SELECT doc_id, count(*) AS matched, round(least(100.0::DOUBLE * count(*) / 3, 100) + 1e-9, 1) AS percent FROM documents JOIN s ON contains(lower(text), skill) OR contains(skill, lower(text)) GROUP BY doc_id""")
def rsm_skill_match(spark, d):
    """Skills of a short list that a text names, or that name it, and their share."""
    return resume.skill_match(t(spark, d, "documents"), "doc_id", "text", ["the", "license", "ing"])


@query(f"""SELECT conv_id, turn, 4 + len(regexp_extract_all(text, '{tx.TOKEN}')) + 85 * (turn % 3) + CASE WHEN role = 'assistant' THEN len(regexp_extract_all('[{{"name":"' || role || '","arguments":"' || conv_id || '"}}]', '{tx.TOKEN}')) ELSE 0 END + CASE WHEN turn % 2 = 1 THEN 6 ELSE 0 END + CASE WHEN turn % 5 = 0 THEN 3 ELSE 0 END AS cost FROM conversations""")
def mdl_message_cost(spark, d):
    """Tokens of messages with images, calls, calls' ids and tools' names."""
    c = t(spark, d, "conversations")
    calls = F.when(F.col("role") == "assistant", F.to_json(F.array(F.struct(F.col("role").alias("name"), F.col("conv_id").cast("string").alias("arguments")))))
    cost = tx.message_cost(F.col("text"), F.col("turn") % 3, calls, F.when(F.col("turn") % 2 == 1, "call-1"), F.when(F.col("turn") % 5 == 0, "tool"))
    return c.select("conv_id", "turn", cost.alias("cost"))


@query("WITH " + bm25_sql(k=10) + r""", s AS (SELECT query_id, chunk_id, rank, score, list_distinct(regexp_extract_all(lower(b.text), '[\p{L}\p{N}]+')) AS w, regexp_extract_all(lower(d.text), '[\p{L}\p{N}]+') AS c FROM hits JOIN benchmark b ON query_id = item_id JOIN documents d ON chunk_id = doc_id),
x AS (SELECT *, CASE WHEN chunk_id % 10 = 0 THEN NULL ELSE len(list_filter(w, lambda y: list_contains(c, y))) / len(w) END AS new FROM s), f AS (SELECT *, count(new) OVER (PARTITION BY query_id) = count(*) OVER (PARTITION BY query_id) AS ok FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY new DESC, rank) AS rn FROM f WHERE ok), n AS (SELECT *, max(new) OVER (PARTITION BY query_id) AS top FROM r WHERE rn <= 3)
SELECT query_id, chunk_id, CASE WHEN top <= 0 THEN 1.0 ELSE round(new / top, 4) END AS score, rn AS rank, true AS reranked FROM n UNION ALL SELECT query_id, chunk_id, score, rank, false FROM f WHERE NOT ok""")
def ret_rerank_top(spark, d):
    """The best three hits by a rerank port, normalised; where the port fails a query keeps its hits."""
    chunks, q = _chunks(spark, d), _queries(spark, d)
    hits = r.bm25(chunks, q, 10).join(chunks.select("chunk_id", "content"), "chunk_id").join(q, "query_id")
    port = lambda a, b: F.when(F.col("chunk_id") % 10 != 0, ports.OverlapRerank()(a, b))
    return ports.reranked(hits, "query", "content", port).select("query_id", "chunk_id", "score", "rank", "reranked")


@query("""WITH x AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'web_search' WHEN 1 THEN 'code_execution' WHEN 2 THEN 'mcp__files' ELSE 'clock' END AS name, replace(replace(text, '"', ''), chr(92), '') AS v FROM documents),
c AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN '{"query":"' || source_ || '","results":[1,{"a":2},' || doc_id || ']}' WHEN 1 THEN '{"exit_code":' || doc_id % 3 || ',"output":"' || left(plain, 200) || '"}' ELSE v END AS content FROM (SELECT x.*, regexp_replace(v, '[[:cntrl:]]', '', 'g') AS plain, documents.source AS source_ FROM x JOIN documents USING (doc_id)))
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '[web_search] query="' || source_ || '" 3 results (' || format('{:,}', length(content)) || ' chars)'
WHEN 1 THEN '[code_execution] exit=' || doc_id % 3 || ' `' || CASE WHEN left(plain, 200) = '' THEN left(content, 80) ELSE left(plain, 80) END || CASE WHEN length(content) > 80 THEN '...' ELSE '' END || '` (1 lines)'
WHEN 2 THEN '[mcp__files] ' || replace(left(v, 80), chr(10), ' ') || CASE WHEN length(v) > 80 THEN '...' ELSE '' END || ' (' || format('{:,}', length(v)) || ' chars)'
ELSE '[clock] (' || format('{:,}', length(v)) || ' chars, ' || CASE WHEN trim(regexp_replace(v, '\\s', ' ', 'g')) <> '' THEN 1 + length(v) - length(replace(v, chr(10), '')) ELSE 0 END || ' lines)' END AS summary FROM c""".replace("\\\\s", "\\s"))
def mdl_tool_lines(spark, d):
    """Results of four kinds of tools in one line each."""
    x = t(spark, d, "documents").withColumn("v", F.translate("text", '"\\', ""))
    plain = F.regexp_replace("v", r"\p{Cntrl}", "")
    k = F.col("doc_id") % 4
    found = F.concat(F.lit('{"query":"'), "source", F.lit('","results":[1,{"a":2},'), F.col("doc_id").cast("string"), F.lit("]}"))
    ran = F.concat(F.lit('{"exit_code":'), (F.col("doc_id") % 3).cast("string"), F.lit(',"output":"'), F.left(plain, F.lit(200)), F.lit('"}'))
    name = F.when(k == 0, "web_search").when(k == 1, "code_execution").when(k == 2, "mcp__files").otherwise("clock")
    return x.select("doc_id", tx.tool_summary(name, F.when(k == 0, found).when(k == 1, ran).otherwise(F.col("v"))).alias("summary"))


@query("""WITH p AS (SELECT l_orderkey AS person, list(lower(l_shipmode_) ORDER BY l_linenumber, l_shipmode_) AS techs, max(CASE WHEN l_linenumber = 2 THEN 'b' ELSE '' END) AS background, count(*) AS n FROM (SELECT *, CASE l_partkey % 7 WHEN 0 THEN 'Spark SQL' WHEN 1 THEN 'Java' WHEN 2 THEN 'SQL' WHEN 3 THEN 'Go' WHEN 4 THEN 'JavaScript' WHEN 5 THEN 'cobol' ELSE 'Kafka' END AS l_shipmode_ FROM lineitem) GROUP BY l_orderkey),
r AS (SELECT *, list_max(list_transform(techs, lambda x: CASE WHEN x = 'java' THEN 1.0 WHEN contains(x, 'java') OR contains('java', x) THEN 0.7 WHEN x = 'sql' THEN 1.0 WHEN contains(x, 'sql') OR contains('sql', x) THEN 0.7 WHEN x = 'kafka' THEN 0.7 WHEN contains(x, 'kafka') OR contains('kafka', x) THEN 0.5 ELSE 0.1 END))::DOUBLE AS relevance,
round(least(CASE WHEN background <> '' THEN 0.2 ELSE 0 END + least(n, 3) * 0.2 + least(n // 2, 3) * 0.1, 1.0), 6)::DOUBLE AS depth FROM p)
SELECT person, relevance, depth, round(least((relevance * 0.5 + depth * 0.3 + 0.2) * 1.5, 1.0), 6) AS weight, (((len(list_filter(techs, lambda x: contains(x, 'java') OR contains('java', x))) > 0)::INT + (len(list_filter(techs, lambda x: contains(x, 'sql') OR contains('sql', x))) > 0)::INT) * 100 // 2)::INT AS match FROM r""")
def rsm_job_fit(spark, d):
    """Projects weighed by a job's skills, and how many of the required ones a person has."""
    names = ["Spark SQL", "Java", "SQL", "Go", "JavaScript", "cobol", "Kafka"]
    tech = F.element_at(F.array(*map(F.lit, names)), (F.col("l_partkey") % 7 + 1).cast("int"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", tech.alias("x")))), lambda x: x["x"])
    same = lambda n: F.array_repeat(F.lit("c"), n)
    x = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("person")).agg(items.alias("techs"), F.max(F.when(F.col("l_linenumber") == 2, "b").otherwise("")).alias("background"), F.count(F.lit(1)).cast("int").alias("n"))
    x = x.withColumns({"architecture": F.lit(None).cast("string"), "challenges": same(F.col("n")), "achievements": same(F.floor(F.col("n") / 2).cast("int"))})
    out = resume.project_weights(x, ["Java", "SQL"], ["Kafka"])
    return out.select("person", "relevance", "depth", "weight", resume.match_score(F.col("techs"), ["Java", "SQL"]).alias("match"))


@query("""WITH c AS (SELECT c_custkey, 1950 + c_custkey % 50 AS y, c_custkey % 14 AS m, c_custkey % 33 AS dd FROM customer)
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN y || '-' || lpad(CASE WHEN m BETWEEN 1 AND 12 THEN m ELSE 1 END::VARCHAR, 2, '0') || '-' || lpad(CASE WHEN dd BETWEEN 1 AND 31 THEN dd ELSE 1 END::VARCHAR, 2, '0') WHEN 1 THEN y || '-01-01' WHEN 2 THEN '1970-01-12' END AS birth_dt,
CASE c_custkey % 4 WHEN 0 THEN 2026 - y WHEN 1 THEN 2026 - y WHEN 2 THEN 56 END::INT AS age, CASE c_custkey % 3 WHEN 0 THEN '硕士' WHEN 1 THEN 'EMBA' ELSE '' END AS degree, CASE c_custkey % 3 WHEN 0 THEN '2' WHEN 1 THEN '94' ELSE '' END AS code,
CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '139' || lpad(c_custkey::VARCHAR, 8, '0') END AS mobile, 'big data|sql|数据|挖掘|n' || c_nationkey AS words, 'a_kwd,b_fea' AS fields FROM c JOIN customer USING (c_custkey)""")
def rsm_profile(spark, d):
    """Birth dates, ages, degrees, mobile numbers, keywords and fields of profiles."""
    c, k = t(spark, d, "customer"), F.col("c_custkey")
    year = (1950 + k % 50).cast("string")
    born = F.when(k % 4 == 0, F.concat_ws("-", year, F.lpad((k % 14).cast("string"), 2, "0"), F.lpad((k % 33).cast("string"), 2, "0"))).when(k % 4 == 1, year).when(k % 4 == 2, "0001000000").otherwise("unknown")
    b = resume.birth(born, 2026)
    degree = F.when(k % 3 == 0, F.lit(2)).when(k % 3 == 1, F.lit(94)).otherwise(F.lit(7))
    named = resume.degree_name(degree)
    phone = F.when(k % 5 == 0, "none").otherwise(F.concat(F.lit("tel 0086-139 "), F.lpad(k.cast("string"), 8, "0")))
    said = resume.without_tags(F.concat(F.lit("Big"), F.lit("<br/>"), F.lit("Data；SQL,数据 挖掘."), F.lit("N"), F.col("c_nationkey").cast("string")))
    fields = F.create_map(F.lit("a_kwd"), F.lit("x"), F.lit("b_fea"), F.lit("0.5"), F.lit("c_fea"), F.lit("-1"), F.lit("d_fea"), F.lit("?"), F.lit("other"), F.lit("y"))
    words = F.array_join(resume.keywords(F.regexp_replace(said, "Big Data", "Big_Data")), "|")
    return c.select("c_custkey", b["birth_dt"].alias("birth_dt"), b["age"].alias("age"), named.alias("degree"), resume.degree_code(F.concat(F.lit(" "), F.lower(named), F.lit(" "))).alias("code"), resume.mobile(phone).alias("mobile"), F.replace(words, F.lit("big_data"), F.lit("big data")).alias("words"), F.array_join(F.array_sort(F.map_keys(resume.kept_fields(fields))), ",").alias("fields"))
