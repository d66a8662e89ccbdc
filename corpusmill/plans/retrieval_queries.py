"""Queries over the retrieval algebra: documents and embeddings are the chunks, benchmark items and every hundredth vector the queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import retrieval as r

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def take(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return take


def _chunks(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), "source", "lang")


def _queries(spark, d):
    return spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _vectors(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def _vector_queries(spark, d):
    return _vectors(spark, d).filter("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"), F.col("label").alias("query_label"))


def _questions(spark, d):
    """The questions of a chunk, a second text field: what users say in the conversation of its id."""
    c = spark.read.parquet(f"{d}/conversations.parquet").filter("role = 'user'")
    said = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return c.groupBy(F.col("conv_id").alias("chunk_id")).agg(F.array_join(said, "\n").alias("content"))


def _text_vectors(spark, d):
    """Queries with a text and a vector: each item with the vector of its id."""
    return _queries(spark, d).join(_vectors(spark, d).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector")), "query_id")


def _four(vectors):
    """Four vectors a chunk, as those of its questions."""
    return vectors.withColumn("chunk_id", F.floor(F.col("chunk_id") / 4))


CONTENT = "(SELECT doc_id AS chunk_id, text AS body, source, lang FROM documents)"
QUESTIONS = "(SELECT conv_id AS chunk_id, string_agg(text, chr(10) ORDER BY turn) AS body FROM conversations WHERE role = 'user' GROUP BY conv_id)"


def bm25_sql(table: str = CONTENT, where: str = "true", k: int | None = 10, name: str = "hits") -> str:
    """CTEs for a keyword search: {name}_s holds all scores, {name} the k best."""
    scores = f"""{name}_w AS (SELECT chunk_id, {where} AS kept, regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table}),
{name}_st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM {name}_w),
{name}_q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM benchmark) GROUP BY ALL),
{name}_tf AS (SELECT term, chunk_id, kept, dl, count(*) AS tf FROM (SELECT chunk_id, kept, len(w) AS dl, unnest(w) AS term FROM {name}_w) WHERE term IN (SELECT term FROM {name}_q) GROUP BY ALL),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY term),
{name}_s AS (SELECT query_id, chunk_id, round(sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM {name}_tf JOIN {name}_df USING (term) JOIN {name}_q USING (term), {name}_st WHERE kept GROUP BY ALL)"""
    if k is None:
        return scores
    return f"""{scores},
{name} AS (SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {name}_s) WHERE rank <= {k})"""


KNN = """{name} AS (SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round((1 + list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[])) / 2, 6) AS score FROM embeddings c, embeddings q WHERE q.vec_id % 100 = 0 AND {where})) WHERE rank <= {k})"""


#: A vector search by the vectors of the items; {chunk} names a vector's chunk.
ITEM_KNN = """{name} AS (SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT q.vec_id AS query_id, {chunk} AS chunk_id, max(round((1 + list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[])) / 2, 6)) AS score FROM embeddings c, embeddings q WHERE q.vec_id IN (SELECT item_id FROM benchmark) GROUP BY ALL)) WHERE rank <= {k})"""


@query("WITH " + bm25_sql() + " SELECT * FROM hits")
def ret_bm25(spark, d):
    """Keyword search of every benchmark item over all documents."""
    return r.bm25(_chunks(spark, d), _queries(spark, d))


@query("WITH " + bm25_sql(where="source = 'src0'") + " SELECT * FROM hits")
def ret_bm25_filtered(spark, d):
    """The same within one source; scores stay those of the whole index."""
    return r.bm25(_chunks(spark, d), _queries(spark, d), keep=F.col("source") == "src0", extra=("source",))


@query("WITH " + bm25_sql(QUESTIONS) + " SELECT * FROM hits")
def ret_bm25_questions(spark, d):
    """Keyword search over the questions of chunks."""
    return r.bm25(_questions(spark, d), _queries(spark, d))


@query("WITH " + bm25_sql(k=None, name="a") + ", " + bm25_sql(QUESTIONS, k=None, name="b") + """, s AS (SELECT query_id, chunk_id, round(0.6::DOUBLE * coalesce(a_s.score, 0) + 0.4::DOUBLE * coalesce(b_s.score, 0), 6) AS score FROM a_s FULL JOIN b_s USING (query_id, chunk_id))
SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 10""")
def ret_bm25_two_fields(spark, d):
    """Keyword scores of contents and of questions added, 0.6 and 0.4."""
    q = _queries(spark, d)
    return r.weighted_sum(r.bm25_scores(_chunks(spark, d), q), r.bm25_scores(_questions(spark, d), q), 0.6, 0.4)


@query("WITH " + KNN.format(name="hits", where="true", k=10) + " SELECT * FROM hits")
def ret_knn(spark, d):
    """Cosine search of every hundredth vector over all vectors."""
    return r.knn(_vectors(spark, d), _vector_queries(spark, d))


@query("WITH " + KNN.format(name="hits", where="c.label < 5", k=10) + " SELECT * FROM hits")
def ret_knn_filtered(spark, d):
    """Cosine search among some labels only: the filter comes first."""
    return r.knn(_vectors(spark, d).filter("label < 5"), _vector_queries(spark, d))


@query("""WITH s AS (SELECT q.vec_id AS query_id, c.vec_id // 4 AS chunk_id, max(round((1 + list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[])) / 2, 6)) AS score FROM embeddings c, embeddings q WHERE q.vec_id % 100 = 0 GROUP BY ALL)
SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 10""")
def ret_nested_knn(spark, d):
    """Four vectors a chunk: the best counts."""
    return r.nested_knn(_vectors(spark, d).withColumn("chunk_id", F.floor(F.col("chunk_id") / 4)), _vector_queries(spark, d))


_RRF = """, u AS ({union}), f AS (SELECT query_id, chunk_id, round(sum(w / (60 + rank)), 12) AS raw, min(set_idx * 1000000 + rank) AS first, array_to_string(list_sort(list(DISTINCT 'search_' || set_idx)), ',') AS hit_sources FROM u GROUP BY ALL)
SELECT query_id, chunk_id, round(raw + 1e-9, 4) AS score, rank, hit_sources FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, first, chunk_id) AS rank FROM f) WHERE rank <= 10"""


@query("WITH " + ITEM_KNN.format(name="a", chunk="c.vec_id", k=20) + ", " + bm25_sql(k=20, name="b") + _RRF.format(union="SELECT *, 0 AS set_idx, 0.7::DOUBLE AS w FROM a UNION ALL SELECT *, 1, 0.3::DOUBLE FROM b"))
def ret_hybrid_rrf(spark, d):
    """Hybrid search over contents: a vector search and a keyword search, 0.7 and 0.3, each twice as long as the result."""
    return r.hybrid(r.knn(_vectors(spark, d), _text_vectors(spark, d), 20), r.bm25(_chunks(spark, d), _queries(spark, d), 20))


@query("WITH " + ITEM_KNN.format(name="a", chunk="c.vec_id // 4", k=20) + ", " + bm25_sql(QUESTIONS, k=20, name="b") + _RRF.format(union="SELECT *, 0 AS set_idx, 0.7::DOUBLE AS w FROM a UNION ALL SELECT *, 1, 0.3::DOUBLE FROM b"))
def ret_question_hybrid(spark, d):
    """Hybrid search over questions: the best of a chunk's question vectors, and the words of its questions."""
    return r.hybrid(r.nested_knn(_four(_vectors(spark, d)), _text_vectors(spark, d), 20), r.bm25(_questions(spark, d), _queries(spark, d), 20))


@query("WITH " + ", ".join([ITEM_KNN.format(name="a", chunk="c.vec_id", k=20), bm25_sql(k=20, name="b"), ITEM_KNN.format(name="c", chunk="c.vec_id // 4", k=20), bm25_sql(QUESTIONS, k=20, name="e")]) + _RRF.format(union="SELECT *, 0 AS set_idx, 0.42::DOUBLE AS w FROM a UNION ALL SELECT *, 1, 0.18::DOUBLE FROM b UNION ALL SELECT *, 2, 0.28::DOUBLE FROM c UNION ALL SELECT *, 3, 0.12::DOUBLE FROM e"))
def ret_all_hybrid(spark, d):
    """Four ranked sets in one fusion: vectors and words of contents (0.6 of 0.7 and 0.3) and of questions (0.4)."""
    v, q = _vectors(spark, d), _text_vectors(spark, d)
    t = _queries(spark, d)
    return r.rrf([(r.knn(v, q, 20), 0.42), (r.bm25(_chunks(spark, d), t, 20), 0.18), (r.nested_knn(_four(v), q, 20), 0.28), (r.bm25(_questions(spark, d), t, 20), 0.12)])


@query("WITH " + ITEM_KNN.format(name="a", chunk="c.vec_id", k=20) + ", " + bm25_sql(k=20, name="b") + _RRF.format(union="SELECT *, 0 AS set_idx, 0.7::DOUBLE AS w FROM a UNION ALL SELECT *, 1, 0.3::DOUBLE FROM b").replace("SELECT query_id, chunk_id, round(raw", ", h AS (SELECT query_id, chunk_id, round(raw") + r"""),
n AS (SELECT query_id, chunk_id, round(score / max(score) OVER (PARTITION BY query_id), 4) AS score, rank FROM h),
w AS (SELECT query_id, chunk_id, rank, list_distinct(regexp_extract_all(lower(b.text), '[\p{L}\p{N}]+')) AS w, regexp_extract_all(lower(d.text), '[\p{L}\p{N}]+') AS c FROM n JOIN benchmark b ON query_id = item_id JOIN documents d ON chunk_id = doc_id WHERE score >= 0.5),
x AS (SELECT query_id, chunk_id, rank, round(len(list_filter(w, lambda y: list_contains(c, y))) / len(w), 6) AS score FROM w)
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS rank FROM x""")
def ret_search(spark, d):
    """A whole search: hybrid hits, enriched, normalised, over a threshold, reranked."""
    from .. import ports

    again = lambda hits: ports.rerank(hits, "query", "content", ports.OverlapRerank())
    return r.search(_chunks(spark, d), _vectors(spark, d), _text_vectors(spark, d), rerank=again).select("query_id", "chunk_id", "score", "rank")


@query("WITH " + KNN.format(name="a", where="true", k=20) + ", " + KNN.format(name="b", where="c.label < 5", k=20) + _RRF.format(union="SELECT *, 0 AS set_idx, 0.6::DOUBLE AS w FROM a UNION ALL SELECT *, 1, 0.4::DOUBLE FROM b"))
def ret_all_vector(spark, d):
    """Fusion of two vector searches, 0.6 and 0.4."""
    v, q = _vectors(spark, d), _vector_queries(spark, d)
    return r.rrf([(r.knn(v, q, 20), 0.6), (r.knn(v.filter("label < 5"), q, 20), 0.4)])


@query("WITH " + bm25_sql() + """ SELECT query_id, chunk_id, CASE WHEN max(score) OVER (PARTITION BY query_id) <= 0 THEN 1.0::DOUBLE ELSE round(score / max(score) OVER (PARTITION BY query_id), 4) END AS score, rank, score AS original_score FROM hits""")
def ret_normalise(spark, d):
    """Keyword scores over the query's largest."""
    return r.normalise(r.bm25(_chunks(spark, d), _queries(spark, d)))


@query("WITH " + bm25_sql() + """, n AS (SELECT query_id, chunk_id, round(score / max(score) OVER (PARTITION BY query_id), 4) AS score, rank, score AS original_score FROM hits) SELECT * FROM n WHERE score >= 0.5""")
def ret_threshold(spark, d):
    """Normalised hits of a score of 0.5 or more."""
    return r.normalise(r.bm25(_chunks(spark, d), _queries(spark, d))).filter("score >= 0.5")


@query("WITH " + bm25_sql() + """, m AS (SELECT query_id // 4 AS query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM hits GROUP BY ALL)
SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM m) WHERE rank <= 10""")
def ret_sub_queries_rrf(spark, d):
    """Four sub-queries of a question merged by ranks."""
    hits = r.bm25(_chunks(spark, d), _queries(spark, d)).withColumn("parent_id", F.floor(F.col("query_id") / 4))
    return r.merge_sub_queries(hits)


@query("WITH " + bm25_sql() + """, m AS (SELECT query_id // 4 AS query_id, chunk_id, max(score) AS score FROM hits GROUP BY ALL)
SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM m) WHERE rank <= 10""")
def ret_sub_queries_score(spark, d):
    """Four sub-queries of a question merged by the best score."""
    hits = r.bm25(_chunks(spark, d), _queries(spark, d)).withColumn("parent_id", F.floor(F.col("query_id") / 4))
    return r.merge_sub_queries(hits, "score")


@query("WITH " + bm25_sql(k=None, name="a") + """, h AS (SELECT query_id, chunk_id, round(score / max(score) OVER (PARTITION BY query_id, source), 4) AS score FROM a_s JOIN documents ON chunk_id = doc_id)
SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM h) WHERE rank <= 10""")
def ret_cross_kb(spark, d):
    """A search of several knowledge bases, the sources: hits over the best of their base, merged by score."""
    return r.merged_kbs(r.bm25_scores(_chunks(spark, d), _queries(spark, d), extra=("source",)), "source")


@query("""WITH s AS (SELECT source AS session, doc_id AS seq, CASE WHEN doc_id % 3 = 0 THEN lang || (doc_id % 7)::VARCHAR END AS url FROM documents), f AS (SELECT *, row_number() OVER (PARTITION BY session, url ORDER BY seq) AS n FROM s)
SELECT session, seq, url, row_number() OVER (PARTITION BY session ORDER BY seq) AS position FROM f WHERE url IS NULL OR n = 1""")
def ret_dedupe_sources(spark, d):
    """The first source of each url of a session; sources without one stay; renumbered."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = docs.select(F.col("source").alias("session"), F.col("doc_id").alias("seq"), F.when(F.col("doc_id") % 3 == 0, F.concat("lang", (F.col("doc_id") % 7).cast("string"))).alias("url"))
    return r.first_by_key(rows, "session", "seq", ["url"])


@query("""WITH n AS (SELECT source AS session, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos FROM documents), f AS (SELECT session, lang, min(pos) AS pos FROM n WHERE pos <= 10 GROUP BY ALL)
SELECT session, lang, row_number() OVER (PARTITION BY session ORDER BY pos) AS key_rank FROM f QUALIFY key_rank <= 5""")
def ret_key_sources(spark, d):
    """The first ten sources of a session, distinct in order, five at most."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    pos = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    first = docs.select(F.col("source").alias("session"), "lang", pos.alias("pos")).filter("pos <= 10").groupBy("session", "lang").agg(F.min("pos").alias("pos"))
    return first.select("session", "lang", F.row_number().over(Window.partitionBy("session").orderBy("pos")).alias("key_rank")).filter("key_rank <= 5")


@query("WITH " + ITEM_KNN.format(name="v", chunk="c.vec_id", k=20) + ", " + bm25_sql(k=None, name="a") + """, s AS (SELECT query_id, chunk_id, round(coalesce(v.score, 0) + 0.3::DOUBLE * coalesce(a_s.score, 0), 6) AS score FROM v FULL JOIN a_s USING (query_id, chunk_id))
SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 10""")
def ret_memory_hybrid(spark, d):
    """The scores of the nearest 20 by vector and 0.3 of the keyword scores added in one search."""
    return r.weighted_sum(r.knn(_vectors(spark, d), _text_vectors(spark, d), 20), r.bm25_scores(_chunks(spark, d), _queries(spark, d)), 1.0, 0.3)


@query("""SELECT doc_id, n_chars AS relevance FROM documents WHERE contains(lower(text), 'license') ORDER BY relevance DESC, doc_id LIMIT 20""")
def ret_memory_like(spark, d):
    """The fallback without a search index: memories that hold the words, by their stored relevance (here their length), best 20."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return r.like_search(docs, "text", "License").select("doc_id", F.col("n_chars").alias("relevance")).orderBy(F.desc("relevance"), "doc_id").limit(20)


@query("""SELECT doc_id, (contains(lower(text), 'the')::INT + contains(lower(text), 'license')::INT) + 3 * contains(lower(source), 'src1')::INT + 2 * (lang = 'en')::INT AS relevance FROM documents
WHERE contains(lower(text), 'the') OR contains(lower(text), 'license') ORDER BY relevance DESC, doc_id LIMIT 50""")
def ret_marketplace(spark, d):
    """Word hits with field bonuses, best 50."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    has = lambda c, w: F.lower(c).contains(w).cast("int")
    relevance = has("text", "the") + has("text", "license") + 3 * has("source", "src1") + 2 * (F.col("lang") == "en").cast("int")
    hit = F.lower("text").contains("the") | F.lower("text").contains("license")
    return docs.filter(hit).select("doc_id", relevance.alias("relevance")).orderBy(F.desc("relevance"), "doc_id").limit(50)


@query("""WITH n AS (SELECT source, doc_id, text AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS rn FROM documents)
SELECT source, string_agg('- ' || t, chr(10) ORDER BY doc_id DESC) AS snapshot FROM n WHERE rn <= 20 GROUP BY source""")
def ret_memory_snapshot(spark, d):
    """The 20 latest memories of each owner as a bulleted text."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rn = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("doc_id")))
    latest = docs.select("source", "doc_id", F.col("text").alias("t"), rn.alias("rn")).filter("rn <= 20")
    lines = F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "t")), asc=False), lambda x: F.concat(F.lit("- "), x["t"]))
    return latest.groupBy("source").agg(F.array_join(lines, "\n").alias("snapshot"))


@query("WITH " + bm25_sql(k=5) + """ SELECT query_id, string_agg('[' || rank || '] ' || text, chr(10) ORDER BY rank) AS context FROM hits JOIN documents ON chunk_id = doc_id GROUP BY query_id""")
def ret_context(spark, d):
    """The five best chunks of each query as one numbered context."""
    chunks = _chunks(spark, d)
    hits = r.bm25(chunks, _queries(spark, d), 5).join(chunks.select("chunk_id", F.col("content").alias("t")), "chunk_id")
    lines = F.transform(F.sort_array(F.collect_list(F.struct("rank", "t"))), lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), x["t"]))
    return hits.groupBy("query_id").agg(F.array_join(lines, "\n").alias("context"))


@query("WITH " + bm25_sql(k=20) + r""", c AS (SELECT query_id, rank, CASE WHEN doc_id % 2 = 0 THEN 'http://x/' || doc_id ELSE '文档 ' || source END AS src, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM hits JOIN documents ON chunk_id = doc_id WHERE rank <= 15)
SELECT query_id, string_agg('【来源 ' || rank || '】(' || src || ')' || chr(10) || t || chr(10), chr(10) ORDER BY rank) AS context FROM c WHERE t <> '' GROUP BY query_id""")
def ret_search_context(spark, d):
    """The fifteen best of twenty hits as numbered blocks with their sources."""
    chunks = _chunks(spark, d)
    hits = r.bm25(chunks, _queries(spark, d), 20).join(chunks, "chunk_id")
    url = F.when(F.col("chunk_id") % 2 == 0, F.concat(F.lit("http://x/"), F.col("chunk_id").cast("string")))
    return r.search_context(hits.withColumns({"url": url, "document": F.col("source"), "content": F.concat(F.lit("<|im_start|> "), "content")}))


@query("WITH " + bm25_sql(where="source = 'src0'") + " SELECT item_id AS query_id, count(chunk_id) = 0 AS refused FROM benchmark LEFT JOIN hits ON item_id = query_id GROUP BY item_id")
def ret_refusal(spark, d):
    """Whether a query finds nothing."""
    q = _queries(spark, d)
    hits = r.bm25(_chunks(spark, d), q, keep=F.col("source") == "src0", extra=("source",))
    return q.select("query_id").join(hits, "query_id", "left").groupBy("query_id").agg((F.count("chunk_id") == 0).alias("refused"))
