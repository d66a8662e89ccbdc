"""Queries over readers and splitters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import layout as ly
from ..operators import scan
from ..operators import splitters as sp
from ..operators.retrieval import bm25
from ..ports import HashEmbedding
from ..sources import cache, readers, sinks
from ..sources.shared import new_path
from .retrieval_queries import _chunks, _queries, bm25_sql

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


@query("SELECT doc_id, i AS chunk_index, trim(substr(text, i * 500 + 1, 500)) AS content, doc_id || '_' || i AS chunk_id FROM (SELECT doc_id, text, unnest(range(greatest(CAST(ceil(length(text) / 500.0) AS BIGINT), 1))) AS i FROM documents) WHERE trim(substr(text, i * 500 + 1, 500)) <> ''")
def spl_fixed(spark, d):
    """Slices of 500 characters."""
    return sp.split_documents(t(spark, d, "documents"), "fixed")


@query("SELECT doc_id, i AS chunk_index, trim(substr(text, i * 400 + 1, 500)) AS content FROM (SELECT doc_id, text, unnest(range(greatest(CAST(ceil((length(text) - 100) / 400.0) AS BIGINT), 1))) AS i FROM documents) WHERE trim(substr(text, i * 400 + 1, 500)) <> ''")
def spl_fixed_overlap(spark, d):
    """Slices of 500 characters, each with the last 100 of the one before."""
    return t(spark, d, "documents").select("doc_id", F.posexplode(sp.fixed_size(F.col("text"), 500, 100)).alias("chunk_index", "content"))


@query()
def spl_recursive(spark, d):
    return sp.split_documents(t(spark, d, "documents"), "recursive")


@query()
def spl_markdown(spark, d):
    return sp.split_documents(t(spark, d, "documents"), "markdown")


@query()
def spl_markdown_titles(spark, d):
    """Markdown chunks with the title and level of their highest header: documents' lines, of which every fourth is made a header."""
    line = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 4 == 1, F.concat(F.repeat(F.lit("#"), (1 + F.length(x) % 3).cast("int")), F.lit(" "), x)).otherwise(x))
    return sp.markdown_chunks(t(spark, d, "documents").select("doc_id", F.array_join(line, "\n").alias("text")), 400)


@query()
def spl_lines(spark, d):
    return sp.split_documents(t(spark, d, "documents"), "lines")


@query()
def spl_tokens(spark, d):
    return sp.split_documents(t(spark, d, "documents"), "tokens")


@query("""WITH l AS (SELECT doc_id, i AS pos, string_split('# ' || text, chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split('# ' || text, chr(10))) + 1)) AS i FROM documents)),
h AS (SELECT *, length(regexp_extract(line, '^(#{1,6})[ \t]+', 1)) AS level FROM l), s AS (SELECT *, sum((level > 0)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM h)
SELECT doc_id, section, level::INT AS level, trim(regexp_replace(line, '^#{1,6}[ \t]+', '')) AS title FROM s WHERE level > 0""")
def spl_headers(spark, d):
    """Headers and sections of each document, its first line made one."""
    return sp.header_lines(t(spark, d, "documents").withColumn("text", F.concat(F.lit("# "), F.col("text"))))


@query("""WITH e AS (SELECT vec_id // 10 AS doc_id, vec_id AS pos, embedding::DOUBLE[] AS v FROM embeddings), b AS (SELECT *, coalesce(list_cosine_similarity(lag(v) OVER (PARTITION BY doc_id ORDER BY pos), v) < 0.2, true) AS breaks FROM e)
SELECT doc_id, pos, breaks, sum(breaks::INT) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS chunk_index FROM b""")
def spl_semantic(spark, d):
    """Breaks where neighbouring vectors differ."""
    v = t(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("doc_id"), F.col("vec_id").alias("pos"), "embedding")
    return sp.semantic(v, 0.2).drop("embedding")


@query("""WITH p AS (SELECT doc_id, i AS pos, line AS t, length(line) AS n FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> ''),
q AS (SELECT *, row_number() OVER o - 1 AS i, lead(t) OVER o AS t1, lead(n) OVER o AS n1 FROM p WINDOW o AS (ORDER BY doc_id, pos)),
j AS (SELECT *, coalesce(n < 60 AND n + 1 + n1 <= 300, false) AS joins FROM q),
s AS (SELECT *, i - coalesce(max(CASE WHEN NOT joins THEN i + 1 END) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM j),
u AS (SELECT i, doc_id, pos, CASE WHEN joins THEN t || chr(10) || t1 ELSE t END AS t, NOT joins AND n < 60 AND n1 IS NOT NULL AS small FROM s WHERE off % 2 = 0),
b AS (SELECT *, coalesce(small AND lag(length(t)) OVER (ORDER BY i) + 1 + length(t) <= 300, false) AS back FROM u),
g AS (SELECT *, sum((NOT back)::INT) OVER (ORDER BY i) - 1 AS chunk_index FROM b)
SELECT chunk_index::BIGINT AS chunk_index, arg_min(doc_id, i) AS doc_id, arg_min(pos, i) AS pos, string_agg(t, chr(10) ORDER BY i) AS text FROM g GROUP BY chunk_index""")
def spl_merge_small(spark, d):
    """Lines of all documents in one pass: short ones join their neighbours, over documents' borders."""
    x = t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).filter(F.trim("text") != "")
    return scan.merge_small_chunks(x, ["doc_id", "pos"], 60, 300)


@query()
def spl_semantic_text(spark, d):
    """Documents by the semantic strategy with a stand-in embedding."""
    return sp.split_documents(t(spark, d, "documents"), "semantic", embed=HashEmbedding(64), size=300, threshold=0.2).drop("chunk_id")


@query()
def spl_json(spark, d):
    """Users' events by type as nested JSON, split at any depth."""
    e = t(spark, d, "events")
    one = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "props"))), lambda x: F.concat(F.lit('{"id": '), x["event_id"].cast("string"), F.lit(', "props": '), x["props"], F.lit("}")))
    kinds = e.groupBy("user_id", "event_type").agg(F.array_join(one, ", ").alias("events"))
    member = F.transform(F.array_sort(F.collect_list(F.struct("event_type", "events"))), lambda x: F.concat(F.lit('"'), x["event_type"], F.lit('": ['), x["events"], F.lit("]")))
    text = kinds.groupBy("user_id").agg(F.concat(F.lit('{"user": '), F.col("user_id").cast("string"), F.lit(', "kinds": {'), F.array_join(member, ", "), F.lit("}}")).alias("text"))
    return text.select("user_id", F.posexplode(sp.batched(sp.json_chunks, size=200)(F.col("text"))).alias("chunk_index", "content"))


@query("SELECT conv_id AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def src_full_text(spark, d):
    """Pages of a document joined in order."""
    return readers.full_text(t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text"))


@query("SELECT c_custkey, concat_ws('; ', 'c_name：' || c_name, 'c_nationkey：' || c_nationkey) AS line FROM customer")
def src_row_lines(spark, d):
    """Table rows as text."""
    c = t(spark, d, "customer")
    return c.select("c_custkey", readers.row_lines(c, ["c_name", "c_nationkey"]).alias("line"))


@query("SELECT c_custkey, concat_ws('; ', 'c_name：' || c_name, CASE WHEN c_custkey % 3 > 0 THEN 'c_nationkey：' || c_nationkey END) || CASE WHEN n_regionkey = 1 THEN '' ELSE ' ——' || n_name END AS line FROM customer JOIN nation ON c_nationkey = n_nationkey")
def src_sheet_lines(spark, d):
    """Rows of sheets as text with the sheets' names."""
    c = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.withColumn("c_nationkey", F.when(F.col("c_custkey") % 3 > 0, F.col("c_nationkey")))
    return c.select("c_custkey", readers.row_lines(c, ["c_name", "c_nationkey"], F.when(F.col("n_regionkey") == 1, "Sheet1").otherwise(F.col("n_name"))).alias("line"))


@query("""SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'pdf_layout' WHEN 1 THEN 'excel' WHEN 2 THEN 'ppt' WHEN 3 THEN 'figure' WHEN 4 THEN 'markdown' WHEN 5 THEN 'text' WHEN 6 THEN NULL ELSE NULL END AS parser, CASE doc_id % 8 WHEN 0 THEN CASE WHEN doc_id % 3 = 0 THEN 'pdf_vision' ELSE 'pdf_layout' END WHEN 1 THEN 'excel' WHEN 2 THEN 'ppt' WHEN 3 THEN 'figure' WHEN 4 THEN 'markdown' WHEN 5 THEN 'text' END AS by_mode FROM documents""")
def src_parsers(spark, d):
    """The parser of each file by its name."""
    names = F.element_at(F.array(*[F.lit(x) for x in ("pdf", "XLSX", "pptx", "jpeg", "Markdown", "csv", "exe", "")]), (F.col("doc_id") % 8 + 1).cast("int"))
    path = F.concat(F.lit("/a.b/"), "source", F.when(names == "", "").otherwise(F.concat(F.lit("."), names)))
    mode = F.when(F.col("doc_id") % 3 == 0, "Vision").otherwise("unknown")
    return t(spark, d, "documents").select("doc_id", readers.parser_of(path).alias("parser"), readers.parser_of(path, mode).alias("by_mode"))


@query("""WITH r AS (SELECT c_nationkey, c_custkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 16 AS part, '<tr><td>' || c_custkey || '</td><td>' || c_name || '</td></tr>' AS line FROM customer)
SELECT c_nationkey, part, '<table><tr><th>c_custkey</th><th>c_name</th></tr>' || string_agg(line, '' ORDER BY c_custkey) || '</table>' AS html FROM r GROUP BY ALL""")
def src_html_tables(spark, d):
    """Tables of 16 rows with the header repeated."""
    return readers.html_tables(t(spark, d, "customer"), "c_nationkey", "c_custkey", ["c_custkey", "c_name"], 16)


@query("SELECT count(*) AS n_rows, max(c_custkey) AS last_row FROM customer WHERE c_name <> ''")
def src_row_count(spark, d):
    """Rows that aren't blank, and the last of them."""
    return readers.row_extent(t(spark, d, "customer"), "c_custkey", ["c_name"])


@query("SELECT event_id, event_id % 5 > 0 AS jsonl FROM events")
def src_jsonl(spark, d):
    """Whether a text is JSON lines: ten lines, of which some are broken for every fifth event."""
    bad = F.when(F.col("event_id") % 5 == 0, F.lit("{oops")).otherwise(F.col("props"))
    text = F.array_join(F.array(*[F.col("props")] * 7, *[bad] * 3), "\n")
    return t(spark, d, "events").select("event_id", readers.is_jsonl(text).alias("jsonl"))


@query("SELECT doc_id AS id, source AS title, CASE WHEN doc_id % 2 = 0 THEN 'u' || doc_id ELSE 'l' || doc_id END AS url, lang AS content, n_chars::DOUBLE AS score FROM documents")
def src_search_hits(spark, d):
    """Hits of two providers under common names."""
    x = t(spark, d, "documents")
    one = F.to_json(F.struct(F.col("source").alias("title"), F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), F.col("lang").alias("content"), F.col("n_chars").alias("score")))
    two = F.to_json(F.struct(F.col("source").alias("title"), F.concat(F.lit("l"), F.col("doc_id").cast("string")).alias("link"), F.col("lang").alias("snippet"), F.col("n_chars").alias("score")))
    return readers.search_hits(x.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, one).otherwise(two).alias("raw")))


@query("""WITH l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents), h AS (SELECT *, regexp_matches(line, 'License[d]?') AS hit FROM l)
SELECT doc_id::VARCHAR AS file, line_no, line, hit FROM (SELECT *, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM h) WHERE near""")
def src_grep(spark, d):
    """Lines that match, each with its neighbours."""
    return readers.matching_lines(t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file"), "text"), "License[d]?", 1)


@query("SELECT source AS chunk_id, arg_max(doc_id, n_chars * 1000000 + doc_id) AS doc_id, max(n_chars * 1000000 + doc_id) AS version FROM documents GROUP BY source")
def snk_newest(spark, d):
    """One row of each chunk id, the newest, as an upsert keeps it."""
    return sinks.newest(t(spark, d, "documents").select(F.col("source").alias("chunk_id"), "doc_id", (F.col("n_chars") * 1000000 + F.col("doc_id")).alias("version")))


@query("SELECT doc_id AS document_id, chunk_id, n_chars FROM (SELECT doc_id, doc_id || '_0' AS chunk_id, n_chars FROM documents UNION ALL SELECT doc_id, doc_id || '_1', -n_chars FROM documents) WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def snk_delete(spark, d):
    """What a delete of the toxic documents leaves of a chunk table that was written twice."""
    x = t(spark, d, "documents")
    base = x.select(F.col("doc_id").alias("document_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("i"), "n_chars", F.lit(1).alias("space_id"), F.regexp_extract("source", r"(\d+)", 1).cast("int").alias("kb_id"))
    chunks = base.select(F.concat_ws("_", "document_id", "i").alias("chunk_id"), "document_id", F.when(F.col("i") == 0, F.col("n_chars")).otherwise(-F.col("n_chars")).alias("n_chars"), F.lit(1).alias("version"), "space_id", "kb_id")
    path = new_path(spark, "chunks")
    for _ in range(2):
        sinks.upsert(spark, chunks, path)
    sinks.delete(spark, t(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("document_id")), path)
    return spark.read.parquet(path).select("document_id", "chunk_id", "n_chars")


@query("SELECT 'good' AS kind, c_custkey::VARCHAR AS c_custkey, '\"' || c_name || '\", ' || chr(10) || 'Inc' AS c_name, CASE WHEN c_custkey % 5 <> 1 THEN c_nationkey::VARCHAR END AS c_nationkey, 0::BIGINT AS bad_lines FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT 'bad', NULL, NULL, NULL, count(*) FILTER (c_custkey % 7 = 0) FROM customer")
def src_csv_bad_lines(spark, d):
    """Customers as CSV with quoted cells over two lines, short lines and lines of too many cells: the good rows, and how many were bad."""
    k = F.col("c_custkey")
    name = F.concat(F.lit('"""'), "c_name", F.lit('"", \nInc"'))
    line = F.concat(k.cast("string"), F.lit(","), name, F.when(k % 5 == 1, "").otherwise(F.concat(F.lit(","), F.col("c_nationkey").cast("string"))), F.when(k % 7 == 0, F.when(k % 5 == 1, ",,").otherwise(",")).otherwise(""))
    customers = t(spark, d, "customer")
    path = new_path(spark, "csv")
    # a file with a header for each task
    n = F.row_number().over(Window.partitionBy(F.spark_partition_id()).orderBy("c_custkey"))
    customers.select(F.when(n == 1, F.concat(F.lit("c_custkey,c_name,c_nationkey\n"), line)).otherwise(line).alias("value")).write.text(path)
    good, bad = readers.lenient_csv(spark, path)
    counted = bad.agg(F.coalesce(F.sum("bad_lines"), F.lit(0)).alias("bad_lines")).select(F.lit("bad").alias("kind"), *[F.lit(None).cast("string").alias(c) for c in good.columns], "bad_lines")
    return good.select(F.lit("good").alias("kind"), *good.columns, F.lit(0).cast("long").alias("bad_lines")).unionByName(counted)


@query("WITH " + bm25_sql(k=5) + " SELECT query_id, chunk_id, rank FROM hits")
def snk_cached_search(spark, d):
    """Keyword hits through the cache: some queries are searched for first, then all, then all once more; the last answer comes from the table alone."""
    chunks, q = _chunks(spark, d), _queries(spark, d)
    keyed = q.withColumn("key", cache.cache_key(F.col("query"), F.col("query_id"), F.lit("bm25"), F.lit(5)))
    held = cache.ResultCache(spark, new_path(spark, "cache"))

    def search(missing):
        return bm25(chunks, missing.select("query_id", "query"), 5).join(missing.select("query_id", "key"), "query_id").select("key", "query_id", "chunk_id", "rank")

    def none(missing):
        raise AssertionError("the cache has all queries")

    held.get_or_compute(keyed.filter("length(query) % 2 = 0"), search)
    held.get_or_compute(keyed, search)
    return held.get_or_compute(keyed, none).select("query_id", "chunk_id", "rank")


@query("SELECT doc_id, md5(lang || '|' || source || '|' || n_chars) AS key FROM documents")
def snk_cache_key(spark, d):
    """A cache key over all parameters of a search."""
    return t(spark, d, "documents").select("doc_id", F.md5(F.concat_ws("|", "lang", "source", F.col("n_chars").cast("string"))).alias("key"))


@query("SELECT l_orderkey AS document_id, l_linenumber AS chunk_index, l_partkey AS chunk_id, total FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS total, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn BETWEEN 2 AND 3")
def snk_chunk_pages(spark, d):
    """The second page (of two rows, after the first) of each document's chunks, with the total."""
    x = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("chunk_index"), F.col("l_partkey").alias("chunk_id"))
    return sinks.chunk_pages(x, 1, 2)


@query(SQL["spl_fixed"])
def snk_full_texts(spark, d):
    """Chunks of parsed texts that were saved before: what spl_fixed makes of the documents themselves."""
    return sp.split_documents(sinks.save_full_texts(t(spark, d, "documents"), new_path(spark, "texts")), "fixed")


@query()
def spl_html(spark, d):
    """Pages as chunks of blocks, then tables."""
    return sp.split_documents(t(spark, d, "pages"), "html", "html", "page_id")


@query()
def spl_files(spark, d):
    """Each document by the strategy of its file's extension."""
    x = t(spark, d, "documents")
    return sp.split_files(x.withColumn("source", F.concat("source", F.when(F.col("lang") == "en", ".md").otherwise(".txt"))))


_TABLE = "'|a|b|' || chr(10) || '|---|---|' || chr(10) || '|1|' || doc_id || '|' || chr(10) || '|2|y|' || chr(10)"


@query(f"SELECT doc_id, {_TABLE} AS tables, text || chr(10) || chr(10) || chr(10) || 'end' AS rest FROM (SELECT doc_id, replace(replace(text, '|', ' '), '<', ' ') AS text FROM documents)")
def spl_markdown_tables(spark, d):
    """Tables of Markdown texts and the texts without them: documents with one table each."""
    table = F.concat(F.lit("|a|b|\n|---|---|\n|1|"), F.col("doc_id").cast("string"), F.lit("|\n|2|y|\n"))
    x = t(spark, d, "documents").select("doc_id", F.concat(F.translate("text", "|<", "  "), F.lit("\n"), table, F.lit("\nend")).alias("text"))
    out = x.select("doc_id", ly.markdown_tables(F.col("text")).alias("m"))
    return out.select("doc_id", F.ltrim(F.array_join("m.tables", "\n"), F.lit("\n")).alias("tables"), "m.rest")


_KINDS = r"""CASE WHEN fenced THEN 'code' WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(line, '^#{1,6}\s+\S') THEN 'header' WHEN regexp_matches(line, '^\s*([-*+]|\d+[.)])\s+') THEN 'list'
  WHEN regexp_matches(line, '^\s*>') THEN 'quote' WHEN regexp_matches(line, '^\s*\|.*\|') THEN 'table' ELSE 'text' END"""


@query(f"""WITH d AS (SELECT doc_id, '# ' || text || chr(10) || '```' || chr(10) || '- code' || chr(10) || '```' || chr(10) || '- item' || chr(10) || '> quoted' AS text FROM documents),
l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM d),
m AS (SELECT *, regexp_matches(line, '^[ \t]{{0,3}}(```|~~~)') AS mark, coalesce(sum(regexp_matches(line, '^[ \t]{{0,3}}(```|~~~)')::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l),
k AS (SELECT *, {_KINDS} AS kind FROM (SELECT *, mark OR before % 2 = 1 AS fenced FROM m)),
n AS (SELECT *, (lag(kind) OVER (PARTITION BY doc_id ORDER BY pos) IS DISTINCT FROM kind OR kind = 'header' OR (mark AND before % 2 = 0)) AS new FROM k),
i AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM n)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY island) - 1 AS element, kind, min(pos) AS start_line, max(pos) AS end_line, string_agg(line, chr(10) ORDER BY pos) AS content FROM i WHERE kind <> 'blank' GROUP BY doc_id, island, kind""")
def spl_markdown_elements(spark, d):
    """Elements of documents with a header, a fenced block, a list and a quote."""
    x = t(spark, d, "documents")
    return ly.markdown_elements(x.select("doc_id", F.concat(F.lit("# "), "text", F.lit("\n```\n- code\n```\n- item\n> quoted")).alias("text")))


@query("""WITH r AS (SELECT l_orderkey AS doc_id, l_partkey % 50 AS start, l_partkey % 50 + l_quantity AS stop FROM lineitem),
f AS (SELECT *, max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM r),
i AS (SELECT *, sum((far IS NULL OR start > far)::INT) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM f) SELECT doc_id, min(start) AS start, max(stop) AS stop FROM i GROUP BY doc_id, island""")
def spl_merged_ranges(spark, d):
    """Ranges that touch or overlap as one."""
    x = t(spark, d, "lineitem")
    start = F.col("l_partkey") % 50
    return ly.merged_ranges(x.select(F.col("l_orderkey").alias("doc_id"), start.alias("start"), (start + F.col("l_quantity")).alias("stop")))


@query()
def spl_packed_entries(spark, d):
    """Conversations as reading orders: turns packed into chunks of 500 characters with their kinds, sources and pages."""
    c = t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.col("role").alias("kind"), F.concat_ws("-", "conv_id", "turn").alias("source_id"), F.floor(F.col("turn") / 2).alias("page"), "text")
    x = ly.packed_entries(c, 500)
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return x.select("doc_id", "chunk_index", "content", join("entry_kinds").alias("kinds"), join("entry_source_ids").alias("sources"), join("pages").alias("pages"), "entry_count")


@query()
def spl_html_table(spark, d):
    """Tables of customers cut by a budget of tokens."""
    x = readers.html_tables(t(spark, d, "customer"), "c_nationkey", "c_custkey", ["c_custkey", "c_name"], 64)
    return x.select("c_nationkey", "part", F.posexplode(ly.split_table(F.col("html"), 60)).alias("piece", "html"))


def _words(spark, d):
    """Lines of an order as words on a page: the flags as tops, the quantities as places."""
    x = t(spark, d, "lineitem")
    top = F.col("l_linenumber") % 2 * 2 + F.when(F.col("l_returnflag") == "N", 0).otherwise(40)
    return x.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 3).alias("page"), F.col("l_partkey").cast("string").alias("text"), (F.col("l_quantity") * 4).alias("x0"), (F.col("l_quantity") * 4 + 20).alias("x1"), top.alias("top"), (top + 10).alias("bottom"))


@query()
def wn_lines(spark, d):
    """Words of a page as lines: a fold, held against a plain loop in the tests."""
    return ly.lines_of_words(_words(spark, d))


@query()
def wn_contents(spark, d):
    """Documents' lines as boxes, with a contents page before them, which goes."""
    x = t(spark, d, "documents")
    head = F.array(F.lit("Contents"), F.substring("text", 1, 12), F.lit("second entry"), F.lit("third entry"))
    return ly.without_contents(x.select("doc_id", F.posexplode(F.concat(head, F.split("text", "\n"))).alias("pos", "text")).withColumn("page", F.floor(F.col("pos") / 40).cast("int")).select("doc_id", "pos", "page", "text"))


@query()
def wn_without_overlaps(spark, d):
    """Boxes of a page by falling score; those over kept ones go."""
    x = _words(spark, d).withColumns({"page": F.col("doc_id"), "id": F.concat_ws("-", "page", "text", "x0"), "score": F.crc32("text") % 97, "kind": F.col("page")})
    return ly.without_overlaps(x.dropDuplicates(["page", "kind", "id"]).drop("doc_id"), 0.3).select("page", "kind", "id")


@query("""WITH w AS (SELECT l_orderkey AS page, l_linenumber AS id, l_quantity * 4 AS x0, l_quantity * 4 + 20 AS x1 FROM lineitem),
r AS (SELECT l_orderkey AS page, CASE l_linenumber % 3 WHEN 0 THEN 'footer' WHEN 1 THEN 'title' ELSE 'text' END AS label, l_quantity * 4 - 8 AS x0, l_quantity * 4 + 12 AS x1 FROM lineitem),
m AS (SELECT w.page, w.id, label, (least(w.x1, r.x1) - greatest(w.x0, r.x0)) / 20.0 AS share FROM w JOIN r ON w.page = r.page WHERE (least(w.x1, r.x1) - greatest(w.x0, r.x0)) / 20.0 >= 0.4),
b AS (SELECT page, id, label, row_number() OVER (PARTITION BY page, id ORDER BY CASE label WHEN 'footer' THEN 1 WHEN 'title' THEN 2 ELSE 3 END, share DESC) AS rn FROM m)
SELECT w.page, w.id, label FROM w LEFT JOIN (SELECT * FROM b WHERE rn = 1) b USING (page, id) WHERE label IS NULL OR label <> 'footer'""")
def jn_labelled(spark, d):
    """Boxes with the label of the region that covers them, by the labels' priority."""
    x = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("id"), (F.col("l_quantity") * 4).alias("x0"), F.lit(0).alias("top"), F.lit(10).alias("bottom"))
    boxes = x.withColumn("x1", F.col("x0") + 20)
    label = F.when(F.col("id") % 3 == 0, "footer").when(F.col("id") % 3 == 1, "title").otherwise("text")
    regions = x.select("page", label.alias("label"), (F.col("x0") - 8).alias("x0"), (F.col("x0") + 12).alias("x1"), "top", "bottom")
    return ly.labelled(boxes, regions, ["footer", "title", "text"]).select("page", "id", "label")
