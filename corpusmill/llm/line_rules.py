"""Quality rules with cross-document line frequency.

Per document, in one pass over its text: words, their characters, symbols, repeated lines and words in
repeated three-word windows.  Across documents: every line is normalised (lower case, digits to 0,
runs of white space to one space) and hashed; for each host the distinct documents holding a line
are counted; lines in more documents than the host's limit are removed; a document that keeps too
few of its words is rejected.  The limit is a share of the host's documents, from a floor of a few documents on, as
one or two documents say nothing of boilerplate; a host of fewer documents than the floor loses no line.

Defined results: a null text has no words and fails the base rules; a null host is a host of its own;
rows that agree in doc_id, host and text are one document and share its result; a line without a
word is never counted; an empty table gives an empty result; a text of any length is cut whole into lines; extra
columns are kept out of the statistics and, whatever their names, kept by the removal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, fresh, n_words, stored, words

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: Frequent lines up to this many (about 40 bytes each) are broadcast to their postings, more are joined by a shuffle.
MAX_BROADCAST_LINES = 500_000


def repeated_window_words(w: Column, width: int = 3) -> Column:
    """Words of the array w inside a window of `width` words that occurs twice or more in it, the first occurrence included.

    Windows are compared by a 64-bit hash within one document.  They are sorted by hash, so that equal ones
    are neighbours; the documents without any repeated window, which are most, aren't sorted.
    """
    starts = F.sequence(F.lit(1), F.size(w) - (width - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(width)]))
    hashes = F.when(F.size(w) >= width, hashes).otherwise(F.array().cast("array<bigint>"))

    def repeated(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.filter(F.zip_with(pairs, F.slice(pairs, 2, F.size(h)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))), lambda x: x.isNotNull())

    def covered(h: Column) -> Column:
        hit = F.flatten(repeated(h))
        return F.size(F.array_distinct(F.flatten(F.transform(hit, lambda i: F.sequence(i, i + (width - 1))))))

    # transform over a one-element array gives the hashes a name, so that they are made once
    return F.element_at(F.transform(F.array(hashes), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))), 1)


def base_statistics(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed in place of text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    per_text = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_window_words(w).cast("long").alias("n_repeat_words"))
    out = docs.withColumn("_w", F.element_at(F.transform(F.array(words(text)), per_text), 1))
    out = out.withColumns(
        {
            "n_words": F.col("_w.n_words"),
            "word_chars": F.length(F.translate(text, BLANKS, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": F.element_at(F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x))), 1).cast("long"),
            "n_repeat_words": F.col("_w.n_repeat_words"),
        }
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("_w", "text")


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.lower(line), "123456789", "000000000"), r"[ \t\x0B\f\r]+", " "))


def keyed_documents(docs: DataFrame) -> DataFrame:
    """docs as id (the doc_id), doc_id (as text), key (a hash of the text), host and text."""
    host = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source")))
    return docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("doc_id").alias("id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("key"), host.alias("host"), "text")


def frequent_postings(keyed: DataFrame, least_docs: int, host_share: float) -> DataFrame:
    """(host, h, doc_id, key, n): the lines, with their words, that least_docs and over host_share of the host's documents hold."""
    line = keyed.select("doc_id", "key", "host", F.explode(F.split(F.col("text"), "\n")).alias("line"))
    line = line.select("doc_id", "key", "host", F.xxhash64(normal_line(F.col("line"))).alias("h"), n_words(F.col("line")).alias("n")).filter("n > 0")
    # one row for each document and line: repeats within a document count once towards the documents
    held = stored(line.groupBy("host", "h", "doc_id", "key").agg(F.sum("n").alias("n")), "line-postings")
    sizes = keyed.select("host", "doc_id", "key").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    often = held.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") >= least_docs)
    often = stored(often.join(sizes, "host").filter(F.col("n_docs") > F.lit(host_share) * F.col("host_docs")).select("host", "h"), "line-frequent")
    # the postings of a frequent line are as many as it is frequent, so they had better not be dealt by it
    return held.join(bounded_broadcast(often, MAX_BROADCAST_LINES), ["host", "h"])


def quality_rules(docs: DataFrame, least_docs: int = 5, host_share: float = 0.02, min_left: float = 0.3) -> DataFrame:
    """docs (doc_id, source, text) with the base statistics, n_removed, n_left and kept.

    kept: the base rules pass and at least min_left of the words stay after frequent lines are removed.
    """
    keyed = keyed_documents(docs)
    removed = frequent_postings(keyed, least_docs, host_share).groupBy("doc_id", "key", "host").agg(F.sum("n").alias("n_removed"))
    out = base_statistics(keyed).join(removed, ["doc_id", "key", "host"], "left")
    n_removed = F.coalesce("n_removed", F.lit(0)).cast("long")
    out = out.withColumn("n_removed", n_removed).withColumn("n_left", F.col("n_words") - F.col("n_removed"))
    kept = ~F.col("base_failed") & (F.col("n_left") >= F.lit(min_left) * F.col("n_words"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed", "n_left", kept.alias("kept"))


def without_frequent_lines(docs: DataFrame, least_docs: int = 5, host_share: float = 0.02) -> DataFrame:
    """docs (doc_id, source, text) with the text rid of its host's frequent lines: the removal itself, whose counts quality_rules reports."""
    doc, key, host, lines = fresh(docs, "doc", "key", "host", "lines")
    gone = frequent_postings(keyed_documents(docs), least_docs, host_share).groupBy("doc_id", "key", "host").agg(F.collect_set("h").alias(lines))
    gone = gone.withColumnsRenamed({"doc_id": doc, "key": key, "host": host})
    site = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source")))
    rows = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("string"), F.lit("")), key: F.coalesce(F.xxhash64("text"), F.lit(0)), host: site})
    left = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(lines, F.xxhash64(normal_line(x))))
    text = F.when(F.col(lines).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return rows.join(gone, [doc, key, host], "left").withColumn("text", text).select(*docs.columns)


def op8_line_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, text AS raw, source FROM documents),
w AS (SELECT *, string_split_regex(trim(text, e' \t\n\x0b\x0c\r'), '[\x20\x09-\x0D]+') AS w0 FROM d),
v AS (SELECT *, list_filter(w0, lambda x: x <> '') AS w, list_filter(string_split(text, e'\n'), lambda x: translate(x, e' \t\n\x0b\x0c\r', '') <> '') AS ls FROM w),
b AS (SELECT doc_id, raw, source, len(w) AS n_words, length(translate(text, e' \t\n\x0b\x0c\r', '')) AS word_chars,
  length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, w FROM v),
k AS (SELECT DISTINCT doc_id, source, raw FROM b),
t AS (SELECT k.doc_id, k.source, k.raw, unnest(range(1, len(b.w) - 1)) AS i, b.w FROM k JOIN (SELECT DISTINCT raw, w FROM b) b ON k.raw = b.raw),
g AS (SELECT doc_id, source, raw, i, count(*) OVER (PARTITION BY doc_id, source, raw, w[i], w[i + 1], w[i + 2]) AS c FROM t),
r AS (SELECT doc_id, source, raw, count(DISTINCT p) AS n FROM (SELECT doc_id, source, raw, unnest([i, i + 1, i + 2]) AS p FROM g WHERE c > 1) GROUP BY ALL),
l0 AS (SELECT doc_id, source, raw, unnest(string_split(raw, e'\n')) AS line FROM k WHERE raw IS NOT NULL),
l AS (SELECT doc_id, source, raw, trim(regexp_replace(translate(lower(line), '123456789', '000000000'), '[ \t\x0B\f\r]+', ' ', 'g')) AS h,
  len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l0),
held AS (SELECT source, h, doc_id, raw, sum(n) AS n FROM l WHERE n > 0 GROUP BY ALL),
hs AS (SELECT source, count(*) AS host_docs FROM k GROUP BY source),
o AS (SELECT held.source, h FROM held JOIN hs ON held.source IS NOT DISTINCT FROM hs.source GROUP BY held.source, h HAVING count(*) >= 5 AND count(*) > 0.02 * any_value(host_docs)),
m AS (SELECT doc_id, held.source, raw, sum(n)::BIGINT AS n_removed FROM held JOIN o ON held.h = o.h AND held.source IS NOT DISTINCT FROM o.source GROUP BY ALL),
s AS (SELECT b.*, coalesce(r.n, 0) AS n_repeat_words, coalesce(m.n_removed, 0) AS n_removed FROM b
  LEFT JOIN r ON b.doc_id IS NOT DISTINCT FROM r.doc_id AND b.source IS NOT DISTINCT FROM r.source AND b.raw = r.raw
  LEFT JOIN m ON b.doc_id IS NOT DISTINCT FROM m.doc_id AND b.source IS NOT DISTINCT FROM m.source AND b.raw = m.raw)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, n_removed, (n_words - n_removed)::BIGINT AS n_left,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed >= 0.3 * n_words AS kept FROM s
"""
