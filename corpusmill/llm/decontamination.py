"""Benchmark decontamination by a distributed positional inverted index.

1. Items become windows of `window` consecutive words (a shorter item is one window).
2. The corpus frequency of every word of the items is counted (words of the items only).
3. Each window takes its `rarest` rarest words as anchors.  Windows of one item with the same anchors share
   one probe, as all of them lie at the same alignment of item and document.
4. Postings (term, document, positions) of the anchor terms are stored.
5. The lists of a probe, rarest first, are shifted by the words' places in the item and
   intersected: what is left are alignments of item and document at which all anchors match.
6. Each window of the probe is compared word by word at its place in the document, which gives the exact
   phrase matches.  Proximity matches stop before that: all anchors of a probe within a stretch of the
   document, in any order.

The lists of a very common word are as long as the word is common; they're dealt by (term,
document), never gathered, and met by broadcast tables of the benchmark or under salts.  A text of any length is indexed
whole.  Documents are known by (doc_id, hash of text): rows that
agree in both share their result.  Defined results: a null text has no words; a null or empty
item has no window; an empty table gives an empty result; extra columns are kept out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, stored

#: Words of the contract: anything but ASCII controls, space and punctuation, lower-cased in A-Z only.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Benchmark tables up to this many rows (about 100 bytes each) are broadcast, larger ones are joined by shuffles.
MAX_BROADCAST_ROWS = 200_000
#: Probes with their windows' words (some kilobytes each, as a probe has up to ten windows of ten words) up to this many are broadcast.
MAX_BROADCAST_PROBES = 20_000
#: Tasks that a very common word's occurrences are dealt to in such a shuffle.
SALTS = 64


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), lambda w: w != "")


def met_by_term(rows: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """rows (term, doc, key, ...) joined with a table of the benchmark's terms.

    A table over the bound of a broadcast is repeated for each salt of the documents, so that no task gets all of a word's rows.
    """
    if table.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        return rows.join(F.broadcast(table), "term", how)
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc", "key"), F.lit(SALTS)).cast("int")).join(salted, ["term", "salt"], how).drop("salt")


def item_windows(benchmark: DataFrame, window: int = 10) -> DataFrame:
    """(item_id, at, words): `at` is the window's place in the item."""
    items = benchmark.select("item_id", tokens(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    return items.select("item_id", F.explode(starts).alias("at"), "w").select("item_id", "at", F.slice("w", F.col("at") + 1, F.lit(window)).alias("words")).distinct()


def corpus_frequency(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): occurrences in the corpus of each of the given terms."""
    seen = met_by_term(docs.select("doc", "key", F.explode(tokens(F.col("text"))).alias("term")), terms, "left_semi")
    counts = seen.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return terms.join(counts, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def probes(windows: DataFrame, frequency: DataFrame, rarest: int = 3) -> DataFrame:
    """(probe, anchors, windows): anchors are structs (n, place, term), rarest first; windows are structs (item_id, at, words)."""
    word = windows.select("item_id", "at", "words", F.posexplode("words").alias("i", "term")).join(frequency, "term")
    anchor = F.struct("n", (F.col("at") + F.col("i")).alias("place"), "term")
    picked = word.groupBy("item_id", "at", "words").agg(F.slice(F.sort_array(F.collect_list(anchor)), 1, rarest).alias("anchors"))
    out = picked.groupBy("item_id", "anchors").agg(F.collect_list(F.struct("item_id", "at", "words")).alias("windows"))
    # a window with a word that the corpus lacks can't occur
    return out.filter(F.col("anchors")[0]["n"] > 0).select(F.sha2(F.to_json(F.struct("item_id", "anchors")), 256).alias("probe"), "anchors", "windows")


def build_index(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Postings (term, doc, key, places): the positions of each term in each document, of all terms or of those given.

    A list is as long as a term is frequent in one document; a term's lists are dealt by document.
    """
    rows = docs.select("doc", "key", F.posexplode(tokens(F.col("text"))).alias("place", "term"))
    if terms is not None:
        rows = met_by_term(rows, terms, "left_semi")
    return rows.groupBy("term", "doc", "key").agg(F.collect_set("place").alias("places"))


def alignments(index: DataFrame, probe: DataFrame, rarest: int = 3) -> DataFrame:
    """(probe, doc, key, starts): where in a document the item would start so that all anchors match."""
    lists = index.select("term", "doc", "key", "places")
    shifted = lambda places, at: F.transform(places, lambda p: p - at)
    first = probe.select("probe", "anchors", F.col("anchors")[0]["term"].alias("term"))
    found = met_by_term(lists, first).select("probe", "anchors", "doc", "key", shifted(F.col("places"), F.col("anchors")[0]["place"]).alias("starts"))
    for k in range(1, rarest):
        done = found.filter(F.size("anchors") <= k)
        more = found.filter(F.size("anchors") > k).withColumn("term", F.col("anchors")[k]["term"])
        kept = F.array_intersect("starts", shifted(F.col("places"), F.col("anchors")[k]["place"]))
        more = more.join(lists, ["term", "doc", "key"]).withColumn("starts", kept).filter(F.size("starts") > 0)
        found = done.unionByName(more.select(*done.columns))
    return found.select("probe", "doc", "key", "starts")


def keyed_documents(docs: DataFrame) -> DataFrame:
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.select("doc_id", doc.alias("doc"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("key"), "text")


def phrase_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, rarest: int = 3) -> DataFrame:
    """(doc, key, n_words, hits) of documents with an exact match; hits are structs (item_id, start, length) in words."""
    windows = stored(item_windows(benchmark, window), "bench-windows")
    terms = windows.select(F.explode("words").alias("term")).distinct()
    frequency = stored(corpus_frequency(docs, terms), "bench-frequency")
    probe = stored(probes(windows, frequency, rarest), "bench-probes")
    anchors = probe.select(F.explode("anchors.term").alias("term")).distinct()
    index = stored(build_index(docs, anchors), "bench-postings")
    found = alignments(index, probe, rarest).join(bounded_broadcast(probe.select("probe", "windows"), MAX_BROADCAST_PROBES), "probe")
    place = F.explode(F.flatten(F.transform("starts", lambda s: F.transform("windows", lambda x: F.struct(x["item_id"].alias("item_id"), (s + x["at"]).alias("start"), F.array_join(x["words"], " ").alias("phrase"), F.size(x["words"]).alias("length"))))))
    candidate = found.select("doc", "key", place.alias("c")).filter("c.start >= 0")
    # candidates of a document: places of the rarest words of items, each once
    gathered = stored(candidate.distinct().groupBy("doc", "key").agg(F.collect_list("c").alias("candidates")), "bench-candidates")
    texts = docs.select("doc", "key", "text").join(bounded_broadcast(gathered.select("doc", "key"), MAX_BROADCAST_ROWS), ["doc", "key"], "left_semi").dropDuplicates(["doc", "key"])
    there = lambda w: F.filter("candidates", lambda c: F.array_join(F.slice(w, c["start"] + 1, c["length"]), " ") == c["phrase"])
    hits = F.element_at(F.transform(F.array(tokens(F.col("text"))), there), 1)
    hits = F.transform(hits, lambda c: F.struct(c["item_id"].alias("item_id"), c["start"].alias("start"), c["length"].alias("length")))
    return texts.join(gathered, ["doc", "key"]).select("doc", "key", hits.alias("hits")).filter(F.size("hits") > 0)


def proximity_matches(docs: DataFrame, benchmark: DataFrame, within: int = 20, window: int = 10, rarest: int = 3) -> DataFrame:
    """(item_id, at, doc_id): documents where all anchors of an item's window lie within `within` words of the rarest one, in any order."""
    docs = keyed_documents(docs)
    windows = stored(item_windows(benchmark, window), "near-windows")
    frequency = stored(corpus_frequency(docs, windows.select(F.explode("words").alias("term")).distinct()), "near-frequency")
    probe = stored(probes(windows, frequency, rarest), "near-probes")
    index = stored(build_index(docs, probe.select(F.explode("anchors.term").alias("term")).distinct()), "near-postings")
    lists = index.select("term", "doc", "key", "places")
    found = met_by_term(lists.withColumnRenamed("places", "near"), probe.withColumn("term", F.col("anchors")[0]["term"])).drop("term")
    for k in range(1, rarest):
        done, more = found.filter(F.size("anchors") <= k), found.filter(F.size("anchors") > k).withColumn("term", F.col("anchors")[k]["term"])
        close = F.filter("near", lambda p: F.exists("places", lambda q: F.abs(p - q) < within))
        more = more.join(lists, ["term", "doc", "key"]).withColumn("near", close).filter(F.size("near") > 0)
        found = done.unionByName(more.select(*done.columns))
    hit = found.select("doc", "key", F.explode("windows").alias("w")).select("doc", "key", "w.item_id", "w.at")
    return docs.select("doc_id", "doc", "key").join(hit, ["doc", "key"]).select("item_id", "at", "doc_id").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, rarest: int = 3) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted as strings), spans of the hits, contaminated: a row for each row of docs (doc_id, text)."""
    keyed = keyed_documents(docs)
    found = phrase_matches(keyed, benchmark, window, rarest)
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["length"] - 1)))))
    items = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item_id"].cast("string"))))
    found = found.select("doc", "key", covered.alias("n_hit"), items.alias("item_ids"), F.col("hits").alias("spans"))
    counted = keyed.select("doc_id", "doc", "key", F.size(tokens(F.col("text"))).cast("long").alias("n_words"))
    out = counted.join(found, ["doc", "key"], "left")
    none = F.array().cast("array<string>")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"), "spans", (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.array_join("item_ids", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


OP2_SQL = r"""
WITH tok AS (SELECT doc_id, text, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
it AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS phrase FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM it WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
pos AS (SELECT DISTINCT doc_id, text, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (SELECT doc_id, text, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM tok, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, text, item_id, i, win.n FROM pos JOIN win ON pos.phrase = win.phrase AND pos.n = win.n),
cov AS (SELECT doc_id, text, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, text, unnest(range(i, i + n)) AS p FROM hit) GROUP BY ALL),
ids AS (SELECT doc_id, text, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM hit GROUP BY ALL)
SELECT tok.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM tok LEFT JOIN cov ON tok.doc_id = cov.doc_id AND tok.text = cov.text LEFT JOIN ids ON tok.doc_id = ids.doc_id AND tok.text = ids.text
"""
