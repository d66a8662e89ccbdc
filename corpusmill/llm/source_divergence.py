"""Source divergence audit: how the words of each source differ from those of the other sources of its language.

1. Vocabulary.  Every text is cut into terms, once; documents that hold a term are counted exactly, by language.  A language
   keeps the terms of at least `min_documents` of its documents.
2. Counts.  A second pass finds all occurrences of the kept terms, each padded with a delimiter on both sides, by an
   Aho-Corasick automaton for each language, over texts whose delimiters are blanks.  Neighbours share a blank, and a
   padded term lies in no other, so each occurrence is found once.  Automata hold `block_terms` terms at most; a larger vocabulary
   is dealt to blocks by hash and the texts are read once for each, so what goes to the tasks stays bounded.
3. Postings (lang, source, term, count), of terms that occur, carry the shares p = 1 + floor(1e9 (count + 5) / (N + 5 V)).  A term that doesn't
   occur has the group's least share, so the postings say all.
4. Pairs.  Postings are dealt by term to blocks, and by source to tiles of some hundred sources; each block sums |p - q| over its
   terms for all pairs of two tiles at once.  The result has a row for each pair of sources, so its size is that of the answer.
5. Ranks by value, ties by the item's UTF-8 bytes.

Defined results: null text, lang and source are empty strings; a language without a kept term has pairs of value 0; a group without
terms takes part with its least shares; repeated rows and rows of equal doc_id are documents of their own; texts of any length
are searched whole, in pieces that end at a delimiter; an empty table gives an empty result; extra columns are kept out.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, small_batches, stored

#: Bytes as both passes read them: delimiters are blanks, A-Z lower-cased; all beyond ASCII belongs to terms.
FOLD = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
PIECE = 1 << 20
#: Counts that a task holds before it hands them on.
HELD = 1 << 20
SMOOTH, WHOLE = 5, 1_000_000_000
#: Groups up to this many (about 100 bytes each) are broadcast.
MAX_BROADCAST_GROUPS = 100_000
#: Sources of a tile, and postings of a block.
TILE, BLOCK = 256, 1 << 18
#: Terms whose shares lie in one matrix.
AT_ONCE = 256

plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)


def pieces(text: str, size: int = PIECE) -> list[bytes]:
    """A text as both passes read it: folded, with blanks around; a long one in pieces that end at a blank."""
    data, out, at = b" " + text.encode().translate(FOLD) + b" ", [], 0
    while at < len(data) - 1:
        end = data.rfind(b" ", at + 1, at + size) if len(data) - at > size else len(data) - 1
        if end < 0:
            end = data.find(b" ", at + size)
        out.append(data[at : end + 1])
        at = end  # the next piece begins with the same blank
    return out


def frequency_batches(batches):
    """For each language and term the documents of a partition that hold it."""
    import pyarrow as pa

    held: dict[str, Counter] = defaultdict(Counter)

    def flush():
        for lang, own in held.items():
            terms, n = pa.array(list(own), pa.binary()).cast(pa.string()), pa.array(list(own.values()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), terms, n], names=["lang", "term", "n"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            cut = pieces(text)
            held[lang].update(set(cut[0].split()) if len(cut) == 1 else set().union(*(p.split() for p in cut)))
        if sum(map(len, held.values())) > HELD:
            yield from flush()
            held.clear()
    yield from flush()


def kept_terms(docs: DataFrame, min_documents: int) -> DataFrame:
    """(lang, term, documents): terms of enough documents of their language."""
    counted = docs.select("lang", "text").mapInArrow(frequency_batches, "lang string, term string, n long")
    return counted.groupBy("lang", "term").agg(F.sum("n").alias("documents")).filter(F.col("documents") >= min_documents)


def count_batches(block):
    """Occurrences of a block's terms by language and source; the numbers of terms are their places in the block."""

    def count(batches):
        import ahocorasick
        import pyarrow as pa

        automata = {}
        for lang, terms in block.value.items():
            automata[lang] = ahocorasick.Automaton()
            for number, term in terms:
                automata[lang].add_word(" " + term.encode().decode("latin-1") + " ", number)
            automata[lang].make_automaton()
        groups: dict[tuple[str, str], int] = {}
        sums, fresh, n_fresh = [np.zeros(0, dtype=np.int64)] * 2, [], 0  # codes (group << 32 | number) with their counts; codes still to count

        def counted():
            codes, times = np.unique(np.concatenate(fresh), return_counts=True) if fresh else (sums[0][:0], sums[1][:0])
            codes, place = np.unique(np.concatenate([sums[0], codes]), return_inverse=True)
            return [codes, np.bincount(place, weights=np.concatenate([sums[1], times]), minlength=len(codes)).astype(np.int64)]

        def flush():
            if len(sums[0]):
                of = pa.array(sums[0] >> 32)
                names = [pa.array([g[k] for g in groups], pa.string()).take(of) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*names, pa.array((sums[0] & 0xFFFFFFFF).astype(np.int32)), pa.array(sums[1])], names=["lang", "source", "number", "n"])

        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                if lang not in automata:
                    continue
                group = groups.setdefault((lang, source), len(groups)) << 32
                for p in pieces(text):
                    fresh.append(np.array([number for _, number in automata[lang].iter(p.decode("latin-1"))], dtype=np.int64) | group)
                    n_fresh += len(fresh[-1])
                if n_fresh > 4 * HELD:
                    sums, fresh, n_fresh = counted(), [], 0
                    if len(sums[0]) > HELD:
                        yield from flush()
                        sums = [np.zeros(0, dtype=np.int64)] * 2
        sums = counted()
        yield from flush()

    return count


def postings(docs: DataFrame, kept: DataFrame, block_terms: int) -> DataFrame:
    """(lang, source, term, count) of kept terms that occur."""
    spark, out = docs.sparkSession, None
    n_blocks = -(-kept.count() // block_terms)
    block = F.pmod(F.xxhash64("lang", "term"), F.lit(n_blocks)) if n_blocks else F.lit(0)
    for b in range(n_blocks):
        rows = sorted((r["lang"], r["term"]) for r in kept.filter(block == b).select("lang", "term").toLocalIterator())
        terms = defaultdict(list)
        for number, (lang, term) in enumerate(rows):
            terms[lang].append((number, term))
        counted = docs.mapInArrow(count_batches(spark.sparkContext.broadcast(dict(terms))), "lang string, source string, number int, n long").groupBy("lang", "source", "number").agg(F.sum("n").alias("count"))
        names = spark.createDataFrame([(number, term) for number, (_, term) in enumerate(rows)], "number int, term string")
        counted = counted.join(F.broadcast(names), "number").select("lang", "source", "term", "count")  # block_terms rows at most, by definition
        out = counted if out is None else out.unionByName(counted)
    return spark.createDataFrame([], "lang string, source string, term string, count long") if out is None else out


def share(count: str, n: str, v: str):
    """1 + floor(1e9 (count + 5) / (n + 5 v)), exact beyond 64 bits."""
    return F.expr(f"1 + cast({WHOLE} * cast({count} + {SMOOTH} as decimal(28, 0)) div cast({n} + {SMOOTH} * {v} as decimal(28, 0)) as bigint)")


def pair_sums(key, ours, groups):
    """Sums of |p - q| over a block's terms for all pairs of sources of two tiles of a language.

    ours: postings of the block (side, source, term, p); groups: all sources of both tiles (side, source, least), least being p where there is no posting.
    `seen` is the number of terms that the sums are over: those of which some source of the two tiles has a posting.
    """
    import pandas as pd

    lang = groups["lang"].iloc[0]
    side = [groups[groups["side"] == s].drop_duplicates("source").sort_values("source") for s in (0, 1)]
    name = [s["source"].to_numpy() for s in side]
    total = np.zeros((len(name[0]), len(name[1])), dtype=np.int64)
    term, _ = pd.factorize(ours["term"])
    place = [pd.Index(n).get_indexer(ours["source"]) for n in name]
    p, on = ours["p"].to_numpy(dtype=np.int64), ours["side"].to_numpy()
    order = np.argsort(term, kind="stable")
    bounds = np.searchsorted(term[order], np.arange(0, (term.max() + 1 if len(term) else 0) + AT_ONCE, AT_ONCE))
    for first, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
        mine = order[lo:hi]
        shares = []
        for s in (0, 1):
            n_terms = int(term[mine].max()) + 1 - first * AT_ONCE if len(mine) else 0
            matrix = np.repeat(side[s]["least"].to_numpy(dtype=np.int64)[:, None], n_terms, axis=1)
            here = mine[on[mine] == s]
            matrix[place[s][here], term[here] - first * AT_ONCE] = p[here]
            shares.append(matrix)
        for i in range(len(name[0])):
            total[i] += np.abs(shares[1] - shares[0][i]).sum(axis=1)
    one, two = np.meshgrid(name[0], name[1], indexing="ij")
    differ = one != two
    gap = np.abs(side[0]["least"].to_numpy(dtype=np.int64)[:, None] - side[1]["least"].to_numpy(dtype=np.int64))
    seen = term.max() + 1 if len(term) else 0
    return pd.DataFrame({"lang": lang, "source": one[differ], "item": two[differ], "value": total[differ], "seen": np.int64(seen), "gap": gap[differ], "v": groups["v"].iloc[0]})


def pairs(posted: DataFrame, groups: DataFrame, tile: int, block: int) -> DataFrame:
    """(lang, source, item, value) of every two sources of a language: |p - q| over all its kept terms."""
    most = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most")).first()["most"] or 0
    n_tiles, n_blocks = -(-most // tile) or 1, -(-posted.count() // block) or 1
    own = F.pmod(F.xxhash64("source"), F.lit(n_tiles)).cast("int")
    # a source is on both sides: with each tile as the first, and with each as the second
    sides = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n_tiles - 1)), lambda o: F.array(F.struct(F.lit(0).alias("side"), own.alias("one"), o.alias("two")), F.struct(F.lit(1).alias("side"), o.alias("one"), own.alias("two"))))))
    keys = ["lang", "one", "two", "block"]
    ours = posted.select("lang", "source", "term", "p", F.pmod(F.xxhash64("term"), F.lit(n_blocks)).alias("block"), sides.alias("t")).select("lang", "t.*", "block", "source", "term", "p")
    all_blocks = groups.select("lang", "source", "least", "v", sides.alias("t")).select("lang", "source", "least", "v", "t.*", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<long>")).alias("block"))
    sums = ours.groupBy(*keys).cogroup(all_blocks.groupBy(*keys)).applyInPandas(pair_sums, "lang string, source string, item string, value long, seen long, gap long, v long")
    # of the terms that none of the two tiles has, both sources have their least shares
    return sums.groupBy("lang", "source", "item").agg((F.sum("value") + (F.max("v") - F.sum("seen")) * F.max("gap")).alias("value"))


def audit(docs: DataFrame, min_documents: int = 30, top_terms: int = 50, block_terms: int = 1 << 18, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank: of each source of docs (lang, source, text) the distances to the language's other sources
    (part `pair`, all), and the terms that it has more of than its language (part `term`, the first top_terms)."""
    small_batches(docs.sparkSession)
    docs = docs.select(plain("lang"), plain("source"), plain("text"))
    kept = stored(kept_terms(docs, min_documents), "divergence-terms")
    counts = stored(postings(docs, kept, block_terms), "divergence-counts")
    v = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    n = counts.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("documents")).join(n, ["lang", "source"], "left").join(v, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"), F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("lang")).alias("lang_n"))
    groups = stored(groups.withColumn("least", F.when(F.col("v") > 0, share("0", "n", "v")).otherwise(0)), "divergence-groups")
    everywhere = counts.withColumn("lang_count", F.sum("count").over(Window.partitionBy("lang", "term")))
    small = bounded_broadcast(groups.drop("least"), MAX_BROADCAST_GROUPS)
    posted = stored(everywhere.join(small, ["lang", "source"]).select("lang", "source", "term", share("count", "n", "v").alias("p"), share("lang_count", "lang_n", "v").alias("q")), "divergence-postings")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    near = pairs(posted, groups, tile, block).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))
    more = posted.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    more = more.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top_terms).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return near.unionByName(more)


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, source, term, count(*) AS c FROM (SELECT lang, source, unnest(w) AS term FROM d) JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
m AS (SELECT lang, sum(c) AS n FROM c GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY ALL),
p AS (SELECT lang, source, term, coalesce(c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 5)) // (coalesce(n, 0) + 5 * v) AS p FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c) + 5)) // (any_value(n) + 5 * any_value(v)) AS q FROM p JOIN m USING (lang) JOIN v USING (lang) GROUP BY ALL),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM f) WHERE part = 'pair' OR rank <= 50
"""
