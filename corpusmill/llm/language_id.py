"""Language identification by Bayesian evidence fusion.

The posterior of a document's language multiplies, in logarithms,
- the likelihood of its text under hashed byte trigrams of each language,
- the likelihood of the declared language, P(declared | language), estimated over all documents,
- the prior of its host, smoothed towards its address suffix and that towards the whole corpus.

The text model is fitted on a bounded sample of rows with a declared language (`rows_per_language`); the
tables of hosts, suffixes and declarations come from grouped aggregation over every document.  Each label of at
least `least_rows` rows is a language of its own, however large the corpus; the rarer ones together are one more,
called `und`, as so few rows don't make a model each.  The table of the text model has a row for each language and
bucket; a column of more than `MAX_LANGUAGES` such labels holds no languages, and is refused.

Addresses: host_of, suffix_of and declared_in take the evidence from a page's url and html, for tables that have these.

Defined results: a null or empty text, or one without a letter, has no text evidence, and the
document is rejected; an undeclared language gives no evidence; a null host is one more host;
rows that repeat get equal results; a text of any length is scored whole, in steps within it; extra columns are kept; an empty
table gives an empty result; with nothing to learn from, no language is known and all documents are rejected.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_broadcast, fresh, small_batches, stored

BUCKETS = 1 << 15
#: Bytes of text that one step of the scoring looks at.
STEP_BYTES = 1 << 18
#: Labels that may be languages; the text model has BUCKETS numbers of four bytes for each.
MAX_LANGUAGES = 1_000
#: What the labels are called that are too rare for a model of their own.
RARE = "und"
#: Hosts up to this many (about 100 bytes each) are broadcast, more are joined by a shuffle.
MAX_BROADCAST_HOSTS = 200_000
#: Trigrams overlap and repeat; a text counts as this share of its trigrams, and as so many at most.
SHARE, MOST = 0.3, 150.0
#: Lower-cases A-Z; digits, symbols and white space become one blank, other bytes stay.
FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], dtype=np.uint32)


def trigram_buckets(data: np.ndarray) -> np.ndarray:
    """A bucket for each three bytes in a row; -1 where all three are blank."""
    c = FOLD[data]
    code = (c[:-2] << 16) | (c[1:-1] << 8) | c[2:]
    bucket = ((code * np.uint32(0x9E3779B1)) >> np.uint32(12) & np.uint32(BUCKETS - 1)).astype(np.int32)
    bucket[code == 0x202020] = -1
    return bucket


def steps(texts):
    """Texts in steps of about STEP_BYTES: (row of each piece, where it begins, bytes).

    A longer text is cut into pieces that share two bytes, so that each trigram lies in one.  Pieces without a trigram are left out.
    """
    rows, starts, run, size = [], [], [], 0
    for i, t in enumerate(texts):
        b = (t or "").encode()
        for at in range(0, len(b) - 2, STEP_BYTES):
            piece = b[at : at + STEP_BYTES + 2]
            rows.append(i)
            starts.append(size)
            run.append(piece)
            size += len(piece)
            if size >= STEP_BYTES:
                yield np.array(rows), np.array(starts), b"".join(run)
                rows, starts, run, size = [], [], [], 0
    if run:
        yield np.array(rows), np.array(starts), b"".join(run)


def step_buckets(starts: np.ndarray, joined: bytes) -> np.ndarray:
    """The buckets of a step's trigrams; -1 for those over the border of two pieces."""
    bucket = trigram_buckets(np.frombuffer(joined, dtype=np.uint8))
    border = starts[1:]
    bucket[border - 1] = bucket[border - 2] = -1
    return bucket


def train_batches(batches):
    """Counts of a partition's trigrams by language and bucket."""
    import pyarrow as pa

    seen: dict[int, np.ndarray] = {}
    for batch in batches:
        lang = np.array(batch.column("lang").to_pylist(), dtype=np.int64)
        for rows, starts, joined in steps(batch.column("text").to_pylist()):
            bucket = step_buckets(starts, joined)
            ends = np.append(starts[1:], len(bucket))
            for own in np.unique(lang[rows]):
                mine = np.concatenate([bucket[a:z] for a, z in zip(starts[lang[rows] == own], ends[lang[rows] == own], strict=True)])
                seen[own] = seen.get(own, 0) + np.bincount(mine[mine >= 0], minlength=BUCKETS)
    for lang, row in seen.items():
        bucket = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), lang), pa.int32()), pa.array(bucket, pa.int32()), pa.array(row[bucket], pa.int64())], names=["lang", "bucket", "n"])


def model_row(counts):
    """log P(bucket | language) of one language, from a row for each of its buckets."""
    import pandas as pd

    seen = np.full(BUCKETS, 0.05)
    seen[counts["bucket"]] += counts["n"]
    return pd.DataFrame({"lang": counts["lang"].iloc[:1], "row": [np.log(seen / seen.sum()).astype(np.float32).tobytes()]})


def declared_language(docs: DataFrame, lang: str, least_rows: int) -> tuple[list[str], dict[str, int]]:
    """The labels of at least least_rows rows, in order, and the rows of each; RARE counts the rows of all others."""
    counts = docs.filter(F.col(lang).isNotNull() & (F.col(lang) != "")).groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts, "language-labels")
    own = {r["lang"]: r["n"] for r in counts.filter(F.col("n") >= least_rows).limit(MAX_LANGUAGES + 1).collect()}
    if len(own) > MAX_LANGUAGES:
        raise ValueError(f"{lang} has more than {MAX_LANGUAGES} labels of {least_rows} rows or more: these aren't languages")
    rare = counts.filter(F.col("n") < least_rows).agg(F.sum("n").alias("n")).first()["n"]
    if rare:
        own[RARE] = own.get(RARE, 0) + rare
    return sorted(own), own


def label_place(lang: Column, languages: list[str]) -> Column:
    """The place of a declared label among the languages, from 1; that of RARE for rare ones, 0 for none."""
    table = F.create_map(*[x for i, name in enumerate(languages) for x in (F.lit(name), F.lit(i + 1))])
    other = languages.index(RARE) + 1 if RARE in languages else 0
    return F.when(lang.isNull() | (lang == ""), F.lit(0)).otherwise(F.coalesce(F.try_element_at(table, lang), F.lit(other)))


def fit_text_model(docs: DataFrame, lang: str = "lang", rows_per_language: int = 2_000, least_rows: int = 5, seed: int = 7) -> tuple[list[str], np.ndarray]:
    """The languages and log P(bucket | language), learned on about rows_per_language rows of each."""
    languages, counts = declared_language(docs, lang, least_rows)
    if not languages:
        return [], np.zeros((0, BUCKETS), dtype=np.float32)
    u = F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in docs.columns if c in ("doc_id", "page_id")], F.col("text")), F.lit(1_000_000)) / 1e6
    place = label_place(F.col(lang), languages)
    rate = F.element_at(F.array(*[F.lit(min(1.0, rows_per_language / counts[x])) for x in languages]), F.greatest(place, F.lit(1)))
    sample = docs.select("text", place.alias("place"), u.alias("u"), rate.alias("rate")).filter("place > 0 and u < rate").select("text", (F.col("place") - 1).cast("int").alias("lang"))
    counts = sample.mapInArrow(train_batches, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    model = np.full((len(languages), BUCKETS), -math.log(BUCKETS), dtype=np.float32)
    for r in counts.groupBy("lang").applyInPandas(model_row, "lang int, row binary").toLocalIterator():
        model[r["lang"]] = np.frombuffer(bytes(r["row"]), dtype=np.float32)
    return languages, model


def text_scores(model):
    """A column function: tempered log-likelihoods of a text by language, null for a text without letters; model is a broadcast.

    A step's trigrams are looked up one language at a time and summed by pieces, so what is held follows the step, not the text or the languages.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def score(texts):
        import pandas as pd

        table = model.value
        middle = table.mean(axis=0)  # only differences between languages matter
        sums, count = np.zeros((len(texts), len(table))), np.zeros(len(texts), dtype=np.int64)
        for rows, starts, joined in steps(texts):
            bucket = step_buckets(starts, joined)
            np.add.at(count, rows, np.add.reduceat(bucket >= 0, starts, dtype=np.int64))
            for i, row in enumerate(table):
                own = np.append(row - middle, np.float32(0.0))  # the last place is that of -1
                np.add.at(sums[:, i], rows, np.add.reduceat(own[bucket], starts, dtype=np.float64))
        scale = np.minimum(SHARE * count, MOST) / np.maximum(count, 1)
        return pd.Series([sums[k] * scale[k] if count[k] else None for k in range(len(texts))])

    return score


def softmax(x: Column) -> Column:
    top = F.array_max(x)
    grown = F.transform(x, lambda v: F.exp(v - top))
    total = F.aggregate(grown, F.lit(0.0), lambda a, v: a + v)
    return F.transform(grown, lambda v: v / total)


def added(*parts: Column) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = F.zip_with(out, p, lambda a, b: a + b)
    return out


def smooth(counts: Column, towards: Column, strength: float) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, v: a + v)
    return F.zip_with(counts, towards, lambda n, p: (n + strength * p) / (total + strength))


def summed(name: str, n: int) -> Column:
    return F.array(*[F.coalesce(F.sum(F.col(name)[i]), F.lit(0.0)) for i in range(n)])


def host_of(url: Column) -> Column:
    """The host of an address, in lower case, without a port; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def suffix_of(host: Column) -> Column:
    """What follows a host's last dot, or '' if it has none or is a number."""
    return F.coalesce(F.regexp_extract(host, r"\.([^.0-9]+)$", 1), F.lit(""))


def declared_in(html: Column) -> Column:
    """The language that the html element of a page declares, without a region; null if none."""
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"""(?i)<html\b[^>]*?\slang\s*=\s*["']?([a-z]+)""", 1)), F.lit(""))


def identify(docs: DataFrame, declared: str = "lang", host: str = "source", rows_per_language: int = 2_000, strength: float = 20.0, least: float = 0.5, least_rows: int = 5, with_text: bool = True) -> DataFrame:
    """docs with language, language_posterior and language_kept; declared and host name the columns of evidence.

    The scored rows are stored, so that each text is scored once; without text (with_text=False) they are small.
    """
    small_batches(docs.sparkSession)
    languages, model = fit_text_model(docs, declared, rows_per_language, least_rows)
    columns = [c for c in docs.columns if with_text or c != "text"]
    n = len(languages)
    language, posterior, kept = "language", "language_posterior", "language_kept"
    if n == 0:
        return docs.select(*columns).withColumns({language: F.lit(None).cast("string"), posterior: F.lit(None).cast("double"), kept: F.lit(False)})
    spark = docs.sparkSession
    score = text_scores(spark.sparkContext.broadcast(model))
    ev, hst, sfx, dcl, sad = fresh(docs, "ev", "host", "suffix", "declared", "said")
    host_key = F.coalesce(F.concat(F.lit("+"), F.lower(F.col(host))), F.lit("-"))
    base = {ev: score(F.col("text")), hst: host_key, dcl: label_place(F.col(declared), languages)}
    scored = stored(docs.withColumns(base).select(*columns, ev, hst, dcl), "language-scores")
    # every document's evidence by host and declaration, in one grouped aggregation
    soft = scored.filter(F.col(ev).isNotNull()).select(F.col(hst).alias("host"), F.col(dcl).alias("declared"), softmax(F.col(ev)).alias("p"))
    cells = stored(soft.groupBy("host", "declared").agg(summed("p", n).alias("p")), "language-cells")
    hosts = cells.groupBy("host").agg(summed("p", n).alias("p")).withColumn("suffix", suffix_of(F.col("host")))
    suffixes = hosts.groupBy("suffix").agg(summed("p", n).alias("suffix_p"))
    whole = hosts.agg(summed("p", n).alias("p")).first()["p"]
    corpus = [(x + 1.0) / (sum(whole) + n) for x in whole]
    corpus_prior = F.array(*map(F.lit, corpus))
    hosts = hosts.join(suffixes, "suffix").select(F.col("host").alias(hst), F.transform(smooth(F.col("p"), smooth(F.col("suffix_p"), corpus_prior, strength), strength), lambda v: F.log(v)).alias(sfx))
    # P(declared | language): a small square table of languages
    table = {r["declared"]: r["p"] for r in cells.filter("declared > 0").groupBy("declared").agg(summed("p", n).alias("p")).collect()}
    square = np.array([[table.get(d + 1, [0.0] * n)[i] for d in range(n)] for i in range(n)]) + 0.5
    square = square / square.sum(axis=1, keepdims=True)
    # a row for each declared language, MAX_LANGUAGES of as many numbers at most
    likelihood = spark.createDataFrame([(d + 1, [math.log(square[i][d]) for i in range(n)]) for d in range(n)], f"{dcl} int, {sad} array<double>")
    said = F.coalesce(F.col(sad), F.array_repeat(F.lit(0.0), n))
    prior = F.coalesce(F.col(sfx), F.array(*[F.lit(math.log(p)) for p in corpus]))
    joined = scored.join(bounded_broadcast(hosts, MAX_BROADCAST_HOSTS), hst, "left").join(F.broadcast(likelihood), dcl, "left")
    joined = joined.withColumn(ev, softmax(added(F.col(ev), said, prior)))
    best = F.array_max(ev)
    name = F.element_at(F.array(*map(F.lit, languages)), F.array_position(ev, best).cast("int"))
    out = joined.withColumns({language: name, posterior: best, kept: F.coalesce(best >= least, F.lit(False))})
    return out.select(*columns, language, posterior, kept)


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    out = identify(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
    return out.select("doc_id", "lang", "language", F.round("language_posterior", 6).alias("language_posterior"), F.col("language_kept").alias("kept"))
