"""Quality classifier by hierarchical empirical Bayes.

1. Every text gets a few shape features, each cut into fixed bins.
2. Labelled documents, counted by feature, bin and label in one grouped aggregation, give each bin a log-likelihood
   ratio; a document's evidence is their sum, damped because the features overlap.
3. Documents count for their host and path as their label says, or as their evidence says where there is
   none.  Host posteriors shrink towards the corpus, path posteriors towards their host, as if each came with so
   many documents of its parent; that strength is estimated from the spread between sites
   (method of moments), so a sparse site keeps to its parent.
4. A document's own share is taken out of its host's and path's sums, so that it doesn't speak twice; its posterior
   adds its evidence to the log-odds of its path without it.

The path is any column below the host: site_of and path_of take both from an address.  Tables that have neither, as
documents, give the source and the language.

Defined results: a null text has the features of an empty one; a null host or path is a site of its own; a label that
is null is no label; of several labels of one doc_id the least counts; without any label the evidence is
0 and the posterior 0.5; a text of any length counts whole; extra columns are kept out; an empty table gives an
empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, stored, words

BINS = 24
#: Share of the summed log-likelihood ratios that counts, as the features aren't independent.
DAMPING = 0.6
#: Sites up to this many (about 100 bytes each) are broadcast, more are joined by a shuffle.
MAX_BROADCAST_SITES = 200_000


def features(text: Column) -> Column:
    """An array of bins, one for each feature: length, symbols, capitals, digits, variety of words, commonest-line share, length of words, line length, ends of sentences."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    share = lambda c, scale: F.least(F.floor(c / n * scale), F.lit(BINS - 1))
    ratio = lambda a, b, scale: F.least(F.floor(a / F.greatest(b, F.lit(1)) * scale), F.lit(BINS - 1))

    def by_words(w: Column) -> Column:
        size = F.size(w)
        return F.array(
            F.least(F.floor(F.log2(size + F.lit(1)) * 1.5), F.lit(BINS - 1)),
            ratio(F.size(F.array_distinct(w)), size, 20),
            ratio(F.length(t), size, 2),
        )

    lines = F.split(t, "\n")
    of_lines = F.element_at(F.transform(F.array(lines), lambda x: F.array(ratio(F.size(F.array_distinct(x)), F.size(x), 10), F.least(F.floor(F.log2(n / F.size(x) + 1) * 2), F.lit(BINS - 1)))), 1)
    shape = F.array(share(count(r"[^\p{L}\p{N}\s.,]"), 80), share(count(r"\p{Lu}"), 40), share(count(r"\p{N}"), 80), share(count(r"[.]"), 200))
    return F.transform(F.concat(F.element_at(F.transform(F.array(words(t)), by_words), 1), of_lines, shape), lambda x: x.cast("int"))


def site_of(url: Column) -> Column:
    """The host of an address, in lower case; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column, depth: int = 1) -> Column:
    """The first folders of an address's path."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1)
    return F.array_join(F.slice(F.filter(F.split(path, "/"), lambda x: x != ""), 1, depth), "/")


def ratios(labelled: DataFrame, smoothing: float = 1.0) -> list[list[float]]:
    """log P(bin | good) / P(bin | bad) of each feature: a table of features by bins, whatever the input."""
    cells = labelled.select("quality", F.posexplode("bins").alias("feature", "bin")).groupBy("feature", "bin").agg(F.sum("quality").alias("good"), F.count(F.lit(1)).alias("n"))
    seen: dict[int, dict[int, tuple[int, int]]] = {}
    for r in cells.collect():
        seen.setdefault(r["feature"], {})[r["bin"]] = (r["good"], r["n"] - r["good"])
    out = []
    for f in sorted(seen):
        good, bad = (sum(x[i] for x in seen[f].values()) + smoothing * BINS for i in (0, 1))
        out.append([math.log((seen[f].get(b, (0, 0))[0] + smoothing) / good) - math.log((seen[f].get(b, (0, 0))[1] + smoothing) / bad) for b in range(BINS)])
    return out


def strength(sites: DataFrame, centre: Column | float) -> float:
    """How many documents of the parent a site counts with: the spread between sites beyond what chance gives sets it."""
    c = centre if isinstance(centre, Column) else F.lit(centre)
    chance = F.sum(c * (1 - c))
    row = sites.agg(F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - c, 2)).alias("spread"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("sites"), chance.alias("chance")).first()
    if not row["n"] or not row["sites"] or not row["chance"]:
        return 1.0
    variance = row["chance"] / row["sites"]
    between = max((row["spread"] - row["chance"]) / row["n"], 1e-4 * variance)
    return min(max(variance / between - 1.0, 1.0), 10_000.0)


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", least: float = 0.25) -> DataFrame:
    """doc_id, evidence, host_posterior, path_posterior, quality_posterior and kept (a posterior of `least` or more) of every row of docs."""
    site = lambda c: F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-"))
    light = stored(docs.select("doc_id", site(host).alias("host"), site(path).alias("path"), features(F.col("text")).alias("bins")), "quality-bins")
    label = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    light = light.join(label, "doc_id", "left")
    table = ratios(light.filter("quality is not null"))
    evidence = F.lit(0.0)
    for i, row in enumerate(table):
        evidence = evidence + F.element_at(F.array(*map(F.lit, row)), F.col("bins")[i] + 1)
    base = light.filter("quality is not null").agg(F.sum("quality").alias("good"), F.count(F.lit(1)).alias("n")).first()
    prior = ((base["good"] or 0) + 1.0) / (base["n"] + 2.0)
    odds = math.log(prior / (1 - prior))
    scored = light.withColumn("evidence", F.lit(DAMPING) * evidence)
    said = F.coalesce(F.col("quality").cast("double"), 1 / (1 + F.exp(-(F.col("evidence") + odds))))
    paths = stored(scored.groupBy("host", "path").agg(F.sum(said).alias("good"), F.count(F.lit(1)).alias("n")), "quality-sites")
    hosts = paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    totals = hosts.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    centre = ((totals["good"] or 0.0) + prior) / ((totals["n"] or 0) + 1.0)
    s = strength(hosts, centre)
    posterior_of = lambda good, n, parent, s: (good + F.lit(s) * parent) / (n + F.lit(s))
    hosts = hosts.select("host", F.col("good").alias("host_good"), F.col("n").alias("host_n"), posterior_of(F.col("good"), F.col("n"), F.lit(centre), s).alias("host_posterior"))
    paths = stored(paths.join(hosts, "host"), "quality-paths")
    t = strength(paths, F.col("host_posterior"))
    out = scored.withColumn("own", said).join(bounded_broadcast(paths, MAX_BROADCAST_SITES), ["host", "path"])
    # the sums without the document itself; rounding leaves them a hair under 0
    without = lambda c: F.greatest(F.col(c) - F.col("own"), F.lit(0.0))
    out = out.withColumn("host_posterior", posterior_of(without("host_good"), F.col("host_n") - 1, F.lit(centre), s))
    out = out.withColumn("path_posterior", posterior_of(without("good"), F.col("n") - 1, F.col("host_posterior"), t))
    p = F.least(F.greatest("path_posterior", F.lit(1e-6)), F.lit(1 - 1e-6))
    posterior = 1 / (1 + F.exp(-(F.col("evidence") + F.log(p / (1 - p)))))
    return out.select("doc_id", F.round("evidence", 6).alias("evidence"), F.round("host_posterior", 6).alias("host_posterior"), F.round("path_posterior", 6).alias("path_posterior"), F.round(posterior, 6).alias("quality_posterior"), (posterior >= least).alias("kept"))


def op1_quality_bayes(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
