"""Scores of retrieval and of answers, per case and over a test set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_case(judged: DataFrame) -> DataFrame:
    """precision_at_k, hit, first_relevant_rank of (case_id, rank, is_relevant); a case without hits has a null rank row."""
    relevant = F.col("is_relevant") & F.col("rank").isNotNull()
    n = F.count("rank")
    precision = F.coalesce(F.sum(relevant.cast("int")) / F.nullif(n, F.lit(0)), F.lit(0.0))
    return judged.groupBy("case_id").agg(F.round(precision + 1e-9, 4).alias("precision_at_k"), F.coalesce(F.max(relevant), F.lit(False)).alias("hit"), F.min(F.when(relevant, F.col("rank"))).alias("first_relevant_rank"))


def overall(cases: DataFrame) -> DataFrame:
    """Mean precision, hit rate, and mean reciprocal rank, where a case without a relevant hit counts 0."""
    return cases.agg(
        F.round(F.avg("precision_at_k") + 1e-9, 4).alias("precision_at_k"),
        F.round(F.avg(F.col("hit").cast("int")) + 1e-9, 4).alias("hit_rate"),
        F.round(F.avg(F.coalesce(1.0 / F.col("first_relevant_rank"), F.lit(0.0))) + 1e-9, 4).alias("mrr"),
    )


def similarity_score(cos: Column) -> Column:
    """1 to 10, halves to the even number."""
    return F.least(F.greatest(F.bround(cos * 10).cast("int"), F.lit(1)), F.lit(10))


def correctness(judge: Column, similarity: Column, strategy: str = "hybrid") -> Column:
    """A score of ten: the judge's, that of the similarity, or 0.7 and 0.3 of them, halves to the even number; null without the judge's."""
    if strategy == "embedding":
        return similarity
    if strategy == "hybrid":
        return F.when(judge.isNotNull() & similarity.isNotNull(), F.least(F.greatest(F.bround(judge * 0.7 + similarity * 0.3).cast("int"), F.lit(1)), F.lit(10)))
    return judge


def faithfulness(claims: DataFrame) -> DataFrame:
    """score of (case_id, supported): of ten, 1 at least; a case without claims scores 1."""
    total = F.count("supported")
    share = F.sum(F.col("supported").cast("int")) / F.nullif(total, F.lit(0))
    return claims.groupBy("case_id").agg(F.greatest(F.lit(1), F.coalesce(F.bround(share * 10).cast("int"), F.lit(1))).alias("faithfulness"))


def mean_of_given(*scores: str) -> Column:
    """The mean of the scores that are neither null nor 0, to one digit."""
    given = F.filter(F.array(*[F.col(c).cast("double") for c in scores]), lambda x: x.isNotNull() & (x != 0))
    total = F.aggregate(given, F.lit(0.0), lambda a, x: a + x)
    return F.round(total / F.nullif(F.size(given), F.lit(0)) + 1e-9, 1)


def context_recall(claims: DataFrame) -> DataFrame:
    return claims.groupBy("case_id").agg(F.round(F.avg(F.col("supported").cast("int")) + 1e-9, 4).alias("context_recall"))


def recall_at_k(judged: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Found relevant rows of all relevant ones (case_id, n_relevant), an extension."""
    found = judged.filter((F.col("rank") <= k) & F.col("is_relevant")).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    return relevant.join(found, "case_id", "left").select("case_id", F.round(F.coalesce("n", F.lit(0)) / F.col("n_relevant") + 1e-9, 4).alias("recall_at_k"))


DIMENSIONS = ("faithfulness", "answer_relevance", "correctness", "quality")


def summary(details: DataFrame) -> DataFrame:
    """One row of a test set's details (status, faithfulness, answer_relevance, correctness, quality, context_precision, answer_similarity).

    Means of each dimension to one digit and of these `overall`; means of precision and similarity, of cases that neither failed nor were cancelled, to four digits;
    cases processed and successful.  A dimension without scores is null and not part of overall.
    """
    good = F.coalesce(~F.col("status").isin("error", "cancelled"), F.lit(True))
    mean = lambda c: F.round(F.avg(c) + 1e-9, 1).alias(c)
    end = lambda c: F.round(F.avg(F.when(good, F.col(c))) + 1e-9, 4).alias(c)
    out = details.agg(F.count(F.lit(1)).alias("processed_cases"), F.coalesce(F.sum(good.cast("long")), F.lit(0)).alias("successful_cases"), *map(mean, DIMENSIONS), end("context_precision"), end("answer_similarity"))
    given = F.array_compact(F.array(*DIMENSIONS))
    total = F.aggregate(given, F.lit(0.0), lambda a, x: a + x)
    return out.withColumn("overall", F.round(total / F.nullif(F.size(given), F.lit(0)) + 1e-9, 1))


def embedding_recall(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """(case_id, context_recall): the largest cosine of an expected answer (case_id, vector) to the case's chunks (case_id, vector), to four digits; a case without chunks is left out."""
    from .retrieval import cosine

    met = chunks.select("case_id", F.col("vector").alias("_v")).join(answers, "case_id")
    return met.groupBy("case_id").agg(F.round(F.max(cosine(F.col("vector"), F.col("_v"))) + 1e-9, 4).alias("context_recall"))
