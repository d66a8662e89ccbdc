"""Places where a model plugs in: embedding, reranking, generation, token counting, and deterministic stand-ins.

A port is a function from columns to a column; a model's own code runs in batches inside a pandas UDF.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sources.shared import stored


class EmbeddingPort(Protocol):
    dimension: int

    def __call__(self, text: Column) -> Column: ...


class RerankPort(Protocol):
    def __call__(self, query: Column, content: Column) -> Column: ...


class LLMPort(Protocol):
    def __call__(self, prompt: Column) -> Column: ...


class HashEmbedding:
    """Signed word hashes summed into `dimension` places, of length 1; the same on every machine."""

    def __init__(self, dimension: int = 64) -> None:
        self.dimension = dimension

    def __call__(self, text: Column) -> Column:
        from .operators.retrieval import analyze

        n = self.dimension

        @F.pandas_udf(T.ArrayType(T.FloatType()))
        def embed(hashes):
            def one(h):
                out = np.zeros(n)
                h = np.asarray(h, dtype=np.int64)
                np.add.at(out, h % n, np.where(h >> 32 & 1, 1.0, -1.0))
                length = np.linalg.norm(out)
                return (out / length if length else out).astype(np.float32)

            return hashes.map(one)

        return embed(F.transform(analyze(text), lambda w: F.xxhash64(w)))


class OverlapRerank:
    """Share of the query's words that the content has."""

    def __call__(self, query: Column, content: Column) -> Column:
        from .operators.retrieval import analyze

        words = F.array_distinct(analyze(query))
        return F.coalesce(F.size(F.array_intersect(words, analyze(content))) / F.nullif(F.size(words), F.lit(0)), F.lit(0.0))


class ScriptedLLM:
    """Answers from a table of prompt patterns; the first that matches, else the default."""

    def __init__(self, answers: list[tuple[str, str]], default: str = "") -> None:
        self.answers, self.default = answers, default

    def __call__(self, prompt: Column) -> Column:
        out = F.lit(self.default)
        for pattern, answer in reversed(self.answers):
            out = F.when(prompt.rlike(pattern), F.lit(answer)).otherwise(out)
        return out


def within(seconds: float, f: Callable, *args):
    """f's result, or an exception after so many seconds; a late call is left behind."""
    import queue
    import threading

    out: queue.Queue = queue.Queue()

    def run():
        try:
            out.put((f(*args), None))
        except Exception as e:  # noqa: BLE001
            out.put((None, e))

    threading.Thread(target=run, daemon=True).start()
    try:
        result, error = out.get(timeout=seconds)
    except queue.Empty:
        raise TimeoutError(f"no answer within {seconds} s") from None
    if error is not None:
        raise error
    return result


def question_batches(chunks: DataFrame, ask: Callable[[list[str]], list[list[str]]], size: int = 3, seconds: float = 120.0) -> DataFrame:
    """(doc_id, chunk_index, questions, failed) of chunks (doc_id, chunk_index, content): a model's questions, `size` chunks a call.

    A document's chunks are dealt to calls in order.  A call that fails, is late, or answers for another number of chunks leaves all its
    chunks without questions and no other.  Calls are rows, so they spread over tasks.
    """
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index")) - 1
    calls = chunks.withColumn("_call", F.floor(place / size)).groupBy("doc_id", "_call").agg(F.array_sort(F.collect_list(F.struct("chunk_index", F.coalesce("content", F.lit("")).alias("content")))).alias("c"))

    def one(contents) -> dict:
        try:
            answer = within(seconds, ask, list(contents))
            if len(answer) != len(contents):
                raise ValueError("an answer for another number of chunks")
            return {"questions": [[str(q) for q in own] for own in answer], "failed": False}
        except Exception:  # noqa: BLE001
            return {"questions": [[] for _ in contents], "failed": True}

    @F.pandas_udf("struct<questions:array<array<string>>,failed:boolean>")
    def answers(contents):
        import pandas as pd

        return pd.DataFrame([one(c) for c in contents], columns=["questions", "failed"])

    asked = calls.withColumn("a", answers(F.transform("c", lambda x: x["content"])))
    each = asked.select("doc_id", "a.failed", F.inline(F.arrays_zip(F.transform("c", lambda x: x["chunk_index"]).alias("chunk_index"), F.col("a.questions").alias("questions"))))
    return each.select("doc_id", "chunk_index", "questions", "failed")


def rewritten(queries: DataFrame, strategy: str, llm: LLMPort, recent: int = 6) -> DataFrame:
    """queries (query_id, query, history) with `queries`, what to search for instead, and `degraded`: whether the model gave nothing and the query stands.

    completion asks with the last `recent` messages of history (an array of structs role, content), synonym and hyde with the query alone;
    decompose takes the lines of the answer without list marks and headings.  Prompts begin with the strategy's name.
    """
    from .functions.text import sub_queries

    if strategy not in ("completion", "synonym", "decompose", "hyde"):
        raise ValueError(f"unknown strategy {strategy}")
    said = lambda m: F.concat(F.when(m["role"] == "user", "User").otherwise("Assistant"), F.lit(": "), F.coalesce(m["content"], F.lit("")))
    history = F.array_join(F.transform(F.slice("history", F.greatest(F.size("history") - recent, F.lit(0)) + 1, recent), said), "\n")
    parts = [F.lit(strategy), F.when(F.size("history") > 0, history), F.col("query")] if strategy == "completion" else [F.lit(strategy), F.col("query")]
    asked = queries.withColumn("_answer", llm(F.concat_ws("\n", *parts)))
    given = F.when(F.coalesce(F.col("_answer"), F.lit("")) != "", sub_queries(F.col("_answer")) if strategy == "decompose" else F.array("_answer"))
    found = F.coalesce(F.size(given) > 0, F.lit(False))
    return asked.withColumns({"queries": F.when(found, given).otherwise(F.array("query")), "degraded": ~found}).drop("_answer")


def rerank(hits: DataFrame, query: str, content: str, port: RerankPort, top: int = 10) -> DataFrame:
    """The first `top` hits of each query take the port's score and a new rank; the others keep their order behind them."""
    scored = hits.withColumn("reranked", F.col("rank") <= top).withColumn("score", F.when(F.col("rank") <= top, F.round(port(F.col(query), F.col(content)), 6)).otherwise(F.col("score")))
    order = Window.partitionBy("query_id").orderBy(F.desc("reranked"), F.when(F.col("reranked"), -F.col("score")), "rank")
    return scored.withColumn("rank", F.row_number().over(order))


def reranked(hits: DataFrame, query: str, content: str, port: RerankPort, top: int = 3) -> DataFrame:
    """The `top` hits of each query by the port's score, normalised, with original_score and reranked; a query for which the port gives
    no score to some hit keeps its hits as they are.

    hits (query_id, chunk_id, score, rank, ...); of equal scores the better rank comes first.
    """
    from .operators.retrieval import normalise

    each = Window.partitionBy("query_id")
    scored = hits.withColumn("_new", port(F.col(query), F.col(content)))
    scored = scored.withColumn("reranked", F.count("_new").over(each) == F.count(F.lit(1)).over(each))
    better = scored.filter("reranked").withColumns({"_before": F.col("score"), "score": F.col("_new").cast("double")})
    better = better.withColumn("rank", F.row_number().over(each.orderBy(F.desc("score"), "rank"))).filter(F.col("rank") <= top)
    better = normalise(better).withColumn("original_score", F.col("_before")).drop("_before", "_new")
    kept = scored.filter(~F.col("reranked")).drop("_new").withColumn("original_score", F.lit(None).cast("double"))
    return better.unionByName(kept)


def grades(answer: Column, passing: int = 5) -> Column:
    """A struct of score (1 to 10), passed and reason of a model's answer with JSON in it; what can't be read has 5 and hasn't passed."""
    braces = F.regexp_extract(F.coalesce(answer, F.lit("")), r"(?s)(\{.*\})", 1)
    given = F.from_json(braces, "score double, reason string")
    read = F.coalesce(F.try_parse_json(braces).isNotNull() & (braces != ""), F.lit(False))
    score = F.when(read, F.least(F.greatest(F.coalesce(given["score"], F.lit(5.0)).cast("int"), F.lit(1)), F.lit(10))).otherwise(5)
    reason = F.when(read, F.coalesce(given["reason"], F.lit(""))).otherwise("no grade")
    return F.struct(score.alias("score"), (read & (score >= passing)).alias("passed"), reason.alias("reason"))


def grade_and_retry(search: Callable[[str, float], DataFrame], enough: Callable[[DataFrame], DataFrame], modes: list[str], threshold: float, decay: float = 0.7) -> DataFrame:
    """Searches all queries by the first mode; those not graded enough go on to the next mode at a lower threshold.

    search(mode, threshold) gives hits with query_id, enough(hits) the query_ids that are served.  The
    result has the attempt that served each query; the last attempt's hits stay whatever their grade.
    """
    out = served = None
    for attempt, mode in enumerate(modes):
        # hits are read for the grade, for the result and for what is served
        hits = stored(search(mode, threshold * decay**attempt).withColumn("attempt", F.lit(attempt)), "graded")
        hits = hits if served is None else hits.join(served, "query_id", "left_anti")
        good = hits if attempt == len(modes) - 1 else hits.join(enough(hits), "query_id", "left_semi")
        out = good if out is None else out.unionByName(good)
        served = out.select("query_id").distinct()
    return out
