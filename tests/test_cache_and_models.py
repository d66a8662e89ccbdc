"""The result cache, many names in texts, question batches, rewriting, research modes, embeddings, labelled tables, lenient CSV."""

import random
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill import ports
from corpusmill.operators import matching, resume
from corpusmill.operators import retrieval as r
from corpusmill.plans import model_queries
from corpusmill.sources import cache, readers

from .conftest import SF


def hits(spark, rows):
    return spark.createDataFrame(rows, "key string, chunk_id long, score double")


def keys(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "key string")


def test_cache_expires_and_replays(spark, tmp_path):
    asked = []

    def search(queries):
        now = sorted(x["key"] for x in queries.collect())
        asked.append(now)
        return hits(spark, [(k, i, 1.0 / (1 + i)) for k in now for i in range(2) if k != "none"])

    held = cache.ResultCache(spark, str(tmp_path / "c"), lifetime=10)
    rows = lambda df: sorted(tuple(x) for x in df.collect())
    first = rows(held.get_or_compute(keys(spark, "a", "none"), search, now=100))
    assert first == [("a", 0, 1.0), ("a", 1, 0.5)] and asked == [["a", "none"]]
    # known keys, also those without hits, aren't asked for again; new ones are
    assert rows(held.get_or_compute(keys(spark, "a", "b", "none"), search, now=105)) == [*first, ("b", 0, 1.0), ("b", 1, 0.5)]
    assert asked[1:] == [["b"]]
    # the first batch expires by itself
    rows(held.get_or_compute(keys(spark, "a", "b"), search, now=112))
    assert asked[2:] == [["a"]]
    assert held.get(keys(spark, "a"), now=500) is None
    assert held.sweep(now=116) == 2 and held.sweep(now=116) == 0
    assert [x["key"] for x in held.get(keys(spark, "a", "b"), now=116).collect()] == ["a"]
    # times before a batch was stored don't see it
    assert held.get(keys(spark, "a"), now=50) is None


def test_cache_with_concurrent_writers(spark, tmp_path):
    """Two writers of one key: both commit whole, readers get one of the two, the newer."""
    held = cache.ResultCache(spark, str(tmp_path / "c"))
    results = [hits(spark, [("a", n, float(n)) for _ in range(3)]).groupBy("key").agg(F.collect_list(F.struct("chunk_id", "score")).alias("rows")) for n in range(4)]
    threads = [threading.Thread(target=held.put, args=(x, 100.0 + n)) for n, x in enumerate(results)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = held.get(keys(spark, "a"), now=200).collect()
    assert [[x["chunk_id"] for x in g["rows"]] for g in got] == [[3, 3, 3]]
    # what a writer leaves unfinished isn't read
    results[0].write.parquet(str(tmp_path / "c" / ".staging-batch-000000000150000-000000009900000-x"))
    assert len(held._batches()) == 4


def test_cache_keys(spark):
    x = spark.createDataFrame([(" Some Query", 3), ("some query ", 3), ("some query", 4), (None, 3), ("", 3)], "q string, k int").select(cache.cache_key(F.col("q"), F.col("k")).alias("key"))
    got = [row["key"] for row in x.collect()]
    assert got[0] == got[1] and len(set(got)) == 4


def plain_first(text, names):
    for place, name in sorted(names):
        if not name.strip():
            continue
        if all(c.isascii() and (c.isalnum() or c in "., ") for c in name):
            if text == name:
                return place
        elif name in text and not (len(name) < 3 and len(text) / len(name) >= 2):
            return place
    return None


@pytest.mark.parametrize("block", [1 << 17, 9])
def test_first_name(spark, block):
    rng = random.Random(2)
    some = lambda n: "".join(rng.choice("ab东方 .") for _ in range(rng.randint(1, n)))
    names = [(i, some(4)) for i in range(60)] + [(60, ""), (61, " ")]
    texts = [(i, some(9)) for i in range(200)] + [(200, ""), (201, None)]
    df, table = spark.createDataFrame(texts, "id long, text string").repartition(3), spark.createDataFrame(names, "place long, name string")
    got = {x["id"]: x["place"] for x in matching.first_name(df, table, block).collect()}
    assert got == {i: plain_first(t, names) if t is not None else None for i, t in texts}
    assert {x["place"] for x in matching.first_name(df, table.limit(0)).collect()} == {None}


def test_many_names_in_one_pass(spark):
    """100 000 names; each text is gone through once, whatever their number."""
    names = spark.range(100_000).select(F.col("id").alias("place"), F.concat(F.lit("公司"), F.col("id").cast("string"), F.lit("号")).alias("name"))
    texts = spark.range(0, 100_000, 997).select("id", F.concat(F.lit("原公司"), F.col("id").cast("string"), F.lit("号店")).alias("text"))
    assert all(x["id"] == x["place"] for x in matching.first_name(texts, names).collect())


def test_company_lookup(spark):
    people = spark.createDataFrame([(1, "Acme (China)"), (2, "acme works"), (3, "北京大东方公司"), (4, "大东方外派"), (5, None)], "id long, company string")
    companies = spark.createDataFrame([(0, "ACME", "a"), (1, "大东方", "b")], "place long, name string, tag string")
    got = sorted((x["id"], x["tag"], x["good"]) for x in resume.company_lookup(people, companies).collect())
    assert got == [(1, "a", True), (2, None, False), (3, "b", True), (4, "b", False), (5, None, False)]


def test_failed_and_late_batches_leave_the_others_whole(spark):
    def ask(contents):
        if "bad" in contents:
            raise RuntimeError("no")
        if "slow" in contents:
            time.sleep(30)
        if "short" in contents:
            return []
        return [[f"{c}?", 7] for c in contents]

    texts = ["a", "b", "bad", "c", "d", "slow", "e", None, "short", "f"]
    chunks = spark.createDataFrame([(d, i, t) for d in (1, 2) for i, t in enumerate(texts)] + [(3, 5, "alone")], "doc_id int, chunk_index int, content string").repartition(4)
    began = time.time()
    got = {(x["doc_id"], x["chunk_index"]): (x["questions"], x["failed"]) for x in ports.question_batches(chunks, ask, size=2, seconds=1.0).collect()}
    assert time.time() - began < 25
    good = {0: "a", 1: "b", 6: "e", 7: ""}
    for d in (1, 2):
        assert {i: got[d, i] for i in range(10)} == {i: ([f"{good[i]}?", "7"], False) if i in good else ([], True) for i in range(10)}
    assert got[3, 5] == (["alone?", "7"], False)
    assert ports.question_batches(chunks.limit(0), ask).count() == 0


def test_rewritten(spark):
    turn = lambda i: {"role": "user" if i % 2 == 0 else "assistant", "content": f"m{i}" if i != 5 else None}
    rows = [(1, "q1", [turn(i) for i in range(9)]), (2, "q2", []), (3, "q3", None)]
    q = spark.createDataFrame(rows, "query_id int, query string, history array<struct<role:string,content:string>>")
    done = {x["query_id"]: (x["queries"], x["degraded"]) for x in ports.rewritten(q, "completion", lambda p: p).collect()}
    assert done[1] == (["completion\nAssistant: m3\nUser: m4\nAssistant: \nUser: m6\nAssistant: m7\nUser: m8\nq1"], False)
    assert done[2] == (["completion\nq2"], False) and done[3] == (["completion\nq3"], False)
    llm = ports.ScriptedLLM([("q1", "以下：\n1. one\n\n- two"), ("q2", "子问题：")], "")
    done = {x["query_id"]: (x["queries"], x["degraded"]) for x in ports.rewritten(q, "decompose", llm).collect()}
    assert done == {1: (["one", "two"], False), 2: (["q2"], True), 3: (["q3"], True)}
    assert {x["degraded"] for x in ports.rewritten(q, "hyde", lambda p: F.lit(None).cast("string")).collect()} == {True}
    with pytest.raises(ValueError, match="strategy"):
        ports.rewritten(q, "other", llm)


@pytest.mark.parametrize(("source", "mode"), [("hybrid", "quick"), ("internal", "standard"), ("external", "deep"), ("hybrid", "deep")])
def test_research_modes(spark, source, mode):
    """Rounds, turns and stopping against a plain loop over the same scripted searches."""
    rng = random.Random(len(source + mode))
    script = {(q, n, out): [rng.randrange(12) for _ in range(rng.choice([0, 0, 2, 6]))] for q in range(8) for n in range(7) for out in (False, True)}
    calls = []

    def search(out):
        def run(queries, n):
            calls.append((n, out))
            asked = {x["query_id"] for x in queries.collect()}
            return spark.createDataFrame([(q, k) for (q, m, o), found in script.items() if m == n and o == out and q in asked for k in found], "query_id int, key int")

        return run

    tasks = spark.createDataFrame([(q, f"q{q}") for q in range(8)], "query_id int, query string")
    got = {tuple(x) for x in r.deep_research(tasks, search(False), search(True), source, mode).select("query_id", "key", "round").collect()}
    expected = set()
    rounds = {"quick": 3, "standard": 5, "deep": 7}[mode]
    for q in range(8):
        seen = {}
        for n in range(rounds):
            outside = {"hybrid": n % 2 == 1, "internal": False, "external": True}[source]
            for k in script[q, n, outside]:
                seen.setdefault(k, n)
            if len(seen) >= 10 or (seen and n >= 2):
                break
        expected |= {(q, k, n) for k, n in seen.items()}
    assert got == expected
    assert all(out == r.searches_outside(source, n) for n, out in calls)


def test_embedding_query(spark):
    """The cosine of every document to the one before, from the definition of the stand-in embedding."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", ports.HashEmbedding(64)(F.col("text")).alias("v")).orderBy("doc_id").collect()
    v = [np.array(x["v"], dtype=float) for x in rows]
    expected = {rows[i]["doc_id"]: float(v[i - 1] @ v[i] / (np.linalg.norm(v[i - 1]) * np.linalg.norm(v[i]) or 1)) for i in range(1, len(rows))}
    got = {x["doc_id"]: x["cosine"] for x in model_queries.mdl_embed(spark, SF).collect()}
    assert got == pytest.approx(expected, abs=2e-6)


def test_labelled_rows():
    assert readers.labelled_rows([["Name", "Age"], ["Al", "7"], ["", "8"]]) == ["Name: Al;Age: 7", "Age: 8"]
    # among numbers, rows of words are headers; the nearest block of them counts
    table = [["Year", "Sum"], ["in", "euros"], ["2001", "5.5"], ["2002", "6,0"], ["later on", "so far"], ["7", "8"], ["9", ""]]
    assert readers.labelled_rows(table) == ["Year,in: 2001;Sum,euros: 5.5", "Year,in: 2002;Sum,euros: 6,0", "later on: 7;so far: 8", "later on: 9"]
    assert readers.labelled_rows([["only"]]) == [] and readers.labelled_rows([]) == []


def test_lenient_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y,z\n1,2,3\n1,2\n\n"a,b","line\nbreak","q""q"\n1,2,3,4\n1,2,3,\n,,\n5\n')
    (tmp_path / "b.csv").write_text("x,y,z\n7,8,9\n1,2,3,4,5,6,7\n")
    good, bad = readers.lenient_csv(spark, str(tmp_path))
    assert sorted((tuple(x) for x in good.collect()), key=str) == sorted([("1", "2", "3"), ("1", "2", None), ("a,b", "line\nbreak", 'q"q'), (None, None, None), ("5", None, None), ("7", "8", "9")], key=str)
    assert {x["file"].rpartition("/")[2]: x["bad_lines"] for x in bad.collect()} == {"a.csv": 2, "b.csv": 1}
