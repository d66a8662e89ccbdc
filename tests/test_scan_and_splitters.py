"""Ordered scans, merging over all documents, the semantic splitter and recursive JSON, against plain loops."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as tx
from corpusmill.operators import scan
from corpusmill.operators import splitters as sp
from corpusmill.plans import document_queries
from corpusmill.ports import HashEmbedding

from .conftest import SF


@pytest.mark.parametrize("block", [3, 7, 1000])
def test_running_and_neighbours(spark, block):
    rng = random.Random(1)
    values = [rng.choice([None, rng.randint(-5, 20)]) for _ in range(60)]
    df = spark.createDataFrame([(f"k{i:03}", v) for i, v in enumerate(values)], "k string, v int").orderBy(F.rand(1)).repartition(5)
    x = scan.neighbours(scan.indexed(df, "k"), {"one": ("v", 1), "two": ("v", -2)}, block)
    x = scan.running(scan.running(x, "total", F.sum, F.col("v"), block), "top", F.max, F.col("v"), block)
    for i, r in enumerate(x.orderBy("_i").collect()):
        before = [v for v in values[:i] if v is not None]
        assert (r["_i"], r["k"], r["v"]) == (i, f"k{i:03}", values[i])
        assert r["one"] == (values[i + 1] if i + 1 < len(values) else None) and r["two"] == (values[i - 2] if i > 1 else None)
        assert r["total"] == (sum(before) if before else None) and r["top"] == max(before, default=None)
    assert scan.indexed(df.limit(0), "k").count() == 0


@pytest.mark.parametrize(("least", "size"), [(50, 500), (20, 40), (40, 50), (0, 10), (100, 60)])
def test_merge_over_all_documents(spark, least, size):
    """The same as one loop over all pieces, at any number of partitions and blocks."""
    rng = random.Random(least)
    for trial in range(3):
        lengths = [rng.choice([rng.randint(0, 12), rng.randint(0, 60), rng.randint(20, 45)]) for _ in range(150)]
        texts = [chr(97 + i % 26) * n for i, n in enumerate(lengths)]
        pieces = spark.createDataFrame([(i // 7, i % 7, t) for i, t in enumerate(texts)], "doc_id int, pos int, text string").repartition(1 + 3 * trial)
        got = scan.merge_small_chunks(pieces, ["doc_id", "pos"], least, size, block=[4, 11, 10_000][trial]).orderBy("chunk_index").collect()
        want = sp.merge_small(texts, least, size)
        assert [r["text"] for r in got] == want
        assert [r["chunk_index"] for r in got] == list(range(len(want)))
    assert scan.merge_small_chunks(pieces.limit(0), ["doc_id", "pos"], least, size).count() == 0


def plain_semantic(pieces, vectors, size, threshold):
    if len(pieces) <= 1:
        return pieces
    out, now = [], pieces[0]
    for i, piece in enumerate(pieces[1:], 1):
        a, b = vectors[i - 1], vectors[i]
        length = np.linalg.norm(a) * np.linalg.norm(b)
        if (length and a @ b / length < threshold) or len(now) + len(piece) > size:
            out.append(now)
            now = piece
        else:
            now += f" {piece}"
    return [c.strip() for c in [*out, now] if c.strip()]


def test_semantic_query(spark):
    """The registered query, all documents, against a loop over the same embeddings."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pieces = [(r["doc_id"], i, p) for r in docs.collect() for i, p in enumerate(sp.recursive(r["text"] or "", 300))]
    embedded = spark.createDataFrame(pieces, "doc_id long, pos int, t string").withColumn("v", HashEmbedding(64)(F.col("t"))).orderBy("doc_id", "pos").collect()
    by_doc = {}
    for r in embedded:
        by_doc.setdefault(r["doc_id"], []).append((r["t"], np.array(r["v"])))
    expected = {(d, i, c) for d, own in by_doc.items() for i, c in enumerate(plain_semantic([t for t, _ in own], [v for _, v in own], 300, 0.2))}
    got = {(r["doc_id"], r["chunk_index"], r["content"]) for r in document_queries.spl_semantic_text(spark, SF).collect()}
    assert got == expected
    assert max(i for _, i, _ in got) > 3


def test_settings(spark):
    docs = spark.createDataFrame([(1, "one two. " * 100), (2, None), (3, " ")], "doc_id int, text string")
    for strategy in ("fixed", "recursive", "lines", "tokens", "semantic"):
        rows = sp.split_by_settings(docs, sp.Settings(strategy=strategy, size=200, overlap=20, least=10, most=400), HashEmbedding(16)).collect()
        assert {r["doc_id"] for r in rows} == {1} and all(r["chunk_id"] == f"1_{r['chunk_index']}" for r in rows)
    for bad in ({"strategy": "none"}, {"size": 1}, {"overlap": 1000}, {"threshold": 2.0}, {"least": 9000}):
        with pytest.raises(ValueError, match="unknown|out of bounds"):
            sp.Settings(**bad)
    with pytest.raises(ValueError, match="port"):
        sp.split_documents(docs, "semantic")


def made_json(rng, depth):
    kind = rng.choice(["text", "number", "list", "object", "object"] if depth else ["text", "number", "null"])
    if kind == "object":
        return {f"k{i}é\""[: rng.randint(2, 5)]: made_json(rng, depth - 1) for i in range(rng.randint(0, 5))}
    if kind == "list":
        return [made_json(rng, depth - 1) for _ in range(rng.randint(0, 4))]
    return {"text": "x\n中" * rng.randint(0, 12), "number": rng.random(), "null": None}[kind]


def leaves(value, path=()):
    if isinstance(value, list):
        value = {str(i): v for i, v in enumerate(value)}
    if isinstance(value, dict) and value:
        return [x for k, v in value.items() for x in leaves(v, (*path, k))]
    return [(path, json.dumps(value))]


def plain_json(value, most, least):
    """Lengths taken anew from whole dumps, each time."""
    dump = lambda v: len(json.dumps(v, ensure_ascii=False))
    chunks = [{}]

    def put(path, v):
        at = chunks[-1]
        for k in path[:-1]:
            at = at.setdefault(k, {})
        at[path[-1]] = v

    def walk(v, path):
        for k, m in v.items():
            if dump({k: m}) < most - dump(chunks[-1]):
                put((*path, k), m)
            else:
                if dump(chunks[-1]) >= least:
                    chunks.append({})
                if isinstance(m, dict) and m:
                    walk(m, (*path, k))
                else:
                    put((*path, k), m)

    walk(value, ())
    return [c for c in chunks if c]


def test_json_is_split_at_any_depth():
    rng = random.Random(3)
    for _ in range(80):
        value = {f"top{i}": made_json(rng, 4) for i in range(rng.randint(0, 6))}
        size, least = rng.choice([20, 60, 200]), rng.choice([None, 10, 100])
        chunks = [json.loads(c) for c in sp.json_chunks(json.dumps(value), size, least)]
        assert chunks == plain_json(sp.by_index(value), 2 * size, max(size - 200, 50) if least is None else least)
        # no value is lost or doubled
        assert sorted(x for c in chunks for x in leaves(c)) == sorted(leaves(sp.by_index(value)) if value else [])
    assert sp.json_chunks('{"a": 1}\n{"a": [2]}\nbroken', 20) == ['{"a": 1}\n{"a": [2]}\nbroken']
    assert sp.json_chunks("\n".join(['{"a": [2]}'] * 8 + ["broken"]), 20) == ['{"a": {"0": 2}}'] * 8
    assert sp.json_chunks("[1, 2]") == ['{"0": 1, "1": 2}'] and sp.json_chunks("7") == ["7"] and sp.json_chunks(" ") == []


def test_json_query(spark):
    got = {}
    for r in document_queries.spl_json(spark, SF).collect():
        got.setdefault(r["user_id"], []).append((r["chunk_index"], json.loads(r["content"])))
    rows = {}
    for e in spark.read.parquet(f"{SF}/events.parquet").orderBy("event_id").collect():
        rows.setdefault(e["user_id"], {"user": e["user_id"], "kinds": {}})["kinds"].setdefault(e["event_type"], []).append({"id": e["event_id"], "props": json.loads(e["props"])})
    expected = {u: list(enumerate(plain_json(sp.by_index({"user": v["user"], "kinds": dict(sorted(v["kinds"].items()))}), 400, 50))) for u, v in rows.items()}
    assert {u: sorted(v, key=lambda x: x[0]) for u, v in got.items()} == expected


def test_json_arguments_shrink(spark):
    deep = {"a": "x" * 9, "b": [{"c": "é" * 12, "d": 5, "e": None}, "short"]}
    rows = spark.createDataFrame([(json.dumps(deep),), ("not json " * 3,), ('"' + "y" * 12 + '"',), (None,)], "t string")
    got = [r["s"] for r in rows.select(tx.shrunk_json(F.col("t"), 10, "+").alias("s")).collect()]
    assert json.loads(got[0]) == {"a": "x" * 9, "b": [{"c": "é" * 10 + "+", "d": 5, "e": None}, "short"]}
    assert got[1:] == ["not json n+", json.dumps("y" * 10 + "+"), None]
