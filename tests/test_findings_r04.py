"""Queries at sizes or on rows where earlier code failed."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from corpusmill.llm import mixing
from corpusmill.operators import page_structure as ps
from corpusmill.plans import page_queries

from .conftest import SF


def test_mixing_broadcasts_no_blocks(spark):
    """Blocks are made by explode, so Spark takes a corpus of them for a few kilobytes; the pieces of documents as well."""
    plan = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    joins = re.findall(r"(\w+Join) ([^\n]*)", plan)
    assert [kind for kind, keys in joins if "block_no" in keys] == ["SortMergeJoin"]
    # the runs are broadcast, not the rows that are dealt to them
    runs = [keys for _, keys in joins if "_run_no" in keys]
    assert runs and all("BuildRight" in keys for keys in runs)


def test_mixing_of_more_runs_than_are_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, None if i % 7 == 0 else f"s{i % 3}", "w " * (i % 90)) for i in range(400)], "doc_id long, source string, text string")
    want = sorted(map(str, mixing.mix(docs, rows_per_run=10).collect()))
    monkeypatch.setattr(mixing, "MAX_BROADCAST_RUNS", 0)
    got = mixing.mix(docs, rows_per_run=10)
    assert "_run_no" not in "".join(re.findall(r"BroadcastHashJoin [^\n]*", got._jdf.queryExecution().executedPlan().toString()))
    assert sorted(map(str, got.collect())) == want and len(want) == 400


def _random_cells(rng, n):
    """Cells in rows of three, some over two columns or rows, or anywhere, where they claim slots twice."""
    straight, out = rng.random() < 0.7, []
    for i in range(n):
        row, column = divmod(i, 3)
        x, y = (column * 70 + rng.randrange(-3, 4), row * 20 + rng.randrange(-3, 4)) if straight else (rng.randrange(200), rng.randrange(200))
        wide, high = (130 if column == 0 and rng.random() < 0.1 else 45, 34 if rng.random() < 0.05 else 13) if straight else (rng.randrange(90), rng.randrange(60))
        out.append({"text": rng.choice([None, "", " a ", "<b>&\"'", "x\u3000", "\x1cq\x85", " mid  dle "]), "x0": float(x), "x1": float(x + wide), "top": float(y), "bottom": float(y + high), "page": float(rng.choice([1, 1, 1, 2])), "header": rng.random() < 0.4})
    return out


def test_tables_built_together_equal_those_built_one_by_one(spark, monkeypatch):
    rng = random.Random(1)
    tables = [(k, _random_cells(rng, rng.choice([8, 9, 16, 17, 64, 65, 300]) if k % 20 == 0 else rng.randrange(1, 24)), rng.choice([None, "", "Cap <1>"])) for k in range(600)]
    tables.append((600, [{**c, "x1": c["x0"] - 1} for c in _random_cells(rng, 5)], "turned"))
    want = []
    for k, cells, title in tables:
        grid = ps.Grid(cells)
        want.append((k, grid.html(title), grid.n_rows, grid.n_columns, sum(s[2] * s[3] > 1 for s in grid.spans.values())))
    rows = [{"k0": k, **c, "caption": title if i == len(cells) // 2 else None, "nth": i + 1} for k, cells, title in tables for i, c in enumerate(cells)]
    schema = "k0 long, text string, x0 double, x1 double, top double, bottom double, page double, header boolean, caption string, nth int"
    df = spark.createDataFrame(rows, schema)
    got = ps.tables_from_cells(df.withColumnsRenamed({"k0": "order", "nth": "id"}), "order")
    assert got.columns == ["order", "html", "n_rows", "n_columns", "n_spans"]
    assert sorted(map(tuple, got.collect())) == want
    # blocks that end within tables, also within those of many blocks
    for block, batch in ((1, 1), (40, 7), (1 << 16, 333)):
        monkeypatch.setattr(ps, "BLOCK_CELLS", block)
        assert [tuple(r.values()) for b in ps._tables(iter(pa.Table.from_pylist(rows, df.toArrow().schema).to_batches(max_chunksize=batch)), ["k0"]) for r in b.to_pylist()] == want


def test_tables_of_null_and_several_keys(spark):
    cells = [(a, b, 1, t, 0, 8, 0, 8, 1, None, None) for a, b, t in [("x", 1, "p"), ("x", None, "q"), (None, 1, "r"), (None, None, "s")]]
    df = spark.createDataFrame(cells, "a string, b int, id int, text string, x0 int, x1 int, top int, bottom int, page int, header boolean, caption string")
    got = {(r["a"], r["b"]): r["html"] for r in ps.tables_from_cells(df, "a", "b").collect()}
    assert got == {(a, b): f"<table>\n<tr><td>{t}</td></tr>\n</table>" for a, b, _, t, *_ in cells}
    assert ps.tables_from_cells(df.limit(0), "a", "b").count() == 0


def test_usual_tables_are_not_built_one_by_one(spark, monkeypatch):
    """An order's lines are shuffled once, its cells not; no table of the query needs the loop over its cells."""
    taken = []
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, f, schema: (taken.append((self, f)), self.limit(0).select(F.lit(0).cast("long").alias("k0"), *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in ps.TABLE.split(", ")]))[1])
    page_queries.wn_tables(spark, SF)
    rows, build = taken[0]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "collect_list" not in plan
    monkeypatch.setattr(ps, "Grid", None)
    cells = rows.toArrow()
    n = rows.filter("nth = 1").count()
    assert sum(b.num_rows for b in build(iter(cells.combine_chunks().to_batches()))) == n > 1000


def test_mixed_stage_broadcasts_no_blocks(spark, monkeypatch):
    plans, stored = {}, corpus_pipeline.stored
    monkeypatch.setattr(corpus_pipeline, "stored", lambda df, name: (plans.update({name: df._jdf.queryExecution().executedPlan().toString()}), stored(df, name))[1])
    corpus_pipeline.mixed(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert [kind for kind, keys in re.findall(r"(\w+Join) ([^\n]*)", plans["mix-taken"]) if "block_no" in keys] == ["SortMergeJoin"]
