import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import layout as ly
from corpusmill.operators import resume
from corpusmill.operators import retrieval as r
from corpusmill.operators import sequences as sq
from corpusmill.operators import splitters as sp
from corpusmill.plans import document_queries, sequence_queries

from .conftest import SF


def median(xs):
    xs = sorted(xs)
    n = len(xs)
    return (xs[n // 2] + xs[(n - 1) // 2]) / 2


def plain_lines(words):
    words = sorted(words, key=lambda w: (w["top"], w["x0"], w["x1"], w["bottom"], w["text"]))
    high = max(3.0, median([w["bottom"] - w["top"] for w in words]) * 0.45)
    wide = max(20.0, median([(w["x1"] - w["x0"]) / len(w["text"]) for w in words]) * 4)
    out = []
    for w in words:
        if out and abs(w["top"] - out[-1]["top"]) <= high and w["x0"] - out[-1]["x1"] <= wide:
            now = out[-1]
            now |= {"text": f"{now['text']} {w['text']}", "x0": min(now["x0"], w["x0"]), "x1": max(now["x1"], w["x1"]), "bottom": max(now["bottom"], w["bottom"])}
        else:
            out.append(dict(w))
    return out


def test_lines_of_words(spark):
    rng = random.Random(2)
    words = [{"doc_id": d, "page": p, "text": "w" * rng.randint(1, 9), "x0": x, "x1": x + rng.randint(5, 40), "top": t, "bottom": t + rng.randint(6, 14)} for d in range(3) for p in range(2) for _ in range(40) for x, t in [(float(rng.randrange(400)), float(rng.randrange(0, 90, 3)))]]
    df = spark.createDataFrame([(w["doc_id"], w["page"], f" {w['text']} ", w["x0"], float(w["x1"]), w["top"], float(w["bottom"])) for w in words] + [(0, 0, "  ", 1.0, 2.0, 3.0, 4.0)], "doc_id int, page int, text string, x0 double, x1 double, top double, bottom double")
    got = ly.lines_of_words(df).orderBy("doc_id", "page", "line").collect()
    expected = [(d, p, k, x["text"], x["x0"], x["x1"], x["top"], x["bottom"]) for d in range(3) for p in range(2) for k, x in enumerate(plain_lines([w for w in words if (w["doc_id"], w["page"]) == (d, p)]))]
    assert [tuple(x) for x in got] == expected
    assert ly.lines_of_words(df.limit(0)).count() == 0


def test_contents_go(spark):
    texts = ["Title", "Contents", " ", "1 Intro ... 2", "2 More ... 5", "1 Intro and so on", "body", "目 录", "第一章 开头 1", "第二章 2", "第一章 开头", "text", "contents"]
    boxes = spark.createDataFrame([(1, i, 0, t) for i, t in enumerate(texts)] + [(2, 0, 0, "no list"), (2, 1, 0, None)], "doc_id int, pos int, page int, text string")
    got = ly.without_contents(boxes).orderBy("doc_id", "pos").collect()
    # the first entry's own heading is looked for by "1 Intro"
    assert [x["text"] for x in got] == ["Title", "1 Intro and so on", "body", "第一章 开头", "text", "no list", None]


def test_overlaps_go(spark):
    rng = random.Random(3)
    rows = [(p, "ab"[k % 2], i, rng.random(), float(x), x + 10.0, float(y), y + 10.0) for p in range(3) for i in range(30) for k, x, y in [(i, rng.randrange(30), rng.randrange(30))]]
    df = spark.createDataFrame(rows, "page int, kind string, id int, score double, x0 double, x1 double, top double, bottom double")

    def share(a, b):
        both = max(0, min(a[5], b[5]) - max(a[4], b[4])) * max(0, min(a[7], b[7]) - max(a[6], b[6]))
        return both / (200 - both)

    kept = []
    for row in sorted(rows, key=lambda x: -x[3]):
        if all(k[:2] != row[:2] or share(k, row) <= 0.3 for k in kept):
            kept.append(row)
    assert sorted(tuple(x) for x in ly.without_overlaps(df, 0.3).collect()) == sorted(kept)


def test_greedy_groups(spark):
    rng = random.Random(4)
    for glue in (0, 2):
        sizes = [rng.randint(1, 60) for _ in range(80)] + [200, 3]
        used, group, expected = 0, 0, []
        for s in sizes:
            if used and used + s + glue > 100:
                group, used = group + 1, s
            else:
                used += s + (glue if used else 0)
            expected.append(group)
        assert spark.range(1).select(ly.greedy_groups(F.array(*[F.lit(s).cast("long") for s in sizes]), 100, glue).alias("g")).first()["g"] == expected


def test_packed_entries(spark):
    got = document_queries.Q["spl_packed_entries"](spark, SF).orderBy("doc_id", "chunk_index").collect()
    turns = {}
    for c in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(c["conv_id"], []).append(c)
    for conv, rows in turns.items():
        chunks = [[]]
        for c in rows:
            text = c["text"].strip(" ")
            if not text:
                continue
            if chunks[-1] and len("\n\n".join(x[1] for x in chunks[-1])) + 2 + len(text) > 500:
                chunks.append([])
            chunks[-1].append((c, text))
        mine = [x for x in got if x["doc_id"] == conv]
        assert [x["content"] for x in mine] == ["\n\n".join(t for _, t in k) for k in chunks if k]
        assert [x["kinds"] for x in mine] == [",".join(c["role"] for c, _ in k) for k in chunks if k]


def test_split_table(spark):
    html = "<table><tr><th>a b</th></tr><tr><td>c</td></tr><tr><td>d e</td></tr></table>"
    got = spark.range(1).select(ly.split_table(F.lit(html), 14).alias("x")).first()["x"]
    assert "".join(got).count("<tr>") == 3 and len(got) > 1 and all(x.startswith("<table><tr>") and x.endswith("</tr></table>") for x in got)
    assert spark.range(1).select(ly.split_table(F.lit("no rows"), 14).alias("x")).first()["x"] == []


@pytest.mark.parametrize(
    ("html", "chunks"),
    [
        ("<h2>Head</h2><p>one <b>two</b></p><table><tr><td>x</td></tr></table><p>three</p>", ["## Head\none two\nthree", "<table><tr><td>x</td></tr></table>"]),
        ("<style>a</style><script>b</script>plain", ["plain"]),
        ("<div>a b c d e f g h</div>", ["a b c d e ", "f g h"]),
        ("<h1></h1><p>你好世界再见</p>", ["你好世界再见"]),
        ("", []),
    ],
)
def test_html_chunks(html, chunks):
    assert sp.html_chunks(html, 5) == chunks
    assert sp.cut_block("你好世界再见 ab c", 5) == ["你好世界再", "见 ab c"]


def test_like_frames_against_a_loop(spark):
    rows = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_id", "value").orderBy("user_id", "event_id").collect()
    kept, last = {}, {}
    for x in rows:
        h = [float(x["value"] % 7), float(x["value"] % 5), float(x["event_id"] % 3)] if x["event_id"] % 11 else None
        before = last.get(x["user_id"])
        if h and before:
            parts = [(a - b) ** 2 / (a + b) for a, b in zip(h, before, strict=True) if a + b > 0]
            if (sum(parts) / len(parts) if parts else 0.0) <= 1 - 0.4:
                continue
        kept.setdefault(x["user_id"], []).append(x["event_id"])
        last[x["user_id"]] = h or before
    got = {}
    for x in sequence_queries.Q["wn_like_frames"](spark, SF).orderBy("user_id", "new_idx").collect():
        got.setdefault(x["user_id"], []).append(x["event_id"])
    assert got == kept


def test_tail_cut(spark):
    def cut(roles, costs, budget=10):
        rows = [(1, i, role.strip("*"), cost, "*" in role) for i, (role, cost) in enumerate(zip(roles, costs, strict=True))]
        return sq.tail_cut(spark.createDataFrame(rows, "k int, i int, role string, cost int, calls_tools boolean"), "k", "i", budget).first()["cut"]

    assert cut(["system", "user", "assistant", "user", "assistant"], [1, 50, 50, 5, 5]) == 2
    assert cut(["user", "assistant*", "tool", "tool", "assistant", "assistant", "user"], [9] * 7) == 1
    assert cut(["user", "user", "assistant*", "tool", "tool", "assistant", "assistant"], [1, 1, 1, 40, 4, 4, 4]) == 1
    assert cut(["user"], [99]) == 1


def test_research(spark):
    q = spark.createDataFrame([(1,), (2,)], "query_id int")
    some = lambda n: lambda left, k: left.crossJoin(spark.range(n).select((F.col("id") + 100 * k).alias("key")))
    got = r.research(q, [some(6), some(7)], enough=10).groupBy("query_id").agg(F.max("round").alias("m"), F.count(F.lit(1)).alias("n")).collect()
    assert [(x["m"], x["n"]) for x in got] == [(1, 13), (1, 13)]
    assert r.research(q, [some(1)], enough=10).agg(F.max("round")).first()[0] == 2
    assert r.research(q, [some(0)], enough=10).count() == 0


def test_projects_and_schools(spark):
    works = spark.createDataFrame([(1, 1, "Acme Ltd"), (1, 2, "Acme"), (1, 3, "")], "person int, work_id int, company string")
    projects = spark.createDataFrame([(1, 7, "acme"), (1, 8, "Acme Ltd Berlin"), (1, 9, "other"), (2, 1, "acme"), (1, 10, None)], "person int, project_id int, company string")
    got = {(x["person"], x["project_id"]): x["work_id"] for x in resume.match_projects(works, projects).collect()}
    assert got == {(1, 7): 1, (1, 8): 1, (1, 9): None, (2, 1): None, (1, 10): None}
    bad = spark.createDataFrame([(1, "not json"), (2, None)], "id int, raw string")
    assert [x["name"] for x in resume.flattened(bad).collect()] == [None, None]


def test_routes():
    assert r.route("question_hybrid", True, False) == "content_hybrid" and r.route("all_vector", False) == "none" and r.route("x", False) == "content_bm25"
