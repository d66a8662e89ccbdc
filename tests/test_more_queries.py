"""Registered queries without SQL against plain loops over their own tables, and functions on odd rows."""

from collections import Counter
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusmill import ports
from corpusmill.functions import text as tx
from corpusmill.operators import page_structure as ps
from corpusmill.operators import resume
from corpusmill.operators import retrieval as r
from corpusmill.operators import splitters as sp
from corpusmill.plans import document_queries, model_queries, page_queries
from corpusmill.plans.retrieval_queries import _chunks, _queries
from corpusmill.sources import readers

from .conftest import SF
from .test_layout import plain_lines


def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_titled_markdown(spark):
    got = {}
    for x in document_queries.spl_markdown_titles(spark, SF).collect():
        got.setdefault(x["doc_id"], []).append((x["chunk_index"], x["content"], x["title"], x["level"]))
    several = 0
    for doc, text in texts(spark).items():
        lines = ["#" * (1 + len(line) % 3) + " " + line if i % 4 == 1 else line for i, line in enumerate(text.split("\n"))]
        sections = []
        for line in lines:
            m = re.match(r"^(#{1,6})\s+(.+)", line)
            if m or not sections:
                sections.append([line, m[2].strip() if m else "", len(m[1]) if m else 0])
            else:
                sections[-1][0] += "\n" + line
        chunks, now = [], None
        for content, title, level in [s for s in sections if s[0].strip()]:
            if now and len(now[0]) + 2 + len(content) <= 400:
                now[0] += "\n\n" + content
                if level and (not now[2] or level < now[2]):
                    now[1:] = [title, level]
                several += 1
            else:
                now = [content, title, level]
                chunks.append(now)
        out = [(p, t, n) for c, t, n in chunks for p in ([c] if len(c) <= 400 else sp.cut_section(c, 400)) if len(p.strip()) >= 50]
        assert [x[1:] for x in sorted(got.get(doc, []))] == out
    assert several > 5


def test_files_by_extension(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    expected = {(x["doc_id"], i, c) for x in rows for i, c in enumerate(sp.markdown(x["text"]) if x["lang"] == "en" else sp.recursive_merged(x["text"]))}
    assert {(x["doc_id"], x["chunk_index"], x["content"]) for x in document_queries.spl_files(spark, SF).collect()} == expected
    pages = spark.createDataFrame([(1, "a.PDF", "one. " * 200), (2, "b", "one. " * 200), (3, "c.md", None)], "doc_id int, source string, text string")
    lengths = {}
    for x in sp.split_files(pages).collect():
        lengths.setdefault(x["doc_id"], []).append(len(x["content"]))
    assert set(lengths) == {1, 2}


def test_contents_query(spark):
    """The registered query over all documents: lines in order, a removed stretch at a time."""
    got = {}
    for x in document_queries.wn_contents(spark, SF).collect():
        got.setdefault(x["doc_id"], []).append((x["pos"], x["text"]))
    for doc, text in texts(spark).items():
        lines = ["Contents", text[:12], "second entry", "third entry", *text.split("\n")]
        kept, i = [], 0
        while i < len(lines):
            if not re.fullmatch("contents|目录|目次|tableofcontents|致谢|acknowledge", re.sub(r"\s", "", lines[i].lower())):
                kept.append((i, lines[i]))
                i += 1
                continue
            entry = next((k for k in range(i + 1, len(lines)) if lines[k].strip()), None)
            if entry is None:
                break
            words = lines[entry].split()
            begin = " ".join(words[:2]) if re.match(r"[0-9a-zA-Z :'.-]{5,}", lines[i].strip()) else lines[entry].strip()[:3]
            i = next((k for k in range(entry + 1, min(len(lines), entry + 129)) if lines[k].startswith(begin)), entry + 1)
        assert sorted(got[doc]) == kept


def test_lines_query(spark):
    pages = {}
    for w in document_queries._words(spark, SF).collect():
        pages.setdefault((w["doc_id"], w["page"]), []).append({k: float(w[k]) if k != "text" else w[k] for k in ("text", "x0", "x1", "top", "bottom")})
    expected = {(*key, i, x["text"], x["x0"], x["x1"], x["top"], x["bottom"]) for key, words in pages.items() for i, x in enumerate(plain_lines(words))}
    got = {tuple(x[c] for c in ("doc_id", "page", "line", "text", "x0", "x1", "top", "bottom")) for x in document_queries.wn_lines(spark, SF).collect()}
    assert got == expected


def test_overlaps_query(spark):
    x = document_queries._words(spark, SF).withColumns({"page": F.col("doc_id"), "id": F.concat_ws("-", "page", "text", "x0"), "score": F.crc32("text") % 97, "kind": F.col("page")})
    rows = {(b["page"], b["kind"], b["id"]): b for b in x.collect()}

    def share(a, b):
        both = max(0, min(a["x1"], b["x1"]) - max(a["x0"], b["x0"])) * max(0, min(a["bottom"], b["bottom"]) - max(a["top"], b["top"]))
        size = lambda c: (c["x1"] - c["x0"]) * (c["bottom"] - c["top"])
        return both / (size(a) + size(b) - both)

    kept = {}
    for key, b in sorted(rows.items(), key=lambda kv: (-kv[1]["score"], kv[0][2])):
        own = kept.setdefault(key[:2], [])
        if all(share(b, k) <= 0.3 for k in own):
            own.append(b)
    got = {tuple(x) for x in document_queries.wn_without_overlaps(spark, SF).collect()}
    # a word that stands twice at the same place, once on either line, is dropped to one of the two before; such ids aren't compared
    twice = {k for k, n in Counter((b["page"], b["kind"], b["id"]) for b in x.collect()).items() if n > 1}
    pages = {k[0] for k in twice}
    assert {g for g in got if g[0] not in pages} == {(*k, b["id"]) for k, own in kept.items() for b in own if k[0] not in pages}


def test_hyde(spark):
    """The vector of the answer, the words of the query: fused from the two searches by ranks."""
    port = ports.HashEmbedding(64)
    chunks, queries = _chunks(spark, SF), _queries(spark, SF)
    vectors = chunks.select("chunk_id", port(F.col("content")).alias("embedding"))
    asked = queries.select("query_id", port(F.concat("query", F.lit(" the answer"))).alias("vector"))
    two = [r.knn(vectors, asked, 20).collect(), r.bm25(chunks, queries, 20).collect()]
    got = {}
    for x in model_queries.ret_hyde(spark, SF).collect():
        got.setdefault(x["query_id"], {})[x["chunk_id"]] = x["score"]
    fused = r.hybrid(spark.createDataFrame(two[0]), spark.createDataFrame(two[1]), 10).collect()
    assert {(q, c): pytest.approx(s) for q, own in got.items() for c, s in own.items()} == {(x["query_id"], x["chunk_id"]): x["score"] for x in fused}
    # the answer's words move the vector search, not the keyword search
    plain = {(x["query_id"], x["chunk_id"]) for x in r.knn(vectors, queries.select("query_id", port(F.col("query")).alias("vector")), 20).collect()}
    assert plain != {(x["query_id"], x["chunk_id"]) for x in two[0]}


def plain_clean(regions, boxes, share):
    """Removals one at a time from a list of neighbours."""
    out, i = list(regions), 0
    area = lambda b: max(0, b["x1"] - b["x0"]) * max(0, b["bottom"] - b["top"])
    common = lambda a, b: max(0, min(a["x1"], b["x1"]) - max(a["x0"], b["x0"])) * max(0, min(a["bottom"], b["bottom"]) - max(a["top"], b["top"]))
    while i + 1 < len(out):
        a, b = out[i], out[i + 1]
        if a["type"] != b["type"] or not common(a, b) or max(common(a, b) / area(a), common(a, b) / area(b)) < share:
            i += 1
        elif a["score"] and b["score"]:
            out.pop(i + 1 if a["score"] > b["score"] else i)
        else:
            out.pop(i + 1 if sum(common(x, a) for x in boxes) > sum(common(x, b) for x in boxes) else i)
    return [x["pos"] for x in out]


def test_regions_query(spark):
    pages, boxes = {}, {}
    for x in page_queries._regions(spark, SF).collect():
        pages.setdefault(x["page"], []).append(x.asDict())
        boxes.setdefault(x["page"], []).append(x.asDict() | {"x0": x["x0"] + 10, "x1": x["x0"] + 30})
    got = {}
    for x in page_queries.wn_clean_regions(spark, SF).collect():
        got.setdefault(x["page"], []).append(x["pos"])
    expected = {p: plain_clean(sorted(own, key=lambda x: x["pos"]), boxes[p], 0.7) for p, own in pages.items()}
    assert {p: sorted(v) for p, v in got.items()} == expected
    assert any(len(v) < len(pages[p]) for p, v in expected.items())


def test_tightest_ties_and_gaps(spark):
    rng = random.Random(4)
    box = lambda i: (rng.randrange(2), rng.randrange(2), i, x := rng.randrange(30), x + rng.randrange(1, 20))
    ours, theirs = [box(i) for i in range(40)], [box(i) for i in range(25)]
    schema = "page int, region int, id int, x0 int, x1 int"
    far = lambda a, b: min(abs(a[3] - b[3]), abs(a[4] - b[4]), abs(a[3] + a[4] - b[3] - b[4]) / 2)
    expected = {(*a[:3], *min(((c[2], far(a, c)) for c in theirs if c[:2] == a[:2]), key=lambda x: (x[1], x[0]), default=(None, None))) for a in [*ours, (9, 9, 99, 1, 2)]}
    got = ps.tightest(spark.createDataFrame([*ours, (9, 9, 99, 1, 2)], schema), spark.createDataFrame(theirs, schema))
    assert {tuple(x) for x in got.collect()} == expected


def one(spark, c, **values):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_tool_summaries(spark):
    for name, content, expected in [
        ("web_search", '{"query": "' + "q" * 120 + '", "results": [1, 2]}', f'[web_search] query="{"q" * 100}" 2 results (152 chars)'),
        ("knowledge_search", "no json", "[knowledge_search] 0 results (7 chars)"),
        ("knowledge-base", '{"query": "", "results": {"a": 1}}', "[knowledge-base] (34 chars)"),
        ("code_execution", "line\nline", "[code_execution] `line line` (2 lines)"),
        ("code_execution", '{"exit_code": 1, "output": ""}', '[code_execution] exit=1 `{"exit_code": 1, "output": ""}` (1 lines)'),
        ("mcp__x", "y" * 1234, f"[mcp__x] {'y' * 80}... (1,234 chars)"),
        (None, " \n", "[unknown] (2 chars, 0 lines)"),
    ]:
        assert one(spark, tx.tool_summary(F.lit(name).cast("string"), F.lit(content))) == expected


def test_front_matter(spark):
    got = one(spark, tx.front_matter(F.lit("---\nname: a b\ndescription: \"x: y\"\nlicense: MIT # yes\nallowed-tools: [read, write]\nmetadata:\n  category: c\n  tags:\n  - p\n  - q\n---\n\nBody\n---\n")))
    assert (got["valid"], got["name"], got["description"], got["license"], got["allowed_tools"], got["category"], got["tags"], got["body"]) == (True, "a b", "x: y", "MIT", ["read", "write"], "c", ["p", "q"], "Body\n---")
    for bad in ("no dashes", "---\nname: x\n---\nb", "text\n---\nname: x\n---\n", ""):
        assert not one(spark, tx.front_matter(F.lit(bad)))["valid"]
    assert not one(spark, tx.front_matter(F.lit(None).cast("string")))["valid"]


def test_profile_fields(spark):
    b = lambda t: one(spark, resume.birth(F.lit(t).cast("string"), 2026))
    assert tuple(b("1985-7")) == ("1985-07-07", "0707", 41) and tuple(b("1985年13月40")) == ("1985-01-01", "0101", 41)
    assert b("unknown") is None and b(None) is None and b("") is None
    assert one(spark, resume.keywords(F.lit("Java, C++；大 数据;x.y"))) == ["java", "c++", "大", "数据", "x", "y"]
    assert one(spark, resume.mobile(F.lit("0086 139-1234-5678"))) == "13912345678" and one(spark, resume.mobile(F.lit(None).cast("string"))) == ""
    assert one(spark, resume.degree_name(F.lit("1"))) == "本科" and one(spark, resume.degree_code(F.lit("mba "))) == "6" and one(spark, resume.degree_name(F.lit(None).cast("string"))) == ""


def shape(x, y, *paragraphs):
    off = f'<p:spPr><a:xfrm><a:off x="{x}" y="{y}"/></a:xfrm></p:spPr>' if x is not None else ""
    body = "".join(f"<a:p>{how}<a:r><a:t>{t}</a:t></a:r></a:p>" for how, t in paragraphs)
    return f"<p:sp>{off}<p:txBody>{body}</p:txBody></p:sp>"


def test_slides(spark, tmp_path):
    ns = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    cell = lambda t: f"<a:tc><a:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></a:txBody></a:tc>"
    table = "<p:graphicFrame><p:xfrm><a:off x='0' y='500'/></p:xfrm><a:graphic><a:graphicData><a:tbl>" + "".join(f"<a:tr>{cell(a)}{cell(b)}</a:tr>" for a, b in (("Name", "Age"), ("Al", "7"))) + "</a:tbl></a:graphicData></a:graphic></p:graphicFrame>"
    group = f"<p:grpSp><p:grpSpPr><a:xfrm><a:off x='0' y='900'/></a:xfrm></p:grpSpPr>{shape(50, 905, ('', 'right'))}{shape(5, 907, ('', 'left'))}</p:grpSp>"
    first = shape(30, 101, ("", "second")) + shape(10, 108, ("", "first"), ('<a:pPr lvl="1"><a:buChar char="x"/></a:pPr>', "item"), ("", " ")) + group + table + shape(None, None, ("", "title"))
    slide = lambda shapes: f"<p:sld {ns}><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:sld>"
    with zipfile.ZipFile(tmp_path / "t.pptx", "w") as z:
        z.writestr("ppt/presentation.xml", f'<p:presentation {ns}><p:sldIdLst><p:sldId id="1" r:id="r2"/><p:sldId id="2" r:id="r1"/></p:sldIdLst></p:presentation>')
        z.writestr("ppt/_rels/presentation.xml.rels", '<Relationships><Relationship Id="r1" Target="slides/slide1.xml"/><Relationship Id="r2" Target="/ppt/slides/slide2.xml"/></Relationships>')
        z.writestr("ppt/slides/slide1.xml", slide(shape(0, 0, ("", "last"))))
        z.writestr("ppt/slides/slide2.xml", slide(first))
    expected = ["title\nfirst\n  .item\nsecond\nName: Al; Age: 7\nleft\nright", "last"]
    assert readers.slides((tmp_path / "t.pptx").read_bytes()) == expected
    assert [(x["type"], x["text"]) for x in readers.read_documents(spark, str(tmp_path)).collect()] == [("ppt", "\n\n".join(expected))]
