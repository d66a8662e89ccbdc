import zipfile

from pyspark.sql import functions as F

from corpusmill.sources import readers, sinks
from corpusmill.streaming import jobs


def test_read_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("文本".encode("gbk"))
    (tmp_path / "b.html").write_text("<p>x <b>y</b></p><script>z</script>")
    (tmp_path / "c.txt").write_text("  \n")
    (tmp_path / "d.bin").write_text("no")
    with zipfile.ZipFile(tmp_path / "e.docx", "w") as z:
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>p1</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c1</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    got = {r["type"]: r["text"] for r in readers.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"text": "文本", "html": "x\ny\nz", "docx": "p1\nc1"}


def test_epub_and_tables(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:x"><rootfiles><rootfile full-path="O/book.opf"/></rootfiles></container>')
        z.writestr("O/book.opf", '<package xmlns="urn:y"><manifest><item id="a" href="a%20b.xhtml"/><item id="c" href="../c.xhtml"/><item id="n" href="none.xhtml"/></manifest><spine><itemref idref="c"/><itemref idref="a"/><itemref idref="n"/></spine></package>')
        z.writestr("O/a b.xhtml", "<p>second</p>")
        z.writestr("c.xhtml", "<p>first</p><p>é</p>")
    assert [r["text"] for r in readers.read_documents(spark, str(tmp_path)).collect()] == ["first\né\n\nsecond"]
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    row = lambda *c: f"<w:tr>{''.join(map(cell, c))}</w:tr>"
    with zipfile.ZipFile(tmp_path / "t.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:tbl>{row("Name", "Age")}{row("Al", "7")}{row("", "8")}</w:tbl></w:body></w:document>')
    assert readers.docx_table_lines((tmp_path / "t.docx").read_bytes()) == "Name: Al;Age: 7\nAge: 8"
    assert readers.decode(b"\xef\xbb\xbfx", ("ascii", "utf-8-sig")) == "x" and readers.decode("\U00020000".encode("gb18030"), readers.PROBED) == "\U00020000"


def test_grep(spark, tmp_path):
    (tmp_path / "a.py").write_text("one\ntwo hit\nthree\nfour\n")
    (tmp_path / "b.txt").write_text("hit")
    got = readers.grep(spark, str(tmp_path), "h.t", glob="*.py", context=1).collect()
    assert sorted((r["line_no"], r["line"], r["hit"]) for r in got) == [(1, "one", False), (2, "two hit", True), (3, "three", False)]


def test_test_cases(spark, tmp_path):
    (tmp_path / "t.csv").write_text('question,expected_answer\n" a ",b\n,c\n')
    (tmp_path / "t.json").write_text('{"name": "n", "test_cases": [{"question": "q", "expected_answer": " x "}, {"question": "q2", "expected_answer": ""}]}')
    assert [tuple(r) for r in readers.test_cases(spark, str(tmp_path / "t.csv")).collect()] == [("a", "b")]
    assert [tuple(r) for r in readers.test_cases(spark, str(tmp_path / "t.json")).collect()] == [("q", "x")]


def test_file_kind(spark):
    rows = spark.createDataFrame([(b"PK\x03\x04",), (b"RIFF0000WAVE",), (b"0000ftypisom",), (b"x",)], "c binary")
    assert [r["k"] for r in rows.select(readers.file_kind(F.col("c")).alias("k")).collect()] == ["zip", "wav", "mp4", "unknown"]


CHUNK = "chunk_id string, document_id long, chunk_index int, content string, version long, space_id long, kb_id long"


def test_upsert_and_delete(spark, tmp_path):
    path = str(tmp_path / "chunks")
    rows = [("1_0", 1, 0, "a", 1, 1, 1), ("1_1", 1, 1, "b", 1, 1, 1), ("2_0", 2, 0, "c", 1, 1, 2)]
    sinks.upsert(spark, spark.createDataFrame(rows, CHUNK), path)
    new = spark.createDataFrame([("1_1", 1, 1, "B", 2, 1, 1)], CHUNK)
    for _ in range(2):
        sinks.upsert(spark, new, path)
    assert sorted((r["chunk_id"], r["content"]) for r in spark.read.parquet(path).collect()) == [("1_0", "a"), ("1_1", "B"), ("2_0", "c")]
    page = sinks.chunk_page(spark, path, 1, 1, 1).collect()
    assert [(r["chunk_id"], r["total"]) for r in page] == [("1_1", 2)]
    sinks.delete(spark, spark.createDataFrame([(2,)], "document_id long"), path)
    assert sorted(r["chunk_id"] for r in spark.read.parquet(path).collect()) == ["1_0", "1_1"]


def test_tables_are_made_and_dropped(spark, tmp_path):
    import pytest

    path = str(tmp_path / "t")
    sinks.drop(spark, path)
    for _ in range(2):
        sinks.ensure(spark, path, CHUNK)
    assert not sinks.exists(spark, str(tmp_path / "none"))
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_text("not parquet")
    # a table that can't be read isn't taken for a missing one
    with pytest.raises(Exception, match="(?i)parquet|footer"):
        sinks.upsert(spark, spark.createDataFrame([("1_0", 1, 0, "a", 1, 1, 1)], CHUNK), str(tmp_path / "broken"))
    texts = sinks.save_full_texts(spark.createDataFrame([(1, "t", 2)], "doc_id int, text string, x int"), str(tmp_path / "f"))
    assert [tuple(r) for r in texts.collect()] == [(1, "t")]
    sinks.export_results(spark.createDataFrame([(1, ["a"])], "i int, c array<string>"), str(tmp_path / "e"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "e")).first()["c"] == '["a"]'


def test_ingest_replays_to_the_same_table(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    spark.createDataFrame([("1_0", 1, 0, "a", 1, 1, 1), ("3_0", 3, 0, "z", 1, 1, 1)], CHUNK).write.parquet(source)
    gone = spark.createDataFrame([(3,)], "document_id long")
    for run in range(2):
        jobs.ingest(spark, source, CHUNK, table, str(tmp_path / f"cp{run}"), gone).awaitTermination()
    assert [r["chunk_id"] for r in spark.read.parquet(table).collect()] == ["1_0"]


def run_stream(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_windowed_counts(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:20:00", "a", 2.0), ("2024-01-01 05:00:00", "b", 1.0)], "ts string, event_type string, value double").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    rows.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e"))
    got = run_stream(spark, jobs.windowed_counts(stream), "counts", "complete").filter("event_type = 'a'").first()
    assert (got["n"], got["total"]) == (2, 3.0)


def test_scrub_at_every_cut():
    text = "a<think>b</think>c <x> <memory-context>d</memory-context>e"
    for cut in range(len(text) + 1):
        shown, held, inside = jobs.scrub(text[:cut], "", "")
        more, held, inside = jobs.scrub(text[cut:], held, inside)
        assert shown + more + held == "ac <x> e" and not inside


def test_stateful_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "a<thi"), (1, 2, "nk>b</think>c")], "stream_id long, seq long, piece string")
    rows.write.parquet(str(tmp_path / "s"))
    got = run_stream(spark, jobs.scrubbed_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "s"))), "scrubbed")
    assert "".join(r["shown"] for r in got.orderBy("seq").collect()) == "ac"
    calls = spark.createDataFrame([(1, i, "x") for i in range(6)], "run_id long, seq long, signature string")
    calls.write.parquet(str(tmp_path / "c"))
    got = run_stream(spark, jobs.loop_stream(spark.readStream.schema(calls.schema).parquet(str(tmp_path / "c"))), "loops")
    assert [r["verdict"] for r in got.orderBy("seq").collect()] == [None, None, "warning", None, "stop", "stop"]
