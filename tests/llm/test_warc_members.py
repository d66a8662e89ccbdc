"""WARC: references resolve, members with several records are read, large payloads share archives by size class."""

import gzip

from corpusmill.llm import warc

from .test_operators import record


def test_references_name_records(spark, tmp_path):
    same = [(1, "http://b/1", "same"), (1, "http://a/1", "same"), (2, "http://c", "same"), (5, None, "same"), (3, "http://d", None), (4, None, None), (None, "http://e", "same"), (6, "http://f", "own")]
    pages = spark.createDataFrame(same, "page_id long, url string, html string").repartition(3)
    warc.write_archives(warc.with_revisits(pages), str(tmp_path / "w"))
    heads = [r for f in (tmp_path / "w").glob("part-*") for _, r, _, _ in warc.salvage(f.read_bytes())]
    ids = {r["warc-record-id"]: r for r in heads}
    revisits = [r for r in heads if r["warc-type"] == "revisit"]
    assert len(ids) == 8 and len(revisits) == 4
    for r in revisits:
        of = ids[r["warc-refers-to"]]
        assert of["warc-type"] == "response" and of["payload"] == r["payload"] and of["warc-target-uri"] == r["warc-refers-to-target-uri"]
    got = sorted((str(r["page_id"]), r["refers_to"]) for r in warc.read_archives(spark, str(tmp_path / "w")).collect())
    assert got == [("1", None), ("1", None), ("2", 1), ("3", None), ("4", 3), ("5", 1), ("6", None), ("None", 1)]


def test_archives_packed_in_one_piece():
    a, b, c = (record(i, bytes([65 + i]) * (10 + i)) for i in range(3))
    read = lambda data: [(at, r and r["payload"], gap, why) for at, r, gap, why in warc.salvage(data)]
    whole = gzip.compress(a + b + c)
    assert [p for _, p, _, _ in read(whole)] == [b"A" * 10, b"B" * 11, b"C" * 12]
    # damage within the pack: the others are read, the gap has its reason
    hurt = bytearray(a + b + c)
    hurt[len(a) + len(b) - 1] ^= 1
    assert [(p, why) for _, p, _, why in read(gzip.compress(bytes(hurt)))] == [(b"A" * 10, ""), (None, "wrong length"), (b"C" * 12, "")]
    # members of one and of several records, with something between that isn't one
    mixed = gzip.compress(a) + b"??" + gzip.compress(b + c) + a
    assert read(mixed) == [(0, b"A" * 10, 0, ""), (len(gzip.compress(a)), None, 2, "no version line"), (len(mixed) - len(a) - len(gzip.compress(b + c)), b"B" * 11, 0, ""), (len(mixed) - len(a) - len(gzip.compress(b + c)), b"C" * 12, 0, ""), (len(mixed) - len(a), b"A" * 10, 0, "")]
    # a member without any record is a gap
    assert [p for _, p, _, _ in read(gzip.compress(b"nothing here") + a)] == [None, b"A" * 10]


def test_size_classes(spark, tmp_path, monkeypatch):
    """A large payload takes an archive of its own; those of other classes still share theirs."""
    monkeypatch.setattr(warc, "SHARED_BYTES", 100)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1600)
    sizes = [50] * 40 + [300] * 9 + [1500] * 2 + [9000] + [400, 401, 1600]
    pages = spark.createDataFrame([(i, "u", chr(97 + i % 26) * n) for i, n in enumerate(sizes)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(warc.with_revisits(pages), str(tmp_path / "w"))
    held = [[len(r["payload"]) for _, r, _, _ in warc.salvage(f.read_bytes())] for f in (tmp_path / "w").glob("part-*")]
    assert sorted(x for h in held for x in h) == sorted(sizes)
    assert all(sum(h) <= 1600 or len(h) == 1 for h in held)
    assert len(held) <= 3 + 3 + 4 + 1 + 1
