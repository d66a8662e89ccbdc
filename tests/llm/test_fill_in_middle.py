"""Fill-in-the-middle against a plain loop over code points, words and lines, and round trips of all outputs."""

import hashlib
import re

import pyarrow as pa
import pytest

from corpusmill.llm import fill_in_middle as fim

from .test_operators import ROWS, SCHEMA

TEXTS = ["", None, "a", "é", "😀", "<P>", "x <S> y", "a<P", ">b", "日本 語\n\nzwei  drei\n", "\n\n", " lead and trail ", "é‍", "<" * 30, "word " * 400, "ß\t中\r\n文" * 50, "<S", "S><M"]


def units(text, unit):
    if unit == "characters":
        return list(text)
    if unit == "lines":
        return re.findall(r"[^\n]*\n|[^\n]+", text)
    return re.findall(r"^[\t-\r ]+|[^\t-\r ]+[\t-\r ]*", text)


def brute(doc_id, text, unit, markers):
    t, digest = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    u = units(t, unit)
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    x, y, z = ("".join(p) for p in (u[:a], u[a:b], u[b:]))
    p, s, m = markers
    if not t or any(k in t for k in markers) or h[2] % 100 >= 90:
        return (str(doc_id), len(u), "plain", None, None, t)
    out = f"{s}{z}{p}{x}{m}{y}" if h[3] % 100 < 20 else f"{p}{x}{s}{z}{m}{y}"
    return (str(doc_id), len(u), "spm" if h[3] % 100 < 20 else "psm", a, b - a, out)


@pytest.mark.parametrize("unit", ["characters", "words", "lines"])
@pytest.mark.parametrize("markers", [("<P>", "<S>", "<M>"), ("[avant]", "¶suite", "文")])
def test_against_a_plain_loop(spark, unit, markers):
    rows = [*((r[0], r[1]) for r in ROWS), *((1000 + 50 * k + i, t) for k in range(8) for i, t in enumerate(TEXTS))]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, form string, N int").repartition(3)
    out = fim.fill_in_middle(docs, unit=unit, markers=markers)
    got = fim.restore(out, markers).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((str(r["doc_id"]), r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got), key=key) == sorted((brute(*r, unit, markers) for r in rows), key=key)
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted((str(i), t or "") for i, t in rows)
    forms = [r["form"] for r in got]
    assert min(forms.count(f) for f in fim.FORMS) > 3


def test_digests_and_empty(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = fim.digests(fim.fill_in_middle(docs)).collect()
    want = [brute(r[0], r[1], "characters", ("<P>", "<S>", "<M>")) for r in ROWS]
    assert sorted((str(r["doc_id"]), r["output_sha256"], r["restored_sha256"]) for r in got) == sorted((w[0], sha(w[-1]), sha(r[1] or "")) for w, r in zip(want, ROWS, strict=True))
    assert fim.digests(fim.fill_in_middle(docs.limit(0))).count() == 0
    for bad in (("a", "ab", "c"), ("aa", "b", "c"), ("<x", "x>", "y"), ("", "a", "b")):
        with pytest.raises(ValueError, match="overlap"):
            fim.fill_in_middle(docs, markers=bad)
    with pytest.raises(ValueError, match="unit"):
        fim.fill_in_middle(docs, unit="sentences")


def test_steps_cover_a_batch(monkeypatch):
    """Slices of a batch, and of a sliced one, hold its rows in order, a long text by itself."""
    monkeypatch.setattr(fim, "STEP", 10)
    texts = ["abc", None, "défg", "x" * 40, "", "", "yz", "k" * 9]
    for kind in (pa.string(), pa.large_string()):
        batch = pa.RecordBatch.from_arrays([pa.array(["before", *texts], kind)], names=["text"]).slice(1)
        seen = []
        for rows, t in fim.steps(batch, "text"):
            seen += [t.data[a:b].tobytes().decode() for a, b in zip(t.start, t.end, strict=True)]
            assert rows.num_rows == 1 or len(t.data) <= 10
        assert seen == [x or "" for x in texts]
