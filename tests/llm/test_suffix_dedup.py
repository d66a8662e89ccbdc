"""Suffix dedup against brute force: odd rows, hot anchors, pieces of long texts, the merge itself."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from corpusmill.llm import suffix_dedup
from corpusmill.llm.substring_dedup import LAST

from .test_operators import ROWS, SCHEMA


def brute(rows, size):
    least = {}
    for doc, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - size + 1):
            least.setdefault(data[i : i + size], set()).add(LAST if doc is None else doc)
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, dtype=bool)
        for i in range(len(data) - size + 1):
            if min(least[data[i : i + size]]) < (LAST if doc is None else doc):
                gone[i : i + size] = True
        kept = bytes(b for b, g in zip(data, gone, strict=False) if not g)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(data) else 0
        out.append((str(doc), len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


@pytest.mark.parametrize(("size", "range_bytes"), [(50, 1 << 20), (50, 3000), (16, 1 << 20), (33, 2000)])
def test_odd_rows(spark, size, range_bytes):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    want = brute([r[:2] for r in ROWS], size)
    assert result(suffix_dedup.dedup(docs, size=size, range_bytes=range_bytes)) == want


def test_hot_passage_and_neighbours(spark):
    """One passage in every document, different texts around it, periodic texts and copies: few and many ranges agree with brute force."""
    rng = random.Random(8)
    some = lambda n: "".join(rng.choice("ab é\n") for _ in range(n))
    passage, base = some(120), some(400)
    rows = [(i, rng.choice([some(30) + passage + some(30), "ab" * 60, base[rng.randrange(200) :], passage[30:90], some(49), some(50), "\x00" * 70 + some(5)])) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows, 50)
    for range_bytes in (1 << 20, 300):
        assert result(suffix_dedup.dedup(docs, range_bytes=range_bytes)) == want
    kept = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.dedup_bytes(docs).collect()}
    assert sorted(hashlib.sha256(k).hexdigest() for k in kept.values()) == sorted(w[-1] for w in want)
    # a sketch so small that it lets everything through changes nothing
    assert result(suffix_dedup.dedup(docs, max_width=1)) == want


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup.dedup(none).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert suffix_dedup.dedup(none).count() == 0
    with pytest.raises(ValueError, match="16 to 500"):
        suffix_dedup.dedup(none, size=8)


def test_pieces_of_long_texts(monkeypatch):
    """Every window start lies in one piece, with the same anchor as in the whole text."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcd ") for _ in range(n)) for n in (49, 50, 999, 3000, 0)] + [None]

    def found(steps):
        out = {}
        for step in steps:
            at, first, last, piece, h = suffix_dedup.anchors(step, 50)
            for a, f, e, p, x in zip(at, first, last, piece, h, strict=True):
                shift = step.bases[p] - step.at[p]
                for w in range(f, e + 1):
                    assert (step.rows[p], w + shift) not in out
                    out[step.rows[p], w + shift] = (a + shift, x)
        return out

    whole = found(suffix_dedup.steps(pa.array(texts), 50))
    assert len(whole) == 1 + 950 + 2951
    monkeypatch.setattr(suffix_dedup, "STEP", 100)
    assert found(suffix_dedup.steps(pa.array(texts), 50)) == whole


def test_loser_tree():
    """Any number of runs comes out in order, with the lengths shared with the row before."""
    rng = random.Random(5)
    for k in (1, 2, 3, 7, 12):
        runs, every = [], []
        for _ in range(k):
            rows = sorted(bytes(rng.choice(b"ab") for _ in range(8)) for _ in range(rng.randrange(1, 40)))
            table = np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(-1, 8)
            shared = suffix_dedup.shared_with_previous(table)
            runs.append((shared.tolist(), b"".join(r[n:] for r, n in zip(rows, shared, strict=True))))
            every += rows
        keys, lengths, source = suffix_dedup.merged_runs(runs, 8)
        assert keys == sorted(every)
        assert lengths == suffix_dedup.shared_with_previous(np.frombuffer(b"".join(keys), dtype=np.uint8).reshape(-1, 8)).tolist()
        assert [source.count(r) for r in range(k)] == [len(n) for n, _ in runs]
