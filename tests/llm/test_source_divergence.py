"""Source divergence against plain loops: odd rows, many blocks and tiles, long texts in pieces."""

import collections
import random
import re

from corpusmill.llm import source_divergence as sd

from .test_operators import ROWS, SCHEMA

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, least, top):
    """rows: (lang, source, text)."""
    rows = [(a or "", b or "", terms(t)) for a, b, t in rows]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == lang]
        held = collections.Counter(t for r in mine for t in set(r[2]))
        kept = {t for t, n in held.items() if n >= least}
        count = {s: collections.Counter(t for r in mine if r[1] == s for t in r[2] if t in kept) for s in {r[1] for r in mine}}
        whole = sum(count.values(), collections.Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in count.items()}, share(whole)
        for s in count:
            near = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in count if o != s]
            more = [(t, p[s][t] - q[t]) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", near, None), ("term", more, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(items[:most], 1)]
    return sorted(out)


def result(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def test_odd_rows(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    rows = [(r[2], r[3], r[1]) for r in ROWS]
    for least, top in ((1, 50), (2, 3), (30, 50)):
        assert result(sd.audit(docs, min_documents=least, top_terms=top)) == brute(rows, least, top)
    assert sd.audit(docs.limit(0)).columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sd.audit(docs.limit(0)).count() == 0


def test_many_blocks_and_tiles(spark):
    """Vocabulary in several automata, postings in several blocks, sources in several tiles: the same result."""
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcxyzé中") for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    some = lambda: rng.choice([" ", "\x00", "-1", "\n@"]).join(rng.choice([w, w.upper()]) for w in rng.choices(vocabulary, k=rng.randrange(60)))
    rows = [(rng.choice(["en", "de", None]), rng.choice([f"s{i}" for i in range(12)]), some()) for _ in range(250)]
    rows += [("lonely", "one", "word")] + [("fr", f"s{i}", None) for i in range(3)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(4)
    want = brute(rows, 5, 50)
    assert result(sd.audit(docs, min_documents=5)) == want
    assert result(sd.audit(docs, min_documents=5, block_terms=150, tile=5, block=900)) == want


def test_pieces():
    """Pieces hold each term once and end at delimiters; a term longer than a piece stays whole."""
    rng = random.Random(2)
    for text in ("", "a", " ", "  a  b ", "x" * 90, " ".join("abc"[: rng.randrange(4)] for _ in range(200)), "Ä-é9中" * 40):
        cut = sd.pieces(text, 16)
        assert all(p[:1] == p[-1:] == b" " for p in cut)
        assert [w.decode() for p in cut for w in p.split()] == terms(text)
