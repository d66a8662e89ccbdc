"""Each operator on odd rows (nulls, empty and long texts, ties, repeats, clashing columns) and empty tables, against brute force."""

import base64
import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import decontamination, html_text, language_id, line_rules, mixing, ngram_join, quality_bayes, registry, sharding, substring_dedup, warc

from ..conftest import SF
from ..helpers import same

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc long, key string, host string, Size int, _own int"


def made_rows():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(60)]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, shared = sentence(80), sentence(25)
    near = base.split()
    near[40] = "other"
    texts = [base, base, " ".join(near), f"{sentence(30)}\n{shared}\n{sentence(30)}", f"{shared} {sentence(50)}", None, "", "  \n\t ", "one", "One two", "a b c " * 30, sentence(20_000), f"{sentence(60)} {base}", "Émile 中文 ß"]
    rows = [(i, t, ["en", "fr", None][i % 3], ["s1", None, "s2", ""][i % 4], len(t or ""), 1, "k", "h", 2, 3) for i, t in enumerate(texts)]
    # a repeated row, a null id, and one id with two texts
    return [*rows, rows[0], (None, base, "en", None, 1, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None), (3, sentence(40), "en", "s1", 5, 1, "k", "h", 2, 3)]


ROWS = made_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def split_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# 2


def bench_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans(decontamination.UPPER, decontamination.LOWER)))


def test_decontamination(spark, docs, none):
    words = bench_words(ROWS[0][1])
    items = [(1, " ".join(words[3:20]).upper()), (10, "ONE"), (9, None), (8, ""), (7, " ".join(words[60:66])), (6, "absent words here"), (5, "a b c a b c a b c a b c"), (1, " ".join(words[3:20]))]
    benchmark = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc int")
    windows = {(i, tuple(w[k : k + 10])) for i, t in items for w in [bench_words(t)] if w for k in range(max(1, len(w) - 9))}
    expected = []
    for row in ROWS:
        w, hit, found = bench_words(row[1]), set(), set()
        for i, x in windows:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    found.add(str(i))
        expected.append((str(row[0]), len(w), len(hit), sorted(found), bool(hit)))
    got = decontamination.decontaminate(docs, benchmark)
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["item_ids"], r["contaminated"]) for r in got.collect()) == sorted(expected)
    assert decontamination.decontaminate(none, benchmark).count() == 0
    assert decontamination.decontaminate(docs, benchmark.limit(0)).filter("contaminated").count() == 0
    near = decontamination.proximity_matches(docs, spark.createDataFrame([(1, "b a c")], "item_id long, text string"))
    assert {r["doc_id"] for r in near.collect()} == {10}


def test_decontamination_with_a_large_benchmark(spark, monkeypatch):
    """A benchmark over the bound of broadcasts takes salted joins, with the same result."""
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = lambda df: sorted(map(str, df.select("doc_id", "n_words", "n_hit", "item_ids").collect()))
    small = rows(decontamination.decontaminate(docs, bench))
    near = sorted(map(str, decontamination.proximity_matches(docs, bench).collect()))
    monkeypatch.setattr(decontamination, "MAX_BROADCAST_ROWS", 3)
    assert rows(decontamination.decontaminate(docs, bench)) == small
    assert sorted(map(str, decontamination.proximity_matches(docs, bench).collect())) == near


# 3


def removed(rows, size):
    order = lambda i: (1, 0) if i is None else (0, i)
    first = {}
    for i, t, *_ in rows:
        w = split_words(t)
        for k in range(len(w) - size + 1):
            x = tuple(w[k : k + size])
            first[x] = min(first.get(x, (order(i), k)), (order(i), k))
    out = []
    for i, t, *_ in rows:
        w = split_words(t)
        gone = {p for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] < (order(i), k) for p in range(k, k + size)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_substring_dedup(spark, docs, none):
    for size in (20, 3):
        got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.dedup(docs, size, max_width=1 << 18).collect())
        assert got == removed(ROWS, size)
    assert substring_dedup.dedup(none).count() == 0
    kept = {r["kept_text"] for r in substring_dedup.dedup_texts(docs).filter("doc_id = 1").collect()}
    assert kept == {""}


def test_sketch_never_understates():
    import numpy as np

    rng = np.random.default_rng(1)
    values = rng.integers(0, 4000, 6000)
    counters = np.zeros(1 << 10, dtype=np.uint8)
    for part in np.array_split(values, 7):
        substring_dedup.count_places(counters, np.sort(part))
    lanes = np.stack([counters & 3, counters >> 2 & 3, counters >> 4 & 3, counters >> 6], axis=1).reshape(-1)
    seen = collections.Counter(values.tolist())
    assert [min(2, seen[v]) for v in range(4096)] == lanes.tolist()


def test_packs_return_what_they_took():
    import numpy as np

    rng = np.random.default_rng(2)
    docs, ids, row = rng.integers(0, 1 << 62, 9), rng.integers(0, 1 << 30, 9).astype(np.int32), np.sort(rng.integers(0, 9, 50))
    h, start = rng.integers(-(1 << 62), 1 << 62, 50), rng.integers(0, 1000, 50).astype(np.int32)
    doc, i, (x, y) = substring_dedup.unpack(substring_dedup.pack(docs, ids, row, [h, start]), [np.int64, np.int32])
    assert (doc == docs[row]).all() and (i == ids[row]).all() and (x == h).all() and (y == start).all()


# 5


def test_sharding(docs, none):
    got = sharding.shard_by_bytes(docs, 4).collect()
    sizes = sorted((str(i), len((t or "").encode()) + 8) for i, t, *_ in ROWS)
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sizes
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert 0 <= r["shard"] < 4
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_by_bytes(none).count() == 0


def test_sharding_is_even_and_splits_a_hot_text(spark):
    hot = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, F.lit("same text " * 9)).otherwise(F.repeat(F.lit("x"), (F.col("id") % 90).cast("int"))).alias("text")).withColumnRenamed("id", "doc_id")
    bytes_ = [r["b"] for r in sharding.shard_by_bytes(hot, 6).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(bytes_) == 6 and max(bytes_) < 1.08 * sum(bytes_) / 6


def test_sharding_columns_and_groups(spark):
    """size, text_crc32 and slots of every document; equal texts share a shard."""
    import zlib

    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    got = registry.queries()["op5_sharding"](spark, SF.replace("0.001", "0.01")).collect()
    assert len(got) == len(text)
    shards, groups = collections.defaultdict(list), collections.defaultdict(set)
    for r in got:
        t = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 8, zlib.crc32(t), "bytes", None)
        shards[r["shard"]].append(r)
        groups[t].add(r["shard"])
    assert set(shards) == set(range(24)) and all(sorted(r["slot"] for r in rows) == list(range(len(rows))) for rows in shards.values())
    total, longest = sum(r["size"] for r in got), max(r["size"] for r in got)
    assert max(sum(r["size"] for r in rows) for rows in shards.values()) <= total / 24 + longest + total / 480
    whole = [g for t, g in groups.items() if (len(t) + 8) * sum(v.encode() == t for v in text.values()) <= total / 960]
    assert all(len(g) == 1 for g in whole) and sum(len(g) == 1 for g in groups.values()) >= 0.99 * len(groups)


def test_find_range(spark):
    cuts = [3, 7, 7, 10, 40, 41, 50]
    rows = spark.range(60).select("id", sharding.find_range(F.col("id"), cuts).alias("r")).collect()
    assert all(r["r"] == sum(c <= r["id"] for c in cuts) for r in rows)


# 8


def test_line_rules(spark, docs, none):
    got = {(str(r["doc_id"]), r["n_words"]): r for r in line_rules.quality_rules(docs, least_docs=2, host_share=0.0).collect()}
    for i, t, *_ in ROWS:
        w = split_words(t)
        grams = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        repeat = {p for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for p in range(k, k + 3)}
        lines = [x for x in (t or "").split("\n") if split_words(x)]
        r = got[str(i), len(w)]
        assert (r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeat))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(repeat) > 50 * len(w))
    assert line_rules.quality_rules(none).count() == 0


def test_frequent_lines_go(spark):
    rows = [(i, f"Page {i}\nwords of number {i} alone\nFOOTER 12  text", "h") for i in range(6)] + [(9, "footer 99 text\nfooter 12 text", "h"), (10, "footer 1 text", "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in line_rules.quality_rules(docs, least_docs=7, host_share=0.1, min_left=0.3).collect()}
    assert got[0]["n_removed"] == 3 and got[9]["n_left"] == 0 and not got[9]["kept"] and got[10]["n_removed"] == 0
    clean = {r["doc_id"]: r["text"] for r in line_rules.without_frequent_lines(docs, least_docs=7, host_share=0.1).collect()}
    assert clean[9] == "" and clean[10] == "footer 1 text" and "FOOTER" not in clean[0] and clean[0].startswith("Page 0")


def test_line_limit_is_alike_at_every_size(spark):
    """A line of a tenth of the documents goes in a host of 60 and in one of 600; clashing columns stay."""
    rows = [(n * 1000 + i, f"h{n}", f"own words {n} {i} {'x' * i}" + ("\nshared line" if i % 10 == 0 else ""), "mine", "k") for n in (60, 600) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, key string, doc_key string")
    got = line_rules.quality_rules(docs).filter("n_removed > 0").collect()
    assert len(got) == 66 and {r["n_removed"] for r in got} == {2}
    left = line_rules.without_frequent_lines(docs)
    assert left.columns == docs.columns and left.filter("text like '%shared%' or key != 'mine' or doc_key != 'k'").count() == 0 and left.count() == 660


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    same(registry.queries()[name](spark, SF), duck.execute(registry.oracle_sql()[name]))


# 9


def lague(targets, seats):
    got = [0] * len(targets)
    for _ in range(seats):
        best = max(range(len(targets)), key=lambda i: (targets[i] / (2 * got[i] + 1), -i))
        got[best] += 1
    return got


def test_sainte_lague(spark):
    rng = random.Random(7)
    for n, seats in [(1, 5), (5, 37), (12, 200), (40, 11)]:
        targets = [float(rng.randint(1, 2000)) for _ in range(n)]
        rows = spark.createDataFrame([(1, seats, f"{i:03}", t) for i, t in enumerate(targets)], "house long, seats_in_all long, source string, target double")
        got = {r["source"]: r["seats"] for r in mixing.sainte_lague(rows).collect()}
        assert [got.get(f"{i:03}", 0) for i in range(n)] == lague(targets, seats)


def water(sizes, weights):
    total, full = 1.5 * sum(sizes), set()
    while True:
        open_ = [i for i in range(len(sizes)) if i not in full]
        left = total - sum(2 * sizes[i] for i in full)
        level = left / sum(weights[i] for i in open_) if open_ else 0
        over = {i for i in open_ if level * weights[i] > 2 * sizes[i]}
        if not over:
            return [2.0 * sizes[i] if i in full else level * weights[i] for i in range(len(sizes))]
        full |= over


def test_mixing(spark, docs, none):
    got = mixing.mix(docs, block=4, n_shards=2).collect()
    assert len(got) == len(ROWS)
    sizes = collections.defaultdict(int)
    for row in ROWS:
        sizes[row[3]] += len(split_words(row[1]))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    expected = dict(zip(names, water([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True))
    taken = collections.defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(expected[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - expected[s]) <= 4 * 3 for s in names)
    key = lambda rows: sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in rows)
    assert key(got) == key(mixing.mix(docs.repartition(5), block=4, n_shards=2, rows_per_run=20_000).collect())
    assert mixing.mix(none).count() == 0


def test_shards_take_their_quotas(spark):
    """Each shard takes its own blocks: as many of a source as Sainte-Lague gives it, in an order of the source that goes round."""
    rows = [(i, "ab"[i % 3 == 0], " ".join(["w"] * (64 * (1 + i % 5)))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(docs, n_shards=4).collect()
    size, target = collections.Counter(), {}
    for r in got:
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
        assert r["taken"] == sum(r["shard_words"])
    seats = int(sum(target.values()) / 64 + 0.5)
    before = [0, 0]
    for shard in range(4):
        now = lague([target["a"], target["b"]], seats * (shard + 1) // 4)
        for k, s in enumerate("ab"):
            words = sum(r["shard_words"][shard] for r in got if r["source"] == s)
            assert words == 64 * (now[k] - before[k])
        before = now
    # no shard is another's copy, and none has a document's block twice while its quota is below the source
    assert len({tuple(r["shard_words"][k] for r in got) for k in range(4)}) == 4
    assert all(w <= r["size"] for r in got for w in r["shard_words"])


@pytest.mark.parametrize("percent", [10, 30, 60, 80, 150])
def test_whole_copies_meet_the_target(spark, percent):
    rng = random.Random(percent)
    rows = [(i, "ab"[i % 2] if i % 7 else None, "w " * rng.choice([rng.randint(1, 40), rng.randint(100, 400), rng.randint(300, 2000)])) for i in range(900)]
    taken = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), weights=(1, 1, 1), scale_percent=percent)
    longest, sums, targets = collections.Counter(), collections.Counter(), {}
    for r in mixing.whole_copies(taken, rows_per_run=50).collect():
        assert r["taken"] // r["size"] <= r["copies"] <= -(-r["taken"] // r["size"])
        sums[r["source"]] += r["copies"] * r["size"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
        targets[r["source"]] = r["target"]
    assert len(sums) == 3 and all(abs(sums[s] - targets[s]) <= 1.2 * longest[s] + 64 * 3 for s in sums)


def test_mixed_stage_meets_the_target(spark):
    import corpus_pipeline

    rng = random.Random(5)
    # rows without an id, many of one size: they are rows of their own
    rows = [(None if i % 3 == 0 else i, "abc"[i % 3], " ".join(f"w{i}" for _ in range(70 if i % 2 else rng.randint(100, 900))), i) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, number int")
    want = {r["source"]: r["target"] for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    got = collections.Counter()
    for r in corpus_pipeline.mixed(spark, docs, SF).collect():
        got[r["source"]] += len(r["text"].split())
    assert all(abs(got[s] - want[s]) <= 900 + 64 * 3 for s in want)


# 10


def test_ngram_join(spark, docs, none):
    got = ngram_join.join(docs).collect()
    grams = {}
    for _, t, *_ in ROWS:
        if t is not None:
            w = split_words(t)
            grams[t] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    texts = list(grams)
    links = [(a, b) for i, a in enumerate(texts) for b in texts[:i] if grams[a] and grams[b] and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])]
    degree = collections.Counter(x for pair in links for x in pair)
    by_key = {hashlib.md5(t.encode()).hexdigest(): t for t in texts}
    assert links and len(got) == len(ROWS)
    assert all(r["n_links"] == degree[by_key[r["key"]]] for r in got if r["key"])
    classes = {r["key"]: r["class_node"] for r in got if r["key"]}
    for a, b in links:
        ka, kb = (hashlib.md5(x.encode()).hexdigest() for x in (a, b))
        assert classes[ka] == classes[kb]
    assert len(set(classes.values())) == len(texts) - len(links)  # links of these rows have no cycle
    assert ngram_join.join(none).count() == 0
    left = ngram_join.first_of_each_class(docs)
    assert left.columns == docs.columns and left.filter("doc_id = 1 or doc_id = 2").count() == 0


def test_large_group_is_one_class(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(120):
        w = list(base)
        w[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows.append((999, " ".join(f"z{i}" for i in range(200))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.join(docs, leaf=4).collect()
    assert {r["class_id"] for r in got} == {0, 999}
    assert sum(r["is_first"] for r in got) == 2
    assert all(r["n_links"] > 0 for r in got if r["doc_id"] < 120)


@pytest.mark.parametrize("block_grams", [ngram_join.BLOCK_GRAMS, 10_000])
def test_pairs_hidden_in_a_family(spark, monkeypatch, block_grams):
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", block_grams)
    rng = random.Random(8)
    fresh_word = iter(range(10**6))

    def changed(words, n):
        words, step = list(words), len(words) // n
        for k in range(n):
            words[k * step + rng.randrange(step - 5)] = f"x{next(fresh_word)}"
        return words

    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    alike = lambda a, b: len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    template = [f"w{i}" for i in range(400)]
    family = [changed(template, 6) for _ in range(200)]
    hidden = {k: changed(family[k], 6) for k in range(0, 200, 10)}
    assert max(alike(family[i], family[i + 1]) for i in range(199)) < 0.8
    assert all(0.8 <= alike(family[k], h) < 0.9 for k, h in hidden.items())
    rows = [(k, " ".join(w)) for k, w in enumerate(family)] + [(1000 + k, " ".join(w)) for k, w in hidden.items()]
    texts = [*family, *hidden.values()]
    sets = [grams(w) for w in texts]
    links = collections.Counter()
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links.update((rows[i][0], rows[j][0]))
    got = {r["doc_id"]: r for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k]["class_id"] == got[1000 + k]["class_id"] for k in hidden)
    assert {k: r["n_links"] for k, r in got.items() if r["n_links"]} == dict(links)


def test_levels_reach_the_recall():
    assert ngram_join.levels(16, 8, 0.8, 0.999) == [4, 6, 8]
    assert 1 - (1 - 0.8**4) ** 16 >= 0.999


# 6


PAGES = [(1, "http://a/x", "<p>one</p>"), (2, "http://b", "<p>one</p>"), (3, None, None), (4, "u", ""), (5, "u\r\nWARC/1.1", "line\nWARC/1.1\r\nWARC-Type: response\r\n\r\nß"), (1, "http://a/x", "<p>one</p>"), (None, "n", "z" * 100_000)]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "k", "x") for p in PAGES], "page_id long, url string, html string, payload string, first_id string")
    warc.write_archives(warc.with_revisits(pages), str(tmp_path / "w"))
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    first = {}
    for i, _, h in sorted(PAGES, key=lambda p: (p[0] is None, p[0] or 0)):
        first.setdefault(h or "", i)
    expected = []
    for i, _, h in PAGES:
        p = (h or "").encode()
        revisit = first[h or ""] != i
        expected.append((str(i), len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", str(first[h or ""] if revisit else None), h or ""))
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"]), r["payload"]) for r in got) == sorted(expected)
    warc.write_archives(warc.with_revisits(pages.limit(0)), str(tmp_path / "empty"))
    assert warc.read_archives(spark, str(tmp_path / "empty")).count() == 0


def record(i, payload):
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n"


def kept_and_lost(data):
    out = list(warc.salvage(data))
    assert sum(n for _, r, n, _ in out if r is None) == sum(n for *_, n, _ in out)
    return [r["payload"] for _, r, _, _ in out if r], [(at, n) for at, r, n, _ in out if not r]


def test_salvage():
    a, b, c = (record(i, bytes([97 + i]) * 50) for i in range(3))
    assert kept_and_lost(a + b + c) == ([b"a" * 50, b"b" * 50, b"c" * 50], [])
    broken = b.replace(b"Content-Length: 50", b"Content-Length: 51")
    assert kept_and_lost(a + broken + c) == ([b"a" * 50, b"c" * 50], [(len(a), len(broken))])
    assert kept_and_lost(a + b[:-30]) == ([b"a" * 50], [(len(a), len(b) - 30)])
    assert kept_and_lost(b"junk" + a) == ([b"a" * 50], [(0, 4)])
    za, zb, zc = map(warc.gzip_member, (a, b, c))
    hurt = bytearray(zb)
    hurt[len(hurt) // 2] ^= 255
    assert kept_and_lost(za + bytes(hurt) + zc) == ([b"a" * 50, b"c" * 50], [(len(za), len(zb))])
    assert kept_and_lost(za + b + zc)[1] == []
    assert kept_and_lost(b"") == ([], [])


def test_salvage_keeps_to_a_damaged_record():
    """A record within the payload of a damaged one isn't one of the archive's."""
    a, c = record(0, b"a" * 50), record(2, b"c" * 50)
    inner = record(9, b"false")
    hurt = record(1, b"x" * 50 + inner + b"y" * 50).replace(b"Content-Length", b"WARC-Payload-Digest: sha1:AAAA\r\nContent-Length", 1)
    assert kept_and_lost(a + hurt + c) == ([b"a" * 50, b"c" * 50], [(len(a), len(hurt))])
    assert kept_and_lost(a + hurt) == ([b"a" * 50], [(len(a), len(hurt))])
    # with a wrong length nothing tells where it ends
    assert kept_and_lost(a + hurt.replace(b"Length: ", b"Length: 1", 1) + c)[0] == [b"a" * 50, b"false", b"c" * 50]


def test_salvage_takes_linear_time():
    import os
    import time

    members = [warc.gzip_member(record(i, os.urandom(700).hex().encode())) for i in range(16_000)]
    hurt = [m[:300] + b"\0\0\0" + m[303:] if i % 3 == 1 else m for i, m in enumerate(members)]
    for data, n in [(b"".join(members), 16_000), (b"".join(hurt), 16_000 - 5_333), (warc.GZIP * 100_000, 0), (b"WARC/1.1\r\nContent-Length: 99\r\n" * 20_000, 0)]:
        began = time.time()
        assert sum(r is not None for _, r, _, _ in warc.salvage(data)) == n
        assert time.time() - began < 10


def test_archives_are_valid_and_bounded(spark, tmp_path):
    pages = spark.createDataFrame([(i % 3, f"http://x/{i}", ("p" if i % 5 else "q" * 70_000) * (i % 4)) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(warc.with_revisits(pages), str(tmp_path / "w"))
    heads = []
    for f in (tmp_path / "w").glob("part-*"):
        for _, r, _, _ in warc.salvage(f.read_bytes()):
            heads.append(r)
    assert len(heads) == 60 and len({r["warc-record-id"] for r in heads}) == 60
    assert all({"warc-type", "warc-record-id", "warc-date", "content-length"} <= set(r) for r in heads)
    assert all(("warc-profile" in r) == (r["warc-type"] == "revisit") for r in heads)


def test_quarantine_log(spark, tmp_path):
    a, b = record(1, b"x" * 9), record(2, b"y" * 9)
    (tmp_path / "d.warc").write_bytes(a + b"??" + b)
    rows = warc.read_archives(spark, str(tmp_path))
    assert [(r["offset"], r["gap_bytes"]) for r in warc.quarantine(rows).collect()] == [(len(a), 2)]
    assert rows.filter("record_type is not null").count() == 2


# 4


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<body><nav>menu</nav><article><h1>T</h1><p>a <b>b</b>c<br>d<p>e &lt;f&gt;</article><div class='ad'>buy</div><footer>x</footer>", "T a bc d e <f>"),
        ("<header>top</header><main><p>body text</p><form>q</form><section id='comments'><p>me too</p></section></main>", "body text"),
        ("<div class='cookie-notice'>ok?</div><div id='content'><p>This is a long enough paragraph of text.</p><p>Short.</p></div>", "This is a long enough paragraph of text. Short."),
        ("<article><script>var t='</p>'</script><style>p{}</style><p>x\n\n y&nbsp;z</p></article>", "x y z"),
        ("<article><p>cut off &am", "cut off &am"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>1<td>2</table></article>", "one two 1 2"),
        ("<article><div hidden>no</div><p>yes</p></article><aside>side</aside>", "yes"),
    ],
)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


LONG = "This paragraph of the body is long enough to stand well over any threshold of the page. " * 3


@pytest.mark.parametrize(
    ("html", "text"),
    [
        # the body in a div beside a teaser card
        (f"<div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><article><a>x</a><a>y</a><a>z</a></article>", " ".join([LONG.strip()] * 3)),
        # related cards beside the real article
        (f"<article><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></article><article><a>One</a> <a>more</a></article><article><a>And</a> <a>more</a></article>", " ".join([LONG.strip()] * 3)),
        # a wrapper with a marked name
        (f"<div class='layout with-sidebar'><article><p>{LONG}</p></article><div class='sidebar'><a>s</a></div></div>", LONG.strip()),
        (f"<div class='layout with-sidebar'><p>{LONG}</p></div>", LONG.strip()),
        # marked blocks of cards stay out
        (f"<article><p>{LONG}</p></article><div class='related'><article><a>One</a> <a>more</a></article></div>", LONG.strip()),
    ],
)
def test_clusters_choose_regions(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize("comment", ["<article class='comment'>{}</article>", "<article itemprop='comment'>{}</article>", "<div class='comments'>{}</div>"])
def test_comments_go(comment):
    body = f"<article><p>{LONG}</p>%s<p>{LONG}</p></article>%s"
    said = comment.format(f"<p>I disagree. {LONG}</p>")
    for html in (body % (said, ""), body % ("", said), body % (f"<article>{LONG}</article>", "")):
        assert html_text.main_text(html) == f"{LONG.strip()} {LONG.strip()}"


def test_marked_block_with_text_in_an_article():
    assert html_text.main_text(f"<article class='comment'><p>{LONG}</p></article>") == LONG.strip()  # nothing else is on the page


def test_a_very_long_page():
    paragraph = f"<p>{LONG}</p>"
    assert html_text.main_text(f"<nav>m</nav><article>{paragraph * 20_000}</article>") == " ".join([LONG.strip()] * 20_000)


def test_planted_article_text(spark):
    """By brute force: what lies in the pages' article elements, without the boxes in it."""
    import html as entities

    for r in spark.read.parquet(f"{SF.replace('0.001', '0.01')}/pages.parquet").select("page_id", "html").collect():
        inner = re.search(r"(?s)<article[^>]*>(.*)</article>", r["html"])
        if inner:
            plain = re.sub(r"(?is)<(script|style|form|aside|nav|footer)\b.*?</\1>|<div class=\"[^\"]*\">.*?</div>|<!--.*?-->", " ", inner[1])
            words = entities.unescape(re.sub(r"(?s)</?(b|i|em|strong|a|span)\b[^>]*>", "", plain).replace("<br>", " "))
            expected = " ".join(re.sub(r"(?s)<[^>]+>", " ", words).split())
            assert html_text.main_text(r["html"]) == expected, r["page_id"]


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x</p>", "t"), (1, "u", "<p>x</p>", "t"), (None, None, None, None)], "page_id long, url string, html string, text string")
    rows = [(r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract(pages).collect()]
    assert sorted(map(str, rows)) == sorted(map(str, [(1, "x", 1), (1, "x", 1), (None, "", 0)]))
    assert html_text.extract(pages.limit(0)).count() == 0


def test_smoothing_keeps_a_constant():
    assert html_text.smoothed([2.0] * 5) == pytest.approx([2.0] * 5)
    assert html_text.smoothed([]) == []


# 7


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    half = docs.withColumn("declared", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    got = language_id.identify(half.filter("n_chars > 100"), declared="declared").filter("doc_id % 2 = 1").collect()
    assert sum(r["language"] == r["lang"] for r in got) >= 0.97 * len(got)
    assert sum(r["language_kept"] for r in got) >= 0.98 * len(got)


def test_language_odd_rows(docs, none):
    got = language_id.identify(docs)
    assert got.columns == [*docs.columns, "language", "language_posterior", "language_kept"] and got.count() == len(ROWS)
    assert got.filter("language_kept and (text is null or text rlike '^[ \\\\s]*$')").count() == 0
    assert language_id.identify(none).count() == 0
    assert language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).filter("language_kept").count() == 0


def test_rare_languages_and_suffixes(spark):
    """Few rows of a language are enough in a large table; labels of a few rows are `und`; a host without a declaration goes by its suffix."""
    rng = random.Random(1)
    made = lambda letters, n: " ".join("".join(rng.choices(letters, k=4)) for _ in range(n))
    rows = [(i, made("abcde", 40), "aa", f"www{i % 9}.site.de") for i in range(3000)] + [(3000 + i, made("fghij", 40), "bb", f"w{i % 9}.site.fr") for i in range(3000)]
    rows += [(6000 + i, made("pqrst", 40), "cc", "w.it") for i in range(20)] + [(6100 + i, made("klmno", 40), f"r{i}", "z") for i in range(8)]
    rows += [(7000, made("pqrst", 40), None, None), (7001, made("klmno", 40), None, None), (7002, "abfg", None, "new.de"), (7003, "abfg", None, "new.fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["language"] for r in language_id.identify(docs, with_text=False).filter("doc_id >= 6000").collect()}
    assert all(got[6000 + i] == "cc" for i in range(20)) and all(got[6100 + i] == "und" for i in range(8))
    assert (got[7000], got[7001], got[7002], got[7003]) == ("cc", "und", "aa", "bb")


def test_evidence_of_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = pages.select("url", "html", language_id.host_of(F.col("url")).alias("host"), language_id.declared_in(F.col("html")).alias("lang")).collect()
    for r in rows:
        assert r["host"] == re.match(r"https?://([^/:]+)", r["url"])[1].lower()
        assert r["lang"] == re.search(r'<html[^>]* lang="(\w+)', r["html"])[1]
    made = spark.createDataFrame([("HTTPS://u@A.Example.CO:80/x.y?z.w", "a.example.co", "co"), ("http://10.0.0.1/", "10.0.0.1", ""), ("no address", None, ""), (None, None, "")], "url string, host string, suffix string")
    assert all(r["h"] == r["host"] and r["s"] == r["suffix"] for r in made.select("*", language_id.host_of(F.col("url")).alias("h"), language_id.suffix_of(language_id.host_of(F.col("url"))).alias("s")).collect())
    # a page's text by what its markup declares
    docs = pages.select("page_id", F.regexp_replace("html", "<[^>]*>", " ").alias("text"), language_id.declared_in(F.col("html")).alias("lang"), language_id.host_of(F.col("url")).alias("source"))
    assert language_id.identify(docs).filter("language != lang").count() == 0


# 1


def test_posterior_without_own_share(spark):
    """By brute force: a document's site posteriors leave the document out."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    one = docs.withColumn("source", F.when(F.col("doc_id") == 3, "alone").otherwise(F.col("source")))
    got = {r["doc_id"]: r for r in quality_bayes.classify(one, labels).collect()}
    rest = quality_bayes.classify(one.filter("source != 'alone'"), labels.filter("doc_id != 3")).agg(F.avg("host_posterior").alias("m")).first()["m"]
    # a site of one document has nothing but the corpus behind it
    assert got[3]["host_posterior"] == got[3]["path_posterior"] and abs(got[3]["host_posterior"] - rest) < 0.05


def test_quality_held_out(spark):
    sf = SF.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train, held = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    got = quality_bayes.classify(docs, train).join(held, "doc_id").collect()
    good = [r for r in got if r["quality"] == 1]
    assert sum(r["kept"] for r in good) >= 0.98 * len(good)
    assert sum(r["kept"] == (r["quality"] == 1) for r in got) >= 0.96 * len(got)


def test_quality_odd_rows(spark, docs, none):
    labels = spark.createDataFrame([(0, 1), (0, 0), (4, 1), (10, 0), (11, None), (None, 1)], "doc_id long, quality int")
    got = quality_bayes.classify(docs, labels)
    assert got.count() == len(ROWS) and got.filter("quality_posterior is null").count() == 0
    assert quality_bayes.classify(none, labels).count() == 0
    unlabelled = quality_bayes.classify(docs, labels.limit(0)).agg(F.min("quality_posterior").alias("a"), F.max("quality_posterior").alias("b")).first()
    assert unlabelled["a"] == pytest.approx(0.5) and unlabelled["b"] == pytest.approx(0.5)


def test_sparse_sites_shrink(spark):
    sites = spark.createDataFrame([(f"h{i}", 50.0 if i % 2 else 95.0, 100) for i in range(20)], "host string, good double, n long")
    assert quality_bayes.strength(sites, 0.725) < 10
    alike = spark.createDataFrame([(f"h{i}", 72.0, 100) for i in range(20)], "host string, good double, n long")
    assert quality_bayes.strength(alike, 0.725) > 100


# the pipeline


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontaminated", "mixed", "sharded"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.language(spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() >= 0.97 * docs.filter("text rlike '[a-z]'").count()
    clean = corpus_pipeline.decontaminated(spark, kept, SF)
    hit = decontamination.decontaminate(kept, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert clean.count() == hit.filter("not contaminated").count()
    sharded = corpus_pipeline.run(spark, SF)
    assert sharded.count() > 0 and {"doc_id", "shard", "slot"} <= set(sharded.columns)


def test_near_duplicates_stage(spark, docs):
    """By brute force: of linked texts, and of copies, the smallest doc_id stays."""
    import corpus_pipeline

    grams = {}
    for _, t, *_ in ROWS:
        w = split_words(t)
        grams[t] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    group = {t: t for t in grams}
    for a in grams:
        for b in grams:
            if a != b and grams[a] and grams[b] and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
                old, new = group[a], group[b]
                group = {t: new if g == old else g for t, g in group.items()}
    kept = set()
    first = {}
    for i, t, *_ in ROWS:
        if t is None:
            kept.add((str(i), t))
        elif group[t] not in first or (first[group[t]][0] is None, first[group[t]][0] or 0) > (i is None, i or 0):
            first[group[t]] = (i, t)
    kept |= {(str(i), t) for i, t in first.values()}
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == sorted((i, str(t)) for i, t in kept)


def test_sharded_stage(spark, docs):
    import corpus_pipeline

    got = corpus_pipeline.sharded(spark, docs, SF).collect()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(i), len((t or "").encode()) + 8) for i, t, *_ in ROWS)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))


def test_pipeline_odd_rows(spark, docs, none):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert {str(r["doc_id"]) for r in out.select("doc_id").collect()} <= {str(r[0]) for r in ROWS}
        if name != "sharded":
            assert out.columns == docs.columns
        assert stage(spark, none, SF).count() == 0
