"""Substring dedup with a count-min prefilter.

A window is `width` consecutive words of one document.  A word goes if a window over it also starts
earlier: in a document with a smaller doc_id, or earlier in the same one.

1. Each partition counts hashes of all windows in a count-min sketch; the counters stop at two, as only
   "once" and "more than once" matter.  The sketches are merged block by block.  A counter never
   understates, so a window that occurs twice is always estimated repeated.
2. A second pass sends on the windows estimated repeated, with 96 bits of hash.  Of equal ones within a
   step of text only the first goes on; the others are repeats already and leave as runs.  Sorted by hash
   and place, all but the first of equal windows are repeats; nothing is lost, and what the sketch
   overestimated falls out here.
3. Repeats go back to their documents and cover words.

The sketch has two rows of a power of two counters, about two for each window up to `max_width`;
beyond that its estimates get worse, more windows take the exact pass, and results stay the
same.  Its bits, max_width / 4 bytes at most, are all that is broadcast.

Defined results: a null text has no words; a document of fewer words than a window loses none; a null doc_id
comes after all others; rows that agree in doc_id and text are one document; an empty table gives an empty
result; extra columns are kept out.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling
from .common import small_batches

LAST = (1 << 63) - 1
BLOCK = 1 << 18
#: Odd multipliers that give the sketch's rows their places.
ROWS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def keyed_documents(docs: DataFrame) -> DataFrame:
    """docs with doc, which orders documents, and id32, a hash of the text; both name a document."""
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.hash(F.coalesce("text", F.lit(""))).alias("id32"), "text")


def places(h: np.ndarray, row: int, width: int) -> np.ndarray:
    return ((h * np.uint64(ROWS[row])) >> np.uint64(64 - (width.bit_length() - 1))).astype(np.int64)


def count_places(counters: np.ndarray, place: np.ndarray) -> None:
    """Adds sorted places to one row of two-bit counters, four in a byte, which stop at two."""
    if not len(place):
        return
    new = np.concatenate([[True], place[1:] != place[:-1]])
    first = np.flatnonzero(new)
    times = np.minimum(np.diff(np.concatenate([first, [len(place)]])), 2).astype(np.uint8)
    place = place[first]
    for lane in range(4):
        mine = (place & 3) == lane  # each byte comes once for a lane
        at, shift = place[mine] >> 2, np.uint8(2 * lane)
        now = counters[at]
        sum_ = np.minimum((now >> shift & 3) + times[mine], 2).astype(np.uint8)
        counters[at] = now & ~np.uint8(3 << 2 * lane) | sum_ << shift


def sketch_batches(size: int, width: int):
    """Counts the windows of a partition; leaves compressed blocks of counters."""

    def count(batches):
        import pyarrow as pa

        schema = pa.schema([("block", pa.int64()), ("counters", pa.binary())])
        table = np.zeros((len(ROWS), width // 4), dtype=np.uint8)
        for batch in batches:
            for step in rolling.steps(batch.column("text")):
                at, _ = step.windows(size)
                h = rolling.window_hashes(step.hashes(0), size)[at]
                for row in range(len(ROWS)):
                    count_places(table[row], np.sort(places(h, row, width)))
        for row in range(len(ROWS)):
            for block in range(0, width, BLOCK):
                part = table[row, block // 4 : (block + BLOCK) // 4]
                if part.any():
                    yield pa.RecordBatch.from_pydict({"block": [row * width + block], "counters": [zlib.compress(part.tobytes(), 1)]}, schema)

    return count


def merge_batches(batches):
    """Adds up the counters of each block, which come one after another; leaves a bit for each that reached two."""
    import pyarrow as pa

    schema = pa.schema([("block", pa.int64()), ("bits", pa.binary())])
    now, total = None, None
    give = lambda: pa.RecordBatch.from_pydict({"block": [now], "bits": [np.packbits(total >= 2).tobytes()]}, schema)
    for batch in batches:
        for block, counters in zip(batch.column("block").to_pylist(), batch.column("counters").to_pylist(), strict=True):
            packed = np.frombuffer(zlib.decompress(counters), dtype=np.uint8)
            part = np.stack([packed & 3, packed >> 2 & 3, packed >> 4 & 3, packed >> 6], axis=1).reshape(-1)
            if block != now:
                if now is not None:
                    yield give()
                now, total = block, part.copy()
            else:
                total = np.minimum(total + part, 2)
    if now is not None:
        yield give()


def sketch_width(texts: DataFrame, max_width: int) -> int:
    """A power of two, about two counters for each word of the texts at six bytes a word, max_width at most."""
    size = texts.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    width = BLOCK
    while width < size / 3 and width < max_width:
        width *= 2
    return width


def repeated_bits(texts: DataFrame, size: int, width: int) -> np.ndarray:
    """The merged sketch as bits, row after row: those of counters at two."""
    spark = texts.sparkSession
    # one sketch for each core at work rather than for each file: what is shuffled follows the cluster
    partial = texts.select("text").coalesce(max(1, spark.sparkContext.defaultParallelism)).mapInArrow(sketch_batches(size, width), "block long, counters binary")
    merged = partial.repartition("block").sortWithinPartitions("block").mapInArrow(merge_batches, "block long, bits binary")
    bits = np.zeros(len(ROWS) * width // 8, dtype=np.uint8)
    for r in merged.toLocalIterator():
        got = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
        bits[r["block"] // 8 : r["block"] // 8 + len(got)] = got
    return bits


#: n is 0 for a window whose turn is to come, else the length of a run of sure repeats.
WINDOWS = "h long, g int, doc long, id32 int, start int, n int"


def pack(docs: np.ndarray, ids: np.ndarray, row: np.ndarray, parts: list[np.ndarray]) -> bytes:
    """Columns of windows as bytes: each document once with its count, then the parts as they are.

    A window takes about 15 bytes in the shuffle this way, half of what it takes as a row.
    """
    new = np.concatenate([[True], row[1:] != row[:-1]])
    at = np.flatnonzero(new)
    counts = np.diff(np.concatenate([at, [len(row)]])).astype(np.int32)
    doc = docs[row[at]]
    head = zlib.compress(np.diff(doc, prepend=np.int64(0)).tobytes() + counts.tobytes(), 1)
    body = [ids[row[at]].tobytes(), *(p.tobytes() for p in parts)]
    return b"".join([np.array([len(at), len(row), len(head)], dtype=np.int32).tobytes(), head, *body])


def unpack(packed: bytes, kinds: list) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    n_docs, n, n_head = np.frombuffer(packed, dtype=np.int32, count=3)
    head = zlib.decompress(packed[12 : 12 + n_head])
    doc = np.cumsum(np.frombuffer(head, dtype=np.int64, count=n_docs))
    counts = np.frombuffer(head, dtype=np.int32, offset=8 * n_docs)
    ids = np.frombuffer(packed, dtype=np.int32, count=n_docs, offset=12 + n_head)
    at, parts = 12 + n_head + 4 * n_docs, []
    for kind in kinds:
        parts.append(np.frombuffer(packed, dtype=kind, count=n, offset=at))
        at += parts[-1].nbytes
    return np.repeat(doc, counts), np.repeat(ids, counts), parts


def deal_keys(spark, n: int) -> np.ndarray:
    """For each of n partitions a number that hash partitioning puts there."""
    found = spark.range(20 * n + 100).select("id", F.expr(f"pmod(hash(id), {n})").alias("p")).groupBy("p").agg(F.min("id").alias("id")).collect()
    keys = np.arange(n, dtype=np.int64)
    for r in found:
        keys[r["p"]] = r["id"]
    return keys


def candidate_batches(size: int, width: int, sketch, keys: np.ndarray):
    """Packs of the windows estimated repeated, dealt by hash; of those with an equal one earlier in the same step, runs of sure repeats."""

    def find(batches):
        import pyarrow as pa

        bits, n_deals = sketch.value, np.uint64(len(keys))
        for batch in batches:
            docs, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "id32"))
            for step in rolling.steps(batch.column("text")):
                at, rows = step.windows(size)
                h = rolling.window_hashes(step.hashes(0), size)[at]
                keep = np.ones(len(h), dtype=bool)
                for row in range(len(ROWS)):
                    place = places(h, row, width) + row * width
                    keep &= (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)
                if not keep.any():
                    continue
                at, rows, h = at[keep], rows[keep], h[keep]
                g = (rolling.window_hashes(step.hashes(1), size)[at] >> np.uint64(32)).astype(np.uint32)
                doc, start = docs[step.first + rows], at - step.row_words[rows]
                order = np.lexsort((start, doc, g, h))
                new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])])
                head = order[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
                sure = np.zeros(len(h), dtype=bool)
                sure[order] = (doc[order] != doc[head]) | (start[order] != start[head])
                out: dict[str, list] = {"deal": [], "sure": [], "packed": []}
                if sure.any():
                    # windows are in the order of the text, so a run of sure ones is a stretch of it
                    opens = sure & ~np.concatenate([[False], sure[:-1] & (at[1:] == at[:-1] + 1) & (rows[1:] == rows[:-1])])
                    n = np.bincount(np.cumsum(opens)[sure] - 1)
                    out["deal"].append(int(keys[step.first % len(keys)]))
                    out["sure"].append(True)
                    out["packed"].append(pack(docs, ids, step.first + rows[opens], [start[opens].astype(np.int32), n.astype(np.int32)]))
                to = np.where(sure, n_deals, (h >> np.uint64(20)) % n_deals).astype(np.int64)
                order = np.argsort(to, kind="stable")
                ends = np.searchsorted(to[order], np.arange(len(keys) + 1))
                for k in np.flatnonzero(np.diff(ends)):
                    mine = order[ends[k] : ends[k + 1]]
                    out["deal"].append(int(keys[k]))
                    out["sure"].append(False)
                    out["packed"].append(pack(docs, ids, step.first + rows[mine], [h[mine], g[mine], start[mine].astype(np.int32)]))
                yield pa.RecordBatch.from_pydict(out, pa.schema([("deal", pa.int64()), ("sure", pa.bool_()), ("packed", pa.binary())]))

    return find


def window_batches(batches):
    """Packs as rows, one for each window or sure run."""
    import pyarrow as pa

    for batch in batches:
        for sure, packed in zip(batch.column("sure").to_pylist(), batch.column("packed").to_pylist(), strict=True):
            if sure:
                doc, ids, (start, n) = unpack(packed, [np.int32, np.int32])
                h, g = np.zeros(len(doc), dtype=np.int64), np.zeros(len(doc), dtype=np.int32)
            else:
                doc, ids, (h, g, start) = unpack(packed, [np.int64, np.int32, np.int32])
                n = np.zeros(len(doc), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (h, g, doc, ids, start, n)], names=["h", "g", "doc", "id32", "start", "n"])


def repeat_batches(batches):
    """Of windows sorted by hash and place, all that start after the first of their kind, and the sure runs as they are."""
    import pyarrow as pa

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h, g, doc, start, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "g", "doc", "start", "n"))
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
        goes_on = last is not None and (h[0], g[0]) == last[:2]
        head = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        first_doc, first_start = doc[head], start[head]
        if goes_on:
            same = head == 0
            first_doc, first_start = np.where(same, last[2], first_doc), np.where(same, last[3], first_start)
        repeat = (n > 0) | (doc != first_doc) | (start != first_start)
        last = (h[-1], g[-1], first_doc[-1], first_start[-1])
        yield pa.RecordBatch.from_arrays([pa.array(doc[repeat]), batch.column("id32").filter(pa.array(repeat)), pa.array(start[repeat]), pa.array(np.maximum(n[repeat], 1))], names=["doc", "id32", "start", "n"])


COVERED = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def cover_batches(size: int, with_text: bool):
    """What each document keeps."""

    def cover(batches):
        import pyarrow as pa

        kinds = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())]
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            out: list[tuple] = []
            for doc_id, text, runs in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("runs"), strict=True):
                word = text.encode().split() if text else []
                gone = np.zeros(len(word) + 1, dtype=np.int32)
                if runs.is_valid and len(runs):
                    start, n = (runs.values.field(c).to_numpy(zero_copy_only=False) for c in ("start", "n"))
                    np.add.at(gone, start, 1)
                    np.add.at(gone, start + n + size - 1, -1)
                keep = np.cumsum(gone)[: len(word)] == 0
                kept = b" ".join(itertools.compress(word, keep.tolist()))
                out.append((doc_id, len(word), int(len(word) - keep.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for _, t in kinds], schema=pa.schema(kinds))

    return cover


def repeats(keyed: DataFrame, size: int, max_width: int) -> DataFrame:
    """(doc, id32, runs): windows of each document that also start earlier, as structs (start, n) of n windows in a row."""
    width = sketch_width(keyed, max_width)
    sketch = keyed.sparkSession.sparkContext.broadcast(repeated_bits(keyed, size, width))
    keys = deal_keys(keyed.sparkSession, int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = keyed.select("doc", "id32", "text").mapInArrow(candidate_batches(size, width, sketch, keys), "deal long, sure boolean, packed binary")
    # of a kind of window each step of text sends at most one that isn't sure, so no hash is hot
    windows = found.repartition("deal").mapInArrow(window_batches, WINDOWS).sortWithinPartitions("n", "h", "g", "doc", "start")
    repeat = windows.mapInArrow(repeat_batches, "doc long, id32 int, start int, n int")
    # rows that agree in doc_id and text send the same windows: a place counts once
    return repeat.groupBy("doc", "id32").agg(F.collect_set(F.struct("start", "n")).alias("runs"))


def covered_documents(docs: DataFrame, size: int, max_width: int, with_text: bool) -> DataFrame:
    small_batches(docs.sparkSession)
    keyed = keyed_documents(docs)
    runs = repeats(keyed, size, max_width)
    return keyed.join(runs, ["doc", "id32"], "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "runs").mapInArrow(cover_batches(size, with_text), COVERED)


def dedup_texts(docs: DataFrame, size: int = 20, max_width: int = 1 << 27) -> DataFrame:
    """(doc_id, kept_text) of every document: the words that are left, joined by one space."""
    return covered_documents(docs, size, max_width, with_text=True).select("doc_id", "kept_text")


def dedup(docs: DataFrame, size: int = 20, max_width: int = 1 << 27) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs (doc_id, text)."""
    return covered_documents(docs, size, max_width, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS phrase FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
f AS (SELECT phrase, min({'d': doc_id, 'i': i}) AS first FROM v GROUP BY phrase HAVING count(*) > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM v JOIN f USING (phrase) WHERE {'d': doc_id, 'i': i} > first),
k AS (SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN g USING (doc_id, p)),
s AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM k GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)
"""
