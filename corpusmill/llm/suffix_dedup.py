"""Suffix-array dedup: byte strings of a given size that also start in an earlier document, by a merge sort of suffixes.

A window is `size` bytes of one document.  A byte goes if a window over it also starts in a document with a smaller doc_id.

1. Anchors.  Of the grams of size / 2 bytes in a window, the one of the smallest hash (of equal ones the first) is the window's
   anchor.  Equal windows have their anchors at the same place, so the suffixes at anchors, about one in 13 at 50 bytes,
   stand for all.  An anchor's suffix ends with its last window; the bytes before it, back to its first window, go along.
2. Filter.  A count-min sketch, merged over the partitions, tells anchors that surely occur once; these go no further.  The
   sketch has `max_width` counters a row at most; a corpus that fills it lets more through, and results stay the same.
3. Runs.  Each task sorts its suffixes, run by run, cuts the runs at sampled splitters and sends them front-coded: of a
   suffix the length it shares with its predecessor, and the rest.  Of equal ones in a run only those of the first document
   go on; the others are covered already.
4. Merge.  A loser tree for each range combines the runs.  A node keeps how much its loser shares with what last passed there,
   so bytes known to agree aren't compared again, and the tree gives the LCP array of the merged suffixes as it goes.
5. Windows.  A window that begins o bytes before its anchor is equal to another if the merged suffixes share size - o bytes (an
   interval of the LCP array) and the bytes before share o (an interval of the same kind over the reversed bytes before).
   In each such pair of intervals all but the smallest document are covered.

Hot anchors: an anchor that a splitter names may be spread over several ranges, or be that of a third of all rows.  Its windows
go one by one instead, dealt by hash, as suffixes of `size` bytes through the same runs and the same tree; so no range holds more
than lies between two splitters, and a run sends a window once, however often it has it.

Defined results: null and empty texts have no bytes; a text shorter than a window loses none; a null doc_id comes after all
others, and rows of equal doc_id (null ones too) never cover each other; rows that agree in doc_id and text are one document and
each gets a row; long texts are read whole, in overlapping pieces; an empty table gives an empty result; extra columns are kept out.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .substring_dedup import BLOCK, ROWS, count_places, keyed_documents, merge_batches, places

U = np.uint64
#: Window starts that one step takes, from one text or several.
STEP = 1 << 20
#: Low bits of a gram's hash that give way to its place in the step.
PLACE = U((1 << 24) - 1)
#: Suffixes of a run.
RUN = 1 << 18
#: Text bytes for each range of suffixes, and sampled suffixes for each splitter.
RANGE_BYTES, DRAWS = 8 << 20, 64


class Step:
    """Pieces of texts, back to back: pieces overlap by less than a window, so that each window start is in one of them."""

    def __init__(self, rows: list[int], bases: list[int], pieces: list[bytes], size: int) -> None:
        self.rows, self.bases = np.array(rows), np.array(bases, dtype=np.int64)
        self.data = np.frombuffer(b"".join(pieces) + bytes(size + 8), dtype=np.uint8)
        lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        self.at = np.cumsum(lengths) - lengths
        self.n_starts = lengths - size + 1


def steps(texts, size: int) -> Iterator[Step]:
    """An Arrow array of texts in steps of about STEP window starts."""
    rows, bases, pieces, held = [], [], [], 0
    for first in range(0, len(texts), 256):
        for row, text in enumerate(texts.slice(first, 256).to_pylist(), first):
            data = (text or "").encode()
            for base in range(0, len(data) - size + 1, STEP):
                piece = data[base : base + STEP + size - 1]
                if held and held + len(piece) > STEP + size:
                    yield Step(rows, bases, pieces, size)
                    rows, bases, pieces, held = [], [], [], 0
                rows.append(row)
                bases.append(base)
                pieces.append(piece)
                held += len(piece)
    if held:
        yield Step(rows, bases, pieces, size)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * U(0x9E3779B97F4A7C15)
    x ^= x >> U(29)
    x *= U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


def anchors(step: Step, size: int) -> tuple[np.ndarray, ...]:
    """Place of each anchor in the step, its first and last window start, its piece, and a hash of its gram."""
    gram = size // 2
    span, n = size - gram + 1, len(step.data) - 8
    word = np.ndarray((n,), dtype="<u8", buffer=step.data, strides=(1,))
    least = mixed(word) & ~PLACE | np.arange(n, dtype=np.uint64)
    done = 1
    while done < span:
        more = min(done, span - done)
        least, done = np.minimum(least[:-more], least[more:]), done + more
    piece = np.repeat(np.arange(len(step.at)), step.n_starts)
    start = np.arange(len(piece)) - np.repeat(np.cumsum(step.n_starts) - step.n_starts, step.n_starts) + step.at[piece]
    place = (least[start] & PLACE).astype(np.int64)
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (piece[1:] != piece[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(place)]]) - 1
    at, h = place[first], np.zeros(len(first), dtype=np.uint64)
    for o in [*range(0, gram - 7, 8), gram - 8]:
        h = mixed(h ^ word[at + o])
    return at, start[first], start[last], piece[first], h


# filter


def sketch_batches(size: int, width: int):
    """Counts the anchors of a partition; leaves compressed blocks of two-bit counters."""

    def count(batches):
        import pyarrow as pa

        schema = pa.schema([("block", pa.int64()), ("counters", pa.binary())])
        table = np.zeros((len(ROWS), width // 4), dtype=np.uint8)
        for batch in batches:
            for step in steps(batch.column("text"), size):
                h = anchors(step, size)[-1]
                for row in range(len(ROWS)):
                    count_places(table[row], np.sort(places(h, row, width)))
        for row in range(len(ROWS)):
            for block in range(0, width, BLOCK):
                part = table[row, block // 4 : (block + BLOCK) // 4]
                if part.any():
                    yield pa.RecordBatch.from_pydict({"block": [row * width + block], "counters": [zlib.compress(part.tobytes(), 1)]}, schema)

    return count


def sketch_width(n_bytes: int, max_width: int) -> int:
    """A power of two, about two counters for each anchor, max_width at most."""
    width = BLOCK
    while width < n_bytes / 6 and width < max_width:
        width *= 2
    return width


def repeated_bits(texts: DataFrame, size: int, width: int) -> np.ndarray:
    """The merged sketch as bits, row after row: those of counters at two."""
    # one sketch for each core at work rather than for each file: what is shuffled follows the cluster
    partial = texts.select("text").coalesce(max(1, texts.sparkSession.sparkContext.defaultParallelism)).mapInArrow(sketch_batches(size, width), "block long, counters binary")
    merged = partial.repartition("block").sortWithinPartitions("block").mapInArrow(merge_batches, "block long, bits binary")
    bits = np.zeros(len(ROWS) * width // 8, dtype=np.uint8)
    for r in merged.toLocalIterator():
        got = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
        bits[r["block"] // 8 : r["block"] // 8 + len(got)] = got
    return bits


def may_repeat(h: np.ndarray, bits: np.ndarray, width: int) -> np.ndarray:
    keep = np.ones(len(h), dtype=bool)
    for row in range(len(ROWS)):
        place = places(h, row, width) + row * width
        keep &= (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)
    return keep


# runs


def row_width(size: int) -> int:
    """Bytes of a suffix as it is sorted: its bytes, those before it from the nearest on, zeros, and how many there are of either."""
    return -(-(2 * size - size // 2 + 2) // 8) * 8


def suffix_rows(data: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, size: int) -> np.ndarray:
    """Suffixes at anchors, one a row: equal rows are equal in all windows of the anchor."""
    before = size - size // 2
    out = np.zeros((len(at), row_width(size)), dtype=np.uint8)
    place = at[:, None] + np.arange(size)
    out[:, :size] = np.where(place < last[:, None] + size, data[place], 0)
    place = at[:, None] - 1 - np.arange(before)
    out[:, size : size + before] = np.where(place >= first[:, None], data[np.maximum(place, 0)], 0)
    out[:, -2], out[:, -1] = at - first, at - last
    return out


def words(rows: np.ndarray) -> list[np.ndarray]:
    """Rows as numbers of 8 bytes, the last first, as lexsort wants them."""
    return [w.astype(np.uint64) for w in np.ascontiguousarray(rows).view(">u8").T[::-1]]


def shared_with_previous(rows: np.ndarray) -> np.ndarray:
    """How many bytes each row shares with the one before it; 0 for the first."""
    differ = rows[1:] != rows[:-1]
    n = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.concatenate([[0], n]).astype(np.int64)[: len(rows)]


def packed(*columns: np.ndarray) -> bytes:
    """Numbers byte by byte, as like bytes compress well."""
    import pyarrow as pa

    raw = b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(blob: bytes, n: int, kinds: list) -> list[np.ndarray]:
    import pyarrow as pa

    raw, at, out = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True), 0, []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).reshape(-1))
        at += n * size
    return out


PLACED = [np.int64, np.int32, np.int64]  # doc, id32, first window start
COVERED = [np.int64, np.int32, np.int64, np.int64]  # doc, id32, window start, windows in a row
RUNS = "part long, n long, shared binary, rest binary, entries binary"


def front_coded(rows: np.ndarray, part: int, *placed: np.ndarray) -> dict:
    """A sorted run for one range: what each row shares with its predecessor, and the rest of it."""
    shared = shared_with_previous(rows)
    rest = rows[np.arange(rows.shape[1]) >= shared[:, None]]
    return {"part": part, "n": len(rows), "shared": packed(shared.astype(np.uint16)), "rest": packed(rest), "entries": packed(*placed)}


def joined_stretches(doc: np.ndarray, ident: np.ndarray, start: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Window starts of a document that lie side by side as one stretch."""
    order = np.lexsort((start, ident, doc))
    doc, ident, start, n = doc[order], ident[order], start[order], n[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (ident[1:] != ident[:-1]) | (start[1:] != start[:-1] + n[:-1])])
    first = np.flatnonzero(new)
    return [doc[first], ident[first], start[first], np.add.reduceat(n, first)]


def sorted_first(rows: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by row and document, and which, in that order, come after an equal row of an earlier document."""
    order = np.lexsort([doc, *words(rows)])
    by_row, by_doc = rows[order], doc[order]
    new = np.concatenate([[True], (by_row[1:] != by_row[:-1]).any(axis=1)])
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order, by_doc != by_doc[head]


def windows_of(rows: np.ndarray, size: int, doc: np.ndarray, ident: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each window of the anchors in rows as a row of its own, with its document and place."""
    before, found = size - size // 2, []
    ahead, behind = rows[:, -2].astype(np.int64), rows[:, -1].astype(np.int64)
    for o in range(before + 1):
        mine = (behind <= o) & (o <= ahead)
        out = np.zeros((int(mine.sum()), rows.shape[1]), dtype=np.uint8)
        out[:, :o] = rows[mine, size : size + o][:, ::-1]
        out[:, o:size] = rows[mine, : size - o]
        found.append((out, doc[mine], ident[mine], start[mine] + ahead[mine] - o))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def cut_run(rows, doc, ident, start, size: int, splitters: list[bytes], n_parts: int) -> Iterator[dict]:
    """A run, sorted, in its ranges: parts up to n_parts are ranges of suffixes, up to twice that windows of hot anchors by hash, beyond that what is covered."""
    gram, sure_part = size // 2, 2 * n_parts + int(doc[0]) % n_parts

    def covered(doc, ident, start, n):
        stretch = joined_stretches(doc, ident, start, n)
        return {"part": sure_part, "n": len(stretch[0]), "shared": b"", "rest": b"", "entries": packed(*stretch)}

    order, sure = sorted_first(rows, doc)
    rows, doc, ident, start = rows[order], doc[order], ident[order], start[order]
    if sure.any():
        yield covered(doc[sure], ident[sure], start[sure], rows[sure, -2].astype(np.int64) - rows[sure, -1] + 1)
        rows, doc, ident, start = rows[~sure], doc[~sure], ident[~sure], start[~sure]
    at = lambda key: bisect.bisect_left(range(len(rows)), key, key=lambda i: rows[i].tobytes())
    hot = np.zeros(len(rows), dtype=bool)
    for head in sorted({s[:gram] for s in splitters}):
        hot[at(head) : at(head + b"\xff" * (rows.shape[1] - gram + 1))] = True
    bounds = [0, *(at(s) for s in splitters), len(rows)]
    for part, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
        mine = lo + np.flatnonzero(~hot[lo:hi])
        if len(mine):
            yield front_coded(rows[mine], part, doc[mine], ident[mine], start[mine])
    hot_rows = np.flatnonzero(hot)
    for first in range(0, len(hot_rows), RUN // 16):
        mine = hot_rows[first : first + RUN // 16]
        window, w_doc, w_ident, w_start = windows_of(rows[mine], size, doc[mine], ident[mine], start[mine])
        order, sure = sorted_first(window, w_doc)
        if sure.any():
            mine = order[sure]
            yield covered(w_doc[mine], w_ident[mine], w_start[mine], np.ones(len(mine), dtype=np.int64))
        order = order[~sure]
        to = np.zeros(len(order), dtype=np.uint64)
        for w in words(window[order])[::-1]:
            to = mixed(to ^ w)
        to = (to % U(n_parts)).astype(np.int64)
        for part in np.unique(to):
            mine = order[to == part]
            yield front_coded(window[mine], n_parts + int(part), w_doc[mine], w_ident[mine], w_start[mine])


def run_batches(size: int, width: int, bits, splitters, n_parts: int):
    """The front-coded runs of a partition."""

    def emit(batches):
        import pyarrow as pa

        schema = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("shared", pa.binary()), ("rest", pa.binary()), ("entries", pa.binary())])
        held, n = [], 0

        def flush():
            for piece in cut_run(*(np.concatenate(c) for c in zip(*held, strict=True)), size, splitters.value, n_parts):
                yield pa.RecordBatch.from_pylist([piece], schema)

        for batch in batches:
            docs, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "id32"))
            for step in steps(batch.column("text"), size):
                at, first, last, piece, h = anchors(step, size)
                keep = may_repeat(h, bits.value, width)
                at, first, last, piece = at[keep], first[keep], last[keep], piece[keep]
                row = step.rows[piece]
                held.append((suffix_rows(step.data, at, first, last, size), docs[row], ids[row], first - step.at[piece] + step.bases[piece]))
                n += len(at)
                if n >= RUN:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()

    return emit


def sample_batches(size: int, width: int, bits, rate: float):
    """Suffixes of which hash and place draw lots, with their hashes for a stable order."""

    def draw(batches):
        import pyarrow as pa

        for batch in batches:
            for step in steps(batch.column("text"), size):
                at, first, last, _, h = anchors(step, size)
                mine = may_repeat(h, bits.value, width) & (mixed(h ^ first.astype(np.uint64)) < U(min(int(rate * (1 << 64)), (1 << 64) - 1)))
                rows = suffix_rows(step.data, at[mine], first[mine], last[mine], size)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary())], names=["suffix"])

    return draw


# merge


def merged_runs(runs: list[tuple[list[int], bytes]], width: int) -> tuple[list[bytes], list[int], list[int]]:
    """Front-coded sorted runs (shared lengths, rests) as one: the rows in order, what each shares with the one before, and the run it comes from.

    A loser tree.  Each node holds a run whose row lost there and the length that the row shares with the winner.  All
    challengers on a path are compared with what left the tree last: who shares more of it is smaller, without a look
    at the bytes; only equal lengths are compared, from that length on.
    """
    k = len(runs)
    now, shared, taken, rest_at = [b""] * k, [0] * k, [0] * k, [0] * k

    def advance(r: int) -> None:
        lengths, rest = runs[r]
        if taken[r] == len(lengths):
            shared[r] = -1  # an ended run loses against all
            return
        same = lengths[taken[r]]
        end = rest_at[r] + width - same
        now[r] = now[r][:same] + rest[rest_at[r] : end]
        shared[r], rest_at[r] = same, end
        taken[r] += 1

    def beats(r: int, q: int) -> bool:
        """Whether r's row comes before q's; the loser's length becomes that shared with the winner."""
        a, b = shared[r], shared[q]
        if a != b or a < 0:
            return a >= b
        x, y = now[r], now[q]
        if x == y:
            shared[q] = width
            return True
        apart = (int.from_bytes(x[a:], "big") ^ int.from_bytes(y[a:], "big")).bit_length()
        same = width - (apart + 7 >> 3)
        if x[same] < y[same]:
            shared[q] = same
            return True
        shared[r] = same
        return False

    for r in range(k):
        advance(r)
    loser, best = [0] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        left, right = best[2 * node], best[2 * node + 1]
        best[node], loser[node] = (left, right) if beats(left, right) else (right, left)
    winner = best[1] if k > 1 else 0
    keys, lengths, source = [], [], []
    while shared[winner] >= 0:
        keys.append(now[winner])
        lengths.append(shared[winner])
        source.append(winner)
        advance(winner)
        node = winner + k >> 1
        while node:
            other = loser[node]
            a, b = shared[winner], shared[other]
            if b > a or (a == b >= 0 and not beats(winner, other)):
                loser[node], winner = winner, other
            node >>= 1
    return keys, lengths, source


def merged_group(table, width: int) -> tuple[np.ndarray, ...]:
    """The runs of a range, merged: rows, shared lengths, and of each entry doc, id32 and first window start."""
    runs, entries = [], []
    for n, shared, rest, placed in zip(*(table.column(c).to_pylist() for c in ("n", "shared", "rest", "entries")), strict=True):
        lengths = unpacked(shared, n, [np.uint16])[0].astype(np.int64)
        runs.append((lengths.tolist(), unpacked(rest, int((width - lengths).sum()), [np.uint8])[0].tobytes()))
        entries.append(unpacked(placed, n, PLACED))
    keys, lengths, source = merged_runs(runs, width)
    # the entries of a run come in its order
    order = np.empty(len(keys), dtype=np.int64)
    order[np.argsort(np.array(source), kind="stable")] = np.arange(len(keys))
    placed = [np.concatenate(c)[order] for c in zip(*entries, strict=True)]
    return np.frombuffer(b"".join(keys), dtype=np.uint8).reshape(len(keys), width), np.array(lengths), *placed


def covered_by_equals(lengths, width: int, doc) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First entry of each kind of equal rows, each entry's kind, and the kinds' smallest documents."""
    new = lengths < width
    new[0] = True
    first = np.flatnonzero(new)
    return first, np.cumsum(new) - 1, np.minimum.reduceat(doc, first)


def covered_windows(rows: np.ndarray, lengths: np.ndarray, doc: np.ndarray, size: int) -> np.ndarray:
    """Of different sorted suffixes with their smallest documents: whether the window that begins o bytes before each is covered, by o."""
    gram = size // 2
    before = size - gram
    out = np.zeros((len(rows), before + 1), dtype=bool)
    group = np.cumsum(lengths < gram) - (lengths[0] < gram)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    several = np.maximum.reduceat(doc, first) != np.minimum.reduceat(doc, first)
    mine = np.flatnonzero(several[group])
    if not len(mine):
        return out
    rows, lengths, doc = rows[mine], lengths[mine], doc[mine]
    ahead, behind = rows[:, -2], rows[:, -1]
    back = np.zeros((len(rows), -(-before // 8) * 8), dtype=np.uint8)
    back[:, :before] = rows[:, size : size + before]
    order = np.lexsort(words(back))
    shared_back, rank = shared_with_previous(back[order]), np.argsort(order, kind="stable")
    for o in range(before + 1):
        valid = np.flatnonzero((behind <= o) & (o <= ahead))
        if len(valid) < 2:
            continue
        kind = (np.cumsum(lengths < size - o) * (len(rows) + 1) + np.cumsum(shared_back < o)[rank])[valid]
        by = np.lexsort((doc[valid], kind))
        kind, by_doc = kind[by], doc[valid][by]
        head = np.maximum.accumulate(np.where(np.concatenate([[True], kind[1:] != kind[:-1]]), np.arange(len(by)), 0))
        out[mine[valid[by]], o] = by_doc != by_doc[head]
    return out


def covered_group(size: int, n_parts: int):
    """The stretches of window starts that one range, or one part of hot windows, covers."""
    width = row_width(size)

    def cover(table):
        import pyarrow as pa

        part = table.column("part")[0].as_py()
        if part >= 2 * n_parts:
            found = [np.concatenate(c) for c in zip(*(unpacked(e, n, COVERED) for n, e in zip(table.column("n").to_pylist(), table.column("entries").to_pylist(), strict=True)), strict=True)]
        else:
            rows, lengths, doc, ident, start = merged_group(table, width)
            first, kind, least = covered_by_equals(lengths, width, doc)
            later = doc != least[kind]
            if part >= n_parts:  # windows: equal rows are all there is
                found = [doc[later], ident[later], start[later], np.ones(int(later.sum()), dtype=np.int64)]
            else:
                n = rows[:, -2].astype(np.int64) - rows[:, -1] + 1
                hits = covered_windows(rows[first], lengths[first], least, size)
                mine = np.flatnonzero(~later & hits.any(axis=1)[kind])
                edge = np.diff(np.pad(hits[kind[mine]], ((0, 0), (1, 1))).astype(np.int8), axis=1)
                (at, low), (_, high) = np.nonzero(edge == 1), np.nonzero(edge == -1)  # o from low to high - 1
                at = mine[at]
                begin = start[at] + rows[at, -2] - (high - 1)
                found = [np.concatenate(c) for c in zip((doc[later], ident[later], start[later], n[later]), (doc[at], ident[at], begin, high - low), strict=True)]
        return pa.Table.from_arrays([pa.array(c.astype(t)) for c, t in zip(found, COVERED, strict=True)], names=["doc", "id32", "start", "n"])

    return cover


# documents


def kept_batches(size: int, with_text: bool):
    """What each document keeps."""

    def keep(batches):
        import pyarrow as pa

        kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            out: list[tuple] = []
            for doc_id, text, runs in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("runs"), strict=True):
                data = np.frombuffer((text or "").encode(), dtype=np.uint8)
                edge = np.zeros(len(data) + 2, dtype=np.int32)
                if runs.is_valid and len(runs):
                    start, n = (runs.values.field(c).to_numpy(zero_copy_only=False) for c in ("start", "n"))
                    np.add.at(edge, start + 1, 1)
                    np.add.at(edge, start + n + size, -1)
                gone = np.cumsum(edge)[: len(data) + 1] > 0  # one place late
                kept = data[~gone[1:]].tobytes()
                out.append((doc_id, len(data), len(data) - len(kept), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for _, t in kinds], schema=pa.schema(kinds))

    return keep


def covered_stretches(keyed: DataFrame, size: int, max_width: int, range_bytes: int) -> DataFrame:
    """(doc, id32, start, n): n windows of a document in a row, from start on, that also start in earlier documents."""
    if not 16 <= size <= 500:
        raise ValueError("windows have 16 to 500 bytes")
    spark = keyed.sparkSession
    n_bytes = keyed.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    width = sketch_width(n_bytes, max_width)
    bits = spark.sparkContext.broadcast(repeated_bits(keyed, size, width))
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_bytes // range_bytes + 1)
    # documents hold about one anchor in 13 bytes and a third may repeat; texts that draw lots give the splitters
    share = min(1.0, 16 * DRAWS * n_parts / (n_bytes / 40 + 1))
    draws = keyed.select("text").sample(share, seed=7).mapInArrow(sample_batches(size, width, bits, 1 / 8 if share < 1 else min(1.0, 2 * DRAWS * n_parts / (n_bytes / 40 + 1))), "suffix binary")
    drawn = sorted(bytes(r["suffix"]) for r in draws.toLocalIterator())
    splitters = spark.sparkContext.broadcast(sorted({drawn[len(drawn) * i // n_parts] for i in range(1, n_parts)}) if drawn else [])
    runs = keyed.select("doc", "id32", "text").mapInArrow(run_batches(size, width, bits, splitters, n_parts), RUNS)
    return runs.groupBy("part").applyInArrow(covered_group(size, n_parts), "doc long, id32 int, start long, n long")


def kept_documents(docs: DataFrame, size: int, max_width: int, range_bytes: int, with_text: bool) -> DataFrame:
    small_batches(docs.sparkSession)
    keyed = keyed_documents(docs)
    # rows that agree in doc_id and text send the same windows: a place counts once
    runs = covered_stretches(keyed, size, max_width, range_bytes).groupBy("doc", "id32").agg(F.collect_set(F.struct("start", "n")).alias("runs"))
    joined = keyed.join(runs, ["doc", "id32"], "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "runs")
    return joined.mapInArrow(kept_batches(size, with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def dedup_bytes(docs: DataFrame, size: int = 50, max_width: int = 1 << 27, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(doc_id, kept) of every document: the bytes that are left.  They may not be UTF-8, as windows can end within a character."""
    return kept_documents(docs, size, max_width, range_bytes, with_text=True).select("doc_id", "kept")


def dedup(docs: DataFrame, size: int = 50, max_width: int = 1 << 27, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs (doc_id, text)."""
    return kept_documents(docs, size, max_width, range_bytes, with_text=False).drop("kept")


def op13_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS i FROM d WHERE length(x) >= 100)),
f AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM w JOIN f USING (s) WHERE doc_id > least),
h AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM g),
r AS (SELECT doc_id, count(*) AS n, count(*) FILTER (q IS NULL OR q < p - 1) AS spans FROM h GROUP BY doc_id),
k AS (SELECT doc_id, p, substr(x, 2 * p + 1, 2) AS b FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2)) AS p FROM d WHERE doc_id IN (SELECT doc_id FROM r)) ANTI JOIN g USING (doc_id, p)),
t AS (SELECT doc_id, string_agg(b, '' ORDER BY p) AS x FROM k GROUP BY doc_id)
SELECT d.doc_id, (length(d.x) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN r.doc_id IS NULL THEN d.x ELSE coalesce(t.x, '') END)) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN t USING (doc_id)
"""
