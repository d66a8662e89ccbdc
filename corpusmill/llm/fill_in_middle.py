"""Fill-in-the-middle: texts cut into prefix, middle and suffix, and put in another order.

The kernel works on the UTF-8 bytes of a whole Arrow batch at once.  A table gives each byte its class; a second one tells of
two neighbouring classes whether a unit begins between them; running sums of these marks, reset at each document, number
the units; searchsorted finds in the sums the bytes where all rows' cuts fall.  Cuts fall between units: characters (code
points), words (a word with the white space after it) or lines.

`restore` rebuilds the texts from outputs and forms alone.

Defined results: a null text is empty; an empty text and one that holds a marker stay plain, as outputs couldn't be taken apart;
null doc_ids draw alike; each row is on its own, so repeated rows give repeated results; a text is never cut
short (a batch is worked off in steps of about STEP bytes, a longer text is a step of its own, at about 6 bytes of memory a
byte); an empty table gives an empty result; extra columns are kept out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

STEP = 8 << 20
#: Classes of bytes.
CONTINUES, BLANK, BREAK, OTHER = range(4)
CLASS = np.full(256, OTHER, dtype=np.uint8)
CLASS[0x80:0xC0] = CONTINUES
CLASS[[0x09, 0x0B, 0x0C, 0x0D, 0x20]] = BLANK
CLASS[0x0A] = BREAK


def begins(rule) -> np.ndarray:
    """Whether a unit begins between two classes, at 4 * first + second."""
    return np.array([rule(a, b) for a in range(4) for b in range(4)])


UNITS = {
    "characters": begins(lambda a, b: b != CONTINUES),
    "words": begins(lambda a, b: a in (BLANK, BREAK) and b == OTHER),
    "lines": begins(lambda a, b: a == BREAK),
}
FORMS = ["plain", "psm", "spm"]
#: By form the order of the parts 0 (prefix), 1 (middle) and 2 (suffix).
ORDER = {"psm": (0, 2, 1), "spm": (2, 0, 1)}


class Texts:
    """The bytes of some rows of an Arrow column of strings, without a copy, and where each row begins and ends."""

    def __init__(self, column) -> None:
        kind = np.int64 if "large" in str(column.type) else np.int32
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, dtype=kind, count=column.offset + len(column) + 1)[column.offset :].astype(np.int64)
        whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
        self.data, self.start, self.end = whole[at[0] : at[-1]], at[:-1] - at[0], at[1:] - at[0]


def steps(batch, name: str) -> Iterator[tuple]:
    """A batch in slices of about STEP bytes of the column `name`, with its Texts; nulls are empty."""
    import pyarrow.compute as pc

    column = pc.fill_null(batch.column(name), "")
    size = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < batch.num_rows:
        done = size[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(size, done + STEP, side="right")))
        yield batch.slice(first, last - first), Texts(column.slice(first, last - first))
        first = last


def unit_sums(texts: Texts, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Up to each byte, how many units have begun (over all rows); how many each row has."""
    kind = CLASS[texts.data]
    mark = np.empty(len(kind), dtype=bool)
    mark[1:] = UNITS[unit][kind[:-1] * np.uint8(4) + kind[1:]]
    filled = texts.end > texts.start
    mark[texts.start[filled]] = True  # a document's first byte begins a unit whatever stands before it
    sums = np.cumsum(mark, dtype=np.int32 if len(mark) < 1 << 31 else np.int64)
    count = np.zeros(len(texts.start), dtype=np.int64)
    count[filled] = sums[texts.end[filled] - 1] - sums[texts.start[filled]] + 1
    return sums, count


def cut_bytes(texts: Texts, sums: np.ndarray, count: np.ndarray, units: np.ndarray) -> np.ndarray:
    """For each row the byte where so many of its units end."""
    out = texts.end.copy()
    within = np.flatnonzero(units < count)
    goal = sums[texts.start[within]].astype(np.int64) + units[within]
    out[within] = np.searchsorted(sums, goal, side="left")
    return out


def marker_places(texts: Texts, marker: str) -> tuple[np.ndarray, np.ndarray]:
    """Where the marker stands, and in which row."""
    sign = marker.encode()
    n = max(0, len(texts.data) - len(sign) + 1)
    at = np.flatnonzero(texts.data[:n] == sign[0])
    for i, b in enumerate(sign[1:], 1):
        at = at[texts.data[at + i] == b]
    row = np.searchsorted(texts.end, at, side="right")
    inside = at + len(sign) <= texts.end[row]
    return at[inside], row[inside]


def joined(texts: Texts, pieces: list[list]) -> tuple[bytes, np.ndarray]:
    """Rows put together from pieces, each bytes or (start, end) in the texts; and where the rows begin and end."""
    view = memoryview(np.ascontiguousarray(texts.data))
    parts = [[p if isinstance(p, bytes) else view[p[0] : p[1]] for p in row] for row in pieces]
    size = [sum(map(len, row)) for row in parts]
    return b"".join(p for row in parts for p in row), np.concatenate([[0], np.cumsum(size, dtype=np.int64)])


def strings(data: bytes, at: np.ndarray):
    import pyarrow as pa

    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(data))


OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def cut_batches(unit: str, markers: tuple[str, str, str], percent: int, spm_percent: int):
    signs = [m.encode() for m in markers]

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            for rows, texts in steps(batch, "text"):
                h = [rows.column(f"h{i}").to_numpy(zero_copy_only=False) for i in (1, 2, 3, 4)]
                sums, count = unit_sums(texts, unit)
                one, two = h[0] % (count + 1), h[1] % (count + 1)
                low, high = np.minimum(one, two), np.maximum(one, two)
                plain = (texts.end == texts.start) | (h[2] % 100 >= percent)
                for m in markers:
                    plain[marker_places(texts, m)[1]] = True
                first, second = cut_bytes(texts, sums, count, low), cut_bytes(texts, sums, count, high)
                form = np.where(plain, 0, np.where(h[3] % 100 < spm_percent, 2, 1))
                pieces = []
                for f, a, b, c, d in zip(form.tolist(), texts.start.tolist(), first.tolist(), second.tolist(), texts.end.tolist(), strict=True):
                    part = [(a, b), (b, c), (c, d)]
                    pieces.append([(a, d)] if not f else [x for k in ORDER[FORMS[f]] for x in (signs[(0, 2, 1)[k]], part[k])])
                data, at = joined(texts, pieces)
                names = pa.array(FORMS).take(pa.array(form))
                columns = [rows.column("doc_id"), pa.array(count), names, pa.array(low, mask=plain), pa.array(high - low, mask=plain), strings(data, at).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return cut


def restored_texts(rows, texts: Texts, markers: tuple[str, str, str]) -> tuple[bytes, np.ndarray]:
    """The texts that outputs were made from, of all rows of a step together."""
    form = rows.column("form").to_pylist()
    place = np.zeros((3, len(form)), dtype=np.int64)
    sign = [len(m.encode()) for m in markers]
    for k, m in enumerate(markers):
        at, row = marker_places(texts, m)
        place[k, row] = at
    pieces = []
    for i, (f, a, d) in enumerate(zip(form, texts.start.tolist(), texts.end.tolist(), strict=True)):
        if f == "plain":
            pieces.append([(a, d)])
            continue
        p, s, m = place[:, i].tolist()
        begin = (p + sign[0], m + sign[2], s + sign[1])  # of prefix, middle and suffix
        end = (s, d, m) if f == "psm" else (m, d, p)
        pieces.append(list(zip(begin, end, strict=True)))
    return joined(texts, pieces)


def restore_batches(markers: tuple[str, str, str]):
    def rebuild(batches):
        import pyarrow as pa

        for batch in batches:
            for rows, texts in steps(batch, "output"):
                yield rows.append_column("text", strings(*restored_texts(rows, texts, markers)).cast(pa.string()))

    return rebuild


def digest_batches(markers: tuple[str, str, str]):
    """Hashes in place of outputs: of each, and of the text rebuilt from it."""

    def digest(batches):
        import pyarrow as pa

        sha = lambda data, start, end: pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(start.tolist(), end.tolist(), strict=True)], pa.string())
        for batch in batches:
            for rows, texts in steps(batch, "output"):
                data, at = restored_texts(rows, texts, markers)
                hashes = [sha(memoryview(np.ascontiguousarray(texts.data)), texts.start, texts.end), sha(memoryview(data), at[:-1], at[1:])]
                kept = [rows.column(c) for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars")]
                yield pa.RecordBatch.from_arrays([*kept, *hashes], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"])

    return digest


def draw(doc_id: Column, seed: int, which: int) -> Column:
    """The 32-bit number that a document draws: the eight hex digits at `which` of a hash of seed and doc_id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(name, 256), 8 * which - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, unit: str = "characters", percent: int = 90, spm_percent: int = 20, markers: tuple[str, str, str] = ("<P>", "<S>", "<M>"), seed: int = 1) -> DataFrame:
    """doc_id, n (units of the text), form, prefix_chars, middle_chars (in units, null if plain) and output of every row of docs (doc_id, text).

    `percent` of the documents are cut, `spm_percent` of these with the suffix first.  markers stand before prefix, suffix and middle.
    """
    if unit not in UNITS:
        raise ValueError(f"unit is one of {', '.join(UNITS)}")
    within = any(a != b and a in b for a in markers for b in markers)
    if len(set(markers)) < 3 or not all(markers) or within or any(b.startswith(a[i:]) for a in markers for b in markers for i in range(1, len(a))):
        raise ValueError("markers are three texts that don't overlap, each other or themselves")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[draw(F.col("doc_id"), seed, i).alias(f"h{i}") for i in (1, 2, 3, 4)])
    return rows.mapInArrow(cut_batches(unit, markers, percent, spm_percent), OUT)


def restore(outputs: DataFrame, markers: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> DataFrame:
    """fill_in_middle's rows with the text that each output was made from."""
    return outputs.mapInArrow(restore_batches(markers), T.StructType([*outputs.schema.fields, T.StructField("text", T.StringType())]))


def digests(outputs: DataFrame, markers: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> DataFrame:
    """fill_in_middle's rows with hashes of the outputs and of the restored texts in place of the outputs."""
    return outputs.mapInArrow(digest_batches(markers), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    return digests(fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet")))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS s FROM documents),
h AS (SELECT *, ('0x' || s[1:8])::BIGINT % (n + 1) AS a, ('0x' || s[9:16])::BIGINT % (n + 1) AS b, ('0x' || s[17:24])::BIGINT % 100 AS c, ('0x' || s[25:32])::BIGINT % 100 AS e FROM d),
f AS (SELECT *, least(a, b) AS lo, greatest(a, b) AS hi, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN e < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, lo) AS x, substr(t, lo + 1, hi - lo) AS y, substr(t, hi + 1) AS z FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN lo::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN (hi - lo)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
