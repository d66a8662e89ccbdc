"""WARC archives: a writer through Spark's text sink and a salvage reader.

A record is a version line, named fields, an empty line, the payload, and two line ends.  Payloads
are UTF-8 text, so a whole archive is text and Spark's own writer lays it out: no task opens a
file.  Archives hold at most `ARCHIVE_BYTES` of payload, or one larger record.  The reader takes whole archives as
binary, checks each record (version line, length, the
two line ends, digest), and after a failed check searches for the next place that reads as a
record: a version line, or a gzip member that inflates to one.  A member may hold several records, up to a whole archive packed in
one piece; what it inflates to is read in the same way.  Where a record's head can be read but its
payload fails a check, what lies within the stated length belongs to that record: places in there count only
if the length itself is wrong, that is, if no record follows where it ends.  The bytes between are reported as a
quarantined gap; records after the gap are recovered.

Defined results: a null html is an empty payload; a null url is written as an empty target; a
null page_id is written as an empty id and read as null; rows that agree in page_id and payload
are written once each, under record ids of their own; a payload of any length is one record, up to the 2 GB that
a row of Spark holds; an empty table gives no archive and an empty result; extra columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, new_path, stored

VERSION = "WARC/1.1"
#: Fixed values of the record format.
START = re.compile(rb"WARC/1\.[01]\r\n")
GZIP = b"\x1f\x8b\x08"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes of one archive, and the payload up to which records share one.
ARCHIVE_BYTES = 1 << 26
SHARED_BYTES = 1 << 16
#: Bytes of a gzip member that one step inflates.
FEED = 1 << 16
FIRST_FEED = 1 << 12
#: A record's head is no longer than this.
HEAD_BYTES = 1 << 16
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Repeated digests up to this many (about 60 bytes and an address each) are broadcast, more are joined by a shuffle.
MAX_BROADCAST_DIGESTS = 500_000
RECORDS = "archive string, offset long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload string, gap_bytes long, gap_reason string"


def base32_sha1(payload: Column) -> Column:
    """The payload's SHA-1 in base 32: each five bytes are eight digits of five bits."""
    digest = F.sha1(payload)
    digits = []
    for i in range(4):
        group = F.conv(F.substring(digest, 10 * i + 1, 10), 16, 10).cast("long")
        for j in range(8):
            digits.append(F.substring(F.lit(ALPHABET), (F.shiftright(group, 35 - 5 * j).bitwiseAND(31) + 1).cast("int"), F.lit(1)))
    return F.concat(*digits)


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) as payload, payload_bytes, payload_digest, record_type, refers_to, refers_to_url.

    Only digests that occur twice or more are joined back; of those the smallest page_id is the response, and of its records that of the first url is referred to.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    out = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    out = out.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", base32_sha1(F.col("payload").cast("binary")))
    groups = out.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))["url"].alias("first_url"), F.count(F.lit(1)).alias("n"))
    repeated = bounded_broadcast(stored(groups.filter("n > 1").select("payload_digest", "first_id", "first_url"), "warc-repeated"), MAX_BROADCAST_DIGESTS)
    out = out.join(repeated, "payload_digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("payload_bytes") >= least_bytes)
    return out.withColumn("record_type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))).withColumn("refers_to", F.when(revisit, F.col("first_id"))).withColumn("refers_to_url", F.when(revisit, F.col("first_url"))).drop("first_id", "first_url")


def record_id(page_id: Column, digest: Column, url: Column) -> Column:
    """A URN that names the page and, as page_ids may repeat, what was found there."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), F.substring(F.sha2(F.concat_ws(" ", url, digest), 256), 1, 16), F.lit(">"))


def record_text(payload: str = "payload", date: str = "1970-01-01T00:00:00Z") -> Column:
    """A whole record, but for its last line feed, which the text sink adds; date is that of the crawl."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    # equal payloads have equal digests, so the response's id follows from the revisit
    refers = record_id(F.col("refers_to"), F.col("payload_digest"), F.coalesce("refers_to_url", F.lit("")))
    address = line("WARC-Refers-To-Target-URI", F.translate(F.coalesce("refers_to_url", F.lit("")), "\r\n", ""))
    revisit = F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", refers), address)
    return F.concat(
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", record_id(F.col("page_id"), F.col("payload_digest"), F.col("url"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.translate("url", "\r\n", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(F.col("record_type") == "revisit", revisit).otherwise(F.lit("")),
        line("Content-Length", F.col("payload_bytes").cast("string")),
        F.lit("\r\n"),
        F.col(payload),
        F.lit("\r\n\r"),
    )


def write_archives(records: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes the records of with_revisits as archives of at most ARCHIVE_BYTES of payload each, or one larger record.

    Records are written by size class, each four times the one before, as an archive takes as many as its class allows; only a class that occurs is
    written.  Payloads up to SHARED_BYTES, which most are, are one class.
    """
    size = F.greatest(F.ceil(F.log2(F.col("payload_bytes") / SHARED_BYTES) / 2), F.lit(0)).cast("int")
    size = F.when(F.col("payload_bytes") <= SHARED_BYTES, 0).otherwise(size)
    classes = sorted(r["c"] for r in records.groupBy(size.alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()) or [0]
    for c in classes:
        some = records.filter(size == c) if len(classes) > 1 else records
        most = max(1, ARCHIVE_BYTES // (SHARED_BYTES * 4**c))
        some.select(record_text(date=date).alias("value")).write.mode("append").option("maxRecordsPerFile", most).option("lineSep", "\n").text(path)


def gzip_member(record: bytes) -> bytes:
    """One record as a gzip member of its own, as compressed archives hold it."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def read_record(data: bytes, at: int) -> tuple[dict | None, int, str]:
    """The record at a place of plain archive bytes, where it ends, and what is wrong with it.

    For a record whose head is sound but whose payload isn't, the end is where its stated length would end it.
    """
    if not START.match(data, at):
        return None, at, "no version line"
    # a head is short; a far away end of one belongs to another record
    end = data.find(b"\r\n\r\n", at, at + HEAD_BYTES)
    if end < 0:
        return None, at, "cut head"
    fields = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None, at, "bad field"
        fields[name.decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch("[0-9]{1,18}", fields.get("content-length", "")):
        return None, at, "no length"
    start = end + 4
    stop = start + int(fields["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        return None, min(stop, len(data)), "wrong length"
    payload = data[start:stop]
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if fields.get("warc-payload-digest", f"sha1:{digest}") != f"sha1:{digest}":
        return None, stop + 4, "wrong digest"
    return fields | {"payload": payload, "digest": digest}, stop + 4, ""


def inflate(data: bytes, at: int) -> tuple[bytes | None, int]:
    """The gzip member at a place and where it ends; None and how far it could be inflated if it's damaged."""
    unpacker, out, view, to = zlib.decompressobj(31), [], memoryview(data), at
    try:
        while not unpacker.eof and to < len(data):
            feed = FIRST_FEED if to == at else FEED
            out.append(unpacker.decompress(view[to : to + feed]))
            to = min(to + feed, len(data))
            if not unpacker.eof and not any(out):
                return None, to  # still in a head, which is no head then
    except zlib.error:
        return None, to
    return (b"".join(out), to - len(unpacker.unused_data)) if unpacker.eof else (None, len(data))


def member(data: bytes, at: int) -> tuple[list[tuple[dict | None, int, str]], int, str]:
    """What a gzip member at a place holds, records and gaps of plain bytes, and where the member ends; nothing if no record can be read in it."""
    plain, end = inflate(data, at)
    if plain is None:
        return [], at, "damaged member"
    record, inner, why = read_record(plain, 0)
    if record is not None and inner == len(plain):
        return [(record, 0, "")], end, ""
    # an archive that was packed in one piece, or several records to a member
    found = [(r, gap, reason) for _, r, gap, reason in salvage(plain)]
    return (found, end, "") if any(r is not None for r, _, _ in found) else ([], end, why)


def salvage(data: bytes) -> Iterator[tuple[int, dict | None, int, str]]:
    """(offset, record or None, bytes of a gap, its reason) through an archive, plain or of gzip members.

    Records and gaps within a member have the member's offset; bytes of such a gap are those inflated.
    """
    at, seen = 0, Places(data)
    while at < len(data):
        if data.startswith(GZIP, at):
            found, end, why = member(data, at)
        else:
            record, end, why = read_record(data, at)
            found = [(record, 0, "")] if record is not None else []
        for record, gap, reason in found:
            yield at, record, gap, reason
        if not found:
            # a sound head gives the place of the next record; if there is none, its length is wrong
            end = end if end > at and (end == len(data) and why != "wrong length" or starts(data, end)) else next_start(data, at + 1, seen)
            yield at, None, end - at, why
        at = end


def starts(data: bytes, at: int) -> bool:
    """Whether a record or a member begins at a place."""
    return bool(START.match(data, at)) or (data.startswith(GZIP, at) and bool(member(data, at)[0]))


class Places:
    """Version lines and gzip marks of an archive, each looked for once: a place found ahead is kept until it's behind."""

    def __init__(self, data: bytes) -> None:
        self.data, self.line, self.pack = data, -1, -1

    def after(self, at: int) -> tuple[int, int]:
        """The next version line and the next gzip mark from a place on; the end of the archive for none."""
        end = len(self.data)
        if self.line < at:
            found = START.search(self.data, at)
            self.line = found.start() if found else end
        if self.pack < at:
            found = self.data.find(GZIP, at)
            self.pack = found if found >= 0 else end
        return self.line, self.pack


def next_start(data: bytes, at: int, seen: Places) -> int:
    """The first place from `at` on where a record can be read whole, or the end."""
    while True:
        line, pack = seen.after(at)
        place = min(line, pack)
        if place == len(data):
            return place
        if member(data, place)[0] if place == pack else read_record(data, place)[0] is not None:
            return place
        at = place + 1


def page_number(text: str | None) -> int | None:
    digits = re.search(r"page:(-?\d+)[:>]", text or "")
    return int(digits[1]) if digits else None


def read_batches(batches, with_payload: bool):
    import pyarrow as pa

    kinds = [("archive", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.string()), ("gap_bytes", pa.int64()), ("gap_reason", pa.string())]
    schema = pa.schema(kinds)
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            rows = []
            for offset, r, gap, why in salvage(content.as_py()):
                if r is None:
                    rows.append((path.as_py(), offset, None, None, None, None, None, None, None, gap, why))
                else:
                    text = r["payload"].decode("utf-8", "replace") if with_payload else None
                    rows.append((path.as_py(), offset, page_number(r.get("warc-record-id")), r.get("warc-target-uri"), r.get("warc-type"), page_number(r.get("warc-refers-to")), len(r["payload"]), r["digest"], text, 0, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for _, t in kinds], schema=schema)


def read_archives(spark, path: str, with_payload: bool = True) -> DataFrame:
    """A row for each record, and for each quarantined gap one with record_type null, gap_bytes and gap_reason."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(lambda batches: read_batches(batches, with_payload), RECORDS)


def quarantine(records: DataFrame) -> DataFrame:
    """The log of gaps: archive, offset, bytes and the check that failed."""
    return records.filter("record_type is null").select("archive", "offset", "gap_bytes", "gap_reason")


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """Archives of all pages, read back.  Archives just written have no gap: one would be a fault and ends the query with its place."""
    path = new_path(spark, "warc")
    write_archives(with_revisits(spark.read.parquet(f"{sf_dir}/pages.parquet")), path)
    records = read_archives(spark, path, with_payload=False)
    gap = F.raise_error(F.concat(F.lit("gap in "), "archive", F.lit(" at "), F.col("offset").cast("string"), F.lit(": "), "gap_reason"))
    kind = F.when(F.col("record_type").isNull(), gap).otherwise(F.col("record_type"))
    return records.select("page_id", "payload_bytes", "payload_digest", kind.alias("record_type"), "refers_to")


OP6_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, h, array_to_string(list_transform(range(32), lambda k: substr('{ALPHABET}', (((('0x' || substr(h, 10 * (k // 8) + 1, 10))::BIGINT >> (35 - 5 * (k % 8)))) & 31) + 1, 1)), '') AS payload_digest FROM p),
f AS (SELECT h, min(page_id) AS first_id, count(*) AS n FROM d GROUP BY h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to FROM d JOIN f USING (h)
"""
