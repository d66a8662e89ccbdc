"""Streaming jobs: ingestion of files into a chunk table, windowed event counts with late data, stateful stream cleaning and loop detection."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.sinks import upsert


def ingest(spark: SparkSession, source: str, schema: str, table: str, checkpoint: str, cancelled: DataFrame | None = None):
    """Files that arrive below a path go into the chunk table; a batch that is replayed after a failure changes nothing."""

    def batch(rows: DataFrame, _: int) -> None:
        rows = rows.join(cancelled, "document_id", "left_anti") if cancelled is not None else rows
        upsert(rows.sparkSession, rows, table)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by kind and window of event time; rows later than the watermark are dropped."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user that a gap closes."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def over_limit(events: DataFrame, limit: int, length: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """Keys that go over a limit in a window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select("user_id", F.col("w.start").alias("start"), "n")


TAGS = ("think", "memory-context", "documents")


def scrub(piece: str, held: str, inside: str) -> tuple[str, str, str]:
    """What of a stream's next piece may be shown, what is held back as it may be part of a tag, and the hidden block that is open."""
    text, shown = held + piece, ""
    while text:
        if inside:
            end = f"</{inside}>"
            at = text.find(end)
            if at < 0:
                return shown, text[-(len(end) - 1) :], inside
            text, inside = text[at + len(end) :], ""
            continue
        at = text.find("<")
        if at < 0:
            return shown + text, "", ""
        shown, text = shown + text[:at], text[at:]
        opened = next((t for t in TAGS if text.startswith(f"<{t}>")), None)
        if opened:
            text, inside = text[len(opened) + 2 :], opened
        elif any(f"<{t}>".startswith(text) for t in TAGS):
            return shown, text, ""
        else:
            shown, text = shown + "<", text[1:]
    return shown, "", inside


def scrubbed_stream(pieces: DataFrame) -> DataFrame:
    """(stream_id, seq, shown) of (stream_id, seq, piece): hidden blocks go, even where a tag is cut in two."""
    import pandas as pd

    def fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, inside = state.get if state.exists else ("", "")
        rows = pd.concat(list(batches)).sort_values("seq")
        shown = []
        for piece in rows["piece"]:
            out, held, inside = scrub(piece or "", held, inside)
            shown.append(out)
        state.update((held, inside))
        yield pd.DataFrame({"stream_id": key[0], "seq": rows["seq"].to_numpy(), "shown": shown})

    return pieces.groupBy("stream_id").applyInPandasWithState(fold, "stream_id long, seq long, shown string", "held string, inside string", "append", GroupStateTimeout.NoTimeout)


def loop_stream(calls: DataFrame, warn: int = 3, stop: int = 5, window: int = 20) -> DataFrame:
    """(run_id, seq, n_same, verdict) of (run_id, seq, signature): state is a run's last `window` calls and the signatures warned of."""
    import pandas as pd

    def fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, warned = (list(state.get[0]), set(state.get[1])) if state.exists else ([], set())
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, signature in zip(rows["seq"], rows["signature"], strict=True):
            last = [*last, signature][-window:]
            n = last.count(signature)
            verdict = "stop" if n >= stop else "warning" if n >= warn and signature not in warned else None
            warned |= {signature} if n >= warn else set()
            out.append((key[0], seq, n, verdict))
        state.update((last, sorted(warned)))
        yield pd.DataFrame(out, columns=["run_id", "seq", "n_same", "verdict"])

    return calls.groupBy("run_id").applyInPandasWithState(fold, "run_id long, seq long, n_same int, verdict string", "last array<string>, warned array<string>", "append", GroupStateTimeout.NoTimeout)
