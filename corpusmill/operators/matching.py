"""Names of a table found in texts: many patterns at once by an automaton, equal names by a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of one automaton (about 100 bytes a character in each task); a larger table is searched for in blocks.
BLOCK_NAMES = 1 << 17
#: Names that count only if equal; the length under which a name must be half of the text that holds it.
EXACT_NAME = r"^[0-9a-zA-Z., ]+$"
SHORT = 3


def contained_in(texts: DataFrame, block: list[tuple[int, str]]) -> DataFrame:
    """(id, place) of texts (id, text): the smallest place of the block's names (place, name) that a text holds."""
    names = texts.sparkSession.sparkContext.broadcast(block)

    def search(batches):
        import ahocorasick
        import pyarrow as pa

        automaton = ahocorasick.Automaton()
        for place, name in names.value:
            if name not in automaton:
                automaton.add_word(name, (place, len(name)))
        automaton.make_automaton()
        for batch in batches:
            ids, places = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                found = [place for _, (place, n) in automaton.iter(text or "") if n >= SHORT or len(text) < 2 * n]
                if found:
                    ids.append(i)
                    places.append(min(found))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(ids, pa.int64())), pa.array(places, pa.int64())], names=["id", "place"])

    schema = f"id {dict(texts.dtypes)['id']}, place long"
    return texts.select("id", "text").mapInArrow(search, schema)


def first_name(texts: DataFrame, names: DataFrame, block_names: int = BLOCK_NAMES) -> DataFrame:
    """texts (id, text) with the place of the first name (place, name) that each equals or holds; null for none.

    A name in ASCII letters, digits, points and blanks must equal the text; any other must lie in it, and if it has under three characters
    be more than half of it.  Blank names match nothing.  Of equal names the smallest place counts.
    """
    known = names.select(F.col("place").cast("long").alias("place"), "name").filter(F.trim("name") != "").groupBy("name").agg(F.min("place").alias("place"))
    exact = known.filter(F.col("name").rlike(EXACT_NAME))
    found = texts.join(exact, texts["text"] == exact["name"]).select("id", "place")
    other = known.filter(~F.col("name").rlike(EXACT_NAME))
    n_blocks = -(-other.count() // block_names)
    for b in range(n_blocks):
        mine = other.filter(F.pmod(F.xxhash64("name"), F.lit(n_blocks)) == b)
        found = found.unionByName(contained_in(texts, [(r["place"], r["name"]) for r in mine.toLocalIterator()]))
    first = found.groupBy("id").agg(F.min("place").alias("place"))
    return texts.join(first, "id", "left")
