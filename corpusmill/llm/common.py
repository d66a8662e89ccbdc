"""Helpers shared by the operators: words, stored intermediate tables, checked broadcasts."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import drop_stored, new_path, shared_dir, small_batches, stored  # noqa: F401

#: ASCII white space; everything else belongs to a word.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows, else df as it is, to be joined by a shuffle.

    max_rows times the width of a row, which the caller knows, is the proven bound.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def words(text: Column) -> Column:
    """The words of a whole text, unchanged, as an array; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names made from the stems that clash with none of df's, in any letter case."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name = f"_{stem}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
