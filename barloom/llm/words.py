"""Column expressions on words, all inside Spark's own operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"


def whole(text: Column) -> Column:
    """The text, empty for null."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs outside ``[\\x20\\x09-\\x0D]``; none for an empty text."""
    return F.array_remove(F.split(text, "[ \\t-\\r]+", -1), "")


def after(items: Column, n: int) -> Column:
    """The array without its first n items."""
    return F.slice(items, n + 1, F.size(items))


def barrier(value: Column) -> Column:
    """The same value, but filters on it stay above it.

    The optimizer would otherwise copy the costly array expressions into the filter.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, lengthened until no column in ``taken`` has them (case aside)."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out
