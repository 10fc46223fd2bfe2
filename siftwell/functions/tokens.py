"""Column functions on token arrays and text templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Size of the character vocabulary: newline and the printable ASCII characters. The next id ends a document.
CHARS, END = 96, 96


def char_ids(text: Column) -> Column:
    """Newline is 0, a printable ASCII character its code less 31; others are dropped."""
    kept = F.regexp_replace(text, r"[^\n -~]", "")
    return F.transform(F.filter(F.split(kept, ""), lambda c: c != ""), lambda c: F.when(c == "\n", 0).otherwise(F.ascii(c) - 31))


def n_char_ids(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\n -~]", "")).cast("bigint")


def with_end(ids: Column, end: int = END, most: int | None = None) -> Column:
    """Ids cut to ``most``, then the end id."""
    return F.concat(ids if most is None else F.slice(ids, 1, most), F.array(F.lit(end)))


def padded_length(n: Column, multiple: int) -> Column:
    """Length after at least one end id is added to reach a multiple."""
    return (F.ceil((n + 1) / multiple) * multiple).cast("bigint")


def pad_to_multiple(ids: Column, multiple: int, end: int = END) -> Column:
    n = F.size(ids)
    return F.concat(ids, F.array_repeat(F.lit(end), (padded_length(n, multiple) - n).cast("int")))


def with_bounds(ids: Column, begin: int, end: int) -> Column:
    """Begin and end ids, each only where the array doesn't have it already."""
    first = F.when(F.element_at(ids, 1) == begin, ids).otherwise(F.concat(F.array(F.lit(begin)), ids))
    return F.when(F.element_at(first, -1) == end, first).otherwise(F.concat(first, F.array(F.lit(end))))


def checksum(ids: Column) -> Column:
    """Sum of ids times their places, from 1."""
    return F.aggregate(F.zip_with(ids, F.sequence(F.lit(1), F.size(ids)), lambda a, b: a.cast("bigint") * b), F.lit(0).cast("bigint"), lambda s, x: s + x)


def option_map(text: Column) -> Column:
    """``a ) x , b ) y`` as a map from the first letter of each part to what follows its last bracket."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p))
    return F.map_from_entries(F.transform(parts, lambda p: F.struct(F.substring(p, 1, 1), F.trim(F.substring_index(p, ")", -1)))))


def domain_file(name: Column) -> Column:
    """A domain's file name: slash to hyphen, space to underscore, brackets dropped."""
    return F.translate(name, "/ ()", "-_")
