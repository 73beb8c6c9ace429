"""Small string and number helpers that the other functions share."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def strip(c: Column) -> Column:
    """Without leading and trailing Unicode white space (plain trim drops spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return c.isNull() | (strip(c) == "")


def words(c: Column) -> Column:
    """Space-separated words; none for the empty string."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def round3(c: Column) -> Column:
    """Three decimals, halves up, in binary arithmetic: floor(1000 x + 0.5) / 1000."""
    return F.floor(c.cast("double") * 1000.0 + 0.5) / 1000.0


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strings(values) -> Column:
    """A literal array of strings."""
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays of distinct strings; two empty ones are equal."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / F.greatest(union, F.lit(1)))


def truncated(c: Column, n: int) -> Column:
    """The first n UTF-16 units, as storage counts characters; half of a pair at the end goes too."""
    raw = F.encode(c, "UTF-16BE")
    high = F.hex(F.substring(raw, 2 * n - 1, 1)).between("D8", "DB")
    cut = F.decode(F.substring(raw, F.lit(1), F.when(high, F.lit(2 * n - 2)).otherwise(F.lit(2 * n))), "UTF-16BE")
    return F.when(F.length(c) * 2 <= n, c).when(F.octet_length(raw) <= 2 * n, c).otherwise(cut)


def snippet(c: Column, n: int = 280) -> Column:
    """White space collapsed, at most n characters and then three dots."""
    flat = strip(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("..."))).otherwise(flat)
