"""Column macros over text: tokens, signatures, similarities, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def word_set(text: Column) -> Column:
    return F.array_distinct(words(text))


def nonspace(text: Column) -> Column:
    """Runs without white space (of any script)."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))


def signature(text: Column) -> Column:
    """SHA-256 of the lower-case text with single spaces."""
    return F.sha2(F.lower(F.array_join(nonspace(text), " ")), 256)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def dot(a: Column, b: Column) -> Column:
    """Up to the shorter vector's end."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 for an empty or zero vector; a and b are arrays of doubles."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def l2_normalize(a: Column) -> Column:
    """A zero vector stays as it is."""
    once = F.array(norm(a))  # an expression of the inner function's would be evaluated for every element
    return F.get(F.transform(once, lambda n: F.when(n == 0, a).otherwise(F.transform(a, lambda x: x / n))), F.lit(0))


def count_matching(text: Column, char_class: str) -> Column:
    """Characters of a class, e.g. ``\\p{L}``."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{char_class}]", ""))


def safe_identifier(text: Column) -> Column:
    """Lower case, runs of other characters than letters and digits as one underscore."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, "[^a-zA-Z0-9]+", "_"), "^_+|_+$", ""))


def truncate_words(text: Column, limit: int) -> Column:
    return F.array_join(F.slice(nonspace(text), 1, limit), " ")


def slug(text: Column) -> Column:
    """Anchor of a heading: lower case, hyphens for the rest, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
