"""Text functions: stripping, tokens, sentences, citation marks, references, names, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Runs of Unicode white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normal_echo(c: Column) -> Column:
    """Collapsed and lower-cased, to tell whether a sub-query only repeats its question."""
    return F.lower(collapse(c))


def tokens(c: Column) -> Column:
    """Lower-case ASCII words (letters, digits, underscore); empty for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0))


def sentences(c: Column) -> Column:
    """Parts after `.`, `!` or `?` and white space, stripped, without empty ones."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])(?U:\s+)"), strip), lambda x: x != "")


def inline_citations(c: Column) -> Column:
    """Distinct labels of `[d1]` marks, by number."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(r"\[(d\d+)\]"), F.lit(1)))
    return F.transform(F.array_sort(F.transform(found, lambda x: F.struct(F.length(x).alias("n"), x.alias("x")))), lambda s: s["x"])


def has_citation_mark(c: Column) -> Column:
    return c.rlike(r"\[d\d+\]")


def content_hash(c: Column) -> Column:
    """The document id of a content."""
    return F.sha2(c, 256)


def key_id(c: Column) -> Column:
    """A short, non-reversible name of an API key."""
    return F.substring(F.sha2(c, 256), 1, 12)


def chunk_key(document_id: Column, strategy: Column, index: Column) -> Column:
    """A chunk's id, the same on every run; order chunks by document and index, not by it."""
    return F.sha2(F.concat_ws("|", document_id, strategy, index.cast("string")), 256)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    return F.regexp_extract(F.lower(basename(path)), r"(\.[^.]+)$", 1)


def approximate_tokens(c: Column) -> Column:
    """Characters by four, rounded down."""
    return F.floor(F.length(c) / 4)


def find(haystack: Column, needle: Column) -> Column:
    """Zero-based place of the first occurrence, -1 if there is none."""
    return F.position(needle, haystack) - 1


def shown(c: Column, signed: bool = False) -> Column:
    """A number with three decimals for tables; `-` for null."""
    return F.when(c.isNull(), "-").otherwise(F.format_string("%+.3f" if signed else "%.3f", c))
