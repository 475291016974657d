"""Text expressions: native columns, with Python's notion of white space, words and digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What str.split() breaks on; \s alone lacks the four separators U+001C to U+001F.
BLANK = r"(?U)[\s\x1c-\x1f]+"


def tokens(text: Column) -> Column:
    """Lower-case white-space tokens; null for null."""
    return F.filter(F.split(F.lower(text), BLANK), lambda x: x != "")


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w+\b"), F.lit(0))


def normalize(text: Column) -> Column:
    """Lower case, white space squeezed to one space, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(text), BLANK, " "))


def shingles(text: Column, size: int = 3) -> Column:
    """Distinct character n-grams; a text shorter than size is its own only one, "" as well."""
    length = F.length(text)
    grams = F.transform(F.sequence(F.lit(1), length - (size - 1)), lambda i: F.substring(text, i, F.lit(size)))
    return F.when(length < size, F.array(text)).otherwise(F.array_distinct(grams))


def jaccard(left: Column, right: Column) -> Column:
    """Of two arrays of distinct values; 0 if either is empty."""
    both = F.size(F.array_intersect(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), 0.0).otherwise(both / (F.size(left) + F.size(right) - both))


def trigrams(text: Column) -> Column:
    """Distinct lower-case trigrams, none for a text of under three characters."""
    return F.when(F.length(text) < 3, F.array().cast("array<string>")).otherwise(shingles(F.lower(text)))


def ngrams(items: Column, size: int) -> Column:
    """Consecutive runs of size array elements, joined by a space; empty if there are fewer."""
    starts = F.sequence(F.lit(1), F.size(items) - (size - 1))
    runs = F.transform(starts, lambda i: F.array_join(F.slice(items, i, F.lit(size)), " "))
    return F.when(F.size(items) < size, F.array().cast("array<string>")).otherwise(runs)


def clean_response(reply: Column) -> Column:
    """A model's reply without thinking tags, text from the first special token on, or a code fence.

    A fence without a line end leaves "" where a row-wise implementation would fail.
    """
    out = reply
    for tag in ("think", "reasoning"):
        out = F.regexp_replace(out, f"(?s)<{tag}>.*?</{tag}>", "")
    out = _strip(F.regexp_replace(out, r"(?s)<\|[^>]+\|>.*", ""))
    body = F.regexp_replace(out, r"^[^\n]*(\n|$)", "")
    body = F.regexp_replace(body, r"(?s)```(?!.*```).*", "")
    return F.when(F.startswith(out, F.lit("```")), _strip(body)).otherwise(out)


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
